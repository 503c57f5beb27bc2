"""Officers and insiders linked to their companies, and the jobs that follow an import in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rollcall.functions import names, vectors
from rollcall.operators import canonicalize, fk, jobs
from rollcall.schema import DEFAULT_ORGANIZATION_TYPE, PEOPLE_TYPES, SOURCE_TYPES
from rollcall.stage import staged

SOURCE_IDS = {name: i for i, name in SOURCE_TYPES.items()}


def _primary(orgs: DataFrame, source: str) -> DataFrame:
    """``source_identifier, __org``: the first primary organisation of a source's identifier."""
    own = orgs.where((F.col("source_id") == SOURCE_IDS[source]) & F.col("alias_source_id").isNull() & F.col("source_identifier").isNotNull())
    return own.groupBy("source_identifier").agg(F.min("id").alias("__org"))


def _linked(people: DataFrame, key: Column, orgs: DataFrame, keep_old: bool) -> DataFrame:
    """``people`` with the organisation that ``key`` identifies as ``known_for_org_id``; people without a key or a match keep theirs."""
    lookup = orgs.select(F.col("source_identifier").alias("__id"), "__org")
    joined = people.withColumn("__key", F.nullif(key, F.lit(""))).join(lookup, F.col("__key") == F.col("__id"), "left")
    both = (F.col("known_for_org_id"), F.col("__org")) if keep_old else (F.col("__org"), F.col("known_for_org_id"))
    return joined.withColumn("known_for_org_id", F.coalesce(*both)).select(*people.columns)


def link_issuers(people: DataFrame, orgs: DataFrame) -> DataFrame:
    """Insiders with the issuer of their record, by its zero-filled number, as their organisation; other people as they are.

    A match replaces an older link, as a later filing does.
    """
    issuer = F.nullif(F.get_json_object("record", "$.issuer_cik"), F.lit(""))
    key = F.when(F.col("source_id") == SOURCE_IDS["sec_edgar"], names.zero_filled(issuer))
    return _linked(people, key, _primary(orgs, "sec_edgar"), keep_old=False)


def link_officers(people: DataFrame, orgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Organisations with a stub for each company that only officers' records name, and people with open links filled.

    Only officers without an organisation count.  A stub has the least name that the records give, an unknown
    type and its normalised name; companies that are there get no stub.  An officer whose record has no number stays open.
    """
    source = SOURCE_IDS["companies_house"]
    number, named = F.get_json_object("record", "$.company_number"), F.coalesce(F.get_json_object("record", "$.company_name"), F.lit(""))
    own = (F.col("source_id") == source) & F.col("known_for_org_id").isNull()
    stubs = fk.stub_organizations(orgs, people.where(own), number, named, source)
    stubs = stubs.withColumns({"name_normalized": names.normalize_company(F.col("name")), "entity_type_id": F.lit(DEFAULT_ORGANIZATION_TYPE).cast("long")})
    everything = staged(orgs.unionByName(stubs.select([c for c in stubs.columns if c in orgs.columns]), allowMissingColumns=True), "linked-orgs")
    return everything, _linked(people, F.when(own, number), _primary(everything, "companies_house"), keep_old=True)


def post_import(orgs: DataFrame, people: DataFrame, embedder: vectors.Embedder, dims: int = vectors.SEGMENT) -> dict[str, DataFrame]:
    """The jobs after an import, in their order: names normalised, links filled, records canonicalised, aliases made, indexes built.

    Tables are those of the schema; ``people`` has ``role_name`` and ``org_name`` as well, which describe a person.  Gives
    ``organizations``, ``people``, ``organization_index``, ``composite_index`` and ``identity_index``.
    """
    orgs, people = jobs.normalize_organizations(orgs), jobs.normalize_people(people)
    orgs, people = link_officers(link_issuers(people, orgs), orgs)
    told = orgs.withColumns({"source": _named("source_id", SOURCE_TYPES), "region": F.col("region_id").cast("string")})
    primary = canonicalize.canonicalize_organizations(told)
    aliases = told.where("alias_source_id IS NOT NULL")
    made = staged(jobs.populate_aliases(primary.unionByName(aliases, allowMissingColumns=True)), "post-orgs")
    told = people.withColumns({"source": _named("source_id", SOURCE_TYPES), "person_type": F.coalesce(_named("person_type_id", PEOPLE_TYPES), F.lit("unknown"))})
    persons = staged(canonicalize.canonicalize_people(told), "post-people")
    composite, identity = jobs.build_people_index(persons, embedder, dims)
    return {"organizations": made, "people": persons, "organization_index": jobs.build_organization_index(made, embedder), "composite_index": composite, "identity_index": identity}


def _named(column: str, values: dict[int, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(column).cast("int"))
