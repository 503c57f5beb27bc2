"""Lookups: organisations, people, roles, locations, regions, and resolution to ids.

Each takes frames and gives a frame of matches; no index or model is kept in the module.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.functions import names, vectors
from rollcall.operators import vector_search

ALIAS_SCORE, SHORT_QUERY = 0.95, 3
ALIAS_CANDIDATES, NAME_LIMIT, ALTERNATIVES = 10, 500, 5
PERSON_HIGH, PERSON_LOW = 0.95, 0.80
RESOLVER_SCORE, RESOLVER_CANDIDATES = 0.7, 5


def role_search(roles: DataFrame, query: str, k: int = 10) -> DataFrame:
    """An exact role alone with score 1, or else the shortest roles that contain the query."""
    text = query.strip().lower()
    rows = roles.where(F.contains(F.lower("name"), F.lit(text)) | (F.col("name_normalized") == text))
    ranked = rows.withColumns({"exact": (F.col("name_normalized") == text).cast("int"), "score": names.like_score(F.col("name"), F.lit(text))})
    first = Window.orderBy(F.col("exact").desc(), F.length("name"), "id")
    best = ranked.orderBy(F.col("exact").desc(), F.length("name"), "id").limit(k).withColumn("rank", F.row_number().over(first)).withColumn("any_exact", F.max("exact").over(Window.partitionBy()))
    kept = best.where("any_exact = 0 OR rank = 1").withColumn("score", F.when(F.col("exact") == 1, 1.0).otherwise(F.col("score")))
    return kept.drop("exact", "any_exact")


def location_search(locations: DataFrame, types: DataFrame, query: str, k: int = 10, simplified_type: str | None = None) -> DataFrame:
    """The shortest locations that contain the query, of one simplified type if given; an unknown type gives nothing."""
    text = query.strip().lower()
    rows = locations.where(F.contains(F.lower("name"), F.lit(text)))
    if simplified_type is not None:
        wanted = types.where(F.col("simplified") == simplified_type).select(F.col("id").alias("location_type_id"))
        rows = rows.join(F.broadcast(wanted), "location_type_id", "left_semi")
    return rows.orderBy(F.length("name"), "id").limit(k).withColumn("score", names.like_score(F.col("name"), F.lit(text)))


def name_lookup(orgs: DataFrame, queries: DataFrame, embedder: vectors.Embedder | None = None, aliases_only: bool = False, single_only: bool = False) -> DataFrame:
    """Exact names to their canonical record: ``qid, canon_id, canon_name, canon_size, score``.

    ``queries`` has ``qid, query``.  Of several groups the one with the best blend of name
    similarity and popularity wins, or without an embedder the largest.
    """
    named = orgs.where("alias_source_id IS NOT NULL") if aliases_only else orgs
    hits = queries.join(named.select(F.col("name").alias("query"), "canon_id"), "query").select("qid", "query", "canon_id").distinct()
    heads = orgs.select(F.col("id").alias("canon_id"), F.col("name").alias("canon_name"), "canon_size")
    order = Window.partitionBy("qid").orderBy(F.col("canon_size").desc(), "canon_id")
    found = hits.join(heads, "canon_id").withColumns({"nth": F.row_number().over(order), "of": F.count(F.lit(1)).over(Window.partitionBy("qid"))})
    if single_only:
        found = found.where("of = 1")
    found = found.where(F.col("nth") <= ALIAS_CANDIDATES)
    if embedder is None:
        best = found.where("nth = 1")
    else:
        texts = vectors.embedded_distinct(found, ["query", "canon_name"], embedder)
        similarity = vectors.cosine(F.col("query_vector"), F.col("canon_name_vector"))
        blended = texts.withColumn("blend", vectors.org_blend(similarity, F.col("canon_name"), F.col("query"), F.col("canon_size")))
        top = Window.partitionBy("qid").orderBy(F.col("blend").desc(), "nth")
        best = blended.withColumn("best", F.row_number().over(top)).where("best = 1")
    return best.select("qid", "canon_id", "canon_name", "canon_size", F.lit(1.0).alias("score"))


def merged(by_name: DataFrame, by_vector: DataFrame, k: int) -> DataFrame:
    """Name matches first, then vector matches of other groups: ``qid, canon_id, score, tier, rank``."""
    both = by_name.select("qid", "canon_id", "score", F.lit(0).alias("tier")).unionByName(by_vector.select("qid", "canon_id", "score", F.lit(1).alias("tier")))
    once = Window.partitionBy("qid", "canon_id").orderBy("tier", F.col("score").desc())
    rows = both.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")
    order = Window.partitionBy("qid").orderBy("tier", F.col("score").desc(), "canon_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _near(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The nearest canonical groups of each query ``(qid, q)``, by slices of queries."""
    return vector_search.search_groups(index, queries, "canon_id", k)


def organization_search(index: DataFrame, orgs: DataFrame, queries: DataFrame, k: int = 20, source: str | None = None, embedder: vectors.Embedder | None = None) -> DataFrame:
    """Vector matches by canonical group, with exact aliases first where they are needed.

    ``queries`` has ``qid, query, q`` (quantised).  ``index`` has ``id, v, vv, canon_id, source``.
    Short queries look at all exact names; longer ones only at unambiguous aliases, and only
    where the best vector match falls short.
    """
    where = None if source is None else F.col("source") == ("wikidata" if source == "wikipedia" else source)
    rows = index if where is None else index.where(where)
    found = _near(rows, queries.select("qid", "q"), k)
    short = F.length(F.trim("query")) <= SHORT_QUERY
    weak = found.where(F.col("rank") == 1).where(F.col("score") < ALIAS_SCORE).select("qid")
    by_name = name_lookup(orgs, queries.where(short).select("qid", "query"), embedder).unionByName(
        name_lookup(orgs, queries.where(~short).join(weak, "qid", "left_semi").select("qid", "query"), embedder, aliases_only=True, single_only=True)
    )
    return merged(by_name, found, k)


def resolve_organizations(matches: DataFrame, orgs: DataFrame, least: float = RESOLVER_SCORE, k: int = RESOLVER_CANDIDATES) -> DataFrame:
    """Matches good enough, with resolved ids and confidence; queries without any are absent."""
    heads = orgs.select(F.col("id").alias("canon_id"), F.col("name").alias("canonical_name"), "source", "source_identifier")
    kept = matches.where((F.col("score") >= least) & (F.col("rank") <= k)).join(heads, "canon_id")
    return kept.select(
        "qid", "rank", "canonical_name", names.resolved_id(F.col("source"), F.col("source_identifier")).alias("canonical_id"), names.confidence(F.col("score")).alias("confidence")
    )


def person_name_lookup(people: DataFrame, queries: DataFrame) -> DataFrame:
    """People of the query's normalised name, one row for each canonical group with its most telling member."""
    wanted = queries.select("qid", "query", names.normalize_person(F.col("query")).alias("name_normalized")).where("name_normalized <> ''")
    order = Window.partitionBy("qid").orderBy(F.col("canon_size").desc(), "id")
    known = people.select("id", "name_normalized", "canon_id", "canon_size", "known_for_role_id", "known_for_org_id")
    hits = wanted.join(known, "name_normalized").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= NAME_LIMIT)
    told = F.when(F.col("known_for_role_id").isNotNull(), 1).otherwise(0) + F.when(F.col("known_for_org_id").isNotNull(), 1).otherwise(0)
    best = Window.partitionBy("qid", "canon_id").orderBy(told.desc(), "nth")
    chosen = hits.withColumn("__best", F.row_number().over(best)).where("__best = 1")
    return chosen.select("qid", "query", F.coalesce("canon_id", "id").alias("canon_id"), F.col("id").alias("matched_id"))


def disambiguated(candidates: DataFrame, people: DataFrame, embedder: vectors.Embedder) -> DataFrame:
    """Candidates ``qid, query, description, canon_id`` ranked by the blend of description, name and popularity.

    A candidate's description is the best of its canonical record's and up to five others of its group.
    """
    described = people.select(
        F.col("id"), F.coalesce("canon_id", "id").alias("canon_id"), "name", "canon_size", "known_for_role_id", "known_for_org_id",
        names.describe_person(F.col("name"), F.col("person_type"), F.col("role_name"), F.col("org_name"), labels_without_role=False).alias("text"),
    )
    own = described.where("id = canon_id").select("canon_id", "text", F.lit(0).alias("alt"))
    pair = Window.partitionBy("canon_id", "known_for_role_id", "known_for_org_id").orderBy("id")
    order = Window.partitionBy("canon_id").orderBy(F.when(F.col("known_for_org_id").isNotNull(), 0).otherwise(1), "id")
    others = described.where("known_for_role_id IS NOT NULL").withColumn("nth", F.row_number().over(pair)).where("nth = 1").withColumn("alt", F.row_number().over(order))
    texts = own.unionByName(others.where(F.col("alt") <= ALTERNATIVES).select("canon_id", "text", "alt"))
    rows = vectors.embedded_distinct(candidates.join(texts, "canon_id"), ["description", "text"], embedder)
    similarity = rows.withColumn("sim", vectors.cosine(F.col("description_vector"), F.col("text_vector")))
    best = similarity.groupBy("qid", "query", "canon_id").agg(F.max("sim").alias("sim"), F.max_by("text", "sim").alias("matched_text"))
    heads = described.where("id = canon_id").select("canon_id", "name", "canon_size")
    blend = vectors.person_blend(F.col("sim"), names.levenshtein_ratio(F.col("query"), F.col("name")), F.col("canon_size"))
    ranked = best.join(heads, "canon_id").withColumn("score", blend)
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "canon_id")))


def person_search(composite: DataFrame, identity: DataFrame | None, people: DataFrame, queries: DataFrame, k: int = 20, embedder: vectors.Embedder | None = None) -> DataFrame:
    """People for each query ``(qid, query, description, q, iq)``, with the tier that found them.

    A composite match above 0.95 settles a query.  The others take people of the same
    normalised name, or without any those of the nearest names, ranked by description; only
    without those do weaker composite matches count.
    """
    near = _near(composite, queries.select("qid", "q"), k)
    high = near.where((F.col("rank") == 1) & (F.col("score") > PERSON_HIGH)).select("qid")
    settled = near.join(high, "qid", "left_semi").select("qid", "canon_id", "score", "rank", F.lit("composite").alias("lookup_method"))
    open_queries = queries.join(high, "qid", "left_anti")
    by_name = person_name_lookup(people, open_queries.select("qid", "query"))
    named = by_name.select("qid").distinct()
    rest = open_queries.join(named, "qid", "left_anti")
    candidates = by_name.select("qid", "canon_id", F.lit("name").alias("lookup_method"))
    if identity is not None and embedder is not None:
        close = _near(identity, rest.select("qid", F.col("iq").alias("q")), k)
        candidates = candidates.unionByName(close.select("qid", "canon_id", F.lit("identity").alias("lookup_method")))
    if embedder is not None:
        ranked = disambiguated(candidates.join(open_queries.select("qid", "query", "description"), "qid").drop("lookup_method"), people, embedder)
    else:
        heads = people.where("id = coalesce(canon_id, id)").select(F.col("id").alias("canon_id"), "name")
        rows = candidates.join(open_queries.select("qid", "query"), "qid").join(heads, "canon_id")
        likeness = names.levenshtein_ratio(F.col("query"), F.col("name"))
        ranked = rows.withColumn("score", F.lit(1.0)).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(likeness.desc(), "canon_id"))).drop("lookup_method")
    found = ranked.join(candidates.select("qid", "canon_id", "lookup_method"), ["qid", "canon_id"]).where(F.col("rank") <= k)
    found = found.select("qid", "canon_id", "score", "rank", "lookup_method")
    left = near.join(high, "qid", "left_anti").join(found.select("qid").distinct(), "qid", "left_anti")
    return settled.unionByName(found).unionByName(left.select("qid", "canon_id", "score", "rank", F.lit("composite").alias("lookup_method")))


def same_name(table: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows whose name equals the query's text without regard to case: ``qid`` and the row's columns.  Null equals nothing."""
    asked = queries.select("qid", F.lower("query").alias("__query"))
    return table.join(asked, F.lower("name") == F.col("__query")).drop("__query")


def resolve_regions(texts: DataFrame, column: str, locations: DataFrame, table: DataFrame) -> DataFrame:
    """Each text with the id of the location it names: by its own normal form, or by the country it normalises to."""
    own = locations.groupBy(F.col("name_normalized").alias("__name")).agg(F.min("id").alias("__by_name"))
    code = locations.where("location_type_id BETWEEN 2 AND 4").groupBy(F.lower("source_identifier").alias("__code")).agg(F.min("id").alias("__by_code"))
    keyed = texts.withColumn("__key", F.lower(F.trim(F.col(column))))
    named = keyed.join(table.select(F.col("key").alias("__key"), F.lower("code").alias("__iso")), "__key", "left")
    found = named.join(own, F.col("__key") == F.col("__name"), "left").join(code, F.col("__iso") == F.col("__code"), "left")
    return found.withColumn("location_id", F.coalesce("__by_name", "__by_code")).drop("__key", "__iso", "__name", "__by_name", "__code", "__by_code")


def by_source(orgs: DataFrame, source_id: Column, identifier: Column) -> DataFrame:
    """Primary rows of one source's identifier."""
    return orgs.where("alias_source_id IS NULL").where((F.col("source_id") == source_id) & (F.col("source_identifier") == identifier))
