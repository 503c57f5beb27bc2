"""Graph patterns over the dump's claims as a table of triples: what the query service's templates ask, as data.

A pattern says which claims an item must have, by value, by one of several values, or by a
value below a class; which claims of others must point to it; and which of its claims are given, where there are any.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rollcall.sources import wikidata
from rollcall.stage import staged

INSTANCE, SUBCLASS, HUMAN = "P31", "P279", "Q5"


@dataclass(frozen=True)
class Claim:
    """Items with a claim of ``prop``.

    ``value`` restricts it to one value, ``or_instance`` also to values that are instances of it, ``below`` to values
    that are subclasses of it at any depth.  ``inward`` takes the items that others' claims have as their value.
    """

    prop: str
    value: str | None = None
    or_instance: bool = False
    below: bool = False
    inward: bool = False


@dataclass(frozen=True)
class Pattern:
    claims: tuple[Claim, ...]
    optional: dict[str, str] = field(default_factory=dict)
    article: bool = False
    described: bool = False


# Properties and classes that the templates name.
_COMPANY = {"lei": "P1278", "ticker": "P249", "country": "P17", "inception": "P571", "dissolution": "P576"}
_LISTED = {"ticker": "P249", "exchange": "P414", "country": "P17", "inception": "P571", "dissolution": "P576"}
ORGANIZATION_PATTERNS = {
    "lei": Pattern((Claim("P1278"),), _COMPANY),
    "ticker": Pattern((Claim("P414"),), _LISTED),
    "public_company": Pattern((Claim(INSTANCE, "Q891723"),), _COMPANY),
    "business": Pattern((Claim(INSTANCE, "Q4830453"),), _COMPANY),
    "organization": Pattern((Claim(INSTANCE, "Q43229"),), _COMPANY),
    "nonprofit": Pattern((Claim(INSTANCE, "Q163740"),), _COMPANY),
    "gov_agency": Pattern((Claim(INSTANCE, "Q327333"),), _COMPANY),
    "enterprise": Pattern((Claim(INSTANCE, "Q6881511"),), _COMPANY),
}


def position_pattern(role: str) -> Pattern:
    """People who held a position that is the role, or an instance of it."""
    return Pattern((Claim(INSTANCE, HUMAN), Claim("P39", role, or_instance=True)), {"country": "P27"}, article=True, described=True)


def occupation_pattern(occupation: str, below: bool = False) -> Pattern:
    """People of an occupation, or with ``below`` of one of its subclasses."""
    return Pattern((Claim(INSTANCE, HUMAN), Claim("P106", occupation, below=below)), {"country": "P27"}, article=True, described=True)


def founder_pattern() -> Pattern:
    """People whom an organisation has as its founder."""
    return Pattern((Claim(INSTANCE, HUMAN), Claim("P112", inward=True)), {"country": "P27"}, article=True, described=True)


def triples(entities: DataFrame) -> DataFrame:
    """``subject, prop, value`` of all claims as a stage table: ids of items, times as dates, else the text as it is."""
    claim = F.explode("all").alias("c")
    flat = entities.select("id", F.explode("claims").alias("prop", "all")).select(F.col("id").alias("subject"), "prop", claim)
    raw = F.col("c.mainsnak.datavalue.value")
    time = F.substring_index(F.regexp_replace(F.get_json_object(raw, "$.time"), r"^\+", ""), "T", 1)
    value = F.when(F.startswith(raw, F.lit("{")), F.coalesce(F.get_json_object(raw, "$.id"), time, F.get_json_object(raw, "$.text"))).otherwise(raw)
    return staged(flat.select("subject", "prop", value.alias("value")).where("value IS NOT NULL"), "triples")


def subclasses(facts: DataFrame, root: str) -> DataFrame:
    """``value``: a class and all classes below it, at any depth."""
    edges = facts.where(F.col("prop") == SUBCLASS).select(F.col("subject").alias("child"), F.col("value").alias("parent"))
    classes = facts.sparkSession.createDataFrame([(root, "organization", root)], "qid string, kind string, type string")
    return wikidata.closure(edges, classes).select(F.col("qid").alias("value")).distinct()


def _subjects(facts: DataFrame, claim: Claim) -> DataFrame:
    """``subject``: the items that have a claim, each once."""
    own = facts.where(F.col("prop") == claim.prop)
    end: Column = F.col("value") if claim.inward else F.col("subject")
    if claim.value is None:
        kept = own
    elif claim.below:
        kept = own.join(subclasses(facts, claim.value), "value", "left_semi")
    elif claim.or_instance:
        instances = facts.where((F.col("prop") == INSTANCE) & (F.col("value") == claim.value)).select(F.col("subject").alias("value"))
        itself = facts.sparkSession.createDataFrame([(claim.value,)], "value string")
        kept = own.join(instances.union(itself).distinct(), "value", "left_semi")
    else:
        kept = own.where(F.col("value") == claim.value)
    return kept.select(end.alias("subject")).distinct()


def matches(facts: DataFrame, entities: DataFrame, pattern: Pattern) -> DataFrame:
    """``id, label``, the optional columns and, if asked for, ``description`` of the items that fit, one row for each.

    Of several values of an optional claim the least is given, and for one that is an item its
    label, else its id, in ``<column>_label``.  An item without any label has its id.  With ``article`` only
    items with an English article count.
    """
    found = reduce(lambda x, y: x.join(y, "subject", "left_semi"), [_subjects(facts, c) for c in pattern.claims])
    named = entities.select("id", wikidata.label().alias("label"), F.try_element_at("descriptions", F.lit("en"))["value"].alias("description"), F.map_contains_key("sitelinks", F.lit("enwiki")).alias("__article"))
    rows = found.join(named, F.col("subject") == F.col("id"))
    if pattern.article:
        rows = rows.where("__article")
    if pattern.optional:
        props = {p: c for c, p in pattern.optional.items()}
        wanted = facts.where(F.col("prop").isin(*props)).join(found, "subject", "left_semi")
        values = wanted.groupBy("subject").agg(*[F.min(F.when(F.col("prop") == p, F.col("value"))).alias(c) for p, c in props.items()])
        rows = rows.join(values, "subject", "left")
    out = [F.col("id"), F.coalesce("label", "id").alias("label"), *pattern.optional]
    for column in ("country", "exchange"):
        if column in pattern.optional:
            own = entities.select(F.col("id").alias(f"__{column}"), wikidata.label().alias(f"__{column}_label"))
            rows = rows.join(own, F.col(column) == F.col(f"__{column}"), "left")
            out.append(F.coalesce(f"__{column}_label", column).alias(f"{column}_label"))
    return rows.select(*out, *(["description"] if pattern.described else []))


def page(rows: DataFrame, after: str | None, n: int) -> DataFrame:
    """The next ``n`` rows by id after the last one of the page before; unlike an offset it reads no row twice."""
    return (rows if after is None else rows.where(F.col("id") > after)).orderBy("id").limit(n)
