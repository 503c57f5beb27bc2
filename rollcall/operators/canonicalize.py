"""Linking of equivalent records and the choice of a representative.

Records that share a key are linked to the key's smallest id, so a key held by n records
gives n - 1 edges; the closure is the components of all edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rollcall.functions import dates
from rollcall.functions.names import zero_filled
from rollcall.operators.components import connected_components
from rollcall.operators.ordered import running

# Which source represents a group.
ORG_PRIORITY = {"gleif": 1, "sec_edgar": 2, "companies_house": 3, "wikidata": 4, "wikipedia": 4}
PERSON_PRIORITY = {"wikidata": 1, "sec_edgar": 2, "companies_house": 3}
LOWEST_PRIORITY = 99


def key_edges(rows: DataFrame, id_col: str, *keys: list[Column]) -> DataFrame:
    """Star edges: every row that has a key, to the smallest id that has it.

    A key is a list of columns, none of which is null in a row that has it.  All kinds of keys go through one scan and one
    grouped minimum.
    """
    parts = [F.when(F.forall(parts, lambda x: x.isNotNull()), F.struct(F.lit(i).alias("kind"), parts.alias("parts"))) for i, parts in enumerate(F.array(*[c.cast("string") for c in key]) for key in keys)]
    keyed = rows.select(F.col(id_col).alias("dst"), F.explode(F.array_compact(F.array(*parts))).alias("key"))
    least = keyed.groupBy("key").agg(F.min("dst").alias("src"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(least, "key").where("src <> dst").select("src", "dst")


def priority(source: Column, order: dict[str, int]) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    return F.coalesce(F.element_at(ranks, source), F.lit(LOWEST_PRIORITY))


def _text(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def organization_edges(orgs: DataFrame) -> DataFrame:
    """Edges of primary records by legal-entity id, ticker, CIK, and normalised name with region.

    ``orgs`` has ``id, source, source_identifier, name_normalized, region, record``.
    """
    lei = F.when(F.col("source") == "gleif", F.col("source_identifier")).otherwise(F.get_json_object("record", "$.lei"))
    cik = F.when(F.col("source") == "sec_edgar", F.col("source_identifier")).otherwise(F.get_json_object("record", "$.cik"))
    name = F.when(_text(F.col("name_normalized")).isNotNull(), F.col("name_normalized"))
    ticker = F.get_json_object("record", "$.ticker")
    return key_edges(orgs, "id", [name, F.coalesce("region", F.lit(""))], [F.upper(_text(lei))], [F.upper(_text(ticker))], [zero_filled(_text(cik))])


def overlap_edges(people: DataFrame) -> DataFrame:
    """Edges between people of one normalised name whose periods overlap.

    In the order of their starts, a period that begins no later than the latest end before
    it overlaps some earlier one, so it belongs to the same island as the row before.  One
    sorted pass replaces the pairwise comparison and gives the same closure; a name that many
    share is passed in ranges, with the latest end carried from each to the next.
    """
    rows = people.where("coalesce(name_normalized, '') <> '' AND coalesce(from_date, '') <> ''").select(
        "id", "name_normalized", "from_date", dates.end_or_open(F.col("to_date")).alias("until")
    ).where("from_date <= until")
    linked = running(rows, ["name_normalized"], ["from_date", "id"], {"before": ("last", "id"), "latest": ("max", "until")})
    return linked.where("from_date <= latest").select(F.col("before").alias("src"), F.col("id").alias("dst"))


def _person_keys() -> list[list[Column]]:
    """The entity id, and the normalised name with the organisation."""
    return [[F.col("qid")], [F.when(_text(F.col("name_normalized")).isNotNull(), F.col("name_normalized")), F.col("known_for_org_id")]]


def person_edges(people: DataFrame) -> DataFrame:
    """Edges by entity id, by normalised name with organisation, and by name with overlapping periods."""
    return key_edges(people, "id", *_person_keys()).union(overlap_edges(people))


def person_merges(people: DataFrame) -> DataFrame:
    """``kind, merges``: by entity id and by name with organisation the rows beyond each key's first, by date the groups that fall together beyond those.

    The number by date is the drop in the number of components, so it doesn't depend on an order.
    """
    joined = lambda labels: labels.agg(F.count_if(F.col("id") != F.col("component")).alias("merges"))  # noqa: E731  components fewer than vertices
    keys = _person_keys()
    keyed = connected_components(key_edges(people, "id", *keys))
    signed = joined(connected_components(person_edges(people))).unionAll(joined(keyed).select(-F.col("merges")))
    every = lambda key: F.when(reduce(lambda x, y: x & y, (c.isNotNull() for c in key)), F.struct(*key))
    by_key = [match_counts(people, every(key)).select(F.lit(kind).alias("kind"), F.col("matches").alias("merges")) for kind, key in zip(("qid", "org"), keys)]
    return by_key[0].unionAll(by_key[1]).unionAll(signed.agg(F.sum("merges").alias("merges")).select(F.lit("date").alias("kind"), "merges"))


def grouped(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with ``component``, their own id where nothing links them."""
    labels = connected_components(edges).select(F.col("id").alias("__id"), "component")
    return rows.join(labels, F.col("id") == F.col("__id"), "left").drop("__id").withColumn("component", F.coalesce("component", "id"))


def represented(rows: DataFrame, order: list[Column], size_on_all: bool) -> DataFrame:
    """``rows`` with ``canon_id`` and ``canon_size``, the representative being first by ``order`` and then by id.

    The group's size stands on all members, or on the representative with 1 on the others.
    """
    rank = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.col("id").alias("id"))
    heads = rows.groupBy("component").agg(F.min(rank).alias("head"), F.count(F.lit(1)).alias("n")).select("component", F.col("head.id").alias("canon_id"), "n")
    joined = rows.drop("canon_id", "canon_size").join(heads, "component")
    size = F.col("n") if size_on_all else F.when(F.col("id") == F.col("canon_id"), F.col("n")).otherwise(F.lit(1))
    return joined.withColumn("canon_size", size.cast("long")).drop("n", "component")


def canonicalize_organizations(orgs: DataFrame) -> DataFrame:
    """Primary organisations with their representative; alias rows are left out."""
    primary = orgs.where("alias_source_id IS NULL") if "alias_source_id" in orgs.columns else orgs
    return represented(grouped(primary, organization_edges(primary)), [priority(F.col("source"), ORG_PRIORITY)], size_on_all=False)


def person_order() -> list[Column]:
    """Sort keys of people: source, known type, role, organisation, date, the most recent date first."""
    date = F.coalesce(F.nullif(F.col("from_date"), F.lit("")), F.col("to_date"), F.lit(""))
    no = lambda condition: F.when(condition, 0).otherwise(1)
    return [
        priority(F.col("source"), PERSON_PRIORITY), no(F.col("person_type") != "unknown"), no(F.col("known_for_role_id").isNotNull()),
        no(F.col("known_for_org_id").isNotNull()), no(date != ""), dates.inverted(date),
    ]


def canonicalize_people(people: DataFrame) -> DataFrame:
    return represented(grouped(people, person_edges(people)), person_order(), size_on_all=True)


def match_counts(rows: DataFrame, key: Column) -> DataFrame:
    """How many merges a key makes at most: the sum over keys of their rows less one."""
    counts = rows.select(key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("matches"))


def group_summary(rows: DataFrame) -> DataFrame:
    """Numbers of groups and of groups with more than one record."""
    sizes = rows.groupBy("canon_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("multi_record_groups"))


def refreshed_sizes(rows: DataFrame) -> DataFrame:
    """``canon_size`` of representatives counted anew, alias rows included."""
    counts = rows.where("canon_id IS NOT NULL").groupBy("canon_id").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("canon_id", "__canon")
    joined = rows.join(counts, (F.col("id") == F.col("__canon")) & (F.col("id") == F.col("canon_id")), "left")
    return joined.withColumn("canon_size", F.coalesce("__n", "canon_size")).drop("__n", "__canon")


def alias_rows(orgs: DataFrame, normalize) -> DataFrame:
    """Alias rows of canonicalised primaries, from the names in their records.

    Names that normalise to the parent's own normal form or to nothing, and repeated ones, are left out.
    """
    kind = "struct<wikidata_aliases:array<string>,other_names:array<string>,ticker:string>"
    parsed = orgs.where("alias_source_id IS NULL").withColumn("__names", F.from_json("record", kind))
    name_of = lambda x: F.coalesce(F.get_json_object(x, "$.name"), x)
    both = F.concat(
        F.transform(F.coalesce(F.col("__names.wikidata_aliases"), F.array().cast("array<string>")), lambda x: F.struct(x.alias("name"), F.lit(5).cast("long").alias("via"))),
        F.transform(F.coalesce(F.col("__names.other_names"), F.array().cast("array<string>")), lambda x: F.struct(name_of(x).alias("name"), F.lit(6).cast("long").alias("via"))),
        F.transform(F.array_compact(F.array(F.nullif(F.col("__names.ticker"), F.lit("")))), lambda x: F.struct(x.alias("name"), F.lit(7).cast("long").alias("via"))),
    )
    listed = parsed.withColumn("__alias", F.explode(both)).withColumn("__normal", normalize(F.col("__alias.name")))
    fresh = listed.where("__normal <> '' AND __normal <> name_normalized").dropDuplicates(["source_identifier", "source_id", "__normal"] if "source_id" in orgs.columns else ["source_identifier", "source", "__normal"])
    return fresh.withColumns({
        "name": F.col("__alias.name"), "name_normalized": F.col("__normal"), "alias_source_id": F.col("__alias.via"),
        "alias_source_identifier": F.col("source_identifier"), "canon_size": F.lit(1).cast("long"), "record": F.lit("{}"),
    }).drop("__names", "__alias", "__normal", "id")


def transitions(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Counts of changed values, the most frequent first."""
    changed = rows.where(~F.col(old).eqNullSafe(F.col(new))).groupBy(old, new).agg(F.count(F.lit(1)).alias("n"))
    return changed.orderBy(F.col("n").desc(), old, new)
