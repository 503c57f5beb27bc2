"""Misspelt names by deletion neighbourhoods, texts within names by gram postings, and perturbed names to measure searches with.

Two texts of an edit distance of k have a text in common that either becomes by at most k
deletions; two letters that changed places need one.  So an equi-join on all texts that names and queries become that way meets every
pair near enough, and the edit distance decides.  Likewise a text that is part of a name has
only grams of it; the query's rarest gram is looked up and the name decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.functions import names
from rollcall.stage import staged

#: Edits that are forgiven in a text of up to so many characters; more in none.
FORGIVEN = ((3, 0), (7, 1), (60, 2))
GRAM = 3


def forgiven(text: Column) -> Column:
    """Edits that a text of this length may have."""
    n = F.length(text)
    return reduce(lambda rest, step: F.when(n <= step[0], F.lit(step[1])).otherwise(rest), reversed(FORGIVEN), F.lit(0))


def _one_less(text: Column) -> Column:
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substr(text, i + 1)))


def deletions(text: Column, most: Column) -> Column:
    """The text and what it becomes by deleting up to ``most`` (two at most) of its characters."""
    none = F.array().cast("array<string>")
    once = F.array_distinct(_one_less(text))
    twice = F.flatten(F.transform(once, _one_less))
    return F.array_distinct(F.concat(F.array(text), F.when(most >= 1, once).otherwise(none), F.when(most >= 2, twice).otherwise(none)))


def edits(a: Column, b: Column) -> Column:
    """The edit distance, where two neighbouring letters that changed places, and nothing else, are one edit."""
    places = F.sequence(F.lit(1), F.length(a) - 1)
    swapped = F.exists(places, lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    distance = F.levenshtein(a, b)
    return F.when((distance == 2) & (F.length(a) == F.length(b)) & swapped, 1).otherwise(distance)


def nearest_names(texts: DataFrame, known: DataFrame, column: str = "text", key: str = "key", order: list[str] | None = None) -> DataFrame:
    """``column``, the columns of ``known`` and ``distance``: of each distinct text the nearest known name within what its length forgives.

    Ties go to the first by the columns ``order``, then by name.  Texts that are null or have no name near are left out.
    """
    allowed = forgiven(F.col(column))
    asked = texts.select(column).where(F.col(column).isNotNull()).distinct().withColumn("__most", allowed)
    asked = asked.withColumn("__via", F.explode(deletions(F.col(column), F.col("__most"))))
    # The shortest texts that are forgiven one edit, and two, may have names this much shorter.
    one, two = (FORGIVEN[i][0] + 1 - FORGIVEN[i + 1][1] for i in (0, 1))
    named = known.withColumn("__via", F.explode(deletions(F.col(key), F.when(F.length(key) < one, 0).when(F.length(key) < two, 1).otherwise(2))))
    met = asked.join(named, "__via").drop("__via").withColumn("distance", edits(F.col(column), F.col(key))).where("distance <= __most").distinct()
    first = Window.partitionBy(column).orderBy("distance", *(order or []), key)
    return met.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth", "__most")


# -- parts of names ----------------------------------------------------------------------


def grams(text: Column, n: Column) -> Column:
    """Distinct runs of ``n`` characters."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, n)))


def postings(table: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """``gram, id`` of all runs of up to three characters of the lower-cased names, as a stage table."""
    text = F.lower(F.col(name_col))
    runs = F.concat(*[grams(text, F.lit(n)) for n in range(1, GRAM + 1)])
    return staged(table.select(F.col(id_col).alias("id"), F.explode(runs).alias("gram")).select("gram", "id"), "postings")


def _texts(queries: DataFrame) -> DataFrame:
    """``qid, query, __text`` of queries that are not blank, as a stage table."""
    return staged(queries.select("qid", "query", F.lower(F.trim("query")).alias("__text")).where("__text <> ''"), "asked")


def _holders(table: DataFrame, texts: DataFrame, index: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """``__text`` and the row of ``table`` for each of the distinct ``texts`` and each row whose name contains it."""
    wanted = texts.select("__text", F.explode(grams(F.col("__text"), F.least(F.length("__text"), F.lit(GRAM)))).alias("gram"))
    counts = index.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("__text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    near = rarest.select("__text", F.col("best.gram").alias("gram")).join(index.withColumnRenamed("id", "__id"), "gram")
    return near.join(table, F.col("__id") == F.col(id_col)).where(F.contains(F.lower(F.col(name_col)), F.col("__text"))).drop("__id", "gram")


def containing(table: DataFrame, queries: DataFrame, index: DataFrame | None = None, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """``qid, query`` and the row of ``table`` for each row whose name contains the query's trimmed text, in any case.

    ``queries`` has ``qid, query``; blank texts and null names match nothing.  ``index`` are the table's
    ``postings``.  All texts go through the index at once, equal ones as one: each by its rarest gram, whose rows are compared with the whole text.
    """
    index = postings(table, id_col, name_col) if index is None else index
    asked = _texts(queries)
    found = _holders(table, asked.select("__text").distinct(), index, id_col, name_col)
    return asked.join(found, "__text").drop("__text")


def contains_search(table: DataFrame, queries: DataFrame, k: int = 10, exact_alone: bool = True, index: DataFrame | None = None) -> DataFrame:
    """The ``k`` shortest names that contain each query, with ``score`` and ``rank``; an equal name alone with score 1 if ``exact_alone``.

    ``table`` has ``id, name`` and, for equal names, ``name_normalized``.  Equal texts are searched for once; with ``exact_alone``
    those that equal a name are joined with it, and only the others go through the index.
    """
    index = postings(table) if index is None else index
    asked = _texts(queries)
    texts = asked.select("__text").distinct()
    first = Window.partitionBy("__text").orderBy(F.length("name"), "id")
    best = lambda rows, most: rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    if exact_alone:
        same = texts.join(table, F.col("__text") == F.col("name_normalized")).where(F.contains(F.lower("name"), F.col("__text")))
        equal = staged(best(same, min(k, 1)).withColumn("score", F.lit(1.0)), "equal-names")
        texts = texts.join(equal.select("__text"), "__text", "left_anti")
    found = best(_holders(table, texts, index, "id", "name"), k).withColumn("score", names.like_score(F.col("name"), F.col("__text")))
    if exact_alone:
        found = found.unionByName(equal)
    return asked.join(found, "__text").drop("__text")


def names_search(table: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``qid, id, rank, distance``: rows whose name contains the query, or where none does the row with the nearest name.

    ``table`` has ``id, name, name_normalized``; of rows with equal names the least id stands for a near one.
    """
    held = staged(contains_search(table, queries, k).select("qid", "id", "rank", F.lit(0).alias("distance")), "names-held")
    left = queries.join(held.select("qid").distinct(), "qid", "left_anti").withColumn("__text", F.lower(F.trim("query")))
    known = table.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("id"))
    near = nearest_names(left.select("__text"), known, "__text", order=["id"])
    return held.unionByName(left.join(near, "__text").select("qid", "id", F.lit(1).alias("rank"), "distance"))


# -- measuring ---------------------------------------------------------------------------

# Short forms of given names.
NICKNAMES = {
    "william": "bill", "robert": "bob", "richard": "dick", "james": "jim", "john": "jack", "margaret": "peggy", "elizabeth": "liz", "katherine": "kate",
    "michael": "mike", "thomas": "tom", "charles": "chuck", "edward": "ted", "joseph": "joe", "anthony": "tony", "daniel": "dan", "matthew": "matt",
}
KINDS = ("swapped", "dropped letter", "doubled letter", "other letter", "other case", "last word alone", "without last word", "nickname")


def _place(id_col: Column, kind: str, n: Column) -> Column:
    """A place from 1 to ``n`` that the id and the kind determine."""
    mixed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(kind), id_col.cast("string"))), 1, 8), 16, 10).cast("long")
    return (F.pmod(mixed, F.greatest(n, F.lit(1))) + 1).cast("int")


def perturbed(table: DataFrame, id_col: str = "id", name_col: str = "name", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``id, name, kind, query``: each name once for each kind of change that alters it; the id is the known answer.

    What is changed where follows from a hash of the kind and the id, so reruns ask the same.
    """
    name, words = F.col("name"), F.split(F.trim("name"), r"\s+")
    first = F.lower(F.get(words, F.lit(0)))
    short = F.element_at(F.create_map(*[F.lit(x) for pair in NICKNAMES.items() for x in pair]), first)

    def changed(kind: str) -> Column:
        at = _place(F.col("id"), kind, F.length(name) - (1 if kind == "swapped" else 0))
        head, letter, tail = F.substring(name, F.lit(1), at - 1), F.substring(name, at, F.lit(1)), F.substr(name, at + 1)
        return {
            "swapped": F.concat(head, F.substring(name, at + 1, F.lit(1)), letter, F.substr(name, at + 2)),
            "dropped letter": F.concat(head, tail),
            "doubled letter": F.concat(head, letter, letter, tail),
            "other letter": F.concat(head, F.when(letter == "x", "z").otherwise("x"), tail),
            "other case": F.when(F.upper(name) == name, F.lower(name)).otherwise(F.upper(name)),
            "last word alone": F.when(F.size(words) > 1, F.element_at(words, -1)),
            "without last word": F.when(F.size(words) > 1, F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")),
            "nickname": F.when(short.isNotNull(), F.concat_ws(" ", short, F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " "))),
        }[kind]

    rows = table.select(F.col(id_col).alias("id"), F.col(name_col).alias("name")).where("length(name) > 1")
    asked = rows.select("id", "name", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), changed(k).alias("query")) for k in kinds])).alias("x"))
    return asked.select("id", "name", "x.kind", "x.query").where("query IS NOT NULL AND query <> '' AND query <> name")


def accuracy_by_kind(asked: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """``kind, queries, acc_at_1, acc_at_k`` of searches for ``perturbed`` names.

    ``asked`` has ``qid, kind, id``, ``found`` has ``qid, id, rank``: the known answer counts if it stands first, or among the first ``k``.
    """
    hits = asked.join(found.where(F.col("rank") <= k).select("qid", F.col("id").alias("__id"), "rank"), "qid", "left")
    of_query = hits.groupBy("qid", "kind").agg(F.min(F.when(F.col("id") == F.col("__id"), F.col("rank"))).alias("at"))
    share = lambda c: F.avg(F.coalesce(c.cast("int"), F.lit(0)))
    return of_query.groupBy("kind").agg(F.count(F.lit(1)).alias("queries"), share(F.col("at") == 1).alias("acc_at_1"), share(F.col("at") <= k).alias("acc_at_k"))
