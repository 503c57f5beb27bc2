"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Every document has a fixed 30-bit hash.  A source's budget becomes a hash threshold:
documents below it are taken once more than those above it.  The threshold is found from
histograms: tokens are summed by source and the hash's top ten bits, the bucket in which
the running sum crosses the budget is the boundary bucket, and only its documents are
summed again by the next ten bits, and then by the last ten.  No document is sorted and
the histograms have at most 1,024 rows a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rollcall.llm.columns import own_prefix
from rollcall.stage import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order (null last), repeating.
WEIGHTS = (5, 2, 1)
#: No target is more than this many times its source's size.
MOST_EPOCHS = 3
BITS = 10
LEVELS = 3


def unit_hash(doc_id: Column) -> Column:
    """30 bits of the MD5 of the id's decimal text; a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long").bitwiseAND(
        F.lit((1 << BITS * LEVELS) - 1)
    )


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Targets of ``(source, source_size)`` rows: shares of the total by weight, each at most ``most`` times the size.

    What capped sources leave is shared by weight among the rest until none is above its
    cap.  In order of cap over weight the capped sources come first, so a running sum tells
    how many there are.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(float(most))})
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rates = capped.withColumns({"rate": left / weights_left, "nth": F.row_number().over(order)})
    free = F.min(F.when(F.col("cap") > F.col("rate") * F.col("weight"), F.struct("nth", "rate"))).over(whole)
    return rates.withColumn("free", free).select(
        "source", "source_size",
        F.when(F.col("nth") >= F.col("free.nth"), F.col("free.rate") * F.col("weight")).otherwise(F.col("cap")).alias("target"),
    )


def _bucket(level: int) -> Column:
    return F.shiftright("u", BITS * (LEVELS - 1 - level))


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """A row for each source of a ``(source, size, u)`` table.

    ``plan_source, source_size, target, epochs, prefix``: every document is taken ``epochs``
    times, and those with a hash below ``prefix`` once more.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(totals, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", F.least(epochs, F.lit(most))).withColumn(
        "budget", F.when(F.col("epochs") < most, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0.0))
    ).withColumns({"below": F.lit(0).cast("double"), "prefix": F.lit(0).cast("long")})
    plan = staged(plan, "mix-plan")  # a row for each source
    for level in range(LEVELS):
        plan = staged(_refine(sized, plan, level), "mix-plan")
    return plan.select(F.col("source").alias("plan_source"), "source_size", "target", "epochs", "prefix")


def _copies(u: Column) -> Column:
    return (F.col("epochs") + F.when(u < F.col("prefix"), 1).otherwise(0)).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, u`` of every row."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return named.select("doc_id", "source", words.alias("size"), unit_hash(F.col("doc_id")).alias("u"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS,
) -> DataFrame:
    """How often each document is taken so that the sources come near their target sizes.

    Returns ``doc_id, size, source_size, target, copies, taken`` for every row.  ``size`` is
    the number of words (null text: 0), ``taken`` is ``size * copies`` and ``copies`` is at
    most ``most``.  A null source is a source of its own and comes last.  A source without
    words has target 0 and nothing of it is taken.  Rows with equal ids share a hash, so they
    are taken together; documents of the last boundary bucket, those with equal hashes, are
    taken if the sum comes nearer the budget with them.  An empty table gives no rows.
    """
    sized = staged(sizes(docs, id_col, text_col, source_col), "sizes")
    joined = sized.join(mix_plan(sized, weights, most), F.col("source").eqNullSafe(F.col("plan_source")))
    copies = _copies(F.col("u"))
    return joined.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as it is taken, columns unchanged.

    Rows with a null source are a source of their own; those with a null, empty or wordless
    text have size 0 and are taken like others of their hash.  Rows with equal ids or
    without an id share a hash and are taken together.  An empty table gives no rows.
    """
    plan = mix_plan(staged(sizes(docs, id_col, text_col, source_col), "sizes"))
    own = own_prefix(docs.columns)
    plan = plan.select(*[F.col(c).alias(f"{own}{c}") for c in ("plan_source", "epochs", "prefix")])
    taken = F.col(f"{own}epochs") + F.when(unit_hash(F.col(id_col)) < F.col(f"{own}prefix"), 1).otherwise(0)
    rows = docs.join(plan, F.col(source_col).eqNullSafe(F.col(f"{own}plan_source"))).withColumn(f"{own}taken", taken)
    copies = rows.where(F.col(f"{own}taken") > 0).withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{own}taken"))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])


def _refine(sized: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """Narrow each source's threshold by one level of its boundary bucket.

    ``prefix`` is the boundary bucket so far, ``below`` the tokens before it.  After the
    last level ``prefix`` is the threshold itself.
    """
    key = F.col("source").eqNullSafe(F.col("plan_source"))
    inside = sized.join(plan.select(F.col("source").alias("plan_source"), "prefix"), key)
    if level:
        inside = inside.where(_bucket(level - 1) == F.col("prefix"))
    histogram = inside.groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("size").cast("double").alias("tokens"))
    joined = histogram.join(
        plan.select(F.col("source").alias("plan_source"), "budget", F.col("below").alias("base")), key
    )
    running = Window.partitionBy("plan_source").orderBy("bucket")
    upto = joined.withColumn("upto", F.col("base") + F.sum("tokens").over(running))
    # The boundary bucket is the first whose running sum passes the budget.
    passes = F.col("upto") > F.col("budget")
    if level == LEVELS - 1:
        passes &= F.col("budget") - (F.col("upto") - F.col("tokens")) <= F.col("upto") - F.col("budget")
    found = upto.where(passes).groupBy(F.col("plan_source").alias("found_source")).agg(
        F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"))).alias("hit")
    )
    full = (F.col("prefix") + 1) * (1 << BITS)
    return plan.join(found, F.col("source").eqNullSafe(F.col("found_source")), "left").select(
        "source", "source_size", "target", "epochs", "budget",
        F.coalesce(F.col("hit.before"), F.col("below")).alias("below"),
        F.coalesce(F.col("hit.bucket"), full).cast("long").alias("prefix"),
    )


#: The same decisions in DuckDB SQL, by a running sum over all documents in hash order.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8) AS UBIGINT)::BIGINT & 1073741823 AS u
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM totals),
weighted AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                    source_size * 3.0::DOUBLE AS cap FROM ranked),
rates AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rk) AS nth, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS rate
          FROM weighted WINDOW before AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT min(nth) AS nth, arg_min(rate, nth) AS rate FROM rates WHERE cap > rate * weight),
targets AS (SELECT rates.*, CASE WHEN rates.nth >= free.nth THEN free.rate * weight ELSE cap END AS target FROM rates, free),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM targets),
budgets AS (SELECT *, CASE WHEN epochs < 3 THEN target - epochs * source_size ELSE 0 END AS budget FROM plan),
grouped AS (SELECT source, u, sum(size)::DOUBLE AS tokens FROM sized GROUP BY source, u),
running AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY u) AS upto FROM grouped)
SELECT s.doc_id, s.size, b.source_size, b.target,
       s.size * (b.epochs + CASE WHEN r.upto <= b.budget OR (r.upto - r.tokens < b.budget AND b.budget - (r.upto - r.tokens) > r.upto - b.budget) THEN 1 ELSE 0 END) AS taken
FROM sized s JOIN running r ON s.u = r.u AND s.source IS NOT DISTINCT FROM r.source
JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
"""
