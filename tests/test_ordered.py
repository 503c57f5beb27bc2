"""Running values and numbers over ranges, where one group holds most rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import Window, functions as F

from rollcall.operators import canonicalize, ordered, upsert
from rollcall.stage import task_count


@pytest.fixture(scope="module")
def rows(spark):
    """Half of all rows are of one group; values are missing at the starts and ends of stretches."""
    rng = random.Random(1)
    group = lambda i: "hot" if i % 2 else rng.choice(["a", "b", None, f"g{i % 40}"])
    data = [(group(i), i * 7 % 1009, i, rng.choice([None, None, rng.randrange(1000)]), rng.choice([None, f"v{i}"])) for i in range(3000)]
    data += [("late", i, 10_000 + i, None, None) for i in range(30)] + [("late", 50, 10_050, 3, "x")]
    return spark.createDataFrame(data, "g string, at int, id int, n int, text string").repartition(5)


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_running_values_equal_windows(rows, inclusive, ranges):
    got = ordered.running(rows, ["g"], ["at", "id"], {"top": ("max", "n"), "told": ("last", "text")}, inclusive, ranges)
    window = Window.partitionBy("g").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.withColumns({"top": F.max("n").over(window), "told": F.last("text", ignorenulls=True).over(window)})
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_a_hot_group_lies_in_several_ranges(rows):
    sizes = [r["count"] for r in ordered.laid_out(rows, ["g", "at", "id"], 10).groupBy("__part").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 2.5 * sum(sizes) / 10


def test_numbers_are_consecutive(rows):
    got = upsert.numbered(rows.select("g", "id"), ["id"], start=5, out="n").orderBy("id").collect()
    assert [r.n for r in got] == list(range(6, 6 + len(got)))


def test_islands_of_a_hot_name(spark):
    """Components of overlapping periods of one name that many share, against all pairs."""
    rng = random.Random(3)
    people = []
    for i in range(400):
        start = rng.randrange(0, 4000)
        people.append((i, "hot" if i % 2 else f"n{i % 30}", f"{1000 + start // 12:04d}-{start % 12 + 1:02d}", rng.choice([f"{1000 + (start + rng.randrange(0, 25)) // 12:04d}-{(start + 3) % 12 + 1:02d}", "", None][: 1 if i % 50 else 3])))
    frame = spark.createDataFrame(people, "id long, name_normalized string, from_date string, to_date string")
    got = {r.id: r.component for r in canonicalize.grouped(frame, canonicalize.overlap_edges(frame)).collect()}
    label = {p[0]: p[0] for p in people}
    until = lambda p: p[3] or "9999-12-31"
    moved = True
    while moved:
        moved = False
        for a in people:
            for b in people:
                if a[1] == b[1] and a[2] <= until(a) and b[2] <= until(b) and a[2] <= until(b) and b[2] <= until(a) and label[a[0]] > label[b[0]]:
                    label[a[0]], moved = label[b[0]], True
    assert got == label and len(set(label.values())) < 350


def test_tasks_of_joins(spark, tmp_path):
    """A join's size is not the product of its tables': it gave thousands of tasks for small tables."""
    spark.range(200_000).selectExpr("id", "uuid() AS a").write.parquet(f"{tmp_path}/a")
    spark.range(20_000).selectExpr("id", "uuid() AS b").write.parquet(f"{tmp_path}/b")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert task_count(a.join(b, "id")) == task_count(a.join(b, "id").union(a.join(b, "id"))) == least
