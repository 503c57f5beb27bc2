"""Archives, arrays and dumps read in parts."""

from __future__ import annotations

import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from rollcall.plans import range_queries
from rollcall.sources import gleif, ranges
from rollcall.streaming import ingest

LINES = [f"line {i} " + "x" * (i % 50) for i in range(500)]


@pytest.fixture
def archive(tmp_path):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/one.dat", "\r\n".join(LINES) + "\r\n")
        z.writestr("two.dat", b"\xff a\n\nlast")
        z.writestr("empty.dat", b"")
        z.writestr("three.txt", "no")
        z.writestr("stored.dat", "\n".join(LINES), zipfile.ZIP_STORED)
        z.writestr("folder/", b"")
    return path


@pytest.mark.parametrize("each", [50, 1000, 7777, 1 << 26])
def test_lines_of_archives(spark, archive, each):
    """Lines keep their order over ranges and reads; ends of lines and broken text do no harm, other members are left."""
    got = {}
    for r in sorted(ranges.zip_lines(spark, archive, "*.dat", each).collect(), key=lambda r: r.at):
        got.setdefault(r.file.rsplit("!", 1)[1], []).append(r.value)
    assert got == {"in/one.dat": LINES, "two.dat": ["� a", "", "last"], "stored.dat": LINES}
    runs = list(ranges.member_runs(archive, "stored.dat", True, each))
    assert len(runs) == max(1, -(-len("\n".join(LINES)) // each))
    with zipfile.ZipFile(archive) as z:
        want = {(n, z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.endswith(".dat")}
    assert {(r.member, r.value) for r in ranges.zip_members(spark, archive, "*.dat", each).collect()} == want


def test_small_reads_and_broken_archives(archive, monkeypatch):
    monkeypatch.setattr(ranges, "READ_BYTES", 7)
    for each in (64, 1 << 20):
        members = [m for run in ranges.member_runs(archive, "*.dat", True, each) for m in run if m.name == "stored.dat"]
        assert [v for m in members for _, _, v in ranges._part_rows(archive, [m], True)] == LINES
        places = [at for m in members for _, at, _ in ranges._part_rows(archive, [m], True)]
        assert places == [sum(len(x) + 1 for x in LINES[:i]) for i in range(len(LINES))]
    monkeypatch.setattr(ranges, "READ_BYTES", 1 << 20)
    with zipfile.ZipFile(archive) as z:
        at = z.getinfo("in/one.dat").header_offset + 30 + len("in/one.dat") + 20
    raw = bytearray(open(archive, "rb").read())
    raw[at] ^= 0xFF
    open(archive, "wb").write(raw)
    member = next(m for run in ranges.member_runs(archive, "one.dat", True, 1 << 20) for m in run)
    with pytest.raises(Exception, match="checksum|invalid|incorrect|Error -3"):
        list(ranges._part_rows(archive, [member], True))


def _objects(rng, n):
    tricky = ['a"b', "\\", '\\"', "[{", "}]", "é日", "", "\\\\", "x" * 70, '"}', "\n"]

    def value(depth):
        kind = rng.randrange(6 if depth < 3 else 3)
        if kind == 0:
            return rng.choice(tricky)
        if kind < 3:
            return rng.choice([None, True, 1.5, -3, rng.choice(tricky) * rng.randrange(1, 4)])
        return [value(depth + 1) for _ in range(rng.randrange(3))] if kind == 3 else {rng.choice(tricky) + str(i): value(depth + 1) for i in range(rng.randrange(3))}

    return [{"k": value(0), rng.choice(tricky): value(0)} for _ in range(n)]


@pytest.mark.parametrize(("each", "read"), [(1, 5), (2, 1), (3, 64), (17, 3), (100, 1 << 20), (1 << 20, 11)])
def test_arrays_are_cut_at_objects(tmp_path, monkeypatch, each, read):
    """Every object once, wherever the ranges end: in texts, between a backslash and what it escapes, in nested arrays."""
    monkeypatch.setattr(ranges, "READ_BYTES", read)
    objects = _objects(random.Random(each), 25)
    for form in ({"ensure_ascii": False}, {"indent": 1}):
        path = str(tmp_path / "a.json")
        text = "﻿ \n" * ("indent" in form) + json.dumps(objects, **form) + "\n"
        open(path, "w").write(text)
        size, quoted, depth, got = len(text.encode()), False, 0, []
        for lo in range(0, size, each):
            got += [json.loads(raw) for _, raw in ranges.range_objects(path, lo, min(lo + each, size), quoted, depth)]
            turns, outside, within = ranges.range_summary(path, lo, min(lo + each, size))
            depth += within if quoted else outside
            quoted ^= bool(turns)
        assert got == objects and depth == 0 and not quoted


def test_array_files(spark, tmp_path):
    objects = _objects(random.Random(3), 200)
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps(objects[i * 60 : i * 60 + 60]))
    (tmp_path / "3.json").write_text("[]")
    (tmp_path / "4.json").write_text("")
    found = ranges.array_objects(spark, f"{tmp_path}/*.json", 333)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.at):
        got.setdefault(r.file.rsplit("/", 1)[1], []).append(json.loads(r.value))
    assert got == {f"{i}.json": objects[i * 60 : i * 60 + 60] for i in range(3)}
    record = {"id": "5493001KJTIIGC8Y1R12", "attributes": {"entity": {"legalName": {"name": "Acme [1] \"x\""}, "status": "ACTIVE"}}}
    (tmp_path / "records.json").write_text(json.dumps([record] * 2))
    assert [r.name for r in gleif.read(spark, str(tmp_path / "records.json")).collect()] == ['Acme [1] "x"'] * 2


def _records(spark, files, folder, batch_bytes):
    lines = ranges.stream_dump(spark, files, f"{folder}/checkpoint", batch_bytes, 256)
    parse = lambda rows: rows.where("value <> ''").select("at", F.get_json_object("value", "$.id").cast("long").alias("id"))
    ingest.ingest(lines, parse, ["id"], f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return sorted((r.at, r.id) for r in ingest.ingested(spark, f"{folder}/table").collect())


def test_a_dump_goes_on_within_a_file(spark, tmp_path):
    (tmp_path / "dump").mkdir()
    lines = [json.dumps({"id": i % 150, "pad": "é" * (i % 40)}, ensure_ascii=False) for i in range(200)]
    text = ["\n".join(lines[:120]) + "\n", "\n".join(lines[120:])]
    for i, part in enumerate(text):
        (tmp_path / "dump" / f"part-{i}").write_text(part)
    (tmp_path / "dump" / "_SUCCESS").write_text("")
    places, at = [], 0
    for i, part in enumerate(text):
        for line in part.encode().splitlines(keepends=True):
            places.append(at)
            at += len(line)
    want = sorted((places[i], i) for i in range(150))
    first = _records(spark, str(tmp_path / "dump"), str(tmp_path), 2000)
    assert 0 < len(first) < 150 and first == want[: len(first)]  # a batch is what its bytes say, up to a line's end
    second = _records(spark, str(tmp_path / "dump"), str(tmp_path), 500)
    assert len(first) < len(second) < 150 and second == want[: len(second)]
    assert _records(spark, str(tmp_path / "dump"), str(tmp_path), 0) == want
    assert _records(spark, str(tmp_path / "dump"), str(tmp_path), 0) == want  # nothing is left
    (tmp_path / "dump" / "part-2").write_text('{"id": 7}\n')
    with pytest.raises(Exception, match="the checkpoint is of"):
        _records(spark, str(tmp_path / "dump"), str(tmp_path), 0)
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "a.gz").write_text("x")
    with pytest.raises(Exception, match="compressed"):
        _records(spark, str(tmp_path / "packed"), str(tmp_path / "other"), 0)


def test_keys_seen_are_state(spark, tmp_path):
    """A batch does not read the table: it may be gone, and rows of old keys are still not added."""
    (tmp_path / "in").mkdir()
    run = lambda: ingest.ingest(ingest.read_lines(spark, str(tmp_path / "in")), lambda x: x.select(F.col("value").alias("id")), ["id"], str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    (tmp_path / "in" / "a").write_text("1\n2\n2\n")
    run()
    assert sorted(r.id for r in ingest.ingested(spark, str(tmp_path / "table")).collect()) == ["1", "2"]
    (tmp_path / "table").rename(tmp_path / "moved")
    (tmp_path / "in" / "b").write_text("2\n3\n")
    run()
    assert [r.id for r in ingest.ingested(spark, str(tmp_path / "table")).collect()] == ["3"]


def test_parts_grow_with_the_files(spark, tmp_path):
    """Parts of a fixed 64 KB were 100,000 tasks for files of some GB."""
    parts = {}
    for size in (1 << 20, 1 << 33, 1 << 36):
        folder = tmp_path / str(size)
        folder.mkdir()
        with open(folder / "a.zip", "wb") as out:
            out.truncate(size)  # a hole; the content isn't read
        parts[size] = range_queries._part_bytes(spark, f"{folder}/*.zip")
    assert parts == {1 << 20: 64 << 10, 1 << 33: 16 << 20, 1 << 36: ranges.RANGE_BYTES}
