"""Large files cut between tasks: members of zip archives, objects of a JSON array, lines of a growing dump.

Spark lists the files; a task opens its part at the place where it begins, so no file is whole
in one task.  Paths are local or shared folders or any store that Arrow's file systems open.
"""

from __future__ import annotations

import fnmatch
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from rollcall.session import ship_package

#: Bytes of a file that a task reads, of rows in a batch, and of one read.
RANGE_BYTES, BATCH_BYTES, READ_BYTES = 64 << 20, 4 << 20, 1 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def opened(path: str) -> pa.NativeFile:
    system, place = located(path)
    return system.open_input_file(place)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """``path, size`` of the files that a path, folder or pattern names; their content is not read."""
    ship_package(spark)
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


def _tasks(files: DataFrame, each: int) -> int:
    return files.agg(F.sum(F.ceil(F.col("size") / each))).first()[0] or 1


# -- archives --------------------------------------------------------------------------


@dataclass
class Member:
    """A member of an archive, or the lines that start in the bytes ``lo`` to ``hi`` of one that is stored as it is."""

    name: str
    header: int
    packed: int
    deflated: bool
    crc: int
    lo: int
    hi: int


def member_runs(path: str, pattern: str, lines: bool, each: int) -> Iterator[list[Member]]:
    """An archive's members whose name fits, by its directory, in runs of about ``each`` packed bytes."""
    held, total = [], 0
    with opened(path) as file, zipfile.ZipFile(file) as archive:
        for info in archive.infolist():
            if info.is_dir() or not fnmatch.fnmatch(info.filename.rsplit("/", 1)[-1], pattern):
                continue
            if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or info.flag_bits & 1:
                raise ValueError(f"{path}: {info.filename} is encrypted or packed by another method than deflate")
            deflated = info.compress_type == zipfile.ZIP_DEFLATED
            cut = lines and not deflated and info.file_size > each
            for lo in range(0, info.file_size, each) if cut else [0]:
                hi = min(lo + each, info.file_size) if cut else info.file_size
                held.append(Member(info.filename, info.header_offset, info.compress_size, deflated, info.CRC, lo, hi))
                total += hi - lo if cut else info.compress_size
                if total >= each:
                    yield held
                    held, total = [], 0
    if held:
        yield held


def _runs(pattern: str, lines: bool, each: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for members in member_runs(path, pattern, lines, each):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([json.dumps([astuple(m) for m in members])])], ["path", "members"])

    return run


def _content_start(file: pa.NativeFile, member: Member) -> int:
    file.seek(member.header)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {member.header}")
    return member.header + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")


def _inflated(file: pa.NativeFile, member: Member) -> Iterator[bytes]:
    """A member's bytes, a bounded number at once, checked against its checksum at the end."""
    at, end, crc = _content_start(file, member), 0, 0
    end, packer = at + member.packed, zlib.decompressobj(-15) if member.deflated else None
    while at < end:
        file.seek(at)
        raw = file.read(min(READ_BYTES, end - at))
        if not raw:
            raise ValueError(f"{member.name}: the archive ends within it")
        at += len(raw)
        while raw:
            out = packer.decompress(raw, READ_BYTES) if packer else raw
            raw = packer.unconsumed_tail if packer else b""
            crc = zlib.crc32(out, crc)
            if out:
                yield out
    if packer and (rest := packer.flush()):
        crc = zlib.crc32(rest, crc)
        yield rest
    if crc != member.crc:
        raise ValueError(f"{member.name}: its checksum differs")


def _stored_from(file: pa.NativeFile, member: Member) -> Iterator[bytes]:
    """Bytes of a stored member from the one before its ``lo`` on, to its end."""
    start = _content_start(file, member)
    at, end = start + max(member.lo - 1, 0), start + member.packed
    while at < end:
        file.seek(at)
        raw = file.read(min(READ_BYTES, end - at))
        if not raw:
            raise ValueError(f"{member.name}: the archive ends within it")
        at += len(raw)
        yield raw


def lines_from(pieces: Iterator[bytes], start: int, stop: int, skip: bool) -> Iterator[tuple[int, bytes]]:
    """``(place, line)`` of the lines that start before ``stop``, from pieces that begin at ``start``; with ``skip`` what is left of a line goes first."""
    held, at = [], start
    for piece in pieces:
        first, *more = piece.split(b"\n")
        held.append(first)
        for following in more:
            line = b"".join(held)
            if skip:
                skip = False
            elif at >= stop:
                return
            else:
                yield at, line
            at, held = at + len(line) + 1, [following]
        if at >= stop and not skip:
            return
    rest = b"".join(held)
    if rest and not skip and at < stop:
        yield at, rest


def _text(raw: bytes) -> str:
    return raw.removesuffix(b"\r").decode("utf-8", "replace")


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is a text, about ``BATCH_BYTES`` in a batch."""
    held, size = [], 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BATCH_BYTES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _part_rows(path: str, members: list[Member], lines: bool) -> Iterator[tuple]:
    with opened(path) as file:
        for member in members:
            if not lines:
                yield path, member.name, b"".join(_inflated(file, member)).decode("utf-8", "replace")
                continue
            name = f"{path}!{member.name}"
            if member.deflated or (member.lo, member.hi) == (0, member.packed):
                found = lines_from(_inflated(file, member), 0, member.hi, False)
            else:  # a byte earlier: a range that begins with a line begins behind a line's end
                found = lines_from(_stored_from(file, member), max(member.lo - 1, 0), member.hi, member.lo > 0)
            for at, line in found:
                yield name, at, _text(line)


def _read_runs(lines: bool) -> Callable:
    names, kinds = (["file", "at", "value"], [pa.string(), pa.int64(), pa.string()]) if lines else (["path", "member", "value"], [pa.string()] * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, members in zip(*[c.to_pylist() for c in batch.columns]):
                yield from _batched(_part_rows(path, [Member(*m) for m in json.loads(members)], lines), names, kinds)

    return run


def _archives(spark: SparkSession, path: str, pattern: str, lines: bool, each: int, schema: str) -> DataFrame:
    files = listed(spark, path)
    runs = files.select("path").mapInArrow(_runs(pattern, lines, each), "path string, members string")
    return runs.repartition(_tasks(files, each)).mapInArrow(_read_runs(lines), schema)


def zip_lines(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, at, value``: lines of the members whose name fits; ``at`` is the byte of the member where a line starts.

    An archive's directory is read by one task, its members by as many as it has runs of ``range_bytes``; a member that is
    stored as it is is cut at lines, a deflated one is read by one task, a bounded number of bytes at once.
    """
    return _archives(spark, path, pattern, True, range_bytes, "file string, at long, value string")


def zip_members(spark: SparkSession, path: str, pattern: str = "*", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, member, value``: whole members whose name fits, as texts; one is in memory at a time."""
    return _archives(spark, path, pattern, False, range_bytes, "path string, member string, value string")


# -- arrays ----------------------------------------------------------------------------


class JsonScan:
    """Follows texts and brackets over pieces of JSON bytes; nothing before the first piece is needed but its state."""

    def __init__(self, quoted: bool, escaped: bool):
        self.quoted, self.escaped = quoted, escaped

    def feed(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each byte whether it is in a text, and 1 for an opening bracket, -1 for a closing one, in texts or not."""
        data = np.frombuffer(raw, np.uint8)
        places = np.arange(len(data))
        last = np.maximum.accumulate(np.concatenate([[-1], np.where(data == 0x5C, -1, places)]))  # the last byte before each one, and the end, that is no backslash
        slashes = np.arange(-1, len(data)) - last + np.where(last == -1, int(self.escaped), 0)
        quote = (data == 0x22) & (slashes[:-1] % 2 == 0)
        after = np.cumsum(quote) + self.quoted
        inside = (after - quote) % 2 == 1
        self.quoted, self.escaped = bool(after[-1] % 2), bool(slashes[-1] % 2)
        step = np.isin(data, (0x7B, 0x5B)).astype(np.int8) - np.isin(data, (0x7D, 0x5D))
        return inside, step


def _escaped_at(file: pa.NativeFile, at: int) -> bool:
    """Whether an odd number of backslashes stands right before ``at``."""
    n = 0
    while n < at:
        size = min(64, at - n)
        file.seek(at - n - size)
        raw = file.read(size)
        run = size - len(raw.rstrip(b"\\"))
        n += run
        if run < size:
            break
    return n % 2 == 1


def _pieces(file: pa.NativeFile, at: int, end: int) -> Iterator[tuple[int, bytes]]:
    while at < end:
        file.seek(at)
        raw = file.read(min(READ_BYTES, end - at))
        if not raw:
            return
        yield at, raw
        at += len(raw)


def range_summary(path: str, lo: int, hi: int) -> tuple[int, int, int]:
    """Of a range: whether it turns texts into no texts, and how brackets change the depth if it begins outside a text, and within one."""
    change = [0, 0]
    with opened(path) as file:
        scan = JsonScan(False, _escaped_at(file, lo))
        for _, raw in _pieces(file, lo, hi):
            inside, step = scan.feed(raw)
            change = [change[0] + int(step[~inside].sum()), change[1] + int(step[inside].sum())]
    return int(scan.quoted), change[0], change[1]


def range_objects(path: str, lo: int, hi: int, quoted: bool, depth: int) -> Iterator[tuple[int, bytes]]:
    """``(place, bytes)`` of the outer array's elements that are objects or arrays and begin within the range; the last one may end behind it."""
    held, begun = [], None
    with opened(path) as file:
        scan = JsonScan(quoted, _escaped_at(file, lo))
        for at, raw in _pieces(file, lo, file.size()):
            inside, step = scan.feed(raw)
            level = depth + np.cumsum(np.where(inside, 0, step), dtype=np.int64)
            depth = int(level[-1])
            opens = np.flatnonzero(~inside & (step == 1) & (level == 2)).tolist()
            ends = np.flatnonzero(~inside & (step == -1) & (level == 1)).tolist()
            if ends and (not opens or ends[0] < opens[0]):  # of an element that began before this piece
                if begun is not None:
                    yield begun, b"".join([*held, raw[: ends[0] + 1]])
                    begun = None
                ends = ends[1:]
            elif begun is not None:
                held.append(raw)
            for start, end in zip(opens, ends):
                if at + start >= hi:
                    return
                yield at + start, raw[start : end + 1]
            if len(opens) > len(ends):
                if at + opens[-1] >= hi:
                    return
                held, begun = [raw[opens[-1] :]], at + opens[-1]
            if begun is None and at + len(raw) >= hi:
                return


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [range_summary(*row) for row in zip(*[c.to_pylist() for c in batch.columns])]
        if found:
            columns = [pa.array(c, pa.int64()) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["path", "lo", "hi", "turns", "outside", "within"])


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, *row in zip(*[c.to_pylist() for c in batch.columns]):
            yield from _batched(((path, at, raw.decode("utf-8", "replace")) for at, raw in range_objects(path, *row)), ["file", "at", "value"], [pa.string(), pa.int64(), pa.string()])


def array_objects(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file, at, value``: the objects of files that are one JSON array each, as texts, by the byte where they start.

    A first pass sums up quotes and brackets of each range of bytes; running sums over a file's ranges say
    whether a range begins within a text and how deep, and a second pass cuts the objects.
    """
    files = listed(spark, path)
    n = _tasks(files, range_bytes)
    lo = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.where("size > 0").select("path", lo.alias("lo"), "size").select("path", "lo", F.least(F.col("lo") + range_bytes, "size").alias("hi"))
    summed = ranges.repartition(n).mapInArrow(_summaries, "path string, lo long, hi long, turns long, outside long, within long")
    before = Window.partitionBy("path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    state = summed.withColumn("quoted", F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2 == 1)
    state = state.withColumn("depth", F.coalesce(F.sum(F.when(F.col("quoted"), F.col("within")).otherwise(F.col("outside"))).over(before), F.lit(0)))
    return state.select("path", "lo", "hi", "quoted", "depth").repartition(n).mapInArrow(_objects, "file string, at long, value string")


# -- dumps -----------------------------------------------------------------------------


@dataclass
class DumpPart(InputPartition):
    """Lines of a file that start from ``lo`` up to ``hi``; ``base`` is the file's place in the dump."""

    path: str
    base: int
    lo: int
    hi: int


def dump_files(path: str) -> list[tuple[str, int, int]]:
    """Path, place in the dump, and size of a file, or of a folder's files in the order of their names; a leading ``.`` or ``_`` is no data."""
    system, place = located(path)
    info = system.get_file_info(place)
    found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(place)) if x.is_file and x.base_name[0] not in "._"]
    prefix, base, out = path[: len(path.rstrip("/")) - len(place.rstrip("/"))], 0, []
    for x in sorted(found, key=lambda x: x.path):
        if re.search(r"\.(gz|bz2|zst|xz)$", x.path):
            raise ValueError(f"{x.path} is compressed; a stream goes on within plain files only")
        out.append((prefix + x.path, base, x.size))
        base += x.size
    return out


class DumpReader(DataSourceStreamReader):
    """Lines of a dump, one plain file or several in a row, from where the last batch ended.

    An offset names the dump by its path and size and has the byte of the next line.  The reader finds the last one in
    the query's own checkpoint; a batch takes about ``batchBytes``, all that is left without it.
    """

    def __init__(self, options: dict):
        self.path, self.checkpoint = options["path"], options["checkpoint"]
        self.each, self.batch = int(options.get("rangebytes", RANGE_BYTES)), int(options.get("batchbytes", 0))
        self.files = dump_files(self.path)
        self.size = sum(size for *_, size in self.files)
        self.at: int | None = None

    def _offset(self, at: int) -> dict:
        return {"dump": self.path, "size": self.size, "byte": at}

    def initialOffset(self) -> dict:
        self.at = 0
        return self._offset(0)

    def _checked(self, offset: dict) -> int:
        if (offset["dump"], offset["size"]) != (self.path, self.size):
            raise ValueError(f"the checkpoint is of {offset['dump']} with {offset['size']} bytes, not of {self.path} with {self.size}")
        return offset["byte"]

    def _planned(self) -> int:
        """The end of the last batch that the checkpoint has planned."""
        system, place = located(self.checkpoint)
        found = system.get_file_info(fs.FileSelector(f"{place}/offsets", allow_not_found=True))
        numbers = [int(x.base_name) for x in found if x.base_name.isdigit()]
        if not numbers:
            return 0
        with system.open_input_stream(f"{place}/offsets/{max(numbers)}") as log:
            return self._checked(json.loads(log.read().decode().strip().split("\n")[-1]))

    def _line_end(self, at: int) -> int:
        """The first end of a line, or of a file, behind byte ``at`` of the dump."""
        path, base, size = next(f for f in self.files if at < f[1] + f[2])
        with opened(path) as file:
            return base + next((start + place + 1 for start, raw in _pieces(file, at - base, size) if (place := raw.find(b"\n")) >= 0), size)

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = self._planned()
        self.at = self._line_end(self.at + self.batch - 1) if self.batch and self.at + self.batch < self.size else self.size
        return self._offset(self.at)

    def partitions(self, start: dict, end: dict) -> list[DumpPart]:
        lo, hi = self._checked(start), self._checked(end)
        spans = [(path, base, max(lo, base), min(hi, base + size)) for path, base, size in self.files]
        return [DumpPart(path, base, at, min(at + self.each, stop)) for path, base, first, stop in spans for at in range(first, stop, self.each)]

    def read(self, partition: DumpPart) -> Iterator[pa.RecordBatch]:
        lo = partition.lo - partition.base
        skip = lo > 0  # a byte earlier: a range that begins with a line begins behind a line's end
        with opened(partition.path) as file:
            pieces = (raw for _, raw in _pieces(file, lo - skip, file.size()))
            found = lines_from(pieces, partition.lo - skip, partition.hi, skip)
            yield from _batched(((at, _text(line)) for at, line in found), ["at", "value"], [pa.int64(), pa.string()])


class Dump(DataSource):
    """Lines of a dump as a stream."""

    @classmethod
    def name(cls) -> str:
        return "dump_lines"

    def schema(self) -> str:
        return "at long, value string"

    def streamReader(self, schema) -> DumpReader:
        return DumpReader(self.options)


def stream_dump(spark: SparkSession, path: str, checkpoint: str, batch_bytes: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``at, value``: lines of a plain file, or of a folder's files in a row, by the byte where they start, as a stream that goes on in the middle.

    ``checkpoint`` is the query's checkpoint.  A dump that has changed its path or size is refused.
    """
    ship_package(spark)
    spark.dataSource.register(Dump)
    options = {"path": path, "checkpoint": checkpoint, "batchBytes": str(batch_bytes), "rangeBytes": str(range_bytes)}
    return spark.readStream.format("dump_lines").options(**options).load()
