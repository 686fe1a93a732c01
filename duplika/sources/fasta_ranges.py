"""FASTA of any size by byte ranges: a distributed index, and a data source of rows of bounded length.

``write_index`` puts ``<file>.fai`` (name, length, offset, bases and bytes of a line, tab-separated) beside each file. ``read_ranges``
deals the files' bytes to tasks and gives a contig as rows of at most ``row_bases`` bases, each with its place. A filter on
``chrom`` or ``start`` is pushed into the source: only the bytes of those rows are read. Nothing holds a whole contig.

Cases: a contig without bases has no row; a name that occurs twice has the rows of both; a file without an index, and a contig
whose lines differ in length before its last one, raise an error; an empty file has no rows.
"""

from __future__ import annotations

import io
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "species string, chrom string, start long, seq string"
INDEX = "file string, chrom string, len long, offset long, line_bases long, line_width long"
ROW_BASES, PARTITION_BYTES, BLOCK = 1 << 20, 64 << 20, 4 << 20
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n\v\f")] = True


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path names, and the path there; without a scheme the local one."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def fasta_files(path: str) -> list[tuple[str, int]]:
    """Path and size of the file, or of the FASTA files in the folder."""
    system, inner = _place(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else "file://" if path.startswith("file:") else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(prefix + inner, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    held = system.get_file_info(fs.FileSelector(inner))
    return sorted((prefix + f.path, f.size) for f in held if f.type == fs.FileType.File and f.base_name[0] not in "._" and not f.base_name.endswith(".fai"))


@dataclass(frozen=True)
class Entry:
    """A contig in its file."""

    chrom: str
    length: int
    offset: int
    line_bases: int
    line_width: int

    def byte(self, base: int) -> int:
        return self.offset + base // self.line_bases * self.line_width + base % self.line_bases

    def base(self, byte: int) -> int:
        """The first base at a byte or after it."""
        lines, rest = divmod(max(0, byte - self.offset), self.line_width)
        return min(self.length, lines * self.line_bases + min(rest, self.line_bases))


def entries(path: str) -> Iterator[Entry]:
    """A file's index, read as a stream."""
    system, inner = _place(path)
    if system.get_file_info(f"{inner}.fai").type != fs.FileType.File:
        raise FileNotFoundError(f"{path} has no index; make it with write_index")
    with system.open_input_stream(f"{inner}.fai") as raw:
        for line in io.TextIOWrapper(io.BufferedReader(raw), encoding="utf-8", newline="\n"):
            name, *numbers = line.rstrip("\n").split("\t")
            yield Entry(name, *map(int, numbers))


# --- index ---------------------------------------------------------------------------


class _Contig:
    """A contig whose lines are being met."""

    def __init__(self, name: str, offset: int):
        self.name, self.offset = name, offset
        self.size = self.bases = self.line_bases = self.line_width = 0
        self.uneven: int | None = None  # the first byte that is not as the first line asks

    def take(self, part: bytes) -> None:
        raw = np.frombuffer(part, np.uint8)
        blank = _BLANK[raw]
        if not self.line_width:
            if self.size == self.line_bases:  # no blank so far
                self.line_bases += int(np.argmax(blank)) if blank.any() else raw.size
            end = part.find(b"\n")
            if end >= 0:
                self.line_width = self.size + end + 1
        if self.line_width and self.line_bases:
            wanted = (self.size + np.arange(raw.size)) % self.line_width >= self.line_bases
        else:
            wanted = self.size + np.arange(raw.size) >= self.line_bases
        ink = np.flatnonzero(~blank)
        if self.uneven is None and (odd := np.flatnonzero(blank != wanted)).size:
            self.uneven = self.size + int(odd[0])
        if ink.size and self.uneven is not None and self.size + int(ink[-1]) >= self.uneven:
            raise ValueError(f"{self.name}: lines of uneven length; write it anew with write_fasta")
        self.bases += ink.size
        self.size += raw.size

    def row(self, file: str) -> tuple:
        lines = max(1, self.line_bases)
        return file, self.name, self.bases, self.offset, lines, self.line_width or lines + 1


def scan(file: str, begin: int, end: int, block: int = BLOCK) -> Iterator[tuple]:
    """Index rows of the contigs whose header begins in the bytes from ``begin`` up to ``end``; the last is followed beyond."""
    system, inner = _place(file)
    with system.open_input_file(inner) as raw:
        fresh = True  # whether a line begins here
        if begin:
            raw.seek(begin - 1)
            fresh = raw.read(1) == b"\n"
        at, contig, head = begin, None, None  # head: the header's bytes so far
        while part := raw.read(block):
            i = 0
            while i < len(part):
                if head is not None:
                    stop = part.find(b"\n", i)
                    head += part[i : stop if stop >= 0 else len(part)]
                    i = stop + 1 if stop >= 0 else len(part)
                    if stop >= 0:
                        name = head[1:].decode().split()
                        contig, head, fresh = _Contig(name[0] if name else "", at + i), None, True
                    continue
                found = i if fresh and part[i : i + 1] == b">" else part.find(b"\n>", i) + 1 or len(part)
                if contig:
                    contig.take(part[i:found])
                if found > i:
                    fresh = part[found - 1 : found] == b"\n"
                i = found
                if i < len(part):  # a header
                    if contig:
                        yield contig.row(file)
                    contig = None
                    if at + i >= end:
                        return
                    head = b""
            at += len(part)
            if contig is None and head is None and at >= end:
                # The next header, if one begins at ``end`` or after, is another range's.
                return
        if head is not None:
            name = head[1:].decode().split()
            contig = _Contig(name[0] if name else "", at)
        if contig:
            yield contig.row(file)


def index_fasta(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``file, chrom, len, offset, line_bases, line_width`` of each contig, from all byte ranges at once."""
    files = fasta_files(path)
    size = sum(s for _, s in files)
    held = spark.createDataFrame([f for f in files if f[1]], "file string, size long")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(partition_bytes).cast("long"))).alias("begin")
    ranges = held.select("file", begin).repartition(size // partition_bytes + 1, "file", "begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                for row in scan(r["file"], r["begin"], r["begin"] + partition_bytes):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield _index_batch(rows)
                        rows = []
                yield _index_batch(rows)

    return ranges.mapInArrow(run, INDEX)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), *[pa.int64()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in INDEX.split(", ")])


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index files from rows sorted by file and offset; each comes under its name once it is whole."""
    now, out, temporary, n = None, None, "", 0

    def close() -> pa.RecordBatch:
        out.close()
        system, inner = _place(now)
        system.move(temporary, f"{inner}.fai")
        return pa.RecordBatch.from_pydict({"file": [now], "contigs": [n]})

    for batch in batches:
        for r in batch.to_pylist():
            if r["file"] != now:
                if now is not None:
                    yield close()
                now, n = r["file"], 0
                system, inner = _place(now)
                folder, base = posixpath.split(inner)
                temporary = f"{folder}/.{base}.{uuid.uuid4().hex}"
                out = system.open_output_stream(temporary)
            out.write(f"{r['chrom']}\t{r['len']}\t{r['offset']}\t{r['line_bases']}\t{r['line_width']}\n".encode())
            n += 1
    if now is not None:
        yield close()


def write_index(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> int:
    """Write the index of each file; the number of contigs. A task holds one row of an index at a time."""
    files = len(fasta_files(path))
    rows = index_fasta(spark, path, partition_bytes).repartition(max(1, min(files, 1000)), "file").sortWithinPartitions("file", "offset")
    done = rows.mapInArrow(_write, "file string, contigs long").agg(F.coalesce(F.sum("contigs"), F.lit(0)).alias("n"), F.collect_set("file").alias("files")).first()
    for file, _ in fasta_files(path):
        if file not in done["files"]:  # without a contig
            system, inner = _place(file)
            system.open_output_stream(f"{inner}.fai").close()
    return done["n"]


# --- rows ----------------------------------------------------------------------------


@dataclass
class _Part(InputPartition):
    """Byte ranges that one task reads."""

    ranges: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.row_bases = int(options.get("rowbases", ROW_BASES))
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.chroms: set[str] | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if f.__class__ in (EqualTo, In) and f.attribute == ("chrom",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chroms = values if self.chroms is None else self.chroms & values
            elif f.__class__ in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute == ("start",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def _rows(self, entry: Entry) -> tuple[int, int]:
        """The rows of a contig, by number, from which the filters take theirs."""
        every = -(-entry.length // self.row_bases)
        return min(every, -(-self.low // self.row_bases)), min(every, self.high // self.row_bases + 1)

    def _extents(self) -> Iterator[tuple[str, int, int]]:
        """Byte ranges with the wanted rows: whole files, or with a filter the parts that the index names."""
        for file, size in fasta_files(self.path):
            if self.chroms is None:
                yield file, 0, size
                continue
            for e in entries(file):
                first, last = self._rows(e)
                if e.chrom in self.chroms and first < last:
                    yield file, e.byte(first * self.row_bases), e.byte(min(e.length, last * self.row_bases) - 1) + 1

    def partitions(self) -> list[InputPartition]:
        parts, now, held = [], [], 0
        for file, begin, end in self._extents():
            while begin < end:
                stop = min(end, begin + self.partition_bytes - held)
                now.append((file, begin, stop))
                held += stop - begin
                begin = stop
                if held >= self.partition_bytes:
                    parts.append(_Part(now))
                    now, held = [], 0
        return [*parts, _Part(now)] if now or not parts else parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._read(partition):
            rows.append(row)
            held += len(row[3])
            if held >= BLOCK or len(rows) == 10_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _read(self, partition: _Part) -> Iterator[tuple[str, str, int, str]]:
        for file, begin, end in partition.ranges:
            system, inner = _place(file)
            species = posixpath.splitext(posixpath.basename(inner))[0].replace("#", "")
            with system.open_input_file(inner) as raw:
                size = raw.size()
                for e in entries(file):
                    if e.offset >= end:
                        break
                    if self.chroms is not None and e.chrom not in self.chroms:
                        continue
                    if e.length and e.byte(e.length - 1) >= size:
                        raise ValueError(f"{file}: the index does not fit {e.chrom}")
                    first, last = self._rows(e)
                    # A row is read where its first base lies.
                    first = max(first, -(-e.base(begin) // self.row_bases))
                    last = min(last, -(-e.base(end) // self.row_bases))
                    for i in range(first, last):
                        start, stop = i * self.row_bases, min(e.length, (i + 1) * self.row_bases)
                        raw.seek(e.byte(start))
                        seq = raw.read(e.byte(stop - 1) + 1 - e.byte(start)).translate(None, b" \t\r\n\v\f")
                        if len(seq) != stop - start:
                            raise ValueError(f"{file}: the index does not fit {e.chrom}")
                        yield species, e.chrom, start, seq.decode()


def _batch(rows: list[tuple[str, str, int, str]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["species", "chrom", "start", "seq"])


class FastaRanges(DataSource):
    """``spark.read.format("fasta_ranges")`` with ``path``, ``rowBases`` and ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_ranges(spark: SparkSession, path: str, row_bases: int = ROW_BASES, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``species, chrom, start, seq``: rows of at most ``row_bases`` bases of each contig."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaRanges)
    return spark.read.format("fasta_ranges").option("rowBases", row_bases).option("partitionBytes", partition_bytes).load(path)


def contig_range(spark: SparkSession, path: str, chrom: str, start: int, length: int, row_bases: int = ROW_BASES) -> DataFrame:
    """``species, chrom, start, seq`` of ``length`` bases from ``start`` on, fewer at a contig's end; reads the rows that hold them."""
    first = start - start % row_bases
    rows = read_ranges(spark, path, row_bases).where((F.col("chrom") == chrom) & (F.col("start") >= first) & (F.col("start") < start + length))
    skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    piece = F.substring("seq", (skip + 1).cast("int"), (F.lit(start + length) - F.col("start") - skip).cast("int"))
    pieces = rows.groupBy("species", "chrom").agg(F.array_sort(F.collect_list(F.struct("start", piece.alias("piece")))).alias("p"))
    return pieces.select("species", "chrom", F.lit(start).cast("long").alias("start"), F.array_join("p.piece", "").alias("seq"))
