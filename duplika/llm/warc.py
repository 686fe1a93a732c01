"""WARC archives: pages in order of their id, in deterministic shards, as files rolled by compressed size.

Writing:

1. A light pass takes each page's size and digests. Of equal payloads of at least ``revisit_bytes`` the one with the largest page_id
   is written as a response, all others as revisits that refer to it.
2. The light rows are sorted by (page_id, hash of url and payload) over all tasks and their sizes summed up along that order. Each
   ``shard_bytes`` begins a shard, so the shards depend on the rows alone, not on partitions, samples or executors.
3. Pages and, as rows before them, the decisions on revisits are dealt by shard and sorted; payloads are shuffled once. A task
   writes its shard record by record, each a gzip member of its own with headers and digests made anew, and rolls to
   the next file at ``file_bytes`` compressed bytes.
4. Files are written under temporary names of the task's attempt. The rows that describe them become a manifest by Spark's own commit, so a
   lost executor or a second attempt leaves at most files that no manifest knows. Then the manifest's files get their
   names, which can be done again after a failure, and the rest of the temporary folder goes.

The folder is one that all executors reach through ``pyarrow.fs`` (a mounted path, S3, GCS, HDFS with its client library). Reading goes through
Spark's own ``binaryFile`` source; digests are taken anew and held against the headers.

Cases: null html is an empty payload; a null page_id sorts first and is not written as a header; a null url leaves the target out,
white space and controls in it are written as ``%XX``; of rows with equal payload and page_id the one with the largest
file and place is the response; rows that are equal throughout are each written, as records with ids of their own; an
empty table gives no files; columns besides page_id, url and html are not read. A page and a file are
handled in memory of their size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, drop, exists, stage, workdir
from .exact_dedup import _from_files, _place

#: Fixed values of the format.
VERSION = "WARC/1.1"
SAME_DIGEST = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that a record's headers take, about.
HEAD_BYTES = 700
#: Shards at most: their first keys are known to every task. Beyond it shards grow with the table.
MAX_SHARDS = 1 << 16


@dataclass(frozen=True)
class Layout:
    """How archives are laid out."""

    shard_bytes: int = 16 << 20
    file_bytes: int = 32 << 20
    revisit_bytes: int = 1000
    prefix: str = "pages"
    date: str = "1970-01-01T00:00:00Z"
    level: int = 6


# --- records ---------------------------------------------------------------------


def record_id(*parts: object) -> str:
    """A record's URN, made from what tells it apart."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(repr(parts).encode('utf-8', 'surrogateescape')).digest()[:16], version=5)}>"


def target(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _b32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record's bytes; headers without a value are left out."""
    lines = [f"{k}: {v}\r\n" for k, v in headers if v is not None]
    lines += [f"WARC-Block-Digest: {_b32(block)}\r\n", f"Content-Length: {len(block)}\r\n"]
    return f"{VERSION}\r\n{''.join(lines)}\r\n".encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, own_id: str, date: str, refers: tuple[str, str | None] | None) -> bytes:
    """A response, or a revisit that ``refers`` to (record id, url) of one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", own_id), ("WARC-Date", date), ("WARC-Target-URI", target(url)),
        ("X-Page-ID", page_id), ("WARC-Payload-Digest", _b32(payload)), ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers:
        headers += [("WARC-Profile", SAME_DIGEST), ("WARC-Refers-To", refers[0]), ("WARC-Refers-To-Target-URI", target(refers[1])), ("WARC-Refers-To-Date", date)]
    return record(headers, http if refers else http + payload)


def members(data: bytes | memoryview, piece: int = 1 << 16) -> Iterator[bytes]:
    """The contents of each gzip member; fed in pieces, so that what follows a member is copied only within one."""
    data, at = memoryview(data), 0
    while at < len(data):
        made, out = zlib.decompressobj(31), []
        while not made.eof:
            if at >= len(data):
                raise ValueError("an archive ends within a record")
            out.append(made.decompress(data[at : at + piece]))
            at += piece
        at = min(at, len(data)) - len(made.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record; the block is held against its length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n" or headers.get("warc-block-digest") not in (None, _b32(rest[:size])):
        raise ValueError(f"a broken record: {headers.get('warc-record-id')}")
    return headers, rest[:size]


# --- shards ------------------------------------------------------------------------


def _located(pages: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, html, h, file, place``; a table that does not come from files is written to some first."""
    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("html")]
    if not _from_files(pages):
        pages = stage(pages.select(*cols), folder, "_located")
    return pages.select(*cols, *_place()).withColumn("h", F.xxhash64("url", "html"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the task's rows before each row."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        upto = before + np.cumsum(batch.column("bytes").to_numpy())
        starts = upto - batch.column("bytes").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), batch.column("page_id"), batch.column("h"), pa.array(starts), pa.array(upto)], ["part", "page_id", "h", "start", "upto"])
        before = int(upto[-1]) if batch.num_rows else before


def shard_starts(slim: DataFrame, folder: str, shard_bytes: int) -> list[tuple[bool, int, int]]:
    """The first key (has an id, page_id, h) of each shard, ``MAX_SHARDS`` at most."""
    light = slim.select("page_id", "h", (F.col("bytes") + HEAD_BYTES).alias("bytes"))
    along = light.repartitionByRange("page_id", "h").sortWithinPartitions("page_id", "h").mapInArrow(_running, "part int, page_id long, h long, start long, upto long")
    along = stage(along, folder, "_along")
    sizes = along.groupBy("part").agg(F.max("upto").alias("size"))  # a row a task
    base = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    step = max(shard_bytes, -(-total // (MAX_SHARDS - 1)))
    key = F.struct(F.col("page_id").isNotNull().alias("some"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "h")
    placed = along.join(F.broadcast(base), "part").select(F.floor((F.col("base") + F.col("start")) / F.lit(step)).alias("shard"), key.alias("key"))
    firsts = placed.groupBy("shard").agg(F.min("key").alias("key")).collect()
    drop(slim.sparkSession, f"{folder}/_along")
    return sorted((r.key.some, r.key.page_id, r.key.h) for r in firsts)


def shard_of(starts: list[tuple[bool, int, int]]):
    """Column function: the shard of (page_id, h). Rows of one key that fills several shards are spread over them by ``spread``."""

    def number(some: bool, page_id: int, h: int, spread: int) -> int:
        low, high = bisect_left(starts, (some, page_id, h)), bisect_right(starts, (some, page_id, h)) - 1
        return low + spread % (high - low + 1) if high > low else max(high, 0)

    @F.pandas_udf("int")
    def shard(some: pd.Series, page_id: pd.Series, h: pd.Series, spread: pd.Series) -> pd.Series:
        return pd.Series([number(*row) for row in zip(some.tolist(), page_id.tolist(), h.tolist(), spread.tolist(), strict=True)], dtype="int32")

    return shard(F.col("page_id").isNotNull(), F.coalesce("page_id", F.lit(0)), F.col("h"), F.pmod(F.xxhash64("file", "place"), F.lit(1 << 30)))


# --- writing -----------------------------------------------------------------------


def revisits(slim: DataFrame, least: int) -> DataFrame:
    """``page_id, h, file, place, to_id, to_url, to_sha1`` of each page whose payload a later one has; the response is the group's largest."""
    large = slim.where(F.col("bytes") >= least)
    order = F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", "file", "place", "url", "sha1")
    groups = large.groupBy("sha256").agg(F.max(order).alias("to"), F.count("*").alias("n")).where("n > 1")
    itself = (F.col("place") == F.col("to.place")) & (F.col("file") == F.col("to.file"))
    return large.join(groups, "sha256").where(~itself).select(
        "page_id", "h", "file", "place", F.col("to.page_id").alias("to_id"), F.col("to.url").alias("to_url"), F.col("to.sha1").alias("to_sha1")
    )


MANIFEST = "name string, temporary string, shard int, records long, bytes long, sha1 string"


def _files(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _writer(folder: str, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        attempt = TaskContext.get().taskAttemptId()
        fs.create_dir(f"{root}/_temporary", recursive=True)
        out, now, last, decided = None, {}, None, None

        def begin(shard: int, number: int):
            name = f"{layout.prefix}-{shard:05d}-{number:04d}.warc.gz"
            now.update(name=name, temporary=f"{name}.{attempt}", shard=shard, records=0, bytes=0, sha1=hashlib.sha1())
            info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", name)), ("WARC-Date", layout.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            file = fs.open_output_stream(f"{root}/_temporary/{now['temporary']}")
            put(file, _member(info, layout.level))
            return file

        def put(file, data: bytes) -> None:
            file.write(data)
            now["sha1"].update(data)
            now["bytes"] += len(data)

        def end(file) -> pa.RecordBatch:
            file.close()
            return pa.RecordBatch.from_pylist([now | {"sha1": now["sha1"].hexdigest()}], pa.schema([("name", pa.string()), ("temporary", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())]))

        shard, number, ordinal = -1, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["decision"]:
                    decided = row
                    continue
                if row["shard"] != shard or now["bytes"] >= layout.file_bytes:
                    if out is not None:
                        yield end(out)
                    number = number + 1 if row["shard"] == shard else 0
                    shard = row["shard"]
                    out = begin(shard, number)
                sha1 = hashlib.sha1(row["html"]).hexdigest()
                refers = None
                if decided is not None and (decided["file"], decided["place"]) == (row["file"], row["place"]):
                    refers = record_id("response", decided["to_id"], decided["to_url"], decided["to_sha1"]), decided["to_url"]
                key = "revisit" if refers else "response", row["page_id"], row["url"], sha1
                # Equal small responses and equal revisits stand side by side; all but the first get a number.
                ordinal = ordinal + 1 if key == last else 0
                last = key
                # What a revisit may refer to is told by its key alone.
                own = record_id(*key, shard, ordinal) if refers or len(row["html"]) < layout.revisit_bytes else record_id(*key)
                put(out, _member(page_record(row["page_id"], row["url"], row["html"], own, layout.date, refers), layout.level))
                now["records"] += 1
        if out is not None:
            yield end(out)

    return run


def _publish(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(folder)
        for batch in batches:
            for row in batch.to_pylist():
                held, final = f"{root}/_temporary/{row['temporary']}", f"{root}/{row['name']}"
                if fs.get_file_info(held).type == pafs.FileType.File:
                    fs.move(held, final)
                elif fs.get_file_info(final).size != row["bytes"]:
                    raise FileNotFoundError(f"{final}: neither written nor named")
            yield batch.select(["name"])

    return run


def write_archives(pages: DataFrame, folder: str, layout: Layout = Layout()) -> DataFrame:  # noqa: B008
    """Write all pages to archives in ``folder`` and return the manifest.

    A folder that has its manifest is not written again: files that still have temporary names get theirs.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    if not exists(spark, f"{folder}/_manifest/_SUCCESS"):
        drop(spark, f"{folder}/_manifest")
        _write(pages, folder, layout)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    manifest.mapInArrow(_publish(folder), "name string").write.format("noop").mode("overwrite").save()
    drop(spark, f"{folder}/_temporary")
    return manifest


def _write(pages: DataFrame, folder: str, layout: Layout) -> None:
    spark, scratch = pages.sparkSession, workdir(pages.sparkSession)
    located = _located(pages, scratch)
    slim = located.select("page_id", "url", "h", F.sha1("html").alias("sha1"), F.sha2("html", 256).alias("sha256"), F.length("html").cast("long").alias("bytes"), "file", "place")
    slim = stage(slim, scratch, "slim")
    shard = shard_of(shards := shard_starts(slim, scratch, layout.shard_bytes))
    none = {"to_id": "long", "to_url": "string", "to_sha1": "string"}
    rows = located.withColumns({c: F.lit(None).cast(t) for c, t in none.items()} | {"decision": F.lit(False)})
    decided = revisits(slim, layout.revisit_bytes).withColumns({"url": F.lit(None).cast("string"), "html": F.lit(None).cast("binary"), "decision": F.lit(True)})
    dealt = rows.unionByName(decided).withColumn("shard", shard).repartitionById(max(1, len(shards)), F.col("shard"))
    ordered = dealt.sortWithinPartitions("shard", "page_id", "h", "file", "place", F.desc("decision"))
    stage(ordered.mapInArrow(_writer(folder, layout), MANIFEST), folder, "_manifest")
    drop(spark, scratch)


# --- reading -----------------------------------------------------------------------

RECORDS = "record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_id string"


def _reader(payloads: bool):
    names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("content"):
                rows, held = [], 0
                for raw in members(file.as_buffer()):
                    headers, block = parse(raw)
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    said = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if payload is not None and hashlib.sha1(payload).hexdigest() != said:
                        raise ValueError(f"a payload that is not its digest's: {headers['warc-record-id']}")
                    page = headers.get("x-page-id")
                    rows.append((headers["warc-record-id"], kind, None if page is None else int(page), headers.get("warc-target-uri"), None if payload is None else len(payload), said, headers.get("warc-refers-to"), payload)[: len(names)])
                    held += len(payload or b"") if payloads else 200
                    if held >= 8 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return run


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds)], names)


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of all archives, as ``RECORDS`` names them, revisits without size; with ``payload`` where asked for."""
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(_reader(payloads), RECORDS + ", payload binary" * payloads)


def missing(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest's files that are not there in full; contents are not read."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("there"))
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    return manifest.join(there, "name", "left").where("there is null or there <> bytes")


def resolve(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``: revisits get the size and id of their response."""
    responses = records.where("record_type = 'response'")
    to = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("digest"))
    size = F.when(F.col("digest") == F.col("payload_digest"), F.col("size")).otherwise(F.raise_error(F.lit("a revisit without its response")).cast("long"))
    again = records.where("record_type = 'revisit'").join(to, "refers_id", "left")
    own = responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(again.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def warc_query(spark: SparkSession, pages: DataFrame, layout: Layout = Layout()) -> DataFrame:  # noqa: B008
    folder = workdir(spark)
    if write_archives(pages, folder, layout).isEmpty():
        empty = spark.createDataFrame([], RECORDS)
        return resolve(empty)
    return resolve(stage(read_archives(spark, folder), folder, "_records"))


#: The same rows in SQL.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER w AS top, row_number() OVER (PARTITION BY html ORDER BY page_id DESC) AS k FROM p WINDOW w AS (PARTITION BY html))
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND k > 1 THEN top END AS refers_to FROM g"""
