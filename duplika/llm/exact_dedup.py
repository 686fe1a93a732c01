"""Exact deduplication with keyed streaming state.

Every row flows with its locator as a stream into a stateful aggregation keyed by digest, in micro-batches of a
bounded number of files. The state lives in RocksDB, on disk, and
never expires: for each digest it retains the count, the stable identifier (largest doc_id) and the
content locator (a row's file and place) of the row that stays. Tasks of a micro-batch add up their own rows of a digest
before they are dealt by it, so a hot text does not flood the state's partition. A hit on a digest is only a claim: the
bytes at the hit's and the keeper's locators are compared in full, and rows whose bytes differ from
their keeper's are grouped by the whole text instead. The comparison of a text of many copies is dealt by
shares of its rows, each beside the keeper's text.

Texts are equal when identical after no change; null counts as empty. Of equal texts the row with the
largest doc_id stays; of several rows with that doc_id the one with the largest locator; a null doc_id
is smaller than any other. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from .common import drop, exists, stage, workdir

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


#: Rows of one text whose bytes are compared in one place.
SHARE = 1 << 12


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def _place() -> tuple[Column, Column]:
    """A row's file and its place there."""
    return F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")


def _from_files(docs: DataFrame) -> bool:
    """Whether rows of ``docs`` can be told by file and place; a column of the table's own may hide these."""
    if "_metadata" in (c.lower() for c in docs.columns):
        return False
    try:
        return bool(docs.select(*_place()).columns)
    except AnalysisException:
        return False


def _located(docs: DataFrame, folder: str) -> DataFrame:
    """Documents with ``file`` and ``place``; a table that does not come from files is written to some first."""
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    if not _from_files(docs):
        docs = stage(docs.select(*cols), folder, "located")
    return docs.select(*cols, *_place())


class _Conf:
    """Session settings for the time of a block."""

    def __init__(self, spark: SparkSession, conf: dict[str, str]):
        self.spark, self.conf = spark, conf

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.conf}
        for k, v in self.conf.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


class DedupStream:
    """The keyed state of a folder; later calls of ``add`` go on where the earlier ones stopped.

    ``batch_files`` bounds the log's files in a micro-batch.
    """

    def __init__(self, spark: SparkSession, folder: str, batch_files: int = 1_000):
        self.spark, self.folder, self.batch_files = spark, folder, batch_files
        self.log, self.checkpoint = f"{folder}/log", f"{folder}/state"

    def add(self, arrivals: DataFrame) -> None:
        """Append rows (digest, keeper, n) to the log and run the stream up to its end."""
        arrivals.write.mode("append").parquet(self.log)
        stream = self.spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", self.batch_files).parquet(self.log)
        state = stream.groupBy("digest").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
        with _Conf(self.spark, _STATE_CONF):
            (
                state.writeStream.outputMode("update").format("noop")
                .option("checkpointLocation", self.checkpoint)
                .trigger(availableNow=True).start().awaitTermination()
            )

    def state(self) -> DataFrame:
        """``digest, n, keeper`` of every digest seen so far."""
        if not exists(self.spark, f"{self.checkpoint}/commits/0"):  # no row has arrived
            return self.spark.read.parquet(self.log).select("digest", "n", "keeper")
        with _Conf(self.spark, _STATE_CONF):
            held = self.spark.read.format("statestore").load(self.checkpoint)
            return held.select("key.digest", F.col("value.sum").alias("n"), F.col("value.max").alias("keeper"))



def dedup_groups(docs: DataFrame, digest=sha256_text, folder: str | None = None) -> DataFrame:
    """Each row with the row of its group that stays.

    Columns: ``doc_id, file, place, digest, keep_id, keep_file, keep_place, group_size, kept``.
    """
    spark = docs.sparkSession
    folder = folder or workdir(spark)
    located = _located(docs, folder)
    slim = located.select("doc_id", "file", "place", digest(F.col("text")).alias("digest"))
    keeper = F.struct("doc_id", "file", "place").alias("keeper")
    stream = DedupStream(spark, folder)
    stream.add(slim.select("digest", keeper, F.lit(1).cast("long").alias("n")))
    state = stage(stream.state(), folder, "seen")
    drop(spark, stream.log)
    claims = slim.join(state, "digest").select(
        *slim.columns, F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.file").alias("keep_file"),
        F.col("keeper.place").alias("keep_place"), F.col("n").alias("group_size"),
    )
    # Hits: the bytes at both locators. Only texts of digests seen more than once are moved.
    again = state.where("n > 1").select("digest", "keeper", F.ceil(F.col("n") / SHARE).alias("shares"))
    texts = stage(located.withColumn("digest", digest(F.col("text"))).join(again, "digest"), folder, "hits")
    is_keeper = (F.col("place") == F.col("keeper.place")) & (F.col("file") == F.col("keeper.file"))
    share = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share")
    keepers = texts.where(is_keeper).select("digest", F.col("text").alias("keep_text"), share)
    hits = texts.where(~is_keeper).withColumn("share", F.pmod(F.xxhash64("file", "place"), F.col("shares")))
    differ = hits.join(keepers, ["digest", "share"]).where(F.col("text") != F.col("keep_text"))
    wrong = stage(differ.select("doc_id", "file", "place", "digest"), folder, "wrong")
    bad = wrong.select("digest").distinct()
    # Collisions of the digest: the whole text is the key among the digests concerned.
    if wrong.isEmpty():
        return claims.withColumn("kept", (F.col("place") == F.col("keep_place")) & (F.col("file") == F.col("keep_file")))
    full = located.withColumn("digest", digest(F.col("text"))).join(bad, "digest", "left_semi")
    exact = full.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "place")).alias("keeper"), F.count("*").alias("group_size"))
    right = full.join(exact, ["digest", "text"]).select(
        *slim.columns, F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.file").alias("keep_file"),
        F.col("keeper.place").alias("keep_place"), "group_size",
    )
    return claims.join(bad, "digest", "left_anti").select(right.columns).unionByName(right).withColumn(
        "kept", (F.col("place") == F.col("keep_place")) & (F.col("file") == F.col("keep_file"))
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns."""
    folder = workdir(docs.sparkSession)
    row, own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), [F.col("doc_id"), F.col("text")]
    if not _from_files(docs):
        docs = stage(docs.select(row, *own), folder, "rows")
        row = F.col("row")
    groups = dedup_groups(docs, folder=folder).where("kept").select("file", "place")
    return docs.select(row, *_place()).join(groups, ["file", "place"], "left_semi").select("row.*")


def dedup_query(docs: DataFrame) -> DataFrame:
    return dedup_groups(docs).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256")
    )


