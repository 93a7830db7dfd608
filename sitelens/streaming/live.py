"""Incremental versions of the read models, over a stream of arriving pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitelens.functions.fingerprint import bands, hamming
from sitelens.functions.urls import canonical_url
from sitelens.operators.page_rules import FACTS, page_issues
from sitelens.session import scratch_path

c = F.col
#: Rows a live view keeps per audit.
BUFFER = 500


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """Pages as a stream: files that appear under the path, each read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, each_batch, checkpoint: str | None = None, mode: str = "append") -> None:
    """Process what has arrived since the checkpoint, batch by batch, and stop."""
    where = checkpoint or scratch_path(stream.sparkSession, "stream")
    query = stream.writeStream.outputMode(mode).foreachBatch(each_batch).option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()


def running_statistics(stream: DataFrame) -> DataFrame:
    """Counters per audit that grow with the stream (output mode complete)."""
    return stream.groupBy("audit_id").agg(F.count(F.lit(1)).alias("crawled"), F.count_if(c("status_code") >= 500).alias("failed"), F.max("crawled_at").alias("last_at"))


def once(stream: DataFrame, late: str | None = None) -> DataFrame:
    """Each page id once; with ``late`` ("2 days") ids are forgotten that long after their crawl time."""
    if late is None:
        return stream.dropDuplicates(["id"])
    return stream.withWatermark("crawled_at", late).dropDuplicatesWithinWatermark(["id"])


def discovered_once(stream: DataFrame) -> DataFrame:
    """(audit_id, key): every canonical link target of an audit when it is first seen."""
    links = stream.select("audit_id", F.explode("links").alias("l")).where("l.internal and l.type = 'anchor'")
    return links.select("audit_id", canonical_url(c("l.url")).alias("key")).dropDuplicates(["audit_id", "key"])


def issues_on_arrival(stream: DataFrame) -> DataFrame:
    """Issues of the page rules for each page as it arrives: the batch rules, unchanged."""
    return page_issues(stream)


def newest(rows: DataFrame, size: int = BUFFER) -> DataFrame:
    """The latest version of each page, and of those the newest ``size`` per audit."""
    latest = Window.partitionBy("id").orderBy(c("crawled_at").desc_nulls_last())
    recent = Window.partitionBy("audit_id").orderBy(c("crawled_at").desc_nulls_last(), "id")
    one = rows.withColumn("__k", F.row_number().over(latest)).where("__k = 1")
    return one.withColumn("__k", F.row_number().over(recent)).where(c("__k") <= size).drop("__k")


def _batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches whose results lie complete under the folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    done = [f.getPath() for f in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(x.getName().removeprefix("batch-")) for x in done)


class Live:
    """A live page view kept in the shared folder: every batch is merged with the view before it.

    The view of each batch lies under the batch's number, so a batch that is repeated
    writes the same view again, and a view started anew on the same folder (``root``,
    with the stream's checkpoint beside it) goes on where the last one stopped.
    """

    def __init__(self, spark: SparkSession, size: int = BUFFER, root: str | None = None) -> None:
        self.spark, self.size, self.root = spark, size, root or scratch_path(spark, "live")

    def _view(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/batch-{number}")

    def merge(self, batch: DataFrame, number: int) -> None:
        before = [n for n in _batches(self.spark, self.root) if n < number]
        rows = batch.unionByName(self._view(before[-1])) if before else batch
        newest(rows, self.size).write.mode("overwrite").parquet(f"{self.root}/batch-{number}")

    def rows(self) -> DataFrame:
        done = _batches(self.spark, self.root)
        if not done:
            raise ValueError("no batch has arrived")
        return self._view(done[-1])


class DuplicateWatch:
    """Marks arriving pages that repeat an earlier one of their audit, exactly or nearly.

    The history holds (audit_id, id, hashes) by hash band and by exact hash; a batch
    joins it by equality on them, so the work follows the number of candidates.  Both
    history and marks are written per batch number: a repeated batch replaces its own.
    Pages without hashes are not compared.
    """

    def __init__(self, spark: SparkSession, distance: int = 3, root: str | None = None) -> None:
        self.spark, self.distance = spark, distance
        root = root or scratch_path(spark, "duplicates")
        self.history, self.found = f"{root}/seen", f"{root}/found"

    def check(self, batch: DataFrame, number: int) -> None:
        near = F.transform(bands(c("sim_hash"), self.distance // 2 + 1), lambda b: F.concat_ws(":", b["part"], b["bits"]))
        keys = F.concat(F.coalesce(near, F.array().cast("array<string>")), F.array(F.concat(F.lit("="), "exact_hash")))
        hashed = batch if "exact_hash" in batch.columns else batch.withColumn("exact_hash", F.lit(None).cast("string"))
        keyed = hashed.select("audit_id", "id", "sim_hash", "exact_hash", F.struct("crawled_at", "id").alias("seq"), F.explode(keys).alias("key")).where("key is not null")
        keyed.write.mode("overwrite").parquet(f"{self.history}/batch-{number}")
        seen = self.spark.read.schema(keyed.schema).parquet(*[f"{self.history}/batch-{n}" for n in _batches(self.spark, self.history) if n <= number])
        a, b = keyed.alias("a"), seen.alias("b")
        hits = a.join(b, (c("a.audit_id") == c("b.audit_id")) & (c("a.key") == c("b.key")) & (c("b.seq") < c("a.seq")) & (c("a.id") != c("b.id")))
        exact = c("a.key").startswith("=")
        hits = hits.where(exact | (hamming(c("a.sim_hash"), c("b.sim_hash")) <= self.distance))
        hits.groupBy(c("a.audit_id").alias("audit_id"), c("a.id").alias("id")).agg(F.max(exact).alias("exact")).write.mode("overwrite").parquet(f"{self.found}/batch-{number}")

    def marks(self) -> DataFrame:
        """(audit_id, id, exact): the pages marked so far."""
        return self.spark.read.parquet(*[f"{self.found}/batch-{n}" for n in _batches(self.spark, self.found)]).distinct()


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/pages.parquet").schema
    # A pattern, because a table may be one file or a folder and a plain path must be a folder.
    return arriving(spark, f"{d}/pages.parque[t]", schema, files_per_batch=4)


def stream_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Running counters after everything has arrived; repeated deliveries count once."""
    to = scratch_path(spark, "statistics")
    run_available(running_statistics(once(_stream(spark, d).select("id", "audit_id", "status_code", "crawled_at"))), lambda b, _: b.write.mode("overwrite").parquet(to), mode="complete")
    return spark.read.parquet(to).select("audit_id", "crawled", "failed")


def stream_page_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues raised page by page on arrival, counted by rule."""
    to = scratch_path(spark, "arrived")
    pages = once(_stream(spark, d).select("id", "audit_id", *FACTS))
    run_available(issues_on_arrival(pages), lambda b, _: b.write.mode("append").parquet(to))
    return spark.read.parquet(to).groupBy("code").agg(F.count(F.lit(1)).alias("n_issues"), F.countDistinct("page_id").alias("n_pages"))


def stream_discovered(spark: SparkSession, d: str) -> DataFrame:
    """Internal link targets in the order they turn up, each canonical URL of an audit once."""
    to = scratch_path(spark, "discovered")
    run_available(discovered_once(_stream(spark, d).select("audit_id", "links")), lambda b, _: b.write.mode("append").parquet(to))
    return spark.read.parquet(to)


def live_buffer(spark: SparkSession, d: str) -> DataFrame:
    """The newest pages of every audit after all batches were merged."""
    live = Live(spark)
    run_available(_stream(spark, d).select("id", "audit_id", "url", "crawled_at"), live.merge)
    return live.rows().select("audit_id", "id", "url")
