"""Streaming: decode, classify, publish, and windowed analysis.

The source is any streaming table with a string column ``value``; Kafka is one
of them. The decode and classify steps are the batch expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logwarden import rules
from logwarden.operators import events as ev
from logwarden.operators.classify import DEFAULT_CASCADE, Cascade
from logwarden.operators.reports import (
    fact_counts, immediate_attention, line_ips, overview, severity_rank, summary_text,
)

MESSAGE = "source string, log_message string, message string, ts timestamp"


def kafka_source(spark: SparkSession, servers: str, topic: str, batch: int | None = None) -> DataFrame:
    """JSON messages of a topic from its latest offset.

    ``batch`` caps the messages per trigger (``rules.STREAM_BATCH`` for reports
    on batches of 50); without it a trigger takes all that is there.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
    )
    raw = (reader.option("maxOffsetsPerTrigger", batch) if batch else reader).load()
    return raw.select(F.col("value").cast("string").alias("value"))


def file_source(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON lines of files that appear in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).schema("value string").text(path)


def decode(stream: DataFrame, schema: str = MESSAGE, value: str = "value") -> DataFrame:
    """Source and message of each record; records without a message are dropped.

    ``message`` stands in only where ``log_message`` is missing, not where it is
    empty.
    """
    rec = stream.select(F.from_json(value, schema).alias("r")).select("r.*")
    others = [c for c in rec.columns if c not in ("source", "log_message", "message")]
    out = rec.select(
        *others,
        F.coalesce("source", F.lit("kafka")).alias("source"),
        F.coalesce("log_message", "message", F.lit("")).alias("log_message"),
    )
    return out.filter(F.col("log_message") != "")


def classify_stream(stream: DataFrame, cascade: Cascade = DEFAULT_CASCADE) -> DataFrame:
    return cascade.classify(stream)


def classification_records(classified: DataFrame) -> DataFrame:
    """One JSON record per line, type ``classification``."""
    rec = F.struct(
        F.lit("classification").alias("type"), F.col("source"), F.col("log_message"),
        F.col("classification").alias("label"), F.col("method"), F.col("confidence"),
    )
    return classified.select(F.to_json(rec).alias("value"))


ANALYSIS_OPTIONS = {"ignoreNullFields": "false"}


def analysis_records(report: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One JSON record per report with events, type ``analysis``."""
    rec = F.struct(
        F.lit("analysis").alias("type"), *[F.col(k) for k in keys], F.col("event_count"), F.col("highest_severity"),
        F.col("requires_immediate_attention").alias("requires_attention"), F.col("summary"),
    )
    return report.filter(F.col("event_count") > 0).select(F.to_json(rec, ANALYSIS_OPTIONS).alias("value"))


def analyze_micro_batch(classified: DataFrame) -> DataFrame:
    """The analysis record of one classified micro-batch (no row if it holds no event)."""
    keyed = classified.withColumn("log_id", F.monotonically_increasing_id())
    return analysis_records(overview(fact_counts(keyed)))


def windowed_analysis(
    classified: DataFrame, window: str = "1 hour", late: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Event count, worst severity, attention flag and summary per tumbling window of event time.

    Unlike a report per poll it does not depend on when records arrive. Lines
    are counted per window and address first and per window then; the state is
    a row per address of each open window, and the watermark closes windows and
    drops them. A window that no later record closes is not given out.
    """
    judged = ev.judge(classified)
    addresses = F.coalesce(line_ips(judged, "log_message"), F.array().cast("array<string>"))
    each = judged.withWatermark(ts, late).select(
        ts, F.col("_event")["severity"].alias("severity"),
        F.explode(F.concat(F.array(F.lit(None).cast("string")), addresses)).alias("ip"),  # NULL stands for the line itself
    )
    line = F.col("ip").isNull()
    level = F.when(line, F.col("severity"))
    counted = (
        each.groupBy(F.window(ts, window), "ip")
        .agg(
            F.count(F.lit(1)).alias("n"), F.count(level).alias("events"), F.min(severity_rank(level)).alias("rank"),
            F.count_if(level == "CRITICAL").alias("c"), F.count_if(level == "HIGH").alias("h"),
        )
        .groupBy("window")
        .agg(
            F.sum(F.when(line, F.col("n"))).alias("total_logs"), F.sum("events").alias("event_count"),
            F.sum("c").alias("critical"), F.sum("h").alias("high"),
            F.count_if(~line & (F.col("n") >= rules.IP_MEDIUM)).alias("ips"),
            F.get(F.array(*[F.lit(s) for s in rules.SEVERITIES]), F.min("rank")).alias("highest_severity"),
        )
    )
    return counted.filter("event_count > 0").select(
        F.col("window.start").alias("window_start"), "total_logs", "event_count", "highest_severity",
        immediate_attention(F.col("highest_severity")).alias("requires_immediate_attention"),
        summary_text(*[F.col(c) for c in ("total_logs", "event_count", "critical", "high", "ips")]).alias("summary"),
    )


def start_files(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "json", once: bool = False, interval: str = "1 second"
) -> StreamingQuery:
    """Write a stream to files; progress lives in the checkpoint, so a restart loses nothing."""
    writer = stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def start_kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str, interval: str = "1 second") -> StreamingQuery:
    """Publish ``value`` records to a topic."""
    return (
        stream.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .start()
    )


Sink = Callable[[DataFrame, int, str], None]  # records (value), number of the micro-batch, type of the records


def file_sink(path: str) -> Sink:
    """A folder per micro-batch and record type; writing it again replaces it."""

    def write(records: DataFrame, number: int, kind: str) -> None:
        records.write.mode("overwrite").text(f"{path}/batch={number}/kind={kind}")

    return write


def kafka_sink(servers: str, topic: str) -> Sink:
    """One topic for all records; each says in its headers which micro-batch and type it is of."""

    def write(records: DataFrame, number: int, kind: str) -> None:
        told = [F.struct(F.lit(k).alias("key"), F.lit(str(v)).cast("binary").alias("value")) for k, v in (("batch", number), ("kind", kind))]
        writer = records.select("value", F.array(*told).alias("headers")).write.format("kafka")
        writer.option("kafka.bootstrap.servers", servers).option("topic", topic).option("includeHeaders", True).save()

    return write


class Commits:
    """Which writes of which micro-batches are done: an empty table per write, in a folder of its own.

    A stream repeats at most its last micro-batch, so tables of earlier ones can be removed at any time.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _table(self, number: int, kind: str) -> str:
        return f"{self.folder}/{number}-{kind}"

    def done(self, spark: SparkSession, number: int, kind: str) -> bool:
        try:
            spark.read.schema("n int").parquet(self._table(number, kind))
        except AnalysisException as why:
            if why.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    def add(self, spark: SparkSession, number: int, kind: str) -> None:
        spark.range(0).select(F.col("id").cast("int").alias("n")).coalesce(1).write.mode("overwrite").parquet(self._table(number, kind))


RECORDS: dict[str, Callable[[DataFrame], DataFrame]] = {"classification": classification_records, "analysis": lambda done: analyze_micro_batch(done)}


def start_publishing(
    decoded: DataFrame, sink: Sink, commits: str, checkpoint: str, once: bool = False, interval: str = "1 second",
    cascade: Cascade = DEFAULT_CASCADE,
) -> StreamingQuery:
    """Both record types of each micro-batch to one sink: classifications, then the batch's analysis.

    What has been written is noted in the folder ``commits``. If a write fails the
    stream stops; started again it repeats the batch, and writes of it that are
    noted are left out. Only a write that ends without its note being made is
    repeated, which a sink that replaces (files) turns into nothing.
    """
    noted = Commits(commits)

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        todo = [kind for kind in RECORDS if not noted.done(spark, number, kind)]
        if not todo:
            return
        done = cascade.classify(batch).persist()
        try:
            for kind in todo:
                sink(RECORDS[kind](done), number, kind)
                noted.add(spark, number, kind)
        finally:
            done.unpersist()

    writer = decoded.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def start_batches(
    decoded: DataFrame, path: str, checkpoint: str, once: bool = False, interval: str = "1 second",
    cascade: Cascade = DEFAULT_CASCADE,
) -> StreamingQuery:
    """Both record types per micro-batch to a folder."""
    return start_publishing(decoded, file_sink(path), f"{checkpoint}-commits", checkpoint, once, interval, cascade)


def start_kafka_batches(
    decoded: DataFrame, servers: str, topic: str, commits: str, checkpoint: str, once: bool = False, interval: str = "1 second",
    cascade: Cascade = DEFAULT_CASCADE,
) -> StreamingQuery:
    """Both record types per micro-batch to one topic."""
    return start_publishing(decoded, kafka_sink(servers, topic), commits, checkpoint, once, interval, cascade)
