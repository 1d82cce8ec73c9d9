"""One query per operator, over the given tables or what Spark derives from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.logs_view import logs, table
from logwarden import rules
from logwarden.functions import entities as ent
from logwarden.functions import formats as fm
from logwarden.functions import privacy as pv
from logwarden.functions.arrays import array_sum, softmax
from logwarden.functions.text import folded, message
from logwarden.operators import anomaly, bundle, calibrate, classify as cl, events as ev, explain, feedback as fb
from logwarden.operators import learn, metrics as mt, reports as rp, robustness as rb
from logwarden.session import stored, tune, work_folder
from logwarden.sources import files, sinks
from logwarden.streaming import jobs, limiter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CUSTOM_PATTERNS = [(r".*sky is \w+ today.*", "Weather"), (r".*job \d+ done.*", "Job Report"), (r".*crash.*", "Crash")]


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        return fn

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return cl.classify(logs(spark, sf))


def found_events(spark: SparkSession, sf: str) -> DataFrame:
    return ev.security_events(classified(spark, sf))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return logs(spark, sf).select("log_id", "source", "log_message")


# --- flagship ---------------------------------------------------------------


@query("flagship_severity_report")
def flagship(spark, sf):
    t = F.col("mitre_technique")["technique_id"]
    return found_events(spark, sf).groupBy("severity", "attack_type", t.alias("technique_id")).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- A: sources and sinks ---------------------------------------------------


@query("a1_csv_scan")
def a1(spark, sf):
    path = work_folder(spark, "csv")
    lines(spark, sf).write.option("header", True).option("escape", '"').csv(path)
    return files.scan_csv(spark, path).select(F.col("log_id").cast("bigint"), "source", "log_message")


@query("a2_text_scan")
def a2(spark, sf):
    path = work_folder(spark, "text")
    lines(spark, sf).select("log_message").write.text(path)
    return files.scan_text(spark, path, source="syslog").select("source", "log_message")


@query("a3_directory_scan")
def a3(spark, sf):
    path = work_folder(spark, "folder")
    some = F.col("source").isin("WebServer", "Syslog")
    lines(spark, sf).filter(some).select("log_message").write.text(f"{path}/lines")
    tables = lines(spark, sf).filter(~some)
    orders = [["log_id", "source", "log_message"], ["log_message", "source"], ["source", "log_id", "log_message"]]
    for i, columns in enumerate(orders):  # files of one folder with headers of their own
        part = tables.filter(F.col("log_id") % len(orders) == i).select(*columns)
        part.write.mode("append").option("header", True).option("escape", '"').csv(f"{path}/tables")
    stem = F.when(F.col("source").startswith("part-"), F.lit("file")).otherwise(F.col("source"))
    return files.scan_directory(spark, path, recursive=True).select(stem.alias("source"), "log_message")


@query("a4_blob_lines")
def a4(spark, sf):
    return files.blob_lines(table(spark, sf, "documents"), "text", ["doc_id"]).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


@query("a5_labelled_csv")
def a5(spark, sf):
    path = work_folder(spark, "labelled")
    logs(spark, sf).drop("ts").write.option("header", True).option("escape", '"').csv(path)
    return files.scan_labelled(spark, path)


@query("a6_hdfs_labels")
def a6(spark, sf):
    return files.label_hdfs(logs(spark, sf).select("log_id", "log_message"), keys=("log_id",))


def alert_lines(spark, sf):
    code = F.when(F.col("log_id") % 2 == 0, F.lit("- ")).otherwise(F.lit("ALERT "))
    return logs(spark, sf).select("log_id", F.concat(code, F.col("log_message")).alias("log_message"))


@query("a7_bgl_labels")
def a7(spark, sf):
    return files.label_alerts(alert_lines(spark, sf), "BGL", keys=("log_id",))


@query("a8_thunderbird_labels")
def a8(spark, sf):
    return files.label_alerts(alert_lines(spark, sf), "Thunderbird", keys=("log_id",))


@query("a9_dataset_lookup")
def a9(spark, sf):
    path = work_folder(spark, "bgl")
    alert_lines(spark, sf).select("log_message").write.text(path)
    return files.load_dataset(spark, "BGL", path)


def json_messages(spark, sf) -> DataFrame:
    """Stream records: no source for HR, key ``message`` for Auth, an empty message for Billing."""
    src, msg = F.col("source"), F.col("log_message")
    rec = F.struct(
        F.when(src != "HR", src).alias("source"),
        F.when(src == "Billing", F.lit("")).when(src != "Auth", msg).alias("log_message"),
        F.when(src.isin("Auth", "Billing"), msg).alias("message"),
        "ts",
    )
    return logs(spark, sf).select(F.to_json(rec).alias("value"))


def stream_of(spark, sf, name: str, messages: DataFrame | None = None, per_trigger: int = 1000) -> tuple[DataFrame, str]:
    base = work_folder(spark, name)
    (json_messages(spark, sf) if messages is None else messages).write.text(f"{base}/in")
    return jobs.file_source(spark, f"{base}/in", per_trigger), base


def drained(spark, stream: DataFrame, base: str) -> DataFrame:
    """Run a stream over what is there and read what it wrote."""
    schema = stream.schema
    jobs.start_files(stream, f"{base}/out", f"{base}/check", "parquet", once=True).awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out")


@query("a10_stream_source")
def a10(spark, sf):
    stream, base = stream_of(spark, sf, "source", lines(spark, sf).select(F.to_json(F.struct("source", "log_message")).alias("value")))
    return drained(spark, jobs.decode(stream).select("source", "log_message"), base)


def feedback_requests(spark, sf) -> DataFrame:
    """Analyst verdicts on the cascade's labels; every thirteenth correction lacks its label."""
    right = F.col("classification") == F.col("target_label")
    return classified(spark, sf).select(
        "log_id", "log_message",
        F.col("classification").alias("predicted_label"),
        F.col("confidence").alias("predicted_confidence"),
        F.when(F.col("source") == "HR", F.lit("")).otherwise(F.col("method")).alias("predicted_method"),
        right.alias("is_correct"),
        F.when(~right & (F.col("log_id") % 13 != 0), F.col("target_label")).alias("correct_label"),
        F.lit("analyst").alias("analyst_id"),
        F.lit("").alias("notes"),
    )


def feedback(spark, sf) -> DataFrame:
    return fb.validate(feedback_requests(spark, sf)).filter("accepted")


@query("a11_feedback_scan")
def a11(spark, sf):
    path = work_folder(spark, "feedback")
    sinks.append_feedback(fb.stamp(feedback(spark, sf)), path)
    return sinks.read_feedback(spark, path).select(
        "log_message", "predicted_label", "predicted_method", "is_correct", "correct_label"
    )


def samples_and_logs(spark, sf) -> DataFrame:
    """The fixed samples and, behind them, the whole log table as further ones."""
    more = logs(spark, sf).select("source", "log_message", F.col("target_label").alias("expected_label"))
    return rb.unseen_samples(spark).drop("ord").unionByName(more)


@query("a12_evaluation_samples")
def a12(spark, sf):
    return samples_and_logs(spark, sf).groupBy("source", "expected_label").agg(F.count(F.lit(1)).alias("n"))


@query("a13_required_columns")
def a13(spark, sf):
    good = files.require_columns(logs(spark, sf), ["source", "log_message", "target_label"])
    return good.groupBy("source").agg(F.count("target_label").alias("n"))


@query("a14_classified_csv")
def a14(spark, sf):
    path = work_folder(spark, "classified")
    sinks.write_classified_csv(lines(spark, sf), path)
    back = files.scan_csv(spark, path)
    return back.select(
        F.col("log_id").cast("bigint"), "source", "log_message", "target_label", "method",
        r6(F.col("confidence").cast("double")).alias("confidence"), "reasoning",
    )


@query("a15_classified_rows")
def a15(spark, sf):
    path = work_folder(spark, "rows")
    sinks.write_classified_rows(lines(spark, sf), path)
    back = files.scan_csv(spark, path)
    return back.select(
        F.col("log_id").cast("bigint"), "source", "log_message", "classification", "method",
        r6(F.col("confidence").cast("double")).alias("confidence"), "entities", "reasoning",
    )


OVERVIEW = [
    "total_logs", "event_count", "suspicious_ip_count", "total_unique_urls", "highest_severity",
    "requires_immediate_attention", "summary",
]


def flat_report(report: DataFrame) -> DataFrame:
    """A nested report with its lists as text."""

    def joined(list_: str, *fields: str, sep: str = ";") -> Column:
        return F.array_join(F.transform(list_, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields]) if fields else x), sep)

    return report.select(
        "source", "event_count", "time_analysis.total_logs", "url_analysis.total_unique_urls", "ip_analysis.suspicious_count",
        "highest_severity", "requires_immediate_attention", "summary",
        joined("ip_analysis.suspicious", "ip", "request_count", "suspicion_level").alias("suspicious"),
        joined("url_analysis.top_urls", "url", "n").alias("top_urls"),
        joined("time_analysis.label_distribution", "label", "n").alias("labels"),
        joined("time_analysis.source_distribution", "source", "n").alias("sources"),
        joined("recommendations", sep="|").alias("recommendations"),
        joined("mitre_coverage", "technique_id", "name", "tactic", "url").alias("techniques"),
    )


def full_analysis(spark, sf) -> rp.Analysis:
    done = classified(spark, sf)
    facts = stored(rp.fact_counts(done, ("source",)), "facts")
    return rp.analyze(done, ("source",), facts=facts, lines=logs(spark, sf))


@query("a16_analysis_json")
def a16(spark, sf):
    analysis = full_analysis(spark, sf)
    folder = sinks.write_analysis_json(analysis, work_folder(spark, "analysis"))
    return flat_report(spark.read.schema(analysis.report.schema).json(f"{folder}/report"))


@query("a16_analysis_tables")
def a16_tables(spark, sf):
    """Rows and keys of the tables that are written beside the reports."""
    analysis = full_analysis(spark, sf)
    folder = sinks.write_analysis_json(analysis, work_folder(spark, "analysis"))
    counts = None
    for name in sinks.LONG_TABLES:
        rows = spark.read.schema(getattr(analysis, name).schema).json(f"{folder}/{name}")
        mine = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name))
        counts = mine if counts is None else counts.unionByName(mine)
    return counts


RECORD = (
    "type string, source string, log_message string, label string, method string, confidence double, "
    "event_count bigint, highest_severity string, requires_attention boolean, summary string"
)


@query("a17_stream_sink")
def a17(spark, sf):
    stream, base = stream_of(spark, sf, "sink")
    jobs.start_batches(jobs.decode(stream), f"{base}/out", f"{base}/check", once=True).awaitTermination()
    out = spark.read.option("recursiveFileLookup", True).text(f"{base}/out")
    rec = out.select(F.from_json("value", RECORD).alias("r")).select("r.*")
    return rec.withColumn("confidence", r6("confidence"))


@query("a17_failing_sink")
def a17_failing(spark, sf):
    """The sink fails once, between its two writes; the stream is started again."""
    stream, base = stream_of(spark, sf, "failing")
    write, failed = jobs.file_sink(f"{base}/out"), []

    def sink(records: DataFrame, number: int, kind: str) -> None:
        if kind == "analysis" and not failed:
            failed.append(number)
            raise ConnectionError("the sink is gone")
        # a folder of its own for every call: a write that comes twice would show
        write(records, number, f"{kind}-{uuid.uuid4().hex}")

    for _ in range(2):
        running = jobs.start_publishing(jobs.decode(stream), sink, f"{base}/commits", f"{base}/check", once=True)
        try:
            running.awaitTermination()
        except StreamingQueryException:
            pass
    if not failed:
        raise AssertionError("the sink has not failed")
    out = spark.read.option("recursiveFileLookup", True).text(f"{base}/out")
    rec = out.select(F.from_json("value", RECORD).alias("r")).select("r.*")
    return rec.withColumn("confidence", r6("confidence"))


@query("a18_feedback_append")
def a18(spark, sf):
    path = work_folder(spark, "append")
    rows = fb.stamp(feedback(spark, sf))
    sinks.append_feedback(rows.filter("is_correct"), path)
    sinks.append_feedback(rows.filter("NOT is_correct"), path)
    return sinks.read_feedback(spark, path).groupBy("is_correct", "analyst_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids")
    )


@query("a19_feedback_clear")
def a19(spark, sf):
    path = work_folder(spark, "clear")
    sinks.append_feedback(fb.stamp(feedback(spark, sf)), path)
    before = stored(sinks.read_feedback(spark, path).agg(F.count(F.lit(1)).alias("n_before")), "before")
    sinks.clear_feedback(spark, path)
    after = sinks.read_feedback(spark, path).agg(F.count(F.lit(1)).alias("n_after"))
    return before.select("n_before", F.lit(after.first()["n_after"]).cast("bigint").alias("n_after"))


# --- B: formats -------------------------------------------------------------

FORMATS = fm.DEFAULT_FORMATS


@query("b1_detect_format")
def b1(spark, sf):
    return logs(spark, sf).select("log_id", FORMATS.detect("log_message").alias("log_type"))


@query("b2_detect_batch")
def b2(spark, sf):
    return FORMATS.batch_types(logs(spark, sf), ["source"], ["log_id"])


def parsed_as(name: str, fields: list[str]) -> Query:
    def run(spark, sf):
        cols = [
            F.array_join(F.col("parsed.block_ids"), ",").alias(f) if f == "block_ids" else F.col(f"parsed.{f}").alias(f)
            for f in fields
        ]
        return FORMATS.parse_batch(logs(spark, sf), name).select("log_id", *cols)

    return run


PARSE_FIELDS = {
    "b3_parse_web": (
        "web_server",
        ["ip_address", "timestamp", "request", "http_method", "url", "protocol", "status_code", "bytes_sent", "raw"],
    ),
    "b4_parse_syslog": ("syslog", ["timestamp", "hostname", "process", "message", "raw"]),
    "b5_parse_security": ("security", ["timestamp", "hostname", "service", "message", "raw"]),
    "b6_parse_hdfs": ("hdfs", ["date", "time", "process_id", "level", "component", "message", "block_ids", "raw"]),
    "b7_parse_openstack": ("openstack", ["component", "process_id", "level", "name", "message", "raw"]),
    "b8_parse_generic": ("generic", ["raw"]),
}
for _name, (_kind, _fields) in PARSE_FIELDS.items():
    query(_name)(parsed_as(_kind, _fields))


@query("b9_parse_batches")
def b9(spark, sf):
    done = FORMATS.parse_batches(logs(spark, sf), ["source"], ["log_id"])
    return done.select("log_id", "log_type", "parsed.timestamp", "parsed.hostname", "parsed.message", "parsed.raw")


@query("b10_parse_each_line")
def b10(spark, sf):
    done = FORMATS.parse_lines(logs(spark, sf))
    return done.select(
        "log_id", "log_type", "parsed.timestamp", "parsed.hostname", "parsed.process_id", "parsed.component",
        "parsed.message", "parsed.status_code", "parsed.raw",
    )


@query("b11_custom_format")
def b11(spark, sf):
    usage = fm.FormatSpec(
        "usage",
        lambda line: F.col(line).rlike(r"^\w+ usage at \d+ percent"),
        lambda line: fm.parsed_struct(line, level=f"regexp_extract({line}, 'at ([0-9]+) percent', 1)"),
    )
    done = FORMATS.register(usage).parse_lines(logs(spark, sf))
    return done.select("log_id", "log_type", "parsed.level", "parsed.raw")


# --- C: entities ------------------------------------------------------------


def scalar(name: str, make: Callable[[str], Column], alias: str) -> None:
    query(name)(lambda spark, sf: logs(spark, sf).select("log_id", make("log_message").alias(alias)))


scalar("c1_ips", lambda c: F.array_join(ent.ip_addresses(c), ","), "ips")
scalar("c2_url", ent.url, "url")
scalar("c3_http_method", ent.http_method, "http_method")
scalar("c4_status_code", ent.status_code, "status_code")
scalar("c5_username", ent.username, "username")


@query("c6_all_entities")
def c6(spark, sf):
    found = logs(spark, sf).withColumn("e", ent.entities("log_message"))
    return found.select(
        "log_id", F.array_join("e.ip_addresses", ",").alias("ips"), "e.http_method", "e.status_code", "e.username", "e.url"
    )


# --- D: classification ------------------------------------------------------


def folded_logs(spark, sf) -> DataFrame:
    return logs(spark, sf).withColumn("fold", folded(message("log_message")))


@query("d1_pattern_tier")
def d1(spark, sf):
    label = cl.pattern_label("log_message", "fold")
    return folded_logs(spark, sf).select("log_id", label.alias("label")).withColumn(
        "confidence", F.when(F.col("label").isNotNull(), 1.0).otherwise(0.0)
    )


@query("d2_custom_patterns")
def d2(spark, sf):
    return folded_logs(spark, sf).select("log_id", cl.pattern_label("log_message", "fold", CUSTOM_PATTERNS).alias("label"))


def keyword_rows(spark, sf) -> DataFrame:
    low = logs(spark, sf).withColumn("low", F.lower(message("log_message")))
    return low.withColumn("k", cl.keyword_decision("low"))


@query("d3_keyword_tier")
def d3(spark, sf):
    return keyword_rows(spark, sf).select("log_id", F.col("k.category").alias("label"), r6("k.confidence").alias("confidence"))


@query("d4_keyword_reasoning")
def d4(spark, sf):
    return keyword_rows(spark, sf).select(
        "log_id", "k.category", r6("k.confidence").alias("confidence"), "k.reasoning", "k.raw_response"
    )


@query("d5_completion_parse")
def d5(spark, sf):
    tagged = F.concat(
        F.lit("<category> "), F.col("target_label"), F.lit(" </category>\n<reasoning>r"),
        F.col("log_id").cast("string"), F.lit("\nend </reasoning>"),
    )
    text = F.when(F.col("log_id") % 7 == 0, F.col("target_label")).otherwise(tagged)
    done = logs(spark, sf).select("log_id", cl.parse_completion(text).alias("k"))
    return done.select("log_id", "k.category", r6("k.confidence").alias("confidence"), "k.reasoning")


@query("d6_prompt")
def d6(spark, sf):
    return logs(spark, sf).select("log_id", cl.prompt("log_message").alias("prompt"))


@query("d7_text_features")
def d7(spark, sf):
    from pyspark.ml.functions import vector_to_array

    done = learn.embed_text(lines(spark, sf), size=256)
    weights = F.filter(vector_to_array("features"), lambda x: x != 0)
    return done.select("log_id", F.size(weights).cast("bigint").alias("terms"), r6(array_sum(weights)).alias("weight"))


def embedding_model(spark, sf) -> tuple[DataFrame, learn.TextModel]:
    rows = stored(learn.vectors(table(spark, sf, "embeddings")).select("vec_id", "label", "embedding", "features"), "vectors")
    return rows, learn.train(rows, "label")


@query("d8_model_tier")
def d8(spark, sf):
    rows, model = embedding_model(spark, sf)
    done = model.predict(rows)
    v = cl.probability_verdict(F.col("probabilities"), model.classes)
    return done.select("vec_id", v.alias("v")).select("vec_id", "v.label", r6("v.confidence").alias("confidence"))


@query("d9_hybrid_cascade")
def d9(spark, sf):
    return classified(spark, sf).select(
        "log_id", "source", "classification", "method", r6("confidence").alias("confidence"), "reasoning",
        F.array_join("entities.ip_addresses", ",").alias("ips"), "entities.username", "entities.url",
    )


@query("d9_all_three_tiers")
def d9_all(spark, sf):
    """Patterns, a fitted text model on what they leave, keywords on what the model declines."""
    rows, model = log_model(spark, sf)
    cascade = cl.Cascade([cl.pattern_tier(), cl.model_tier(model.model, model.classes), cl.keyword_tier()], entities=None)
    done = cascade.classify(rows.select("log_id", "log_message"))
    alone = model.predict(rows.select("log_id", "log_message")).select(F.col("log_id").alias("id"), "predicted", F.array_max("probabilities").alias("sure"))
    done = done.join(alone, F.col("log_id") == F.col("id"))
    sure = F.col("sure") >= rules.MODEL_THRESHOLD
    model_right = (F.col("classification") == F.col("predicted")) & (F.abs(F.col("confidence") - F.col("sure") + 0.05) < 1e-9)
    regex = F.col("method") == "regex"
    return done.select(
        "log_id", F.when(regex, F.col("classification")).alias("pattern_label"),
        F.when(regex, True).when(sure, (F.col("method") == "bert") & model_right).otherwise(F.col("method") == "llm").alias("as_expected"),
    )


@query("k3_custom_entities")
def k3(spark, sf):
    """An entity function of one's own: sums of digits in place of addresses."""

    def entities(text: str, fold: str) -> Column:
        numbers = F.regexp_extract_all(F.col(text), F.lit(r"\d+"), F.lit(0))
        return F.struct(F.size(numbers).alias("numbers"), F.length(fold).alias("length"))

    done = cl.Cascade([cl.pattern_tier()], entities=entities).classify(lines(spark, sf))
    return done.select("log_id", F.col("entities.numbers").cast("bigint").alias("numbers"), F.col("entities.length").cast("bigint").alias("length"))


@query("k5_completion_function")
def k5(spark, sf):
    """A completion function of one's own on the lines that no pattern decides; it falls over on some of them."""

    def complete(prompts: pd.Series) -> pd.Series:
        if prompts.str.contains("percent").any():
            raise TimeoutError("no answer")
        return "<category>" + prompts.str.contains("job").map({True: "Workflow Error", False: "HTTP Status"}) + "</category>"

    done = cl.Cascade([cl.pattern_tier(), cl.completion_tier(complete), cl.keyword_tier()], entities=None).classify(lines(spark, sf))
    return done.select("log_id", "classification", "method", r6("confidence").alias("confidence"))


def labels_of(df: DataFrame) -> DataFrame:
    return df.select("log_id", "classification", "method", r6("confidence").alias("confidence"), "reasoning")


@query("d10_custom_tiers")
def d10(spark, sf):
    return labels_of(cl.Cascade([cl.pattern_tier(CUSTOM_PATTERNS), cl.keyword_tier()]).classify(logs(spark, sf)))


@query("d11_failing_tier")
def d11(spark, sf):
    def broken(messages: pd.Series) -> pd.DataFrame:
        raise RuntimeError("tier is down")

    tiers = [cl.pattern_tier(), cl.BatchTier("bert", broken), cl.keyword_tier()]
    return labels_of(cl.Cascade(tiers).classify(logs(spark, sf)))


@query("d12_fallback")
def d12(spark, sf):
    return labels_of(cl.Cascade([cl.pattern_tier(), cl.model_tier()]).classify(logs(spark, sf)))


@query("d13_reasoning")
def d13(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        *[cl.reasoning(m, F.round(F.col("value") / 500, 3) + 0.0001).alias(f"said_{m}") for m in rules.METHODS],
    )


@query("d14_confidence_shift")
def d14(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        *[r6(cl.adjust_confidence(F.col("value") / 500, m)).alias(f"by_{m}") for m in [*rules.METHODS, "other"]],
    )


@query("d15_platt_scaling")
def d15(spark, sf):
    """Scored on rows that neither the model nor its calibration has seen."""
    rows = learn.vectors(table(spark, sf, "embeddings")).select("vec_id", "label", "features")
    _, _, done = learn.calibrated_holdout(rows, "label", "vec_id")
    total = array_sum(F.col("calibrated"))
    inside = F.forall("calibrated", lambda p: (p >= 0) & (p <= 1))
    return done.groupBy("label").agg(F.count(F.lit(1)).alias("scored"), F.count_if((F.abs(total - 1) < 1e-9) & inside).alias("sound"))


def logits(spark, sf) -> DataFrame:
    """Ten numbers per vector: the sums of every tenth component, so that all components count."""

    def one(k: Column) -> Column:
        tenths = F.filter("embedding", lambda x, i: i % 10 == k)
        return F.aggregate(tenths, F.lit(0.0), lambda acc, x: acc + x.cast("double")) * 10 + F.when(k == F.col("label"), 2.0).otherwise(0.0)

    ten = F.transform(F.sequence(F.lit(0), F.lit(9)), one)
    return table(spark, sf, "embeddings").select("vec_id", "label", ten.alias("logits"))


@query("d16_temperature_softmax")
def d16(spark, sf):
    p = logits(spark, sf).select("vec_id", F.posexplode(softmax(F.col("logits"), 1.5)).alias("class", "p"))
    return p.select("vec_id", F.col("class").cast("bigint").alias("class"), r6("p").alias("p"))


@query("d17_temperature_losses")
def d17_losses(spark, sf):
    return calibrate.temperature_losses(logits(spark, sf), "logits", "label").select(
        F.round("temperature", 1).alias("temperature"), r6("loss").alias("loss")
    )


@query("d17_temperature_fit")
def d17(spark, sf):
    return calibrate.fit_temperature(logits(spark, sf), "logits", "label").select(
        F.round("temperature", 1).alias("temperature"), r6("loss").alias("loss")
    )


@query("d18_forest_fit")
def d18(spark, sf):
    rows = table(spark, sf, "embeddings")
    samples = anomaly.tree_samples(
        rows.select("vec_id", "embedding"), "vec_id", rows.count(), rules.FOREST_TREES, rules.FOREST_SAMPLE, rules.FOREST_SEED
    )
    nodes = anomaly.grow_trees(samples, "embedding", rules.FOREST_SAMPLE, rules.FOREST_SEED)
    return nodes.groupBy("tree").agg(
        F.count(F.lit(1)).alias("nodes"), F.max("depth").cast("bigint").alias("depth"), F.max("size").alias("rows")
    )


@query("d19_anomaly_scores")
def d19(spark, sf):
    rows = table(spark, sf, "embeddings")
    done = anomaly.score_anomalies(rows, anomaly.fit_forest(rows))
    return done.select("vec_id", "is_anomaly", r6("anomaly_score").alias("anomaly_score"))


@query("d20_anomaly_tier")
def d20(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("log_message", F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
    tiers = [cl.pattern_tier(), anomaly.anomaly_tier(anomaly.fit_forest(rows)), cl.keyword_tier()]
    done = cl.Cascade(tiers, entities=None).classify(rows)
    return done.select("vec_id", "classification", "method", r6("confidence").alias("confidence"))


@query("d18_tree_rows")
def d18_rows(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    samples = anomaly.tree_samples(rows, "vec_id", rows.count(), rules.FOREST_TREES, rules.FOREST_SAMPLE, rules.FOREST_SEED)
    return samples.groupBy(F.col("tree").cast("bigint").alias("tree")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("vec_id").alias("ids"))


@query("d19_outlier_share")
def d19_share(spark, sf):
    """As many outliers as the set share, within the quantile's error; scores are 0 for inliers and between 0 and 1 for outliers."""
    rows = table(spark, sf, "embeddings")
    done = anomaly.score_anomalies(rows, anomaly.fit_forest(rows))
    found, n, score = F.count_if("is_anomaly"), F.count(F.lit(1)), F.col("anomaly_score")
    alike = F.when(F.col("is_anomaly"), (score > 0) & (score <= 1)).otherwise(score == 0)
    return done.agg(n.alias("rows"), (F.abs(found - rules.FOREST_CONTAMINATION * n) <= 2 + n / 10_000).alias("as_many_as_set"), F.bool_and(alike).alias("scored_alike"))


@query("d20_tier_agrees")
def d20_agrees(spark, sf):
    """The anomaly tier labels what the batch scores flag, with the score less its adjustment."""
    rows = table(spark, sf, "embeddings").withColumn("log_message", F.lit("vector"))
    forest = anomaly.fit_forest(rows)
    done = cl.Cascade([cl.pattern_tier(), anomaly.anomaly_tier(forest), cl.keyword_tier()], entities=None).classify(anomaly.score_anomalies(rows, forest))
    found = F.col("classification") == "Anomaly"
    sure = F.greatest(F.lit(0.0), F.col("anomaly_score") - 0.05)
    return done.select("vec_id", ((found == F.col("is_anomaly")) & F.when(found, F.abs(F.col("confidence") - sure) < 1e-9).otherwise(True)).alias("agrees"))


# --- E: events and reports --------------------------------------------------


@query("e1_event_filter")
def e1(spark, sf):
    return ev.extract_events(classified(spark, sf)).select("log_id", "event_type")


@query("e2_attack_signature")
def e2(spark, sf):
    return ev.extract_events(classified(spark, sf)).select("log_id", "attack_type", "severity")


@query("e3_event_columns")
def e3(spark, sf):
    return ev.extract_events(classified(spark, sf)).select(
        "log_id", "event_type", "log_message", "severity", r6("confidence").alias("confidence"),
        F.array_join("source_ips", ",").alias("source_ips"), "url_pattern", "attack_type", "http_method", "status_code",
        "username", "requires_attention",
    )


@query("e4_root_cause")
def e4(spark, sf):
    return ev.add_root_cause(ev.extract_events(classified(spark, sf))).select("log_id", "root_cause")


@query("e5_technique_lookup")
def e5(spark, sf):
    done = ev.add_technique(ev.extract_events(classified(spark, sf)))
    return done.select("log_id", "attack_type", "mitre_technique.*")


@query("e6_technique_coverage")
def e6(spark, sf):
    return ev.technique_coverage(found_events(spark, sf))


@query("e7_technique_catalogue")
def e7(spark, sf):
    seen = found_events(spark, sf).groupBy("attack_type").agg(F.count(F.lit(1)).alias("n"))
    return ev.technique_catalogue(spark).join(seen, "attack_type", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("e8_recommendation")
def e8(spark, sf):
    return ev.add_recommendation(ev.extract_events(classified(spark, sf))).select("log_id", "recommendation")


@query("e9_distinct_recommendations")
def e9(spark, sf):
    return ev.distinct_recommendations(found_events(spark, sf))


@query("e10_ip_frequency")
def e10(spark, sf):
    return rp.ip_frequency(logs(spark, sf))


@query("e11_suspicious_ips")
def e11(spark, sf):
    return rp.suspicious_ips(rp.ip_frequency(logs(spark, sf)))


@query("e12_top_urls")
def e12(spark, sf):
    top = rp.top_urls(rp.url_counts(logs(spark, sf), ent.url("log_message")))
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query("e12_top_page_urls")
def e12_pages(spark, sf):
    top = rp.top_urls(rp.url_counts(table(spark, sf, "pages"), F.col("url"), order="page_id"))
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query("e13_unique_urls")
def e13(spark, sf):
    return rp.unique_urls(logs(spark, sf), ent.url("log_message"))


@query("e13_unique_urls_sketch")
def e13_sketch(spark, sf):
    """Distinct paths per source and over all, from sketches that merge, within 5 % of the exact numbers."""
    each = logs(spark, sf).select("source", rp.url_path(ent.url("log_message")).alias("path"))
    sketches = stored(rp.url_sketches(each, ("source",)), "sketches")
    exact = each.groupBy("source").agg(F.countDistinct("path").alias("exact"))
    parts = rp.sketched_urls(sketches, ("source",)).join(exact, "source")
    whole = rp.sketched_urls(sketches).crossJoin(each.agg(F.countDistinct("path").alias("exact"))).withColumn("source", F.lit("all"))
    done = parts.unionByName(whole)
    return done.select("source", F.col("exact"), (F.abs(F.col("unique_urls") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


@query("e14_suspicious_urls")
def e14(spark, sf):
    return rp.suspicious_urls(logs(spark, sf), ent.url("log_message"), ["log_id"])


@query("e14_suspicious_page_urls")
def e14_pages(spark, sf):
    return rp.suspicious_urls(table(spark, sf, "pages"), F.col("url"), ["page_id"])


@query("e15_label_distribution")
def e15(spark, sf):
    return rp.distribution(classified(spark, sf), "classification")


@query("e16_source_distribution")
def e16(spark, sf):
    return rp.distribution(logs(spark, sf), "source")


@query("e17_highest_severity")
def e17(spark, sf):
    judged = ev.judge(classified(spark, sf))
    return judged.groupBy("source").agg(rp.highest_severity(F.col("_event.severity")).alias("highest_severity"))


@query("e18_immediate_attention")
def e18(spark, sf):
    judged = ev.judge(classified(spark, sf))
    worst = judged.groupBy("target_label").agg(rp.highest_severity(F.col("_event.severity")).alias("worst"))
    return worst.select("target_label", rp.immediate_attention(F.col("worst")).alias("requires_immediate_attention"))


@query("e19_summary")
def e19(spark, sf):
    return rp.overview(rp.fact_counts(classified(spark, sf))).select("summary")


@query("e20_full_analysis")
def e20(spark, sf):
    return rp.analyze(classified(spark, sf), ("source",)).overview.select("source", *OVERVIEW)


@query("e20_report")
def e20_report(spark, sf):
    return flat_report(rp.report_rows(rp.fact_counts(classified(spark, sf), ("source",)), ("source",)))


@query("e20_events")
def e20_events(spark, sf):
    done = full_analysis(spark, sf).events
    return done.select("log_id", "source", "event_type", "severity", "attack_type", "root_cause", "mitre_technique.technique_id", "recommendation")


def analysis_table(name: str) -> None:
    @query(f"e20_{name}")
    def one(spark, sf):
        return getattr(full_analysis(spark, sf), name)


for _name in ("ip_frequency", "suspicious_ips", "top_urls", "suspicious_patterns", "label_distribution", "recommendations", "technique_coverage"):
    analysis_table(_name)


@query("e21_input_info")
def e21(spark, sf):
    return rp.input_info(logs(spark, sf), FORMATS.detect("first_line"), by=("source",))


# --- F: privacy -------------------------------------------------------------


def spans(df: DataFrame, key: str, text: str, patterns=None) -> DataFrame:
    each = df.select(key, F.posexplode(pv.pii_spans(text, patterns)).alias("pos", "s"))
    return each.select(key, "s.pii_type", "s.value", F.col("s.start").cast("bigint").alias("start"),
                       F.col("s.end").cast("bigint").alias("end"), "s.replacement")


@query("f1_pii_spans")
def f1(spark, sf):
    return spans(table(spark, sf, "documents"), "doc_id", "text")


@query("f2_mask_documents")
def f2(spark, sf):
    return pv.mask_column(table(spark, sf, "documents").select("doc_id", "text"), "text")


@query("f3_mask_logs")
def f3(spark, sf):
    return pv.mask_column(logs(spark, sf).select("log_id", "log_message"), "log_message")


@query("f4_pii_audit")
def f4(spark, sf):
    done = pv.audit(table(spark, sf, "documents").select("doc_id", "text"), "text")
    where = F.transform(
        "audit.details",
        lambda d: F.concat_ws(":", d["type"], d["start"].cast("string"), d["end"].cast("string"), d["replacement"]),
    )
    return done.select(
        "doc_id", F.col("audit.original_length").cast("bigint").alias("original_length"),
        F.col("audit.pii_found").cast("bigint").alias("pii_found"),
        F.array_join("audit.pii_types", ",").alias("pii_types"), F.array_join(where, ";").alias("details"),
    )


@query("f5_mask_ips")
def f5(spark, sf):
    return pv.mask_column(logs(spark, sf).select("log_id", "log_message"), "log_message", pv.pii_patterns(mask_ips=True))


@query("f6_custom_pattern")
def f6(spark, sf):
    custom = [("user_id", r"\bu\d+\b", "[USER_REDACTED]")]
    return pv.mask_column(
        logs(spark, sf).select("log_id", "log_message"), "log_message", pv.pii_patterns(custom=custom)
    )


@query("f7_mask_events")
def f7(spark, sf):
    return pv.mask_events(found_events(spark, sf)).select("log_id", "log_message", "root_cause", "username", "url_pattern")


@query("f8_pii_totals")
def f8(spark, sf):
    return pv.audit_totals(table(spark, sf, "documents"), "text", pv.pii_patterns(mask_ips=True))


# --- G: feedback ------------------------------------------------------------


@query("g1_validate_feedback")
def g1(spark, sf):
    return fb.validate(feedback_requests(spark, sf)).select("log_id", "accepted", "error")


@query("g2_corrections")
def g2(spark, sf):
    return fb.corrections(feedback(spark, sf)).select("log_id", "predicted_label", "correct_label")


@query("g3_feedback_stats")
def g3(spark, sf):
    return fb.stats(feedback(spark, sf))


@query("g4_feedback_by_method")
def g4(spark, sf):
    return fb.stats_by_method(feedback(spark, sf))


@query("g5_training_rows")
def g5(spark, sf):
    return fb.training_rows(feedback(spark, sf))


# --- H: evaluation ----------------------------------------------------------

AVERAGES = [
    "accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted"
]


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[r6(c).alias(c) for c in AVERAGES], "total_samples")


def label_pairs(spark, sf) -> DataFrame:
    return mt.pair_counts(classified(spark, sf), "target_label", "classification")


@query("h1_accuracy")
def h1(spark, sf):
    return mt.accuracy(label_pairs(spark, sf)).select(r6("accuracy").alias("accuracy"), "total_samples")


@query("h2_label_domain")
def h2(spark, sf):
    return mt.label_domain(classified(spark, sf), "target_label", "classification")


@query("h3_confusion_matrix")
def h3(spark, sf):
    return mt.confusion_matrix(label_pairs(spark, sf))


@query("h4_class_report")
def h4(spark, sf):
    done = mt.class_report(label_pairs(spark, sf))
    return done.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("h5_averages")
def h5(spark, sf):
    return rounded(mt.evaluate(classified(spark, sf), "target_label", "classification"))


@query("h5_document_labels")
def h5_documents(spark, sf):
    return rounded(mt.evaluate(table(spark, sf, "labels"), "quality", "toxic"))


def approaches() -> dict[str, cl.Cascade]:
    pattern, model, keyword = cl.pattern_tier(), cl.model_tier(), cl.keyword_tier()
    tiers = [[pattern], [model], [keyword], [pattern, model, keyword]]
    return {name: cl.Cascade(t, entities=None) for name, t in zip(rules.APPROACHES, tiers)}


@query("h6_compare_approaches")
def h6(spark, sf):
    done = mt.compare_approaches(logs(spark, sf), approaches(), by=("source",))
    return rounded(done, "source", "approach")


@query("h7_cross_domain")
def h7(spark, sf):
    return rounded(mt.evaluate(classified(spark, sf), "target_label", "classification", ("source",)), "source")


@query("h7_method_distribution")
def h7_methods(spark, sf):
    return mt.method_distribution(classified(spark, sf), ("source",))


@query("h8_unseen_by_source")
def h8(spark, sf):
    return rb.unseen_by_source(rb.unseen_details(samples_and_logs(spark, sf)))


@query("h8_unseen_details")
def h8_details(spark, sf):
    return rb.unseen_details(samples_and_logs(spark, sf)).withColumn("confidence", r6("confidence"))


@query("h8_unseen_metrics")
def h8_metrics(spark, sf):
    return rounded(rb.unseen_metrics(rb.unseen_details(samples_and_logs(spark, sf))))


@query("h9_few_shot_metrics")
def h9(spark, sf):
    more = logs(spark, sf).select("source", "log_message", F.col("target_label").alias("expected_label"))
    chosen = rb.few_shot_samples(spark).drop("ord").unionByName(more)
    return rounded(rb.unseen_metrics(rb.unseen_details(chosen)))


def alerts(spark, sf) -> DataFrame:
    return logs(spark, sf).filter("target_label = 'Security Alert'").select("log_id", "log_message")


def benign(spark, sf) -> DataFrame:
    return logs(spark, sf).filter("target_label <> 'Security Alert'").select("log_id", "log_message")


@query("h10_evasion_variants")
def h10(spark, sf):
    return rb.evasion_attacks(alerts(spark, sf))


@query("h11_evasion_results")
def h11(spark, sf):
    return rb.evasion_results(alerts(spark, sf)).select("log_id", "attack", "original_label", "poisoned_label", "passed")


@query("h12_injection_results")
def h12(spark, sf):
    done = rb.alert_expected(rb.injection_attacks(alerts(spark, sf)), expected=True)
    return done.withColumn("confidence", r6("confidence"))


@query("h13_label_flip_results")
def h13(spark, sf):
    return rb.alert_expected(rb.flip_attacks(benign(spark, sf)), expected=False).drop("confidence")


@query("h14_robustness_summary")
def h14(spark, sf):
    return rb.suite_summary(
        {
            "evasion": rb.evasion_results(alerts(spark, sf)),
            "prompt_injection": rb.alert_expected(rb.injection_attacks(alerts(spark, sf)), expected=True),
            "label_flipping": rb.alert_expected(rb.flip_attacks(benign(spark, sf)), expected=False),
        }
    )


@query("h15_train")
def h15(spark, sf):
    """A model fitted on three folds of five, measured on the last."""
    rows = learn.vectors(table(spark, sf, "embeddings")).select("vec_id", "label", "features")
    _, _, done = learn.calibrated_holdout(rows, "label", "vec_id")
    return rounded(mt.evaluate(done.withColumn("truth", F.col("label").cast("string")), "truth", "predicted"))


@query("h16_cross_validation")
def h16(spark, sf):
    rows = learn.vectors(table(spark, sf, "embeddings")).select("vec_id", "label", "features")
    scores = learn.cross_validate(rows, "label", "vec_id")
    return learn.cross_validation_summary(scores).select(r6("f1_macro_mean").alias("f1_macro_mean"), r6("f1_macro_std").alias("f1_macro_std"))


@query("h16_fold_sizes")
def h16_folds(spark, sf):
    folds = learn.assign_folds(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id")
    return folds.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("h17_split_sizes")
def h17_sizes(spark, sf):
    parts = learn.assign_split(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id")
    return parts.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"))


@query("h17_holdout_report")
def h17(spark, sf):
    rows = learn.vectors(table(spark, sf, "embeddings")).select("vec_id", "label", "features")
    done = learn.holdout_report(rows, "label", "vec_id")
    return done.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


# --- I: explanation ---------------------------------------------------------


def log_model(spark, sf) -> tuple[DataFrame, learn.TextModel]:
    rows = stored(logs(spark, sf).select("log_id", "log_message", "target_label"), "training")
    return rows, learn.train(rows, "target_label", learn.text_features(size=1024))


@query("a20_saved_model")
def a20(spark, sf):
    """Models saved and loaded by their folder alone decide every row as before."""
    rows, model = embedding_model(spark, sf)
    forest = anomaly.fit_forest(rows)
    path = work_folder(spark, "models")
    bundle.Bundle(model, None, forest).save(spark, path)
    again = bundle.Bundle.load(spark, path)
    before = anomaly.score_anomalies(model.predict(rows), forest)
    after = anomaly.score_anomalies(again.model.predict(rows), again.forest).select(
        F.col("vec_id").alias("id"), F.col("predicted").alias("p"), F.col("is_anomaly").alias("a")
    )
    same = before.join(after, F.col("vec_id") == F.col("id"))
    return same.select("vec_id", (F.col("predicted") == F.col("p")).alias("same_label"), (F.col("is_anomaly") == F.col("a")).alias("same_anomaly"))


@query("i1_word_importance")
def i1(spark, sf):
    rows, model = log_model(spark, sf)
    return explain.explain_words(rows, model).withColumn("confidence", r6("confidence"))


@query("i1_forms_agree")
def i1_forms(spark, sf):
    """The fast form against scoring every shortened text, word by word."""
    rows, model = log_model(spark, sf)
    fast = explain.explain_words(rows, model)
    slow = explain.explain_masked(rows, model.predict, model.classes)
    both = fast.alias("f").join(slow.alias("s"), ["log_id", "pos"], "full")
    same = (F.col("f.word") == F.col("s.word")) & (F.col("f.predicted_label") == F.col("s.predicted_label"))
    same &= F.abs(F.col("f.importance") - F.col("s.importance")) < 0.00011  # both are rounded to 4 places
    return both.agg(F.count(F.lit(1)).alias("words"), F.count_if(~F.coalesce(same, F.lit(False))).alias("differing"))


@query("i2_top_words")
def i2(spark, sf):
    rows, model = log_model(spark, sf)
    return explain.explain_batch(rows, model, n=10).withColumn("confidence", r6("confidence"))


@query("i3_explain_batch")
def i3(spark, sf):
    rows, model = log_model(spark, sf)
    return explain.explain_batch(rows, model).withColumn("confidence", r6("confidence"))


# --- J: streaming -----------------------------------------------------------


@query("j1_stream_decode")
def j1(spark, sf):
    stream, base = stream_of(spark, sf, "decode")
    return drained(spark, jobs.decode(stream).select("source", "log_message"), base)


@query("j2_stream_classify")
def j2(spark, sf):
    stream, base = stream_of(spark, sf, "classify")
    done = jobs.classify_stream(jobs.decode(stream)).select("source", "log_message", "classification", "method", "confidence")
    return drained(spark, done, base).withColumn("confidence", r6("confidence"))


@query("j3_windowed_analysis")
def j3(spark, sf):
    whole = logs(spark, sf).select(F.to_json(F.struct("source", "log_message", "ts")).alias("value"))
    stream, base = stream_of(spark, sf, "windows", whole)
    report = jobs.windowed_analysis(jobs.classify_stream(jobs.decode(stream)))
    return drained(spark, report, base).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("j4_micro_batches")
def j4(spark, sf):
    whole = lines(spark, sf).select(F.to_json(F.struct("source", "log_message")).alias("value")).repartition(4)
    stream, base = stream_of(spark, sf, "micro", whole, per_trigger=1)
    got = drained(spark, jobs.classify_stream(jobs.decode(stream)).select("source", "classification"), base)
    return got.groupBy("source", "classification").agg(F.count(F.lit(1)).alias("n"))


@query("j5_restart")
def j5(spark, sf):
    base = work_folder(spark, "restart")
    values = lines(spark, sf).withColumn("value", F.to_json(F.struct("source", "log_message")))
    for part in (F.col("source").isin("WebServer", "Auth"), ~F.col("source").isin("WebServer", "Auth")):
        # Stopped and started again on the same checkpoint: only what is new is read.
        values.filter(part).select("value").write.mode("append").text(f"{base}/in")
        stream = jobs.decode(jobs.file_source(spark, f"{base}/in")).select("source", "log_message")
        got = drained(spark, stream, base)
    return got.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def requests(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("ip"), F.col("ts").cast("timestamp").alias("ts"))


@query("j6_request_limiter")
def j6(spark, sf):
    done = limiter.limit_requests(requests(spark, sf), window=36_000, limit=3)
    return done.select("event_id", "ip", "admitted")


@query("j6_stream_limiter")
def j6_stream(spark, sf):
    base = work_folder(spark, "limited")
    requests(spark, sf).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("event_id bigint, ip string, ts timestamp").parquet(f"{base}/in")
    return drained(spark, limiter.limit_stream(stream, window=36_000, limit=3), base).select("event_id", "ip", "admitted")


@query("j6_busy_slices")
def j6_slices(spark, sf):
    return limiter.screen_requests(requests(spark, sf), window=36_000, limit=3)
