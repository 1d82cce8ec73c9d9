from __future__ import annotations

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from logwarden.streaming import jobs, limiter


def feed(spark, folder, *messages):
    rows = spark.createDataFrame([(m if isinstance(m, str) else json.dumps(m),) for m in messages], "value string")
    rows.coalesce(1).write.mode("append").text(f"{folder}/in")
    return jobs.decode(jobs.file_source(spark, f"{folder}/in"))


def run(spark, stream, folder, name="out"):
    schema = stream.schema
    jobs.start_files(stream, f"{folder}/{name}", f"{folder}/{name}-check", "parquet", once=True).awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def test_decode_rules(spark, folder):
    stream = feed(
        spark, folder, {"log_message": "a"}, {"source": "S", "message": "b"}, {"log_message": "", "message": "c"},
        {"source": "X"}, {"log_message": "d", "message": "e"},
    )
    got = {(r.source, r.log_message) for r in run(spark, stream, folder).collect()}
    assert got == {("kafka", "a"), ("S", "b"), ("kafka", "d")}


def test_both_record_types_and_restart(spark, folder):
    stream = feed(spark, folder, {"source": "S", "log_message": "failed login from 10.0.0.1"}, {"log_message": "Backup ended"})
    jobs.start_batches(stream, f"{folder}/out", f"{folder}/check", once=True).awaitTermination()
    stream = feed(spark, folder, {"log_message": "Backup started"})
    jobs.start_batches(stream, f"{folder}/out", f"{folder}/check", once=True).awaitTermination()
    recs = [json.loads(r.value) for r in spark.read.option("recursiveFileLookup", True).text(f"{folder}/out").collect()]
    assert sorted(r["log_message"] for r in recs if r["type"] == "classification") == [
        "Backup ended", "Backup started", "failed login from 10.0.0.1",
    ]
    analyses = [r for r in recs if r["type"] == "analysis"]
    assert len(analyses) == 1  # the second batch has no event
    assert analyses[0]["event_count"] == 1 and analyses[0]["highest_severity"] == "HIGH" and analyses[0]["requires_attention"]


def brute(rows, window, limit):
    hits, out = defaultdict(list), {}
    for i, ip, us in sorted(rows, key=lambda r: (r[2], r[0])):
        hits[ip] = [t for t in hits[ip] if t > us - window * 1_000_000]
        out[i] = len(hits[ip]) < limit
        if out[i]:
            hits[ip].append(us)
    return out


@pytest.mark.parametrize("window,limit,span", [(60, 3, 2000), (60, 5, 900), (10, 1, 4000), (60, 120, 600)])
def test_limiter_agrees_with_brute_force(spark, window, limit, span):
    import random

    rng = random.Random(limit * span)
    # One address holds over a third of all requests.
    rows = [(i, "hot" if rng.random() < 0.4 else f"ip{rng.randrange(20)}", rng.randrange(span) * 1_000_000 + rng.choice([0, 500_000])) for i in range(1500)]
    df = spark.createDataFrame(rows, "event_id bigint, ip string, us bigint").select("event_id", "ip", F.timestamp_micros("us").alias("ts"))
    done = limiter.limit_requests(df, window=window, limit=limit).collect()
    assert {r.event_id: r.admitted for r in done} == brute(rows, window, limit)
    assert len(done) == len(rows)


def test_stream_limiter_carries_state_over_batches(spark, folder):
    rows = [(i, f"ip{i % 3}", 1_700_000_000_000_000 + i * 4_000_000) for i in range(120)]
    schema = "event_id bigint, ip string, us bigint"
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in").select("event_id", "ip", F.timestamp_micros("us").alias("ts"))
        done = run(spark, limiter.limit_stream(stream, window=60, limit=2), folder)
    assert {r.event_id: r.admitted for r in done.collect()} == brute(rows, 60, 2)


def test_sources_and_sinks_for_brokers_build(spark, folder):
    stream = feed(spark, folder, {"log_message": "a"})
    with pytest.raises(Exception):  # the connector is not installed here
        jobs.kafka_source(spark, "host:9092", "logs")
    with pytest.raises(Exception):
        jobs.start_kafka(jobs.classification_records(jobs.classify_stream(stream)), "host:9092", "out", f"{folder}/c")


def test_limiter_keeps_requests_without_address(spark):
    from logwarden.streaming.limiter import limit_requests

    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "a", 1_600_000_000 + i) for i in range(30)], "event_id bigint, ip string, s bigint")
    rows = rows.selectExpr("event_id", "ip", "timestamp_seconds(s) AS ts")
    assert {tuple(r) for r in limit_requests(rows).groupBy("ip").count().collect()} == {("unknown", 10), ("a", 20)}


def test_limiter_keeps_every_request(spark):
    rows = [(i, None if i % 3 == 0 else i % 3, None if i % 5 == 0 else 1_600_000_000 + i % 7) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id bigint, ip int, s bigint").selectExpr("event_id", "ip", "timestamp_seconds(s) AS ts")
    done = limiter.limit_requests(df, limit=2).collect()
    assert sorted(r.event_id for r in done) == list(range(30))
    assert {r.event_id for r in done if r.admitted is None} == {i for i in range(30) if i % 5 == 0}
    assert {r.event_id: r.ip for r in done} == {i: ip for i, ip, _ in rows}
    want = brute([(i, ip, s * 1_000_000) for i, ip, s in rows if s is not None], 60, 2)
    assert {r.event_id: r.admitted for r in done if r.admitted is not None} == want


def test_points_that_admit_some_of_their_requests(spark):
    rows = [(i, "hot", 1_700_000_000_000_000 + (i // 50) * 20_000_000) for i in range(600)] * 2  # ids repeat: ties
    df = spark.createDataFrame(rows, "event_id bigint, ip string, us bigint").select("event_id", "ip", F.timestamp_micros("us").alias("ts")).repartition(5)
    done = limiter.limit_requests(df, limit=70)
    per = {r.ts: r.n for r in done.groupBy("ts").agg(F.count_if("admitted").alias("n")).collect()}
    assert [n for _, n in sorted(per.items())] == [70, 0, 0] * 4 and done.count() == 1200
    first = done.where("admitted").groupBy("ts").agg((F.max("event_id") - F.min("event_id")).alias("d")).collect()
    assert {r.d for r in first} == {34}


def test_a_chain_takes_steps_for_admissions_only():
    import numpy as np

    chain = limiter.Chain(60_000_000, 120)
    steps = 0
    for chunk in range(600):  # a request every 10 microseconds for 60 chunks of a second, ten times over
        times = np.arange(chunk * 1_000_000, (chunk + 1) * 1_000_000, 10)
        steps += len(chain.pass_chunk(times, np.ones(len(times), dtype=int)))
    assert steps == 10 * 120


@pytest.mark.parametrize("files_per_trigger", [1, 1000])
def test_windows_name_suspicious_addresses(spark, folder, files_per_trigger):
    line = "Failed password for root from {} port 22 ssh2"
    times = [("2024-01-01T10:%02d:00" % i, ip) for i, ip in enumerate(["10.0.0.1"] * 5 + ["10.0.0.2"] * 4)]
    times += [("2024-01-01T11:30:00", "10.0.0.1"), ("2024-01-01T14:00:00", "10.0.0.3")]
    for ts, ip in times:
        feed(spark, folder, {"source": "sshd", "log_message": line.format(ip), "ts": ts})
    stream = jobs.decode(jobs.file_source(spark, f"{folder}/in", files_per_trigger))
    got = run(spark, jobs.windowed_analysis(jobs.classify_stream(stream)), folder).orderBy("window_start").collect()
    assert [r.total_logs for r in got] == [9, 1]
    assert "1 suspicious IP address(es) identified." in got[0].summary
    assert "suspicious" not in got[1].summary
