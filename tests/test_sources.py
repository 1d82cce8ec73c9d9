from __future__ import annotations

import os

import pytest

from logwarden.operators import classify as cl, reports as rp
from logwarden.sources import files, sinks

SSHD = "Jun 14 15:16:01 server sshd[1]: Failed password"


def put(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return path


def test_csv_scan(spark, folder):
    put(folder, "a.csv", 'source,log_message\nTestSys,User admin logged in.\nX,"two\nlines, ""quoted"""\n')
    got = {tuple(r) for r in files.scan_csv(spark, f"{folder}/a.csv").collect()}
    assert got == {("TestSys", "User admin logged in."), ("X", 'two\nlines, "quoted"')}
    put(folder, "app+one 1%.csv", "log_message\nhello\n")
    row = files.scan_csv(spark, f"{folder}/app+one 1%.csv").first()
    assert (row.source, row.log_message) == ("app+one 1%", "hello")
    put(folder, "bad.csv", "x\n1\n")
    with pytest.raises(ValueError, match="log_message"):
        files.scan_csv(spark, f"{folder}/bad.csv")


def test_text_scan(spark, folder):
    put(folder, "auth.log", b"\n   \n" + SSHD.encode() + b"\n  plain \xff\xfeline  \n\n")
    put(folder, "other.txt", "plain\n" + SSHD + "\n")
    rows = files.scan_text(spark, folder).collect()
    assert {(r.source, r.log_message, r.log_type) for r in rows} == {
        ("auth", SSHD, "security"), ("auth", "plain line", "security"), ("other", "plain", "generic"), ("other", SSHD, "generic"),
    }


def test_file_type_with_many_splits(spark, folder):
    put(folder, "big.log", "\n\n" + SSHD + "\n" + "plain text line\n" * 2000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = files.scan_text(spark, folder)
        assert df.rdd.getNumPartitions() > 1
        assert [r.log_type for r in df.select("log_type").distinct().collect()] == ["security"]
        assert df.count() == 2001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_directory_scan(spark, folder):
    put(folder, "a.log", "one\n")
    put(folder, "b.csv", "log_message,source\ntwo,S\n")
    put(folder, "c.json", "{}")
    put(folder, "sub/d.txt", "three\n")
    flat = {tuple(r)[:2] for r in files.scan_directory(spark, folder).collect()}
    deep = {tuple(r)[:2] for r in files.scan_directory(spark, folder, recursive=True).collect()}
    assert flat == {("a", "one"), ("S", "two")}
    assert deep == flat | {("d", "three")}
    os.makedirs(f"{folder}/empty")
    with pytest.raises(ValueError):
        files.scan_directory(spark, f"{folder}/empty")


def test_blob(spark):
    df = spark.createDataFrame([(1, " Backup completed.\n\n  x \t\n")], "id int, blob string")
    got = [(r.line_no, r.log_message, r.source) for r in files.blob_lines(df, "blob", ["id"]).collect()]
    assert got == [(0, "Backup completed.", "raw_input"), (2, "x", "raw_input")]


def test_labelled_sets(spark, folder):
    put(folder, "syn.csv", "log_message,target_label\nm,Error\n")
    assert tuple(files.load_dataset(spark, "Synthetic", f"{folder}/syn.csv").first()) == ("unknown", "m", "Error")
    put(folder, "h.log", "081109 203518 148 WARN dfs: x\n081109 203518 148 FATAL dfs: x\nother\n\n")
    assert [r.target_label for r in files.load_dataset(spark, "hdfs", f"{folder}/h.log").collect()] == [
        "Error", "Critical Error", "System Notification",
    ]
    put(folder, "b.log", "- 1 fine\n-\ttab  \nAPPREAD 2 bad\n-x\n")
    got = [tuple(r) for r in files.load_dataset(spark, "bgl", f"{folder}/b.log").collect()]
    assert got == [
        ("BGL", "1 fine", "System Notification"), ("BGL", "tab", "System Notification"),
        ("BGL", "APPREAD 2 bad", "Security Alert"), ("BGL", "-x", "Security Alert"),
    ]
    assert files.load_dataset(spark, "thunderbird", f"{folder}/b.log").first().source == "Thunderbird"
    with pytest.raises(ValueError, match="unknown dataset"):
        files.load_dataset(spark, "nope", "x")


def test_classified_csv_keeps_input_columns(spark, lines, folder):
    from pyspark.sql import functions as F

    df = lines(("S", 'failed login, "x"'), ("T", "sky")).withColumn("extra", F.lit("e"))
    sinks.write_classified_csv(df, f"{folder}/out")
    back = files.scan_csv(spark, f"{folder}/out")
    assert back.columns == ["log_id", "source", "log_message", "extra", "target_label", "method", "confidence", "reasoning"]
    assert {(r.log_message, r.target_label, r.extra) for r in back.collect()} == {
        ('failed login, "x"', "Security Alert", "e"), ("sky", "Unclassified", "e"),
    }


def test_analysis_json_per_file(spark, folder):
    put(folder, "in/a/app.log", "failed login from 10.0.0.1\n" * 6 + "GET /x?q=1 HTTP/1.1 status: 404\n")
    put(folder, "in/b/app.log", "Backup ended\n")  # same name, another input
    lines = files.scan_directory(spark, f"{folder}/in", recursive=True, keep_file=True)
    analysis = rp.analyze(cl.classify(lines), ("file",), order="line_order", lines=lines)
    runs = [sinks.write_analysis_json(analysis, f"{folder}/out") for _ in range(2)]
    assert runs[0] != runs[1]
    rows = {os.path.basename(os.path.dirname(r.file)): r for r in spark.read.schema(analysis.report.schema).json(f"{runs[0]}/report").collect()}
    assert set(rows) == {"a", "b"}
    a, b = rows["a"], rows["b"]
    assert (a.time_analysis.total_logs, a.event_count, b.time_analysis.total_logs, b.event_count) == (7, 7, 1, 0)
    assert [tuple(x) for x in a.ip_analysis.suspicious] == [("10.0.0.1", 6, "MEDIUM")] and b.ip_analysis.suspicious == []
    assert [tuple(x) for x in a.url_analysis.top_urls] == [("/x", 1)] and a.url_analysis.total_unique_urls == 1
    assert {x.label: x.n for x in a.time_analysis.label_distribution} == {"Security Alert": 6, "HTTP Status": 1}
    assert b.highest_severity is None and b.mitre_coverage == [] and b.recommendations == []
    assert [t.technique_id for t in a.mitre_coverage] == ["T1046"]
    assert spark.read.json(f"{runs[0]}/events").count() == 7
    assert {r.file.split("/")[-2] for r in spark.read.json(f"{runs[1]}/ip_frequency").collect()} == {"a"}


def test_report_lists_are_bounded(spark):
    facts = spark.range(5000).selectExpr("'f' AS file", "'ip' AS kind", "cast(id AS string) AS key", "id + 10 AS n", "id AS first_seen")
    facts = facts.unionByName(spark.range(40).selectExpr("'f' AS file", "'url' AS kind", "concat('/', id) AS key", "5 AS n", "id AS first_seen"))
    row = rp.report_rows(facts, ("file",)).first()
    assert len(row.ip_analysis.suspicious) == rp.LISTED and row.ip_analysis.suspicious[0].ip == "4999" and row.ip_analysis.suspicious_count == 5000
    assert [u.url for u in row.url_analysis.top_urls] == [f"/{i}" for i in range(20)]


def test_reports_over_files_use_the_line_order(spark, folder):
    put(folder, "a.log", "from 10.0.0.2\nfrom 10.0.0.1\n" + "both 10.0.0.1 10.0.0.2\n" * 5)
    done = cl.classify(files.scan_directory(spark, folder))
    got = rp.analyze(done, order="line_order").suspicious_ips.collect()
    assert [(r.ip, r.request_count) for r in got] == [("10.0.0.2", 6), ("10.0.0.1", 6)]


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    texts = {"a": "source,log_message\nA,first\n", "b 1%": "log_message,source\nsecond,B\n", "c+d": "id,log_message\n9,third\n", "e": ""}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = {(r.source, r.log_message, r.id) for r in files.scan_csv(spark, str(tmp_path)).collect()}
    assert got == {("A", "first", None), ("B", "second", None), ("c+d", "third", "9")}
    (tmp_path / "f.csv").write_text("id,text\n1,no message\n")
    with pytest.raises(ValueError):
        files.scan_csv(spark, str(tmp_path))


def test_headers_cost_one_record_a_file(spark, tmp_path):
    for i in range(40):
        head = "source,log_message" if i % 2 else "log_message,id"
        body = "".join(f"s{i},m{k}\n" if i % 2 else f"m{k},{k}\n" for k in range(200))
        (tmp_path / f"f{i:02}.csv").write_text(f"{head}\n{body}")
    heads = files.file_headers(spark, str(tmp_path))
    assert heads.count() == 40 and {tuple(r.header) for r in heads.collect()} == {("source", "log_message"), ("log_message", "id")}
    rows = files.scan_csv(spark, str(tmp_path), ordered=True, keep_file=True)
    assert rows.count() == 8000 and rows.where("log_message IS NULL OR NOT startswith(log_message, 'm')").count() == 0
    per = {r.source: r.ids for r in rows.selectExpr("source", "id").groupBy("source").agg({"id": "count"}).withColumnRenamed("count(id)", "ids").collect()}
    assert per["s1"] == 0 and per["f00"] == 200 and len(per) == 40


def test_labelled_files_of_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("log_message,target_label\nx,Error\n")
    (tmp_path / "b.csv").write_text('target_label,extra,source,log_message\nHTTP Status,1,S,"two\nlines"\n')
    assert {tuple(r) for r in files.scan_labelled(spark, str(tmp_path)).collect()} == {("unknown", "x", "Error"), ("S", "two\nlines", "HTTP Status")}
    (tmp_path / "c.csv").write_text("log_message\nx\n")
    with pytest.raises(ValueError, match="target_label"):
        files.scan_labelled(spark, str(tmp_path))
