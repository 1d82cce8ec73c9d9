from __future__ import annotations

import re

from pyspark.sql import functions as F

from logwarden import rules
from logwarden.functions.formats import DEFAULT_FORMATS, FormatSpec, parsed_struct

WEB = '192.168.1.100 - - [21/Apr/2019:03:39:58 +0330] "GET /index.html HTTP/1.1" 200 1234'
SSHD = "Jun 14 15:16:01 server sshd[1234]: Failed password for root from 192.168.1.200"
CRON = "Jun 14 15:16:01 myhost cron[123]: job completed"
SUDO = "Jun 14 15:16:01 server sudo: user1 : TTY=pts/0"
NOVA = "nova.osapi_compute.wsgi.server 1234 INFO nova.api: GET /v2/servers/detail HTTP/1.1 status: 200"
HDFS = "081109 203518 148 INFO dfs.DataNode$DataXceiver: Receiving block blk_-1608999687919862906"
TEXT = "just some random text 12345"


def parsed(lines, *rows):
    return [r for r in DEFAULT_FORMATS.parse_lines(lines(*rows)).orderBy("log_id").collect()]


def test_detection(lines):
    got = [r.log_type for r in parsed(lines, WEB, SSHD, CRON, SUDO, NOVA, HDFS, TEXT)]
    assert got == ["web_server", "security", "syslog", "security", "openstack", "hdfs", "generic"]


def test_web_fields(lines):
    post = '10.0.0.1 - user [01/Jan/2025:00:00:00 +0000] "POST /api/login HTTP/1.1" 302 0'
    empty = '10.0.0.1 - - [01/Jan/2025:00:00:00 +0000] "" 400 0'
    a, b, c = (r.parsed for r in parsed(lines, WEB, post, empty))
    assert (a.ip_address, a.http_method, a.url, a.protocol) == ("192.168.1.100", "GET", "/index.html", "HTTP/1.1")
    assert (a.status_code, a.bytes_sent, a.raw) == ("200", "1234", WEB)
    assert (b.http_method, b.url, b.status_code, b.bytes_sent) == ("POST", "/api/login", "302", "0")
    # An empty request is no web line by detection; forced parsing gives empty parts.
    forced = DEFAULT_FORMATS.parse_batch(lines(empty), "web_server").first().parsed
    assert c.ip_address is None
    assert (forced.request, forced.http_method, forced.url, forced.protocol) == ("", "", "", "")


def test_syslog_security_hdfs_openstack(lines):
    sys_, sec, sudo, hdfs, nova, text = (r.parsed for r in parsed(lines, CRON, SSHD, SUDO, HDFS, NOVA, TEXT))
    assert (sys_.hostname, sys_.process, sys_.message) == ("myhost", "cron[123]", "job completed")
    assert (sec.service, sec.message) == ("sshd", "Failed password for root from 192.168.1.200")
    assert sudo.service == "sudo"
    assert (hdfs.level, hdfs.component, hdfs.block_ids) == ("INFO", "dfs.DataNode$DataXceiver", ["blk_-1608999687919862906"])
    assert (nova.component, nova.process_id, nova.name) == ("nova.osapi_compute.wsgi.server", "1234", "nova.api")
    assert text.raw == TEXT and text.message is None


def test_detected_line_may_still_only_give_raw(lines):
    dated = "2017-05-16 nova.api 1234 INFO nova.api: hello"
    row = parsed(lines, dated)[0]
    assert row.log_type == "openstack" and row.parsed.component is None and row.parsed.raw == dated


def test_security_falls_back_to_syslog_shape(lines):
    row = DEFAULT_FORMATS.parse_batch(lines(CRON), "security").first().parsed
    assert (row.service, row.message) == ("cron[123]", "job completed")


def test_batch_type_comes_from_first_non_blank_line(lines):
    rows = lines(("a", "  "), ("a", CRON), ("a", WEB), ("b", TEXT), ("b", WEB))
    types = {r.source: r.log_type for r in DEFAULT_FORMATS.batch_types(rows, ["source"], ["log_id"]).collect()}
    assert types == {"a": "syslog", "b": "generic"}
    done = DEFAULT_FORMATS.parse_batches(rows, ["source"], ["log_id"]).collect()
    assert len(done) == 4
    assert {r.parsed.ip_address for r in done} == {None}


def test_custom_format_goes_before_the_catch_all(lines):
    custom = FormatSpec("kv", lambda c: F.col(c).contains("="), lambda c: parsed_struct(c, name=f"substring_index({c}, '=', 1)"))
    done = DEFAULT_FORMATS.register(custom).parse_lines(lines("k=v", WEB.replace("index.html", "a=b"))).orderBy("log_id")
    assert [r.log_type for r in done.collect()] == ["kv", "web_server"]
    assert done.first().parsed.name == "k"


def test_detection_agrees_with_python_re(spark, sf):
    from checks.logs_view import logs

    rows = logs(spark, sf).select("log_message", DEFAULT_FORMATS.detect("log_message").alias("t")).collect()
    for r in rows:
        want = next((n for n in rules.DETECT_ORDER if re.search(rules.DETECT[n], r.log_message)), "generic")
        assert r.t == want


def test_batches_with_a_null_key_stay(spark):
    from logwarden.functions.formats import DEFAULT_FORMATS

    rows = spark.createDataFrame([(0, None, "plain"), (1, None, "plain too"), (2, "a", "plain")], "log_id bigint, source string, log_message string")
    assert DEFAULT_FORMATS.parse_batches(rows, ["source"], ["log_id"]).count() == 3
