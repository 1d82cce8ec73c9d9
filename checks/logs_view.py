"""The ``logs`` table the checks run on, derived from ``events``.

The text is portable: Spark and DuckDB give the same rows for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOGS_SQL = """
SELECT event_id AS log_id, ts,
  CASE event_type WHEN 'click' THEN 'WebServer' WHEN 'view' THEN 'Syslog' WHEN 'error' THEN 'Auth'
       WHEN 'purchase' THEN 'Billing' ELSE 'HR' END AS source,
  CASE event_id % 20
    WHEN 0 THEN 'Multiple failed login attempts for user u' || CAST(user_id AS STRING) || ' from 10.0.0.' || CAST(user_id % 40 AS STRING)
    WHEN 1 THEN 'GET /item/' || CAST(user_id AS STRING) || '?id=' || CAST(event_id % 7 AS STRING) || ' HTTP/1.1 status: 404'
    WHEN 2 THEN 'Backup completed successfully.'
    WHEN 3 THEN 'User u' || CAST(user_id AS STRING) || ' logged in from 172.16.' || CAST(event_id % 200 AS STRING) || '.9'
    WHEN 4 THEN 'memory usage at ' || CAST(event_id % 100 AS STRING) || ' percent'
    WHEN 5 THEN 'Suspicious sql injection via GET /admin?id=1%27 from 10.9.8.' || CAST(event_id % 3 AS STRING)
    WHEN 6 THEN 'Privilege escalation detected for user admin' || CAST(user_id AS STRING)
    WHEN 7 THEN 'task failed: job ' || CAST(event_id AS STRING) || CASE event_id % 140 WHEN 7 THEN ' timed out' WHEN 27 THEN ' no space left'
           WHEN 47 THEN ' out of memory' WHEN 67 THEN ' segfault' WHEN 87 THEN ' tls handshake' WHEN 107 THEN ' access denied' ELSE '' END
    WHEN 8 THEN 'API v' || CAST(event_id % 5 AS STRING) || ' is deprecated and will be removed'
    WHEN 9 THEN 'Database crash, core dump written'
    WHEN 10 THEN 'GET /files/../etc/passwd?x=<script HTTP/1.0 status: 403'
    WHEN 11 THEN '192.168.1.' || CAST(user_id % 30 AS STRING) || ' - - [21/Apr/2019:03:39:58 +0330] "GET /p' || CAST(event_id % 25 AS STRING) || ' HTTP/1.1" 200 ' || CAST(event_id AS STRING)
    WHEN 12 THEN 'Jun 14 15:16:01 server sshd[' || CAST(event_id AS STRING) || ']: Failed password for root from 192.168.1.200'
    WHEN 13 THEN 'Jun 14 15:16:01 myhost cron[123]: job ' || CAST(event_id AS STRING) || ' done'
    WHEN 14 THEN 'nova.compute 1234 INFO nova.api: POST /v2/servers HTTP/1.1 status: 200'
    WHEN 15 THEN '081109 203518 148 INFO dfs.DataNode: Receiving block blk_-' || CAST(event_id AS STRING) || ' src blk_7'
    WHEN 16 THEN 'Contact hr' || CAST(user_id AS STRING) || '@example.com SSN 123-45-' || CAST(1000 + event_id % 9000 AS STRING) || ' password=hunter' || CAST(event_id AS STRING)
    WHEN 17 THEN 'Connection error: unauthorized token=abc' || CAST(event_id AS STRING) || CASE event_id % 180 WHEN 17 THEN ' xss' WHEN 37 THEN ' path traversal'
           WHEN 57 THEN ' ddos flood' WHEN 77 THEN ' data leak' WHEN 97 THEN ' malware' WHEN 117 THEN ' file inclusion' WHEN 137 THEN ' shell exec' WHEN 157 THEN ' union select' ELSE '' END
    WHEN 18 THEN 'The sky is blue today ' || CAST(event_id AS STRING)
    ELSE 'critical resource retired, restart needed' END AS log_message,
  CASE event_id % 20 WHEN 0 THEN 'Security Alert' WHEN 1 THEN 'HTTP Status' WHEN 2 THEN 'System Notification' WHEN 3 THEN 'User Action'
    WHEN 4 THEN 'Resource Usage' WHEN 5 THEN 'Security Alert' WHEN 6 THEN 'Security Alert' WHEN 7 THEN 'Workflow Error' WHEN 8 THEN 'Deprecation Warning'
    WHEN 9 THEN 'Critical Error' WHEN 10 THEN 'Security Alert' WHEN 11 THEN 'HTTP Status' WHEN 12 THEN 'Security Alert' WHEN 13 THEN 'System Notification'
    WHEN 14 THEN 'HTTP Status' WHEN 15 THEN 'System Notification' WHEN 16 THEN 'Security Alert' WHEN 17 THEN 'Security Alert' WHEN 18 THEN 'Unclassified'
    ELSE 'Critical Error' END AS target_label
FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOGS_SQL, events=table(spark, sf_dir, "events"))
