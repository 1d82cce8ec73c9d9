"""The same results in SQL for DuckDB, written apart from the Spark code.

Only the fixed values (patterns, word lists, wording) are shared.
"""

from __future__ import annotations

from checks.logs_view import LOGS_SQL
from logwarden import rules as r

CUSTOM = [(r"sky is \w+ today", "Weather"), (r"job \d+ done", "Job Report"), (r"crash", "Crash")]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_in(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def case(branches: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {default} END"


def pattern_case(col: str, patterns=r.PATTERN_RULES) -> str:
    return case([(f"regexp_matches({col}, {q(p)}, 'i')", q(label)) for p, label in patterns])


def keyword_case(lo: str) -> str:
    return case([(words_in(lo, w), q(label)) for w, label, _ in r.KEYWORD_RULES])


def classified(base: str, name: str, text: str = "log_message") -> str:
    """CTEs that label ``base`` with pattern tier, then keyword tier."""
    return f"""
{name}_1 AS (SELECT *, lower({text}) AS lo, {pattern_case(text)} AS rx FROM {base}),
{name}_2 AS (SELECT *, {keyword_case("lo")} AS kw FROM {name}_1),
{name} AS (SELECT *, coalesce(rx, kw, 'Unclassified') AS classification,
  CASE WHEN rx IS NOT NULL THEN 'regex' ELSE 'llm' END AS method,
  CAST(CASE WHEN rx IS NOT NULL THEN 1.0 WHEN kw IS NOT NULL THEN 0.6 ELSE 0.0 END AS DOUBLE) AS confidence,
  CASE WHEN rx IS NOT NULL THEN {q(r.REASON_PATTERN)}
       WHEN kw IS NOT NULL THEN 'Classified via LLM analysis (confidence: 0.60).'
       ELSE 'Classified via LLM analysis (confidence: 0.00).' END AS reasoning FROM {name}_2)"""


LOGS = "logs AS (" + LOGS_SQL.format(events="events") + ")"
CLS = LOGS + "," + classified("logs", "cls")


def first(col: str, pattern: str, flags: str = "") -> str:
    return f"nullif(regexp_extract({col}, {q(pattern)}, 1, {q(flags)}), '')"


def entity(col: str, kind: str) -> str:
    return {
        "url": first(col, r.URL_PATTERN),
        "http_method": first(col, r.VERB_PATTERN),
        "status_code": first(col, r.STATUS_PATTERN, "i"),
        "username": first(col, r.USER_PATTERN, "i"),
        "ips": f"array_to_string(regexp_extract_all({col}, {q(r.IP_PATTERN)}), ',')",
    }[kind]


attack_case = case([(words_in("lo", w), q(a)) for w, a, _ in r.ATTACK_SIGNATURES], "'UNKNOWN'")
attack_level = case([(words_in("lo", w), q(s)) for w, _, s in r.ATTACK_SIGNATURES], "'HIGH'")
status4 = f"coalesce(starts_with({entity('log_message', 'status_code')}, '4'), false)"
BRANCH = f"""CASE WHEN classification = 'Security Alert' THEN 1 WHEN classification = 'Critical Error' THEN 2
  WHEN contains(lower(classification), 'error') OR contains(lower(classification), 'fail') THEN 3
  WHEN classification = 'HTTP Status' THEN (CASE WHEN {status4} THEN 4 END)
  WHEN {words_in("lo", r.SUSPICIOUS_WORDS)} THEN 5 END"""
advice_case = case([(f"attack_type = {q(a)}", q(t)) for a, t in r.RECOMMENDATIONS], q(r.RECOMMENDATION_DEFAULT))
prefix_case = case([(f"severity = {q(s)}", q(t)) for s, t in r.SEVERITY_PREFIXES], "''")
head, tail = r.ROOT_CAUSE_DEFAULT
cause_case = case([(words_in("lo", w), q(t)) for w, t in r.ROOT_CAUSES], f"{q(head)} || event_type || {q(tail)}")

TECH = "tech(attack_type, technique_id, name, tactic, url) AS (VALUES " + ", ".join(
    f"({q(a)}, {q(t)}, {q(n)}, {q(c)}, {q(r.TECHNIQUE_URL + t)})" for a, t, n, c in r.TECHNIQUES
) + ")"

EVENTS = (
    CLS
    + f""",
br AS (SELECT *, {BRANCH} AS b FROM cls),
ev1 AS (SELECT *,
  CASE b WHEN 1 THEN 'Security Alert' WHEN 2 THEN 'Critical Error' WHEN 3 THEN classification
         WHEN 4 THEN 'Suspicious HTTP Activity' ELSE 'Suspicious Activity' END AS event_type,
  CASE b WHEN 1 THEN ({attack_level}) WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'LOW' ELSE 'MEDIUM' END AS severity,
  CASE b WHEN 1 THEN ({attack_case}) WHEN 4 THEN 'ENUMERATION' ELSE 'UNKNOWN' END AS attack_type,
  b IN (1, 2, 5) AS requires_attention FROM br WHERE b IS NOT NULL),
ev AS (SELECT *, {cause_case} AS root_cause, {prefix_case} || {advice_case} AS recommendation FROM ev1),
"""
    + TECH
)

RANK = case([(f"severity = {q(s)}", str(i)) for i, s in enumerate(r.SEVERITIES)])
NAMES = case([(f"rk = {i}", q(s)) for i, s in enumerate(r.SEVERITIES)])
IPS = f"ipx AS (SELECT log_id, source, unnest(regexp_extract_all(log_message, {q(r.IP_PATTERN)})) AS ip FROM logs)"
URLS = f"ux AS (SELECT log_id, source, {entity('log_message', 'url')} AS u FROM logs)"

SUMMARY = """'Analysed ' || total_logs || ' log entries, identified ' || event_count || ' security events.'
 || CASE WHEN critical > 0 THEN ' ' || critical || ' CRITICAL severity event(s) require immediate attention.' ELSE '' END
 || CASE WHEN high > 0 THEN ' ' || high || ' HIGH severity event(s) detected.' ELSE '' END
 || CASE WHEN suspicious_ip_count > 0 THEN ' ' || suspicious_ip_count || ' suspicious IP address(es) identified.' ELSE '' END
 || CASE WHEN event_count = 0 THEN ' No security events detected in the analysed logs.' ELSE '' END"""


def overview(key: str, base: str) -> str:
    """Report rows per ``key`` expression over events ``base``."""
    return f"""WITH {EVENTS}, {IPS}, {URLS},
t AS (SELECT {key} AS k, count(*) AS total_logs FROM logs GROUP BY 1),
e AS (SELECT {key} AS k, count(*) AS event_count, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high, min({RANK}) AS rk FROM ev GROUP BY 1),
i AS (SELECT k, count(*) AS n FROM (SELECT {key} AS k, ip FROM ipx GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1),
w AS (SELECT {key} AS k, count(DISTINCT split_part(u, '?', 1)) AS n FROM ux GROUP BY 1),
x AS (SELECT t.k, total_logs, coalesce(event_count, 0) AS event_count, coalesce(critical, 0) AS critical,
  coalesce(high, 0) AS high, coalesce(i.n, 0) AS suspicious_ip_count, coalesce(w.n, 0) AS total_unique_urls, {NAMES} AS highest_severity
  FROM t LEFT JOIN e USING (k) LEFT JOIN i USING (k) LEFT JOIN w USING (k))
{base}"""


OVERVIEW_ROWS = f"""SELECT k AS source, total_logs, event_count, suspicious_ip_count, total_unique_urls, highest_severity,
 coalesce(highest_severity IN ('CRITICAL', 'HIGH'), false) AS requires_immediate_attention, {SUMMARY} AS summary FROM x"""

# --- parsing -----------------------------------------------------------------

DETECT = case(
    [(f"regexp_matches(log_message, {q(r.DETECT[n])})", q(n)) for n in r.DETECT_ORDER], "'generic'"
)


def parse(pattern: str, names: list[str], col: str = "log_message") -> dict[str, str]:
    ok = f"regexp_matches({col}, {q('^' + pattern)})"
    return {n: f"CASE WHEN {ok} THEN regexp_extract({col}, {q('^' + pattern)}, {i + 1}) END" for i, n in enumerate(names)}


def parse_sql(fields: dict[str, str]) -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in fields.items())
    return f"WITH {LOGS} SELECT log_id, {cols}, log_message AS raw FROM logs"


web = parse(r.WEB_LINE, ["ip_address", "timestamp", "request", "status_code", "bytes_sent"])
for pos, part in enumerate(["http_method", "url", "protocol"]):
    web[part] = f"""CASE WHEN regexp_matches(log_message, {q('^' + r.WEB_LINE)}) THEN
      coalesce(string_split_regex(trim(regexp_extract(log_message, {q('^' + r.WEB_LINE)}, 3)), '\\s+')[{pos + 1}], '') END"""
syslog = parse(r.SYSLOG_LINE, ["timestamp", "hostname", "process", "message"])
plain = parse(r.SYSLOG_LINE, ["timestamp", "hostname", "service", "message"])
secure = parse(r.SECURITY_LINE, ["timestamp", "hostname", "service", "message"])
security = {n: f"coalesce({secure[n]}, {plain[n]})" for n in secure}
hdfs = parse(r.HDFS_LINE, ["date", "time", "process_id", "level", "component", "message"])
hdfs["block_ids"] = f"""CASE WHEN regexp_matches(log_message, {q('^' + r.HDFS_LINE)})
  THEN array_to_string(regexp_extract_all(log_message, {q(r.HDFS_BLOCK)}), ',') END"""
openstack = parse(r.OPENSTACK_LINE, ["component", "process_id", "level", "name", "message"])
BY_TYPE = {"web_server": web, "syslog": syslog, "security": security, "hdfs": hdfs, "openstack": openstack}


def field(name: str) -> str:
    return case([(f"log_type = {q(t)}", f[name]) for t, f in BY_TYPE.items() if name in f])


# --- spans -------------------------------------------------------------------


def pii(mask_ips: bool = False) -> list[tuple[str, str, str]]:
    return [p for p in r.PII_PATTERNS if mask_ips or p[0] != "ipv4"]


def span_sql(key: str, text: str, base: str, patterns) -> str:
    parts = []
    for rank, (kind, pattern, token) in enumerate(patterns):
        parts.append(f"""
SELECT {key}, {rank} AS ord, {q(kind)} AS pii_type, v[i] AS value, {q(token)} AS replacement,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
FROM (SELECT {key}, v, g, unnest(range(1, len(v) + 1)) AS i FROM
  (SELECT {key}, regexp_extract_all({text}, {q(pattern)}) AS v, string_split_regex({text}, {q(pattern)}) AS g FROM {base}))""")
    return " UNION ALL ".join(parts)


def mask_expr(col: str, patterns) -> str:
    for _, pattern, token in patterns:
        col = f"regexp_replace({col}, {q(pattern)}, {q(token)}, 'g')"
    return col


# --- metrics -----------------------------------------------------------------


def metric_sql(ctes: str, pairs: str, keys: list[str], out: str) -> str:
    """``pairs`` selects keys, t, p (one row per sample); ``out`` reads rep (per label) or avgs."""
    k = "".join(f"{x}, " for x in keys)
    on = " AND ".join(["a.label = b.label"] + [f"a.{x} = b.{x}" for x in keys])
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""WITH {ctes}, pr AS ({pairs}),
a AS (SELECT {k}t AS label, count(*) AS support, count(*) FILTER (t = p) AS tp FROM pr GROUP BY ALL),
b AS (SELECT {k}p AS label, count(*) AS called FROM pr GROUP BY ALL),
sc AS (SELECT {"".join(f"coalesce(a.{x}, b.{x}) AS {x}, " for x in keys)}coalesce(a.label, b.label) AS label,
  coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(called, 0) AS called FROM a FULL JOIN b ON {on}),
rep0 AS (SELECT *, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM sc),
rep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rep0),
avgs AS (SELECT {k}round(CAST(sum(tp) / sum(support) AS DOUBLE), 6) AS accuracy, round(avg(precision), 6) AS precision_macro,
  round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
  round(sum(precision * support) / sum(support), 6) AS precision_weighted, round(sum(recall * support) / sum(support), 6) AS recall_weighted,
  round(sum(f1 * support) / sum(support), 6) AS f1_weighted, CAST(sum(support) AS BIGINT) AS total_samples FROM rep {group})
{out}"""


PAIRS = "SELECT target_label AS t, classification AS p FROM cls"

# --- stream inputs -----------------------------------------------------------

STREAM = f"""{LOGS}, st AS (SELECT ts, CASE WHEN source = 'HR' THEN 'kafka' ELSE source END AS source, log_message
  FROM logs WHERE source <> 'Billing')"""
SAMPLES = "smp(source, log_message, expected) AS (VALUES " + ", ".join(
    f"({q(s)}, {q(m)}, {q(e)})" for s, m, e in r.UNSEEN_SAMPLES
) + ")"
FEW = "smp(source, log_message, expected) AS (VALUES " + ", ".join(
    f"({q(s)}, {q(m)}, {q(e)})" for s, m, e in r.UNSEEN_SAMPLES[: r.FEW_SHOT_SIZE]
) + ")"


def unseen(samples: str) -> str:
    return (
        f"{LOGS}, {samples}, allsmp AS (SELECT * FROM smp UNION ALL SELECT source, log_message, target_label FROM logs),"
        + classified("allsmp", "cls")
    )


FB = f"""{CLS}, req AS (SELECT log_id, log_message, classification AS predicted_label,
  CASE WHEN source = 'HR' THEN '' ELSE method END AS predicted_method, classification = target_label AS is_correct,
  CASE WHEN classification <> target_label AND log_id % 13 <> 0 THEN target_label END AS correct_label FROM cls),
fb AS (SELECT * FROM req WHERE is_correct OR correct_label IS NOT NULL)"""

# --- suites ------------------------------------------------------------------

EVADE = f"""{LOGS}, alerts AS (SELECT log_id, log_message AS original FROM logs WHERE target_label = 'Security Alert'),
evade AS (
  SELECT log_id, original, 'unicode_homoglyph' AS attack, replace(replace(original, 'a', chr(1072)), 'e', chr(1077)) AS poisoned FROM alerts
  UNION ALL SELECT log_id, original, 'whitespace_injection', replace(original, ' ', '  ' || chr(9) || ' ') FROM alerts
  UNION ALL SELECT log_id, original, 'case_randomisation', array_to_string(list_transform(string_split(original, ''),
    lambda c, i: CASE WHEN i % 2 = 1 THEN upper(c) ELSE lower(c) END), '') FROM alerts
  UNION ALL SELECT log_id, original, 'benign_prefix', {q(r.BENIGN_PREFIX)} || original FROM alerts
  UNION ALL SELECT log_id, original, 'zero_width_split', replace(original, 'fail', 'f' || chr(8203) || 'ail') FROM alerts)"""
EVADED = (
    EVADE + "," + classified("alerts", "co", "original") + "," + classified("evade", "cp", "poisoned")
    + """, evres AS (SELECT cp.log_id, cp.attack, co.classification AS original_label, cp.classification AS poisoned_label,
  cp.classification = co.classification AS passed FROM cp JOIN co USING (log_id))"""
)
INJ = (
    "inj AS (" + " UNION ALL ".join(
        f"SELECT log_id, {q(n)} AS attack, {q(lead)} || log_message AS log_message FROM logs WHERE target_label = 'Security Alert'"
        for n, lead, _ in r.INJECTION_PAYLOADS
    ) + ")," + classified("inj", "ci")
)
FLIP = (
    "flip AS (" + " UNION ALL ".join(
        f"SELECT log_id, {q(n)} AS attack, {q(d)} AS description, {q(m + ' ')} || log_message AS log_message FROM logs WHERE target_label <> 'Security Alert'"
        for n, d, m in r.LABEL_FLIPS
    ) + ")," + classified("flip", "cf")
)

APPROACH_PAIRS = " UNION ALL ".join(
    f"SELECT source, {q(name)} AS approach, target_label AS t, {expr} AS p FROM cls"
    for name, expr in zip(
        r.APPROACHES, ["coalesce(rx, 'Unclassified')", "'Unclassified'", "coalesce(kw, 'Unclassified')", "classification"]
    )
)
LOGITS = """lg AS (SELECT vec_id, label, list_transform(range(0, 10), lambda k: list_sum(list_transform(list_filter(embedding, lambda x, i: (i - 1) % 10 = k), lambda x: CAST(x AS DOUBLE))) * 10 + CASE WHEN k = label THEN 2.0 ELSE 0.0 END) AS z FROM embeddings)"""
LOSSES = f"""WITH {LOGITS}, mx AS (SELECT label, z, list_max(z) AS m FROM lg), tt AS (SELECT unnest(range(1, 51)) / 10.0 AS temperature),
ls AS (SELECT temperature, avg(ln(list_sum(list_transform(z, lambda v: exp((v - m) / temperature)))) - (z[label + 1] - m) / temperature) AS loss FROM mx, tt GROUP BY 1)"""

REASONED = {
    "regex": q(r.REASON_PATTERN),
    "bert": f"printf({q(r.REASON_MODEL)}, v)",
    "llm": f"printf({q(r.REASON_COMPLETION)}, v)",
    "anomaly": "''",
}
ENTITY_JSON = """'{' || array_to_string(list_filter([
  CASE WHEN len(ipl) > 0 THEN '"ip_addresses":["' || array_to_string(ipl, '","') || '"]' END,
  '"http_method":"' || vb || '"', '"status_code":"' || sc || '"', '"username":"' || us || '"', '"url":"' || replace(u, '"', '\\"') || '"'], lambda x: x IS NOT NULL), ',') || '}'"""
CLS_COLS = "round(confidence, 6) AS confidence, reasoning"

ORACLE: dict[str, str] = {
    "flagship_severity_report": f"WITH {EVENTS} SELECT severity, ev.attack_type, technique_id, count(*) AS n FROM ev LEFT JOIN tech USING (attack_type) GROUP BY ALL",
    "a1_csv_scan": f"WITH {LOGS} SELECT log_id, source, log_message FROM logs",
    "a2_text_scan": f"WITH {LOGS} SELECT 'syslog' AS source, log_message FROM logs",
    "a3_directory_scan": f"WITH {LOGS} SELECT CASE WHEN source IN ('WebServer', 'Syslog') THEN 'file' ELSE source END AS source, log_message FROM logs",
    "a4_blob_lines": """SELECT doc_id, line_no, 'raw_input' AS source, log_message FROM
 (SELECT doc_id, i - 1 AS line_no, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') AS log_message FROM
  (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
 WHERE log_message <> ''""",
    "a5_labelled_csv": f"WITH {LOGS} SELECT source, log_message, target_label FROM logs",
    "a6_hdfs_labels": f"""WITH {LOGS}, lv AS (SELECT log_id, log_message, regexp_extract(log_message, {q('^' + r.HDFS_LABEL_LINE)}, 4) AS lv FROM logs)
 SELECT log_id, 'HDFS' AS source, log_message, {case([(f"lv = {q(n)}", q(x)) for n, x in r.HDFS_LEVEL_LABELS], q(r.HDFS_DEFAULT_LABEL))} AS target_label FROM lv""",
    "a11_feedback_scan": f"WITH {FB} SELECT log_message, predicted_label, predicted_method, is_correct, correct_label FROM fb",
    "a12_evaluation_samples": f"WITH {LOGS}, {SAMPLES} SELECT source, expected AS expected_label, count(*) AS n FROM (SELECT source, expected FROM smp UNION ALL SELECT source, target_label FROM logs) GROUP BY ALL",
    "a13_required_columns": f"WITH {LOGS} SELECT source, count(target_label) AS n FROM logs GROUP BY 1",
    "a14_classified_csv": f"WITH {CLS} SELECT log_id, source, log_message, classification AS target_label, method, {CLS_COLS} FROM cls",
    "a15_classified_rows": f"""WITH {CLS}, en AS (SELECT *, regexp_extract_all(log_message, {q(r.IP_PATTERN)}) AS ipl, {entity('log_message', 'http_method')} AS vb,
 {entity('log_message', 'status_code')} AS sc, {entity('log_message', 'username')} AS us, {entity('log_message', 'url')} AS u FROM cls)
 SELECT log_id, source, log_message, classification, method, {ENTITY_JSON} AS entities, {CLS_COLS} FROM en""",
    "a18_feedback_append": f"WITH {FB} SELECT is_correct, 'analyst' AS analyst_id, count(*) AS n, count(*) AS ids FROM fb GROUP BY 1",
    "a19_feedback_clear": f"WITH {FB} SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n_after FROM fb",
    "b1_detect_format": f"WITH {LOGS} SELECT log_id, {DETECT} AS log_type FROM logs",
    "b2_detect_batch": f"WITH {LOGS}, f AS (SELECT source, arg_min(log_message, log_id) AS log_message FROM logs GROUP BY 1) SELECT source, {DETECT} AS log_type FROM f",
    "b3_parse_web": parse_sql(web),
    "b4_parse_syslog": parse_sql(syslog),
    "b5_parse_security": parse_sql(security),
    "b6_parse_hdfs": parse_sql(hdfs),
    "b7_parse_openstack": parse_sql(openstack),
    "b8_parse_generic": f"WITH {LOGS} SELECT log_id, log_message AS raw FROM logs",
    "b9_parse_batches": f"""WITH {LOGS}, f AS (SELECT source, arg_min(log_message, log_id) AS log_message FROM logs GROUP BY 1),
 ty AS (SELECT source, {DETECT} AS log_type FROM f) SELECT log_id, log_type, {field("timestamp")} AS timestamp, {field("hostname")} AS hostname,
 {field("message")} AS message, log_message AS raw FROM logs JOIN ty USING (source)""",
    "b10_parse_each_line": f"""WITH {LOGS}, ty AS (SELECT *, {DETECT} AS log_type FROM logs) SELECT log_id, log_type, {field("timestamp")} AS timestamp,
 {field("hostname")} AS hostname, {field("process_id")} AS process_id, {field("component")} AS component, {field("message")} AS message,
 {field("status_code")} AS status_code, log_message AS raw FROM ty""",
    "b11_custom_format": f"""WITH {LOGS}, ty AS (SELECT *, {DETECT} AS lt FROM logs),
 us AS (SELECT *, lt = 'generic' AND regexp_matches(log_message, '^\\w+ usage at \\d+ percent') AS is_usage FROM ty)
 SELECT log_id, CASE WHEN is_usage THEN 'usage' ELSE lt END AS log_type,
 CASE WHEN is_usage THEN regexp_extract(log_message, 'at (\\d+) percent', 1) WHEN lt = 'hdfs' THEN {hdfs["level"]} WHEN lt = 'openstack' THEN {openstack["level"]} END AS level,
 log_message AS raw FROM us""",
    "c6_all_entities": f"WITH {LOGS} SELECT log_id, nullif({entity('log_message', 'ips')}, '') AS ips, "
    + ", ".join(f"{entity('log_message', k)} AS {k}" for k in ("http_method", "status_code", "username", "url")) + " FROM logs",
    "d1_pattern_tier": f"WITH {CLS} SELECT log_id, rx AS label, CAST(CASE WHEN rx IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS confidence FROM cls",
    "d2_custom_patterns": f"WITH {LOGS} SELECT log_id, {pattern_case('log_message', CUSTOM)} AS label FROM logs",
    "d3_keyword_tier": f"WITH {CLS} SELECT log_id, coalesce(kw, 'Unclassified') AS label, CAST(CASE WHEN kw IS NULL THEN 0 ELSE 0.7 END AS DOUBLE) AS confidence FROM cls",
    "d4_keyword_reasoning": f"""WITH {CLS} SELECT log_id, coalesce(kw, 'Unclassified') AS category, CAST(CASE WHEN kw IS NULL THEN 0 ELSE 0.7 END AS DOUBLE) AS confidence,
 '[Simulated] ' || {case([(words_in("lo", w), q(t)) for w, _, t in r.KEYWORD_RULES], q(r.KEYWORD_NO_REASON))} AS reasoning, '' AS raw_response FROM cls""",
    "d5_completion_parse": f"""WITH {LOGS}, tx AS (SELECT log_id, CASE WHEN log_id % 7 = 0 THEN target_label ELSE '<category> ' || target_label || ' </category>' || chr(10)
 || '<reasoning>r' || log_id || chr(10) || 'end </reasoning>' END AS t FROM logs)
 SELECT log_id, coalesce(nullif(trim(regexp_extract(t, '<category>(.*?)</category>', 1, 's')), ''), 'Unclassified') AS category, CAST(0.85 AS DOUBLE) AS confidence,
 trim(regexp_extract(t, '<reasoning>(.*?)</reasoning>', 1, 's')) AS reasoning FROM tx""",
    "d6_prompt": f"WITH {LOGS} SELECT log_id, {q(r.PROMPT_HEAD)} || log_message AS prompt FROM logs",
    "d9_hybrid_cascade": f"WITH {CLS} SELECT log_id, source, classification, method, {CLS_COLS}, nullif({entity('log_message', 'ips')}, '') AS ips, {entity('log_message', 'username')} AS username, {entity('log_message', 'url')} AS url FROM cls",
    "d10_custom_tiers": f"""WITH {CLS}, cu AS (SELECT *, {pattern_case('log_message', CUSTOM)} AS cx FROM cls)
 SELECT log_id, coalesce(cx, kw, 'Unclassified') AS classification, CASE WHEN cx IS NOT NULL THEN 'regex' ELSE 'llm' END AS method,
 CAST(CASE WHEN cx IS NOT NULL THEN 1 WHEN kw IS NOT NULL THEN 0.6 ELSE 0 END AS DOUBLE) AS confidence,
 CASE WHEN cx IS NOT NULL THEN 'Matched rule-based pattern.' WHEN kw IS NOT NULL THEN 'Classified via LLM analysis (confidence: 0.60).'
 ELSE 'Classified via LLM analysis (confidence: 0.00).' END AS reasoning FROM cu""",
    "d11_failing_tier": f"WITH {CLS} SELECT log_id, classification, method, {CLS_COLS} FROM cls",
    "d12_fallback": f"""WITH {CLS} SELECT log_id, coalesce(rx, 'Unclassified') AS classification, 'regex' AS method,
 CAST(CASE WHEN rx IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS confidence, CASE WHEN rx IS NULL THEN {q(r.REASON_FALLBACK)} ELSE {q(r.REASON_PATTERN)} END AS reasoning FROM cls""",
    "d13_reasoning": "WITH x AS (SELECT event_id, round(value / 500, 3) + 0.0001 AS v FROM events) SELECT event_id, "
    + ", ".join(f"{e} AS said_{m}" for m, e in REASONED.items()) + " FROM x",
    "d14_confidence_shift": "SELECT event_id, " + ", ".join(
        f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 500 + ({a})::DOUBLE)), 6) AS by_{m}"
        for m, a in [*r.ADJUSTMENTS.items(), ("other", 0.0)]
    ) + " FROM events",
    "d16_temperature_softmax": f"""WITH {LOGITS}, ex AS (SELECT vec_id, list_transform(z, lambda v: exp((v - list_max(z)) / 1.5)) AS e FROM lg)
 SELECT vec_id, i - 1 AS class, round(e[i] / s, 6) AS p FROM (SELECT vec_id, e, list_sum(e) AS s, unnest(range(1, 11)) AS i FROM ex)""",
    "d17_temperature_losses": f"{LOSSES} SELECT round(CAST(temperature AS DOUBLE), 1) AS temperature, round(loss, 6) AS loss FROM ls",
    "d17_temperature_fit": f"{LOSSES} SELECT round(CAST(temperature AS DOUBLE), 1) AS temperature, round(loss, 6) AS loss FROM ls ORDER BY ls.loss, ls.temperature LIMIT 1",
    "e1_event_filter": f"WITH {EVENTS} SELECT log_id, event_type FROM ev",
    "e2_attack_signature": f"WITH {EVENTS} SELECT log_id, attack_type, severity FROM ev",
    "e3_event_columns": f"""WITH {EVENTS} SELECT log_id, event_type, log_message, severity, round(confidence, 6) AS confidence, {entity('log_message', 'ips')} AS source_ips,
 {entity('log_message', 'url')} AS url_pattern, attack_type, {entity('log_message', 'http_method')} AS http_method, {entity('log_message', 'status_code')} AS status_code,
 {entity('log_message', 'username')} AS username, requires_attention FROM ev""",
    "e4_root_cause": f"WITH {EVENTS} SELECT log_id, root_cause FROM ev",
    "e5_technique_lookup": f"WITH {EVENTS} SELECT log_id, attack_type, technique_id, name, tactic, url FROM ev LEFT JOIN tech USING (attack_type)",
    "e6_technique_coverage": f"WITH {EVENTS} SELECT technique_id, name, tactic, url, min(log_id) AS first_seen FROM ev JOIN tech USING (attack_type) GROUP BY ALL",
    "e7_technique_catalogue": f"WITH {EVENTS} SELECT tech.attack_type, technique_id, name, tactic, url, count(log_id) AS n FROM tech LEFT JOIN ev USING (attack_type) GROUP BY ALL",
    "e8_recommendation": f"WITH {EVENTS} SELECT log_id, recommendation FROM ev",
    "e9_distinct_recommendations": f"WITH {EVENTS} SELECT recommendation, min(log_id) AS first_seen FROM ev GROUP BY 1",
    "e10_ip_frequency": f"WITH {LOGS}, {IPS} SELECT ip, count(*) AS request_count, min(log_id) AS first_seen FROM ipx GROUP BY 1",
    "e11_suspicious_ips": f"WITH {LOGS}, {IPS} SELECT ip, count(*) AS request_count, min(log_id) AS first_seen, CASE WHEN count(*) >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS suspicion_level FROM ipx GROUP BY 1 HAVING count(*) >= 5",
    "e12_top_urls": f"""WITH {LOGS}, {URLS}, c AS (SELECT split_part(u, '?', 1) AS url, count(*) AS n, min(log_id) AS first_seen FROM ux WHERE u IS NOT NULL GROUP BY 1)
 SELECT url, n, first_seen, row_number() OVER (ORDER BY n DESC, first_seen) AS rank FROM c QUALIFY rank <= 20""",
    "e12_top_page_urls": """WITH c AS (SELECT split_part(url, '?', 1) AS url, count(*) AS n, min(page_id) AS first_seen FROM pages GROUP BY 1)
 SELECT url, n, first_seen, row_number() OVER (ORDER BY n DESC, first_seen) AS rank FROM c QUALIFY rank <= 20""",
    "e13_unique_urls": f"WITH {LOGS}, {URLS} SELECT count(DISTINCT split_part(u, '?', 1)) AS total_unique_urls FROM ux",
    "e14_suspicious_urls": f"WITH {LOGS}, {URLS} " + " UNION ALL ".join(
        f"SELECT log_id, u AS url, {q(n)} AS pattern FROM ux WHERE regexp_matches(u, {q(p)}, 'i')" for p, n in r.URL_RULES
    ),
    "e14_suspicious_page_urls": " UNION ALL ".join(
        f"SELECT page_id, url, {q(n)} AS pattern FROM pages WHERE regexp_matches(url, {q(p)}, 'i')" for p, n in r.URL_RULES
    ),
    "e15_label_distribution": f"WITH {CLS} SELECT classification, count(*) AS n, min(log_id) AS first_seen FROM cls GROUP BY 1",
    "e16_source_distribution": f"WITH {LOGS} SELECT source, count(*) AS n, min(log_id) AS first_seen FROM logs GROUP BY 1",
    "e17_highest_severity": f"WITH {EVENTS}, m AS (SELECT source, min({RANK}) AS rk FROM ev GROUP BY 1) SELECT source, {NAMES} AS highest_severity FROM (SELECT DISTINCT source FROM logs) LEFT JOIN m USING (source)",
    "e18_immediate_attention": f"WITH {EVENTS}, m AS (SELECT target_label, min({RANK}) AS rk FROM ev GROUP BY 1) SELECT target_label, coalesce(rk <= 1, false) AS requires_immediate_attention FROM (SELECT DISTINCT target_label FROM logs) LEFT JOIN m USING (target_label)",
    "e19_summary": overview("1", f"SELECT {SUMMARY} AS summary FROM x"),
    "e20_full_analysis": overview("source", OVERVIEW_ROWS),
    "e21_input_info": f"WITH {LOGS}, f AS (SELECT source, arg_min(log_message, log_id) AS log_message, count(*) AS total_logs FROM logs GROUP BY 1) SELECT source, {DETECT} AS detected_type, total_logs FROM f",
    "f1_pii_spans": f"WITH s AS ({span_sql('doc_id', 'text', 'documents', pii())}) SELECT doc_id, pii_type, value, start, start + length(value) AS \"end\", replacement FROM s",
    "f2_mask_documents": f"SELECT doc_id, {mask_expr('text', pii())} AS text FROM documents",
    "f3_mask_logs": f"WITH {LOGS} SELECT log_id, {mask_expr('log_message', pii())} AS log_message FROM logs",
    "f4_pii_audit": f"""WITH s AS ({span_sql('doc_id', 'text', 'documents', pii())}),
 g AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(pii_type))), ',') AS types,
  string_agg(pii_type || ':' || start || ':' || (start + length(value)) || ':' || replacement, ';' ORDER BY ord, start) AS details FROM s GROUP BY 1)
 SELECT doc_id, length(text) AS original_length, coalesce(n, 0) AS pii_found, coalesce(types, '') AS pii_types, coalesce(details, '') AS details FROM documents LEFT JOIN g USING (doc_id)""",
    "f5_mask_ips": f"WITH {LOGS} SELECT log_id, {mask_expr('log_message', pii(True))} AS log_message FROM logs",
    "f6_custom_pattern": f"WITH {LOGS} SELECT log_id, {mask_expr('log_message', [*pii(), ('', chr(92) + 'bu' + chr(92) + 'd+' + chr(92) + 'b', '[USER_REDACTED]')])} AS log_message FROM logs",
    "f7_mask_events": f"WITH {EVENTS} SELECT log_id, {mask_expr('log_message', pii())} AS log_message, {mask_expr('root_cause', pii())} AS root_cause, {entity('log_message', 'username')} AS username, {entity('log_message', 'url')} AS url_pattern FROM ev",
    "f8_pii_totals": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {q(k)} AS pii_type, CAST(sum(len(regexp_extract_all(text, {q(p)}))) AS BIGINT) AS hits, count(*) FILTER (regexp_matches(text, {q(p)})) AS rows_hit FROM documents"
        for k, p, _ in pii(True)
    ) + ") WHERE hits > 0",
    "g1_validate_feedback": f"WITH {FB} SELECT log_id, is_correct OR correct_label IS NOT NULL AS accepted, CASE WHEN NOT is_correct AND correct_label IS NULL THEN 'correct_label is required when is_correct=false' END AS error FROM req",
    "g2_corrections": f"WITH {FB} SELECT log_id, predicted_label, correct_label FROM fb WHERE NOT is_correct",
    "g3_feedback_stats": f"WITH {FB} SELECT count(*) AS total, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct) AS incorrect, round(count(*) FILTER (is_correct) / count(*), 4) AS accuracy FROM fb",
    "g4_feedback_by_method": f"WITH {FB} SELECT coalesce(nullif(predicted_method, ''), 'unknown') AS method, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct) AS incorrect FROM fb GROUP BY 1",
    "g5_training_rows": f"WITH {FB} SELECT log_message, correct_label FROM fb WHERE NOT is_correct",
    "h1_accuracy": f"WITH {CLS} SELECT round(avg(CASE WHEN target_label = classification THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS total_samples FROM cls",
    "h2_label_domain": f"WITH {CLS} SELECT target_label AS label FROM cls UNION SELECT classification FROM cls",
    "h3_confusion_matrix": f"""WITH {CLS}, lb AS (SELECT target_label AS l FROM cls UNION SELECT classification FROM cls)
 SELECT a.l AS truth, b.l AS predicted, (SELECT count(*) FROM cls WHERE target_label = a.l AND classification = b.l) AS n FROM lb a, lb b""",
    "h4_class_report": metric_sql(CLS, PAIRS, [], "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep"),
    "h5_averages": metric_sql(CLS, PAIRS, [], "SELECT * FROM avgs"),
    "h5_document_labels": metric_sql("one AS (SELECT 1)", "SELECT quality AS t, toxic AS p FROM labels", [], "SELECT * FROM avgs"),
    "h6_compare_approaches": metric_sql(CLS, APPROACH_PAIRS, ["source", "approach"], "SELECT * FROM avgs"),
    "h7_cross_domain": metric_sql(CLS, "SELECT source, target_label AS t, classification AS p FROM cls", ["source"], "SELECT * FROM avgs"),
    "h7_method_distribution": f"WITH {CLS} SELECT source, method, count(*) AS n FROM cls GROUP BY ALL",
    "h8_unseen_by_source": f"WITH {unseen(SAMPLES)} SELECT source, count(*) FILTER (classification = expected) AS correct, count(*) AS total FROM cls GROUP BY 1",
    "h8_unseen_details": f"WITH {unseen(SAMPLES)} SELECT source, substring(log_message, 1, 80) AS message, expected, classification AS predicted, method, round(confidence, 6) AS confidence, classification = expected AS correct FROM cls",
    "h8_unseen_metrics": metric_sql(unseen(SAMPLES), "SELECT expected AS t, classification AS p FROM cls", [], "SELECT * FROM avgs"),
    "h9_few_shot_metrics": metric_sql(unseen(FEW), "SELECT expected AS t, classification AS p FROM cls", [], "SELECT * FROM avgs"),
    "h10_evasion_variants": f"WITH {EVADE} SELECT log_id, original, attack, poisoned FROM evade",
    "h11_evasion_results": f"WITH {EVADED} SELECT * FROM evres",
    "h12_injection_results": f"WITH {LOGS}, {INJ} SELECT log_id, attack, classification AS classified_as, round(confidence, 6) AS confidence, classification = 'Security Alert' AS passed FROM ci",
    "h13_label_flip_results": f"WITH {LOGS}, {FLIP} SELECT log_id, attack, description, classification AS classified_as, classification <> 'Security Alert' AS passed FROM cf",
    "h14_robustness_summary": f"""WITH {EVADED}, {INJ}, {FLIP}, al AS (SELECT 'evasion' AS suite, passed FROM evres
 UNION ALL SELECT 'prompt_injection', classification = 'Security Alert' FROM ci UNION ALL SELECT 'label_flipping', classification <> 'Security Alert' FROM cf),
 bo AS (SELECT * FROM al UNION ALL SELECT 'summary', passed FROM al)
 SELECT suite, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (passed) / count(*), 4) AS pass_rate FROM bo GROUP BY 1""",
    "h16_fold_sizes": """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), f AS (SELECT label, n, unnest(range(0, 5)) AS k FROM c)
 SELECT label, CAST(k AS INTEGER) AS fold, n // 5 + CASE WHEN k < n % 5 THEN 1 ELSE 0 END AS n FROM f WHERE n // 5 + CASE WHEN k < n % 5 THEN 1 ELSE 0 END > 0""",
    "j1_stream_decode": f"WITH {STREAM} SELECT source, log_message FROM st",
    "j2_stream_classify": f"WITH {STREAM}, {classified('st', 'cls')} SELECT source, log_message, classification, method, round(confidence, 6) AS confidence FROM cls",
    "j4_micro_batches": f"WITH {CLS} SELECT source, classification, count(*) AS n FROM cls GROUP BY ALL",
    "j5_restart": f"WITH {LOGS} SELECT source, count(*) AS n FROM logs GROUP BY 1",
}

for key, kind, alias in [
    ("c1_ips", "ips", "ips"), ("c2_url", "url", "url"), ("c3_http_method", "http_method", "http_method"),
    ("c4_status_code", "status_code", "status_code"), ("c5_username", "username", "username"),
]:
    ORACLE[key] = f"WITH {LOGS} SELECT log_id, {entity('log_message', kind)} AS {alias} FROM logs"

_alerts = """WITH {logs} SELECT {cols} CASE WHEN log_id % 2 = 0 THEN 'System Notification' ELSE 'Security Alert' END AS target_label,
 CASE WHEN log_id % 2 = 0 THEN log_message ELSE 'ALERT ' || log_message END AS log_message FROM logs"""
ORACLE["a7_bgl_labels"] = _alerts.format(logs=LOGS, cols="log_id, 'BGL' AS source,")
ORACLE["a8_thunderbird_labels"] = _alerts.format(logs=LOGS, cols="log_id, 'Thunderbird' AS source,")
ORACLE["a9_dataset_lookup"] = _alerts.format(logs=LOGS, cols="'BGL' AS source,")
ORACLE["a10_stream_source"] = f"WITH {LOGS} SELECT source, log_message FROM logs"

_stream_events = EVENTS.replace(CLS, f"{STREAM}, {classified('st', 'cls')}")
ORACLE["a17_stream_sink"] = f"""WITH {_stream_events},
ipf AS (SELECT count(*) AS n FROM (SELECT ip FROM (SELECT unnest(regexp_extract_all(log_message, {q(r.IP_PATTERN)})) AS ip FROM st) GROUP BY 1 HAVING count(*) >= 5)),
x AS (SELECT (SELECT count(*) FROM st) AS total_logs, count(*) AS event_count, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high, (SELECT n FROM ipf) AS suspicious_ip_count, min({RANK}) AS rk FROM ev)
SELECT 'classification' AS type, source, log_message, classification AS label, method, round(confidence, 6) AS confidence,
  CAST(NULL AS BIGINT) AS event_count, NULL AS highest_severity, CAST(NULL AS BOOLEAN) AS requires_attention, NULL AS summary FROM cls
UNION ALL SELECT 'analysis', NULL, NULL, NULL, NULL, NULL, event_count, {NAMES}, rk <= 1, {SUMMARY} FROM x"""

ORACLE["j3_windowed_analysis"] = f"""WITH {EVENTS}, {IPS}, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ws, ts, log_id FROM logs),
t AS (SELECT ws, count(*) AS total_logs FROM w GROUP BY 1),
e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ws, count(*) AS event_count, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high, min({RANK}) AS rk FROM ev GROUP BY 1),
i AS (SELECT ws, count(*) AS n FROM (SELECT ws, ip FROM ipx JOIN w USING (log_id) GROUP BY 1, 2 HAVING count(*) >= 5) GROUP BY 1),
x AS (SELECT t.ws, total_logs, event_count, critical, high, rk, coalesce(n, 0) AS suspicious_ip_count FROM t JOIN e USING (ws) LEFT JOIN i USING (ws))
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, total_logs, event_count, {NAMES} AS highest_severity,
  rk <= 1 AS requires_immediate_attention, {SUMMARY} AS summary FROM x
WHERE ws + INTERVAL 1 HOUR <= (SELECT max(ts) FROM logs) - INTERVAL 10 MINUTE"""

ORACLE["j6_busy_slices"] = """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS ip, CAST(floor(epoch_us(ts) / 36000000000.0) AS BIGINT) AS slice, count(*) AS n FROM events GROUP BY 1, 2),
b AS (SELECT a.ip, a.slice, a.n + coalesce(p.n, 0) > 3 AS busy FROM s a LEFT JOIN s p ON p.ip = a.ip AND p.slice = a.slice - 1)
SELECT b.ip, b.slice FROM b LEFT JOIN b x ON x.ip = b.ip AND x.slice = b.slice + 1 WHERE b.busy OR coalesce(x.busy, false)"""

# --- reports per source ------------------------------------------------------

_per_source = f"""WITH {EVENTS}, {IPS}, {URLS},
ipf AS (SELECT source, ip, count(*) AS request_count, min(log_id) AS first_seen FROM ipx GROUP BY ALL),
urls AS (SELECT source, split_part(u, '?', 1) AS url, count(*) AS n, min(log_id) AS first_seen FROM ux WHERE u IS NOT NULL GROUP BY ALL),
top AS (SELECT * FROM urls QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first_seen, url) <= 20),
bad AS (SELECT *, CASE WHEN request_count >= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS suspicion_level FROM ipf WHERE request_count >= 5),
labels AS (SELECT source, classification AS label, count(*) AS n, min(log_id) AS first_seen FROM cls GROUP BY ALL),
sources AS (SELECT source, count(*) AS n, min(log_id) AS first_seen FROM logs GROUP BY ALL),
recs AS (SELECT source, recommendation, count(*) AS n, min(log_id) AS first_seen FROM ev GROUP BY ALL),
techs AS (SELECT source, technique_id, name, tactic, url, count(*) AS n, min(log_id) AS first_seen FROM ev JOIN tech USING (attack_type) GROUP BY ALL),
patterns AS (""" + " UNION ALL ".join(
    f"SELECT source, log_id, u AS url, {q(n)} AS pattern FROM ux WHERE regexp_matches(u, {q(p)}, 'i')" for p, n in r.URL_RULES
) + ")"


def _listed(table: str, text: str, order: str, name: str, sep: str = ";") -> str:
    return f"coalesce((SELECT string_agg({text}, {q(sep)} ORDER BY {order}) FROM {table} y WHERE y.source = x.k), '') AS {name}"


_report = overview("source", f"""SELECT x.k AS source, event_count, total_logs, total_unique_urls, suspicious_ip_count AS suspicious_count, highest_severity,
 coalesce(highest_severity IN ('CRITICAL', 'HIGH'), false) AS requires_immediate_attention, {SUMMARY} AS summary,
 {_listed("bad", "ip || ':' || request_count || ':' || suspicion_level", "request_count DESC, first_seen, ip", "suspicious")},
 {_listed("top", "url || ':' || n", "n DESC, first_seen, url", "top_urls")},
 {_listed("labels", "label || ':' || n", "n DESC, first_seen, label", "labels")},
 {_listed("sources", "y.source || ':' || n", "n DESC, first_seen", "sources")},
 {_listed("recs", "recommendation", "first_seen, recommendation", "recommendations", "|")},
 {_listed("techs", "technique_id || ':' || name || ':' || tactic || ':' || url", "first_seen, technique_id", "techniques")}
FROM x""")
_report = _report.replace(f"WITH {EVENTS}, {IPS}, {URLS}", _per_source, 1)
ORACLE |= {
    "a16_analysis_json": _report,
    "e20_report": _report,
    "a16_analysis_tables": _per_source + " " + " UNION ALL ".join(
        f"SELECT source, count(*) AS n, {q(name)} AS name FROM {table} GROUP BY ALL"
        for name, table in (("events", "ev"), ("ip_frequency", "ipf"), ("suspicious_ips", "bad"), ("suspicious_patterns", "patterns"), ("source_distribution", "sources"))
    ),
    "a17_failing_sink": ORACLE["a17_stream_sink"],
    "e20_events": f"WITH {EVENTS} SELECT log_id, source, event_type, severity, attack_type, root_cause, technique_id, recommendation FROM ev LEFT JOIN tech USING (attack_type)",
    "e20_ip_frequency": f"{_per_source} SELECT * FROM ipf",
    "e20_suspicious_ips": f"{_per_source} SELECT * FROM bad",
    "e20_top_urls": f"{_per_source} SELECT * FROM top",
    "e20_suspicious_patterns": f"{_per_source} SELECT * FROM patterns",
    "e20_label_distribution": f"{_per_source} SELECT * FROM labels",
    # the column that reports are split by and the one that is counted are the same here
    "e20_recommendations": f"{_per_source} SELECT * FROM recs",
    "e20_technique_coverage": f"{_per_source} SELECT * FROM techs",
    "e13_unique_urls_sketch": f"""WITH {LOGS}, {URLS} SELECT coalesce(source, 'all') AS source, count(DISTINCT split_part(u, '?', 1)) AS exact, true AS close
 FROM ux GROUP BY ROLLUP (source)""",
    "d9_all_three_tiers": f"WITH {CLS} SELECT log_id, rx AS pattern_label, true AS as_expected FROM cls",
    "k3_custom_entities": rf"""WITH {LOGS} SELECT log_id, CAST(len(regexp_extract_all(log_message, '\d+')) AS BIGINT) AS numbers, length(log_message) AS length FROM logs""",
    "k5_completion_function": f"""WITH {CLS} SELECT log_id, CASE WHEN rx IS NOT NULL THEN rx WHEN contains(log_message, 'percent') THEN classification
  WHEN contains(log_message, 'job') THEN 'Workflow Error' ELSE 'HTTP Status' END AS classification, method,
 round(CAST(CASE WHEN rx IS NOT NULL THEN 1.0 WHEN contains(log_message, 'percent') THEN confidence ELSE 0.75 END AS DOUBLE), 6) AS confidence FROM cls""",
    "i1_forms_agree": rf"""WITH {LOGS} SELECT CAST(sum(greatest(1, len(list_filter(regexp_split_to_array(log_message, '\s+'), lambda w: w <> '')))) AS BIGINT) AS words,
 CAST(0 AS BIGINT) AS differing FROM logs""",
}

ORACLE |= {
    "a20_saved_model": "SELECT vec_id, true AS same_label, true AS same_anomaly FROM embeddings",
    "d15_platt_scaling": "SELECT label, count(*) // 5 AS scored, count(*) // 5 AS sound FROM embeddings GROUP BY 1",
    "h17_split_sizes": """WITH c AS (SELECT label, count(*) AS n, CAST(round(count(*) * 0.8) AS BIGINT) AS k FROM embeddings GROUP BY 1)
 SELECT label, t AS is_test, CASE WHEN t THEN n - k ELSE k END AS n, CASE WHEN t THEN n - k ELSE k END AS ids FROM c, (VALUES (true), (false)) v(t)""",
}

# Each request of an address after the other: the times admitted before it, those that still count, the verdict.
ORACLE["j6_request_limiter"] = """WITH RECURSIVE r AS (SELECT event_id, CAST(user_id AS VARCHAR) AS ip, epoch_us(ts) AS us,
   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 walk AS (SELECT event_id, ip, k, [us] AS hits, true AS admitted FROM r WHERE k = 1
  UNION ALL
  SELECT event_id, ip, k, CASE WHEN len(now) < 3 THEN list_append(now, us) ELSE now END, len(now) < 3
  FROM (SELECT r.event_id, r.ip, r.k, r.us, list_filter(w.hits, lambda h: h > r.us - 36000000000) AS now FROM walk w JOIN r ON r.ip = w.ip AND r.k = w.k + 1))
SELECT event_id, ip, admitted FROM walk"""
ORACLE |= {
    "d18_tree_rows": "SELECT t AS tree, least(256, (SELECT count(*) FROM embeddings)) AS rows, least(256, (SELECT count(*) FROM embeddings)) AS ids FROM range(100) g(t)",
    "d19_outlier_share": "SELECT count(*) AS rows, true AS as_many_as_set, true AS scored_alike FROM embeddings",
    "d20_tier_agrees": "SELECT vec_id, true AS agrees FROM embeddings",
}
ORACLE["j6_stream_limiter"] = ORACLE["j6_request_limiter"]
