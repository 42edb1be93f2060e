"""DuckDB SQL with the expected result of each registered query.

The expected values are closed forms over the given tables; nothing here uses
the library under test.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

NUMBER = "chr(31) || 'number' || chr(31)"
QUOTED = "chr(31) || 'quoted' || chr(31)"


def _iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def _hash(pattern: str, service: str, severity: str) -> str:
    def field(label: str, value: str) -> str:
        return (
            f"CASE WHEN {value} IS NULL THEN '{label}' || chr(31) || 'absent' "
            f"ELSE '{label}' || chr(31) || 'present' || chr(31) || {value} END"
        )

    return (
        f"sha1({pattern} || chr(30) || {field('service', service)} || chr(30) || "
        f"{field('severity', severity)})"
    )


PLAIN = (
    f"'user ' || {NUMBER} || ' ' || event_type || ' k=' || {NUMBER} || ' value ' || {NUMBER}"
    " || ' from ' || chr(31) || 'ipv4' || chr(31)"
)
OBJECT = (
    f"'{{\"' || {QUOTED} || '\":\"' || {QUOTED} || '\",\"' || {QUOTED} || '\":\"' || {QUOTED} || '\"}}'"
)

# The logical record of every event.
EVENTS = f"""
ev AS (
  SELECT *,
    'user ' || user_id || ' ' || event_type || ' k=' || k || ' value '
      || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)
      || ' from 10.0.' || (user_id % 256) || '.' || k AS body
  FROM (
    SELECT event_id, user_id, event_type, value, ts,
      date_trunc('millisecond', ts) AS t,
      regexp_extract(props, '[0-9]+') AS k,
      CASE WHEN event_id % 11 <> 0 THEN 'svc-' || (user_id % 7) END AS svc,
      CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
        WHEN 'signup' THEN 'info' WHEN 'view' THEN 'debug' END AS level,
      CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13
        WHEN 'signup' THEN 9 WHEN 'view' THEN 5 END AS sev,
      md5(CAST(event_id AS VARCHAR)) AS trace,
      CASE WHEN event_id % 13 <> 0 THEN 'host-' || (user_id % 5) END AS host,
      event_id % 97 AS turn
    FROM events)),
rec AS (
  SELECT *, {_hash(PLAIN, 'svc', 'sev')} AS fp,
    sha256('00000000-0000-4000-8000-000000000001' || chr(31) || 'events' || chr(31) || '0'
      || chr(31) || event_id || chr(31) || '0') AS digest
  FROM ev),
records AS (
  SELECT *, substr(digest,1,8) || '-' || substr(digest,9,4) || '-' || substr(digest,13,4)
    || '-' || substr(digest,17,4) || '-' || substr(digest,21,12) AS id
  FROM rec),
issues AS (
  SELECT fp, arg_min(body, event_id) AS sample, any_value(sev) AS sev, min(t) AS first_seen,
    max(t) AS last_seen, count(*) AS n, coalesce(any_value(svc), '') AS services
  FROM records GROUP BY fp)
"""

ERROR_CODE = """CASE turn WHEN 5 THEN 'malformed-syntax' WHEN 6 THEN 'unrecognized-shape'
  WHEN 7 THEN 'missing-timestamp' WHEN 8 THEN 'empty-line' END"""

KIND = """CASE WHEN svc IN ('svc-0','svc-1','svc-2') THEN 'json-lines'
  WHEN svc IN ('svc-3','svc-4') THEN 'gcp-cloud-logging' ELSE 'aws-cloudwatch' END"""

STRUCTURED = "(level IS NOT NULL AND event_id % 2 = 1)"
GROUP = "coalesce('/aws/lambda/' || svc, 'app')"
STREAM = "'2026/09/09/[$LATEST]' || coalesce(host, 'stream')"
EVENT_ID = "lpad(CAST(event_id + 1 AS VARCHAR), 56, '0')"
GCP_LEVEL = "CASE level WHEN 'warn' THEN 'WARNING' ELSE upper(level) END"


def with_events(sql: str) -> str:
    return f"WITH RECURSIVE {EVENTS} {sql}"


# Parsed form of a rendered event, per format.
FORMS = {
    "json-lines": {
        "body": "body", "sev": "sev", "text": "level", "host": "host",
        "env": "'production'", "trace": "trace", "attributes": "'{}'",
        "fp": _hash(PLAIN, "svc", "sev"),
    },
    "gcp-cloud-logging": {
        "body": "body", "sev": "sev", "text": GCP_LEVEL, "host": "NULL", "env": "NULL",
        "trace": "trace",
        "attributes": "'{\"labels\":{' || coalesce('\"host\":\"' || host || '\",', '')"
        " || '\"location\":\"us-central1\"}}'",
        "fp": _hash(PLAIN, "svc", "sev"),
    },
    "aws-cloudwatch": {
        "body": f"CASE WHEN {STRUCTURED} THEN '{{\"level\":\"' || level || '\",\"msg\":\"' || body || '\"}}' ELSE body END",
        "sev": f"CASE WHEN {STRUCTURED} THEN sev END",
        "text": f"CASE WHEN {STRUCTURED} THEN level END",
        "host": "NULL", "env": "NULL", "trace": "NULL",
        "attributes": f"'{{\"id\":\"' || {EVENT_ID} || '\",\"logGroup\":\"' || {GROUP}"
        f" || '\",\"logStream\":\"' || {STREAM} || '\"}}'",
        "fp": f"CASE WHEN {STRUCTURED} THEN {_hash(OBJECT, 'svc', 'sev')} ELSE {_hash(PLAIN, 'svc', 'CAST(NULL AS INTEGER)')} END",
    },
}


def _parsed(kind: str) -> str:
    form = FORMS[kind]
    good = "turn NOT IN (5,6,7,8)"

    def when(value: str) -> str:
        return f"CASE WHEN {good} THEN {value} END"

    return f"""SELECT event_id, {ERROR_CODE} AS error_code, {when(_iso('t'))} AS "timestamp",
      {when(form['body'])} AS body, {when(form['sev'])} AS severity_number,
      {when(form['text'])} AS severity_text, {when('svc')} AS service_name,
      CAST({when(form['host'])} AS VARCHAR) AS host,
      CAST({when(form['env'])} AS VARCHAR) AS environment,
      CAST({when(form['trace'])} AS VARCHAR) AS trace_id, CAST(NULL AS VARCHAR) AS span_id,
      {when(form['attributes'])} AS attributes, '{kind}' AS source_type,
      {when(form['fp'])} AS fingerprint FROM ev"""


ORACLE["parse_jsonlines"] = with_events(_parsed("json-lines"))
ORACLE["parse_gcp"] = with_events(_parsed("gcp-cloud-logging"))
ORACLE["parse_cloudwatch"] = with_events(_parsed("aws-cloudwatch"))

# The line a damaged event stands on.
RAW_DAMAGED = """CASE turn WHEN 5 THEN 'not json' WHEN 6 THEN '[1,2]'
  WHEN 7 THEN '{"message":"' || body || '"}' WHEN 8 THEN '  ' END"""

ORACLE["parse_errors"] = with_events(f"""
SELECT {KIND} AS source_type, {ERROR_CODE} AS error_code, count(*) AS lines
FROM ev WHERE turn IN (5,6,7,8) GROUP BY 1, 2""")

ORACLE["rejected_lines"] = with_events(f"""
SELECT event_id, {KIND} AS source_type, {ERROR_CODE} AS error_code, {RAW_DAMAGED} AS raw
FROM ev WHERE turn IN (5,6,7,8)""")

ORACLE["run_totals"] = with_events(f"""
SELECT coalesce(svc, 'none') AS file, {KIND} AS source_type, count(*) AS processed_lines,
  count(*) FILTER (turn IN (5,6,7,8)) AS parse_errors,
  count(*) FILTER (turn NOT IN (5,6,7,8)) AS ingested_records
FROM ev GROUP BY 1, 2""")

# --- sources

ORACLE["line_meter"] = with_events("""
SELECT coalesce(svc, 'none') AS service, count(*) AS total_lines, 0 AS bytes_not_in_lines
FROM ev GROUP BY 1""")

ORACLE["expand_envelope"] = with_events("""
SELECT min(event_id) OVER w AS envelope,
  CAST(row_number() OVER (PARTITION BY user_id, event_id // 40 ORDER BY event_id) - 1 AS INTEGER)
    AS position,
  '{"logGroup":"/aws/lambda/u' || user_id || '","logStream":"'
  || CASE WHEN event_id % 10 = 4 THEN 'own' ELSE 's' END || '",'
  || CASE WHEN event_id % 10 = 3 THEN '"message":["' || body || '"]}'
     ELSE '"id":"' || event_id || '","message":"' || body || '","timestamp":' || epoch_ms(t) || '}' END
  AS value
FROM ev WINDOW w AS (PARTITION BY user_id, event_id // 40)""")

ORACLE["expand_other_lines"] = """
SELECT CAST(0 AS INTEGER) AS position, count(*) AS lines, count(*) AS events FROM events"""

HEADS = """heads AS (
  SELECT *, coalesce(svc, 'none') AS file FROM ev WHERE turn <> 8
  QUALIFY row_number() OVER (PARTITION BY coalesce(svc, 'none') ORDER BY event_id) <= 20)"""

ORACLE["head_sample"] = with_events(f", {HEADS} SELECT file, event_id FROM heads")

ORACLE["detect_format"] = with_events(f"""
, {HEADS},
scored AS (
  SELECT file, any_value({KIND}) AS kind,
    avg(CASE WHEN turn NOT IN (5,6,7) AND {KIND} = 'gcp-cloud-logging' THEN 1 ELSE 0 END) AS gcp,
    avg(CASE WHEN turn NOT IN (5,6,7) AND {KIND} = 'aws-cloudwatch' THEN 1 ELSE 0 END) AS cloudwatch,
    CASE WHEN 2 * count(*) FILTER (turn NOT IN (5,6)) > count(*) THEN 0.3 ELSE 0.0 END::DOUBLE
      AS json_lines
  FROM heads GROUP BY file)
SELECT file, gcp, cloudwatch, json_lines,
  CASE WHEN json_lines >= greatest(gcp, cloudwatch) THEN 'json-lines'
    WHEN gcp >= cloudwatch THEN 'gcp-cloud-logging' ELSE 'aws-cloudwatch' END AS source_type
FROM scored""")

# --- variants of one format

_NO = "CAST(NULL AS VARCHAR)"

ORACLE["jsonlines_aliases"] = with_events(f"""
SELECT event_id, error_code,
  CASE WHEN ok THEN {_iso("CASE WHEN m = 3 THEN date_trunc('second', t) ELSE t END")} END AS "timestamp",
  CASE WHEN ok THEN CASE WHEN b = 3 THEN '' ELSE body END END AS body,
  CASE WHEN ok THEN CASE l WHEN 0 THEN 17 WHEN 2 THEN 13 END END AS severity_number,
  CASE WHEN ok THEN CASE l WHEN 0 THEN 'ERROR' WHEN 2 THEN ' Warn ' WHEN 3 THEN '30' WHEN 4 THEN '40' END END
    AS severity_text,
  CASE WHEN ok THEN CASE s WHEN 0 THEN 'a' WHEN 1 THEN 'd' ELSE 'e' END END AS service_name,
  CASE WHEN ok AND s = 1 THEN 'h1' END AS host,
  CASE WHEN ok AND s = 2 THEN 'prod' END AS environment,
  CASE WHEN ok AND s = 2 THEN 't' END AS trace_id,
  CASE WHEN ok AND s = 2 THEN 's' END AS span_id,
  CASE WHEN ok THEN '{{' || array_to_string(list_filter([
    CASE WHEN m = 1 THEN '"@timestamp":"nope"' END,
    CASE WHEN s = 1 THEN '"hostname":"h2"' END,
    CASE WHEN l = 1 THEN '"level":null' END,
    CASE WHEN s = 0 THEN '"logger":"b"' END,
    CASE WHEN l = 4 THEN '"lvl":"error"' END,
    CASE b WHEN 1 THEN '"message":"  "' WHEN 2 THEN '"message":7' END,
    CASE b WHEN 0 THEN '"msg":"other"' WHEN 3 THEN '"msg":null' END,
    CASE WHEN s = 1 THEN '"service":""' END,
    CASE l WHEN 1 THEN '"severity":"info"' WHEN 5 THEN '"severity":{{"a":1}}' END,
    CASE WHEN l = 6 THEN '"x":1' END
  ], lambda x: x IS NOT NULL), ',') || '}}' END AS attributes,
  'json-lines' AS source_type
FROM (SELECT *, event_id % 5 AS m, event_id % 4 AS b, event_id % 7 AS l, event_id % 3 AS s,
        event_id % 5 <> 4 AS ok,
        CASE WHEN event_id % 5 = 4 THEN 'missing-timestamp' END AS error_code FROM ev)""")

ORACLE["gcp_variants"] = with_events(f"""
SELECT event_id, error_code, CASE WHEN ok THEN {_iso('t')} END AS "timestamp",
  CASE WHEN ok THEN CASE p WHEN 4 THEN '' WHEN 2 THEN '{{"z":' || user_id || ',"a":"1.0"}}' ELSE body END END AS body,
  CASE WHEN ok AND w = 10 THEN 21 END AS severity_number,
  CASE WHEN ok AND w = 10 THEN 'CRITICAL' END AS severity_text,
  CASE WHEN ok THEN CASE r WHEN 0 THEN 's1' WHEN 1 THEN 's2' WHEN 2 THEN 's3' WHEN 3 THEN 's4' END END
    AS service_name,
  {_NO} AS host, {_NO} AS environment,
  CASE WHEN ok AND w IN (9, 10) THEN 'abc' END AS trace_id,
  CASE WHEN ok AND w = 9 THEN 'sp' END AS span_id,
  CASE WHEN ok THEN '{{' || array_to_string(list_filter([
    CASE WHEN p = 2 THEN '"a":"1.0"' END,
    CASE WHEN p = 3 THEN '"insertId":"i"' END,
    CASE WHEN p = 1 THEN '"n":' || user_id END,
    CASE WHEN p = 2 THEN '"z":' || user_id END,
    CASE r WHEN 5 THEN '"labels":{{"zone":"own"}}'
      ELSE '"labels":{{' || array_to_string(list_filter([
        CASE WHEN r <> 1 THEN '"container_name":"s2"' END,
        CASE WHEN r <> 2 THEN '"instance_id":"s3"' END,
        CASE WHEN r <> 3 THEN '"module_id":"s4"' END,
        CASE WHEN r <> 0 THEN '"service_name":"s1"' END,
        '"zone":"z"'], lambda x: x IS NOT NULL), ',') || '}}' END,
    CASE WHEN p = 4 THEN '"httpRequest":{{"status":500}},"operation":{{"id":"o"}}' END
  ], lambda x: x IS NOT NULL), ',') || '}}' END AS attributes,
  'gcp-cloud-logging' AS source_type
FROM (SELECT *, error_code IS NULL AS ok FROM (
  SELECT *, event_id % 5 AS p, event_id % 6 AS r, event_id % 17 AS w,
    CASE WHEN event_id % 17 = 2 OR (event_id % 17 = 5)
      THEN 'unrecognized-shape'
    WHEN event_id % 19 IN (3, 4) THEN 'missing-timestamp' END AS error_code FROM ev))""")

ORACLE["cloudwatch_variants"] = with_events(f"""
SELECT event_id, error_code, CASE WHEN ok THEN {_iso('t')} END AS "timestamp",
  CASE WHEN ok THEN CASE b WHEN 0 THEN '' WHEN 1 THEN ''
    WHEN 2 THEN '{{"b":2.5,"level":null,"severity":"WARNING"}}'
    WHEN 3 THEN '{{"level":30,"z":{{"x":[],"y":1}}}}'
    WHEN 4 THEN '{{"level":"error"}} tail' WHEN 5 THEN '[1]' ELSE 'ERROR ' || body END END AS body,
  CASE WHEN ok AND b = 2 THEN 13 END AS severity_number,
  CASE WHEN ok THEN CASE b WHEN 2 THEN 'WARNING' WHEN 3 THEN '30' END END AS severity_text,
  CASE WHEN ok AND g = 0 THEN 'pay/worker' END AS service_name,
  {_NO} AS host, {_NO} AS environment, {_NO} AS trace_id, {_NO} AS span_id,
  CASE WHEN ok THEN CASE g WHEN 0 THEN '{{"logGroup":"/aws/ecs/pay/worker","logStream":"i"}}'
    WHEN 1 THEN '{{"logGroup":"custom"}}' WHEN 2 THEN '{{"id":9}}'
    ELSE '{{"id":"a","logGroup":"/aws/lambda"}}' END END AS attributes,
  'aws-cloudwatch' AS source_type
FROM (SELECT *, error_code IS NULL AS ok FROM (
  SELECT *, event_id % 9 AS b, event_id % 5 AS g,
    CASE WHEN event_id % 8 IN (0, 1, 2, 3) THEN 'invalid-timestamp'
      WHEN event_id % 8 = 5 THEN 'missing-timestamp' END AS error_code FROM ev))""")

# --- functions

ORACLE["severity_map"] = r"""
SELECT event_id, e.number, e.text, coalesce(e.number, e.syslog) AS syslog_number,
  coalesce(e.number, e.pino) AS pino_number
FROM events JOIN (VALUES
  (0, 17, 'ERROR', NULL, NULL), (1, 13, '  warn' || chr(9), NULL, NULL),
  (2, 9, 'Informational', NULL, NULL), (3, NULL, 'banana', NULL, NULL),
  (4, NULL, NULL, NULL, NULL), (5, NULL, NULL, NULL, NULL),
  (6, NULL, '30', NULL, 9), (7, NULL, '30', NULL, 9), (8, NULL, '3', 17, NULL),
  (9, NULL, '3.5', NULL, NULL), (10, NULL, NULL, NULL, NULL), (11, NULL, NULL, NULL, NULL),
  (12, NULL, NULL, NULL, NULL), (13, NULL, '-1', NULL, NULL), (14, 9, 'access', NULL, NULL),
  (15, 21, 'Panic', NULL, NULL), (16, NULL, '70', NULL, NULL)
) e(i, number, text, syslog, pino) ON event_id % 17 = e.i"""

ORACLE["severity_bands"] = """
SELECT number, CASE WHEN number IS NULL THEN 'unknown' WHEN number >= 21 THEN 'fatal'
  WHEN number >= 17 THEN 'error' WHEN number >= 13 THEN 'warn' WHEN number >= 9 THEN 'info'
  WHEN number >= 5 THEN 'debug' ELSE 'trace' END AS band, count(*) AS n
FROM (SELECT CASE WHEN event_id % 25 > 0 THEN CAST(event_id % 25 AS INTEGER) END AS number FROM events)
GROUP BY 1, 2"""

_INSTANT = """CASE event_id % 12 WHEN 0 THEN t WHEN 1 THEN date_trunc('second', t)
  WHEN 2 THEN date_trunc('second', t) + INTERVAL 250 MILLISECOND WHEN 3 THEN t
  WHEN 4 THEN date_trunc('second', t) WHEN 5 THEN date_trunc('minute', t) - INTERVAL 2 HOUR
  WHEN 6 THEN date_trunc('day', t)
  WHEN 7 THEN t + INTERVAL 90 MINUTE
  WHEN 11 THEN date_trunc('month', t) + INTERVAL 31 DAY END"""
ORACLE["instants"] = with_events(f"""
SELECT event_id, CASE WHEN moment >= TIMESTAMP '1970-01-01' THEN {_iso('moment')} END AS instant
FROM (SELECT event_id, {_INSTANT} AS moment FROM ev)""")

ORACLE["canonical_json"] = """
SELECT event_id, '{"a":{"b":["1.0",' || event_id || ',{"c":-2.5,"d":null}],"y":1},"z":"'
  || event_type || '"}' AS json FROM events"""

_SPACES = r"[\t\n\v\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
ORACLE["first_lines"] = f"""
SELECT doc_id, coalesce(list_filter(list_transform(
  string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)),
  lambda x: trim(regexp_replace(x, '{_SPACES}', ' ', 'g'))), lambda x: x <> '')[1], '') AS line
FROM documents"""

ORACLE["span_kinds"] = """
SELECT * FROM (
  SELECT 'variable' AS type, 'number' AS kind, 3 * count(*) AS n FROM events
  UNION ALL SELECT 'variable', 'ipv4', count(*) FROM events
  UNION ALL SELECT 'text', NULL, 4 * count(*) FROM events) WHERE n > 0"""

_KINDS_MESSAGE = [
    ("'seen |timestamp| ok'", f"'timestamp=' || {_iso('t')}"),
    (
        "'job |uuid| done'",
        "'uuid=' || substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-'"
        " || substr(d, 17, 4) || '-' || substr(d, 21, 12)",
    ),
    ("'to |email| now'", "'email=user' || user_id || '.x@shop.test'"),
    ("'peer |ipv6| up'", "'ipv6=fd00::' || lower(printf('%x', user_id))"),
    ("'from |ipv4| end'", "'ipv4=10.0.' || (user_id % 256) || '.7'"),
    ("'key |hex| kept'", "'hex=' || d"),
    ("'took |number|ms'", "'number=' || event_id"),
    ("'got \"|quoted|\" back'", "'quoted=' || body"),
    ("'GET /users/|path-id|/view ok'", "'path-id=' || event_id"),
]
ORACLE["span_kinds_all"] = with_events(
    "SELECT event_id, CASE event_id % 9 "
    + " ".join(f"WHEN {k} THEN {shape}" for k, (shape, _) in enumerate(_KINDS_MESSAGE))
    + " END AS structure, CASE event_id % 9 "
    + " ".join(f"WHEN {k} THEN {value}" for k, (_, value) in enumerate(_KINDS_MESSAGE))
    + " END AS found FROM (SELECT *, md5(CAST(event_id AS VARCHAR)) AS d FROM ev)"
)

ORACLE["spans_rebuild_text"] = """
SELECT 'documents' AS source, count(*) AS texts, 0 AS changed FROM documents
UNION ALL SELECT 'conversations', count(*), 0 FROM conversations
UNION ALL SELECT 'pages', count(*), 0 FROM pages"""

ORACLE["fingerprints"] = with_events("SELECT event_id, id, fp AS fingerprint FROM records")
ORACLE["distinct_fingerprints"] = with_events("SELECT DISTINCT fp AS fingerprint FROM records")

# --- dashboard


def _rate(start: str, end: str, unit: str) -> str:
    return with_events(f"""
SELECT {_iso('bucket')} AS bucket, count(t) AS total, count(t) FILTER (sev >= 17) AS errors,
  CASE WHEN count(t) = 0 THEN 0.0::DOUBLE
    ELSE (count(t) FILTER (sev >= 17))::DOUBLE / count(t) END AS ratio
FROM (SELECT unnest(generate_series(date_trunc('{unit}', TIMESTAMP '{start}'),
    date_trunc('{unit}', TIMESTAMP '{end}' - INTERVAL 1 MILLISECOND), INTERVAL 1 {unit})) AS bucket)
LEFT JOIN records ON date_trunc('{unit}', t) = bucket
  AND t >= TIMESTAMP '{start}' AND t < TIMESTAMP '{end}'
GROUP BY bucket""")


ORACLE["error_rate_minute"] = _rate("2024-01-10 00:00:00", "2024-01-10 02:00:00", "minute")
ORACLE["error_rate_hour"] = _rate("2024-01-10 00:00:00", "2024-01-12 00:00:00", "hour")
ORACLE["error_rate_day"] = _rate("2024-01-05 00:00:00", "2024-01-25 00:00:00", "day")
ORACLE["error_rate_odd"] = _rate("2024-01-10 00:00:30", "2024-01-10 00:07:30", "minute")
ORACLE["error_rate_inverted"] = _rate("2024-01-12 00:00:00", "2024-01-10 00:00:00", "minute")

_DAYS = "t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-25'"

ORACLE["by_service"] = with_events(f"""
SELECT coalesce(svc, 'unknown') AS service_name, count(*) AS total,
  count(*) FILTER (sev >= 17) AS errors FROM records WHERE {_DAYS} GROUP BY 1""")

_SUMMARY = f"""fp AS fingerprint, sample AS sample_message, issues.sev AS severity,
  {_iso('first_seen')} AS first_seen, services"""


def _top(where: str, limit: int) -> str:
    return with_events(f"""
SELECT {_SUMMARY}, c AS event_count FROM issues JOIN (
  SELECT fp, count(*) AS c FROM records WHERE {where} GROUP BY fp ORDER BY c DESC, fp LIMIT {limit}
) USING (fp)""")


ORACLE["top_issues"] = _top(_DAYS, 10)
ORACLE["top_issues_limit"] = _top("t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-12'", 3)

ORACLE["spikes"] = with_events(f"""
, cur AS (SELECT fp, count(*) AS c FROM records WHERE t >= TIMESTAMP '2024-01-10 03:00:00'
  AND t < TIMESTAMP '2024-01-10 06:00:00' GROUP BY fp),
prev AS (SELECT fp, count(*) AS p FROM records WHERE t >= TIMESTAMP '2024-01-10 00:00:00'
  AND t < TIMESTAMP '2024-01-10 03:00:00' GROUP BY fp)
SELECT {_SUMMARY}, issues.n AS event_count, c AS current_count, p AS previous_count,
  c::DOUBLE / p AS multiplier
FROM issues JOIN cur USING (fp) JOIN prev USING (fp) WHERE c >= p * 3""")

_RAGGED = ("2024-01-05 07:11:13.250", "2024-01-24 21:03:59.125")
_RAGGED_T = f"t >= TIMESTAMP '{_RAGGED[0]}' AND t < TIMESTAMP '{_RAGGED[1]}'"

ORACLE["rollup_error_rate"] = _rate(*_RAGGED, "day")
ORACLE["rollup_by_service"] = with_events(f"""
SELECT coalesce(svc, 'unknown') AS service_name, count(*) AS total,
  count(*) FILTER (sev >= 17) AS errors FROM records WHERE {_RAGGED_T} GROUP BY 1""")
ORACLE["rollup_top_issues"] = _top(_RAGGED_T, 10)
ORACLE["rollup_spikes"] = with_events(f"""
, cur AS (SELECT fp, count(*) AS c FROM records WHERE t >= TIMESTAMP '2024-01-10 03:00:20'
  AND t < TIMESTAMP '2024-01-10 07:00:50.500' GROUP BY fp),
prev AS (SELECT fp, count(*) AS p FROM records WHERE t >= TIMESTAMP '2024-01-09 22:59:49.500'
  AND t < TIMESTAMP '2024-01-10 03:00:20' GROUP BY fp)
SELECT {_SUMMARY}, issues.n AS event_count, c AS current_count, p AS previous_count,
  c::DOUBLE / p AS multiplier
FROM issues JOIN cur USING (fp) JOIN prev USING (fp) WHERE c >= p * 3""")
ORACLE["rollup_timeline"] = with_events(f"""
SELECT {_iso('bucket')} AS bucket, count(t) AS total
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-24', INTERVAL 1 DAY)) AS bucket)
LEFT JOIN (SELECT * FROM records WHERE svc = 'svc-1' AND sev = 17 AND {_RAGGED_T})
  ON date_trunc('day', t) = bucket
GROUP BY bucket""")
ORACLE["rollup_blast_radius"] = with_events(f"""
SELECT translate({PLAIN}, chr(31), '|') AS pattern, count(DISTINCT svc) AS services,
  count(DISTINCT host) AS hosts, count(*) AS total
FROM records WHERE {_RAGGED_T} GROUP BY 1""")
ORACLE["rollup_of_runs"] = with_events(f"""
SELECT coalesce(svc, 'unknown') AS service_name, count(*) AS total,
  count(*) FILTER (sev >= 17) AS errors, phase
FROM records, (VALUES ('before'), ('after'), ('vacuumed')) AS phases(phase)
WHERE {_RAGGED_T} GROUP BY 1, 4""")

ORACLE["new_issues"] = with_events(f"""
SELECT {_SUMMARY}, issues.n AS event_count FROM issues
WHERE first_seen >= TIMESTAMP '2024-01-01 02:00:00' AND first_seen < TIMESTAMP '2024-01-15'""")

# --- lists

_LIST = f"""id, {_iso('t')} AS "timestamp", '2024-02-01T00:00:00.000Z' AS observed_at,
  sev AS severity_number, level AS severity_text, body, svc AS service_name, host,
  'production' AS environment, trace AS trace_id, {_NO} AS span_id, 'json-lines' AS source_type,
  fp AS fingerprint"""


def _list(where: str, limit: int, offset: int = 0) -> str:
    return with_events(
        f"SELECT {_LIST} FROM records WHERE {where} ORDER BY t DESC, id DESC"
        f" LIMIT {limit + 1} OFFSET {offset}"
    )


ORACLE["list_logs_page1"] = _list("true", 50)
ORACLE["list_logs_page2"] = _list("true", 50, 50)
ORACLE["list_logs_filtered"] = _list(f"(sev IN (17, 13) OR sev IS NULL) AND svc = 'svc-3' AND {_DAYS}", 200)
ORACLE["list_logs_search"] = _list("sev = 13 AND body ILIKE '%purchase k=1%'", 100)
ORACLE["list_logs_unknown"] = _list("sev IS NULL", 10)

_COUNTS = {
    "level": "sev IN (17, 5)",
    "unknown": "sev IS NULL",
    "service": "svc = 'svc-0'",
    "search": "body LIKE '%from 10.0.1%'",
    "from": "t >= TIMESTAMP '2024-01-05'",
    "to": "t < TIMESTAMP '2024-01-05'",
    "inverted": "false",
    "cursor": "t < TIMESTAMP '2024-01-15' OR (t = TIMESTAMP '2024-01-15' AND id < '88888888-8888-8888-8888-888888888888')",
    "attribute_exists": "true",
    "attribute_missing": "false",
    "attribute_text": "event_type = 'click'",
    "attribute_number": "user_id = 7 AND event_type = 'view'",
    "attribute_type": "false",
}
ORACLE["count_logs_by_filter"] = with_events(
    " UNION ALL ".join(
        f"SELECT '{name}' AS filter, count(*) AS n FROM records WHERE {where}"
        for name, where in _COUNTS.items()
    )
)

_ISSUE = f"""fp AS fingerprint, sample AS sample_message, sev AS severity_number, n AS event_count,
  {_iso('first_seen')} AS first_seen, {_iso('last_seen')} AS last_seen,
  services AS affected_services, 'unresolved' AS status, false AS regression"""

ORACLE["list_issues"] = with_events(
    f"SELECT {_ISSUE} FROM issues ORDER BY last_seen DESC, fp LIMIT 500"
)
ORACLE["list_issues_filtered"] = with_events(
    f"SELECT {_ISSUE} FROM issues WHERE services = 'svc-2' AND (sev = 17 OR sev IS NULL)"
)
ORACLE["issue_lookup"] = with_events(
    f"SELECT {_ISSUE} FROM issues WHERE services = 'svc-1' AND sev = 17"
)

# --- issues

ORACLE["issue_fold"] = with_events(f"SELECT {_ISSUE} FROM issues")

ORACLE["issue_services"] = with_events(f"""
SELECT fp AS fingerprint, sample AS sample_message, sev AS severity_number,
  {_iso('first_seen')} AS first_seen, {_iso('last_seen')} AS last_seen, n AS event_count,
  coalesce(services, '') AS affected_services
FROM (
  SELECT event_type AS fp, arg_max(body, event_id) AS sample, any_value(sev) AS sev,
    arg_max(t, event_id) AS first_seen, max(t) AS last_seen, count(*) AS n
  FROM ev GROUP BY event_type)
LEFT JOIN (
  SELECT event_type AS fp, string_agg(svc, ',' ORDER BY seen DESC) AS services
  FROM (SELECT event_type, svc, max(event_id) AS seen FROM ev WHERE svc IS NOT NULL GROUP BY 1, 2)
  GROUP BY 1) USING (fp)""")

_HALVES = """
, early AS (SELECT fp, arg_min(body, event_id) AS sample, any_value(sev) AS sev, min(t) AS first_seen,
  max(t) AS last_seen, count(*) AS n, any_value(svc) AS svc FROM records
  WHERE t < TIMESTAMP '2024-01-15' GROUP BY fp),
late AS (SELECT fp, arg_min(body, event_id) AS sample, any_value(sev) AS sev, min(t) AS first_seen,
  max(t) AS last_seen, count(*) AS n, any_value(svc) AS svc FROM records
  WHERE t >= TIMESTAMP '2024-01-15' GROUP BY fp),
merged AS (SELECT fp, e.fp IS NOT NULL AS known, l.fp IS NOT NULL AS hit,
  CASE WHEN e.fp IS NOT NULL THEN e.sample ELSE l.sample END AS sample,
  coalesce(e.sev, l.sev) AS sev, coalesce(e.first_seen, l.first_seen) AS first_seen,
  coalesce(greatest(e.last_seen, l.last_seen), e.last_seen, l.last_seen) AS last_seen,
  e.last_seen AS early_seen, coalesce(e.n, 0) + coalesce(l.n, 0) AS n,
  coalesce(e.svc, l.svc, '') AS services
  FROM early e FULL OUTER JOIN late l USING (fp))"""

ORACLE["issue_merge"] = with_events(f"""{_HALVES}
SELECT fp AS fingerprint, sample AS sample_message, sev AS severity_number,
  {_iso('first_seen')} AS first_seen, {_iso('last_seen')} AS last_seen, n AS event_count,
  services AS affected_services,
  CASE WHEN known AND sev = 17 AND NOT hit THEN 'resolved'
    WHEN known AND sev = 13 THEN 'ignored' ELSE 'unresolved' END AS status,
  CASE WHEN known AND sev = 13 OR known AND sev = 17 AND NOT hit THEN {_iso('early_seen')} END AS resolved_at,
  known AND hit AND coalesce(sev = 17, false) AS regression
FROM merged""")

ORACLE["regressions"] = with_events(f"""{_HALVES}
SELECT fp AS fingerprint, sample AS sample_message, sev AS severity, n AS event_count,
  {_iso('first_seen')} AS first_seen, services FROM merged WHERE known AND hit""")

ORACLE["stored_regressions"] = ORACLE["regressions"]

# The state machine stepped action by action.
_STEPS = """
WITH RECURSIVE first AS (
  SELECT user_id, arg_min(event_type, event_id) AS kind, min(ts) AS moment FROM events GROUP BY 1),
known AS (
  SELECT 'u' || user_id AS fp, CASE kind WHEN 'view' THEN 'ignored' WHEN 'purchase' THEN 'resolved'
      ELSE 'unresolved' END AS status,
    CASE WHEN kind IN ('view', 'purchase') THEN moment END AS resolved_at, kind = 'click' AS regression
  FROM first WHERE kind <> 'error'),
actions AS (
  SELECT 'u' || user_id AS fp, CASE WHEN event_type IN ('click', 'purchase') THEN 'resolve'
      WHEN event_type IN ('error', 'signup') THEN 'ignore' ELSE 'reopen' END AS action, ts AS moment,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
walk AS (
  SELECT fp, CAST(0 AS BIGINT) AS i, status, resolved_at, regression, CAST(NULL AS VARCHAR) AS action,
    CAST(NULL AS VARCHAR) AS before FROM known
  UNION ALL
  SELECT w.fp, a.i,
    CASE WHEN a.action = 'ignore' THEN 'ignored'
      WHEN a.action = 'resolve' AND w.status = 'unresolved' THEN 'resolved'
      WHEN a.action = 'reopen' AND w.status = 'ignored' THEN 'unresolved' ELSE w.status END,
    CASE WHEN a.action = 'resolve' AND w.status = 'unresolved' THEN a.moment
      WHEN a.action = 'reopen' AND w.status = 'ignored' THEN NULL ELSE w.resolved_at END,
    CASE WHEN a.action = 'resolve' AND w.status = 'unresolved' THEN false ELSE w.regression END,
    a.action, w.status
  FROM walk w JOIN actions a ON a.fp = w.fp AND a.i = w.i + 1)
"""

ORACLE["issue_actions"] = f"""{_STEPS}
SELECT fp AS fingerprint, status, strftime(resolved_at, '%Y-%m-%d %H:%M:%S.%f') AS resolved_at, regression
FROM walk QUALIFY row_number() OVER (PARTITION BY fp ORDER BY i DESC) = 1"""

ORACLE["issue_actions_refused"] = f"""{_STEPS}
SELECT fp AS fingerprint, action, before AS status, count(*) AS n FROM walk
WHERE action = 'resolve' AND before <> 'unresolved' OR action = 'reopen' AND before <> 'ignored'
GROUP BY 1, 2, 3
UNION ALL
SELECT fp, action, NULL, count(*) FROM actions WHERE fp NOT IN (SELECT fp FROM known) GROUP BY 1, 2"""

ORACLE["blast_radius"] = with_events(f"""
SELECT translate({PLAIN}, chr(31), '|') AS pattern, count(DISTINCT svc) AS services,
  count(DISTINCT host) AS hosts, count(*) AS total
FROM records WHERE {_DAYS} GROUP BY 1""")

ORACLE["issue_timeline"] = with_events(f"""
SELECT {_iso('bucket')} AS bucket, count(t) AS total
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-24', INTERVAL 1 DAY)) AS bucket)
LEFT JOIN (SELECT * FROM records WHERE svc = 'svc-1' AND sev = 17) ON date_trunc('day', t) = bucket
GROUP BY bucket""")

ORACLE["orphan_records"] = "SELECT 0 AS without_issue, 0 AS without_job"

# --- jobs

_JOBS = """
WITH jobs AS (
  SELECT 'job-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'f' || user_id AS filename,
    CASE WHEN event_id % 2 = 0 THEN 'json-lines' END AS source_type,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
      ELSE 'completed' END AS status,
    CASE WHEN event_id % 5 > 0 THEN event_id % 1000 END AS total_lines,
    event_id * k % 1200 AS processed_lines, event_id * k % 1200 % 7 AS parse_errors,
    CASE WHEN event_id % 9 > 0 THEN k * 25 END AS elapsed_ms,
    CASE WHEN event_type = 'error' THEN 'disk full' END AS error, date_trunc('millisecond', ts) AS moment
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))
"""

ORACLE["import_status"] = f"""{_JOBS}
SELECT id, filename, status, source_type, total_lines, processed_lines, parse_errors,
  {_iso('moment')} AS created_at, CASE WHEN status IN ('failed', 'completed') THEN {_iso('moment')} END AS finished_at,
  error, CASE WHEN done THEN processed_lines - parse_errors END AS ingested_records,
  CASE WHEN done THEN elapsed_ms END AS elapsed_ms,
  CASE WHEN done THEN CASE WHEN elapsed_ms <= 0 THEN processed_lines
    ELSE CAST(floor(processed_lines / (elapsed_ms / 1000.0::DOUBLE) + 0.5) AS BIGINT) END END AS lines_per_second
FROM (SELECT *, status = 'completed' AND elapsed_ms IS NOT NULL AS done FROM jobs)"""

ORACLE["import_progress"] = f"""{_JOBS}
SELECT id, status, CASE WHEN total_lines > 0 THEN CAST(least(100,
    floor(processed_lines::DOUBLE / total_lines * 100 + 0.5)) AS INTEGER) END AS percent,
  status IN ('completed', 'failed') AS terminal FROM jobs"""

ORACLE["list_imports"] = f"""{_JOBS}
SELECT id, filename, status, {_iso('moment')} AS created_at, total_lines, processed_lines, parse_errors
FROM jobs ORDER BY moment DESC, id LIMIT 50"""

ORACLE["job_transitions"] = f"""{_JOBS}
SELECT upper(status) AS status, CAST(CASE status WHEN 'pending' THEN 0 WHEN 'running' THEN 2 ELSE 3 END AS INTEGER) AS step,
  count(*) AS jobs, CAST(sum(processed_lines) + CASE status WHEN 'running' THEN count(*) ELSE 0 END AS BIGINT) AS processed
FROM jobs GROUP BY jobs.status"""

# --- import from files


def _by_kind(field: str) -> str:
    return " ".join(
        ["CASE kind"]
        + [f"WHEN '{kind}' THEN {form[field]}" for kind, form in FORMS.items()]
        + ["END"]
    )


LANDED = f""", landed AS (
  SELECT ev.*, {KIND} AS kind FROM ev),
stored AS (
  SELECT event_id, t, kind, svc, turn, {_by_kind('body')} AS sbody, {_by_kind('sev')} AS ssev,
    {_by_kind('text')} AS stext, {_by_kind('host')} AS shost, {_by_kind('env')} AS senv,
    {_by_kind('attributes')} AS sattributes, {_by_kind('fp')} AS sfp
  FROM landed WHERE turn NOT IN (5, 6, 7, 8))
"""

ORACLE["ingest_records"] = with_events(f"""{LANDED}
SELECT {_iso('t')} AS "timestamp", sbody AS body, ssev AS severity_number, stext AS severity_text,
  svc AS service_name, shost AS host, senv AS environment, kind AS source_type, sfp AS fingerprint,
  sattributes AS attributes, strftime(t, '%Y-%m-%d') AS event_date FROM stored""")

ORACLE["ingest_rejects"] = with_events(f"""
SELECT {KIND} AS source_type, {ERROR_CODE} AS error_code, {RAW_DAMAGED} AS raw, count(*) AS n
FROM ev WHERE turn IN (5,6,7,8) GROUP BY 1, 2, 3""")

_STORED_ISSUES = with_events(f"""{LANDED}
SELECT sfp AS fingerprint, arg_min(sbody, event_id) AS sample_message,
  any_value(ssev) AS severity_number, {_iso('min(t)')} AS first_seen, {_iso('max(t)')} AS last_seen,
  count(*) AS event_count, coalesce(any_value(svc), '') AS affected_services,
  'unresolved' AS status, false AS regression
FROM stored GROUP BY sfp""")
ORACLE["ingest_issues"] = _STORED_ISSUES
ORACLE["stream_issues"] = _STORED_ISSUES
ORACLE["reprocess_issues"] = _STORED_ISSUES
ORACLE["stream_batches"] = _STORED_ISSUES

ORACLE["forced_type"] = with_events(f"""
SELECT {ERROR_CODE} AS error_code, 'json-lines' AS source_type, count(*) AS n FROM ev GROUP BY 1""")

_NOW = "TIMESTAMP '2024-01-20 06:00:00'"
ORACLE["time_presets"] = with_events(f"""
SELECT count(*) FILTER (t >= {_NOW} - INTERVAL 1 HOUR AND t < {_NOW}) AS in_1h,
  count(*) FILTER (t >= {_NOW} - INTERVAL 24 HOUR AND t < {_NOW}) AS in_24h,
  count(*) FILTER (t >= {_NOW} - INTERVAL 7 DAY AND t < {_NOW}) AS in_7d,
  count(*) FILTER (t >= {_NOW} - INTERVAL 30 DAY AND t < {_NOW}) AS in_30d,
  count(*) FILTER (t >= {_NOW} - INTERVAL 24 HOUR AND t < {_NOW}) AS in_ever,
  count(*) FILTER (t >= TIMESTAMP '2024-01-10' AND t < TIMESTAMP '2024-01-12') AS in_custom
FROM ev""")

ORACLE["ingest_jobs"] = with_events("""
SELECT coalesce(svc, 'none') AS service, 'completed' AS status, count(*) AS total_lines,
  count(*) AS processed_lines, count(*) FILTER (turn IN (5,6,7,8)) AS parse_errors,
  count(*) FILTER (turn NOT IN (5,6,7,8)) AS ingested_records
FROM ev GROUP BY 1""")

ORACLE["ingest_odd_names"] = with_events("""
SELECT coalesce(svc, 'none') AS service, 'completed' AS status, count(*) AS lines,
  count(*) FILTER (turn NOT IN (5,6,7,8)) AS records, count(*) FILTER (turn IN (5,6,7,8)) AS rejects
FROM ev GROUP BY 1""")

ORACLE["ingest_envelopes"] = with_events(f"""
SELECT 'u' || user_id AS service_name, count(*) AS events,
  count(DISTINCT CASE WHEN user_id = 0 THEN 0 ELSE event_id // 40 END) AS envelopes,
  min(body) AS first_body, max(body) AS last_body,
  {_iso('min(t)')} AS first_seen, {_iso('max(t)')} AS last_seen
FROM ev GROUP BY user_id""")

ORACLE["reprocess"] = with_events(f"""
SELECT {KIND} AS source_type, {ERROR_CODE} AS error_code, count(*) AS n,
  count(*) FILTER (turn NOT IN (5,6,7,8)) AS bodies
FROM ev GROUP BY 1, 2""")

_RENDERED = {
    "json-lines": f"""'{{"@timestamp":"' || {_iso('t')} || '",' || coalesce('"service":"' || svc || '",', '')
      || '"message":"' || body || '",' || coalesce('"host":"' || host || '",', '')
      || '"env":"production","trace_id":"' || trace || '"' || coalesce(',"level":"' || level || '"', '') || '}}'""",
    "gcp-cloud-logging": f"""'{{"logName":"projects/sample-project/logs/' || coalesce(svc, 'app')
      || '%2Fstderr","timestamp":"' || {_iso('t')} || '","resource":{{"type":"cloud_run_revision","labels":{{'
      || coalesce('"service_name":"' || svc || '",', '') || '"location":"us-central1"}}}},"textPayload":"' || body
      || '","trace":"projects/sample-project/traces/' || trace || '"'
      || coalesce(',"labels":{{"host":"' || host || '"}}', '') || coalesce(',"severity":"' || {GCP_LEVEL} || '"', '') || '}}'""",
    "aws-cloudwatch": f"""'{{"logGroup":"' || {GROUP} || '","logStream":"' || {STREAM} || '","id":"' || {EVENT_ID}
      || '","timestamp":' || epoch_ms(t) || ',"message":"' || CASE WHEN {STRUCTURED}
        THEN '{{\\"level\\":\\"' || level || '\\",\\"msg\\":\\"' || body || '\\"}}' ELSE body END || '"}}'""",
}
ORACLE["render_lines"] = with_events(
    " UNION ALL ".join(
        f"SELECT '{kind}' AS source_type, event_id, md5({sql}) AS digest FROM ev"
        for kind, sql in _RENDERED.items()
    )
)


ORACLE["ingest_bad_file"] = with_events("""
SELECT coalesce(svc, 'none') AS service, 'completed' AS status, count(*) AS lines,
  count(*) FILTER (turn NOT IN (5,6,7,8)) AS records, false AS explained
FROM ev GROUP BY 1
UNION ALL SELECT 'broken', 'failed', 0, 0, true""")

ORACLE["progress_rows"] = with_events("""
SELECT coalesce(svc, 'none') AS service, count(*) AS lines,
  count(*) FILTER (turn IN (5,6,7,8)) AS errors, 'running' AS status, true AS steady
FROM ev GROUP BY 1""")

ORACLE["compacted_store"] = with_events("""
SELECT phase, CAST(CAST(t AS DATE) AS VARCHAR) AS day, count(*) AS records,
  count(DISTINCT coalesce(svc, '') || '/' || event_type || '/' || coalesce(level, '')) AS fingerprints,
  CAST(sum(coalesce(sev, 0)) AS BIGINT) AS levels, 5 AS runs, (SELECT count(*) FROM ev) AS events
FROM ev, (VALUES ('before'), ('after'), ('vacuumed')) AS p(phase) GROUP BY 1, 2""")

ORACLE["issue_buckets"] = with_events("""
SELECT CASE WHEN sev = 17 THEN 'resolved' ELSE 'unresolved' END AS status,
  count(DISTINCT coalesce(svc, '') || '/' || event_type) AS issues, count(*) AS events, true AS sound
FROM ev GROUP BY 1""")

ORACLE["stream_state"] = ORACLE["ingest_issues"]

ORACLE["long_spans"] = with_events("""
SELECT event_id,
  CASE event_id % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'email' WHEN 2 THEN 'number' WHEN 3 THEN 'ipv6' ELSE 'email' END
    AS kinds,
  CAST(CASE event_id % 5 WHEN 0 THEN 600 + event_id % 1500 + length(CAST(user_id AS VARCHAR)) + 10
    WHEN 1 THEN 600 + event_id % 1500 + 7 WHEN 2 THEN length(CAST(user_id AS VARCHAR))
    WHEN 3 THEN 23 ELSE 600 + event_id % 1500 + 12 END AS INTEGER) AS signs
FROM ev""")
