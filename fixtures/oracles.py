"""The same inputs and results in plain SQL, written independently of the library.

Every statement is `WITH` the shared inputs and one query over them.
"""

from __future__ import annotations

FLAGS = (
    "has_request has_response has_impression has_click has_install has_lead "
    "has_postinstall has_vast has_ad_interactions"
).split()
FLAG_LIST = ", ".join(FLAGS)
MAX_FLAGS = ", ".join(f"max({f}) AS {f}" for f in FLAGS)
P = "event_year, event_month, event_day, event_hour"
ROW = f"unique_id, user_id, request_ts, {FLAG_LIST}, zone, {P}"

FILL = (
    "(has_impression = 1 OR has_click = 1 OR has_install = 1 OR has_lead = 1 "
    "OR has_postinstall = 1 OR has_vast = 1)"
)
NOFILL = (
    "(has_request = 1 AND has_impression IS NULL AND has_click IS NULL AND has_install IS NULL "
    "AND has_lead IS NULL AND has_postinstall IS NULL AND has_vast IS NULL)"
)
CLASS = f"CASE WHEN {FILL} THEN 'fill' WHEN {NOFILL} THEN 'nofill' ELSE 'unclassified' END"


def parts(ts: str, names: str = P) -> str:
    out = zip(("year", "month", "day", "hour"), names.split(", "))
    return ", ".join(f"CAST({fn}({ts}) AS INT) AS {name}" for fn, name in out)


def merge(source: str, where: str = "true") -> str:
    return (
        f"SELECT unique_id, user_id, request_ts, {MAX_FLAGS}, arg_max(zone, event_id) AS zone, "
        f"{parts('request_ts')} FROM {source} WHERE {where} GROUP BY unique_id, user_id, request_ts"
    )


INPUTS = f"""
WITH raw AS (
  SELECT event_id, ts, user_id, CAST(ts AS DATE) AS event_date,
    min(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS request_ts,
    concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS unique_id,
    event_type, value, k, props,
    concat('zone_', CAST(k % 9 AS STRING)) AS zone,
    CASE WHEN user_id % 11 <> 0 THEN 1 END AS has_request,
    CASE WHEN event_type <> 'error' THEN 1 END AS has_response,
    CASE WHEN event_type = 'view' THEN 1 END AS has_impression,
    CASE WHEN event_type = 'click' THEN 1 END AS has_click,
    CASE WHEN event_type = 'signup' THEN 1 END AS has_lead,
    CASE WHEN event_type = 'purchase' THEN 1 END AS has_install,
    CASE WHEN event_type = 'purchase' AND value > 100 THEN 1 END AS has_postinstall,
    CASE WHEN event_type = 'view' AND k >= 80 THEN 1 END AS has_vast,
    CASE WHEN k % 10 = 0 THEN 1 END AS has_ad_interactions,
    CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click'
      WHEN 'purchase' THEN 'install' WHEN 'signup' THEN 'app_event' WHEN 'error' THEN 'request' END AS kind
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e
),
ad AS ({merge('raw')}),
cls AS (SELECT *, CAST(request_ts AS DATE) AS event_date, {CLASS} AS event_class FROM ad),
hot AS (SELECT * FROM cls WHERE event_date >= DATE '2024-01-23'),
cold AS (
  SELECT * FROM cls WHERE event_class <> 'unclassified' AND event_date <= DATE '2024-01-23'
    AND (event_date > DATE '2024-01-15' OR has_click = 1)
),
defect AS (
  SELECT * FROM cls WHERE event_class <> 'unclassified'
    AND NOT (user_id % 50 = 7 AND event_day % 2 = 1)
),
zeros AS (
  SELECT * REPLACE (CASE WHEN has_vast IS NULL AND user_id % 13 = 0 THEN 0 ELSE has_vast END AS has_vast)
  FROM ad
),
users AS (
  SELECT c_custkey AS user_id, c_name AS name, n_name AS nation, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
ledger AS (
  SELECT 'profile_hourly' AS job_name, 2024 AS current_year, 1 AS current_month,
    29 AS current_day, h AS current_hour,
    2024 AS next_year, 1 AS next_month, 29 AS next_day, h + 1 AS next_hour, 4 AS week_number,
    CASE WHEN h % 5 = 0 THEN 0 ELSE 1 END AS is_processed, CAST(1 + h % 3 AS INT) AS retries
  FROM (SELECT DISTINCT CAST(hour(ts) AS INT) AS h FROM events) x WHERE h < 23
),
day_list AS (
  SELECT CAST(d AS DATE) AS event_date
  FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) t(d)
),
hour_list AS (
  SELECT event_date, CAST(h AS INT) AS event_hour FROM day_list, range(24) r(h)
),
rec_day AS (
  SELECT coalesce(h.event_date, c.event_date) AS event_date,
    coalesce(h.event_class, c.event_class) AS event_class,
    coalesce(h.n, 0) AS hot_rows, coalesce(c.n, 0) AS cold_rows
  FROM (SELECT event_date, event_class, count(*) AS n FROM cls WHERE event_class <> 'unclassified' GROUP BY ALL) h
  FULL JOIN (SELECT event_date, event_class, count(*) AS n FROM defect GROUP BY ALL) c
    ON h.event_date = c.event_date AND h.event_class = c.event_class
),
pct_day AS (
  SELECT *, CASE WHEN cold_rows <> 0 THEN (hot_rows - cold_rows) * 100 / cold_rows
    WHEN hot_rows = 0 THEN 0.0 ELSE 100.0 END AS pct_diff FROM rec_day
),
gate_day AS (SELECT event_date, bool_and(abs(pct_diff) < 1) AS passed FROM pct_day GROUP BY event_date),
rec_hour AS (
  SELECT coalesce(h.event_date, c.event_date) AS event_date,
    coalesce(h.event_hour, c.event_hour) AS event_hour,
    coalesce(h.event_class, c.event_class) AS event_class,
    coalesce(h.n, 0) AS hot_rows, coalesce(c.n, 0) AS cold_rows
  FROM (SELECT event_date, event_hour, event_class, count(*) AS n FROM cls
        WHERE event_class <> 'unclassified' GROUP BY ALL) h
  FULL JOIN (SELECT event_date, event_hour, event_class, count(*) AS n FROM defect GROUP BY ALL) c
    ON h.event_date = c.event_date AND h.event_hour = c.event_hour AND h.event_class = c.event_class
),
pct_hour AS (
  SELECT *, CASE WHEN cold_rows <> 0 THEN (hot_rows - cold_rows) * 100 / cold_rows
    WHEN hot_rows = 0 THEN 0.0 ELSE 100.0 END AS pct_diff FROM rec_hour
),
halves AS (SELECT CAST(lower_hour AS INT) AS lower_hour FROM (VALUES (0), (12)) v(lower_hour)),
drops AS (
  SELECT d.event_date AS lower_date, lower_hour,
    CASE WHEN lower_hour = 12 THEN CAST(d.event_date + INTERVAL 1 DAY AS DATE) ELSE d.event_date END AS upper_date,
    CASE WHEN lower_hour = 12 THEN 0 ELSE 12 END AS upper_hour,
    CASE WHEN coalesce(passed, false) THEN 'drop' ELSE 'hold' END AS action,
    CASE WHEN NOT coalesce(passed, false) THEN coalesce(off, concat(residue, ' rows of no class are in the hot tier only')) END AS reason,
    residue
  FROM (SELECT event_date, count(*) FILTER (WHERE event_class = 'unclassified') AS residue FROM cls GROUP BY event_date) d
  CROSS JOIN halves LEFT JOIN gate_day g ON d.event_date = g.event_date
  LEFT JOIN (
    SELECT event_date, string_agg(concat(event_class, ': ', hot_rows, ' hot rows, ', cold_rows, ' cold, off by ',
      CAST(floor(abs(pct_diff)) AS BIGINT), ' percent'), '; ' ORDER BY event_class) AS off
    FROM pct_day WHERE abs(pct_diff) >= 1 GROUP BY event_date) o ON d.event_date = o.event_date
),
change_day AS (
  SELECT coalesce(e.event_date, w.event_date) AS event_date, coalesce(e.event_hour, w.event_hour) AS event_hour,
    coalesce(e.n, 0) AS expected, coalesce(w.n, 0) AS written
  FROM (SELECT event_date, event_hour, count(*) AS n FROM cls WHERE event_class <> 'unclassified' GROUP BY ALL) e
  FULL JOIN (SELECT event_date, event_hour, count(*) AS n FROM defect GROUP BY ALL) w
    ON e.event_date = w.event_date AND e.event_hour = w.event_hour
),
change_gate AS (
  SELECT *, abs(pct_diff) <= 5 AS passed FROM (
    SELECT *, CASE WHEN expected <> 0 THEN (written - expected) * 100 / expected
      WHEN written = 0 THEN 0.0 ELSE 100.0 END AS pct_diff FROM change_day) x
),
message AS (
  SELECT event_id, event_date, kind, unique_id, user_id, ts, request_ts, zone, {FLAG_LIST},
    CASE WHEN event_id % 97 = 0 THEN substr(whole, 1, 40) ELSE whole END AS payload,
    CASE WHEN event_id % 97 = 0 THEN 'unparseable' WHEN event_id % 83 = 0 THEN 'bad_value'
      WHEN event_id % 89 = 0 THEN 'missing_key' END AS fault
  FROM (SELECT *, concat('{{"event_id":', event_id,
      ',"uniqueId":', CASE WHEN event_id % 89 = 0 THEN 'null' ELSE concat('"', unique_id, '"') END,
      ',"topology_entry_time":"', CAST(ts AS STRING), '","request_timestamp":"', CAST(request_ts AS STRING),
      '","user_id":', user_id, ',"zone":"', zone, '","event_type":"', event_type, '","cellid":', k,
      ',"topicname":"', event_type, '","appid":', CASE WHEN k % 2 = 0 THEN concat('"app', k, '"') ELSE 'null' END, ',',
      '"has_request":', CASE WHEN event_id % 83 = 0 THEN '"x"' ELSE coalesce(CAST(has_request AS STRING), 'null') END,
      {", ".join(f"""',"{f}":', coalesce(CAST({f} AS STRING), 'null')""" for f in FLAGS if f != "has_request")},
      '}}') AS whole FROM raw) m
)
"""

WEEK_U = "CAST(strftime({d}, '%U') AS INT)"

# The profile of merged rows: every hour, five of the nine zones.
ZONES = "('zone_0', 'zone_2', 'zone_4', 'zone_6', 'zone_8')"
PROFILE = (
    "count(*) FILTER (WHERE has_impression = 1) AS impressions, "
    "count(*) FILTER (WHERE has_click = 1) AS clicks"
)

OFFSETS = [(n, 24, f"{n:+d}d") for n in (2, 3, -1, -5, -6, -7, -8, -14, -15)] + [
    (n, 1, f"{n:+d}h") for n in (-1, -2)
]
OFFSET_VALUES = ", ".join(f"('{label}', {n * width})" for n, width, label in OFFSETS)

# Written out here, so that the library's own list is compared with something else.
REGISTRY = """
  ('ad_inflated', 'ad_inflated_messages', 100000, 'ad_inflated', 'hot_events'),
  ('ad_response', 'ad_responded_messages', 100000, 'ad_response', 'hot_events'),
  ('request', 'request_messages', 100000, 'request', 'hot_events'),
  ('impression', 'impression_messages', 100000, 'impression', 'hot_events'),
  ('click', 'click_messages', 50000, 'click', 'hot_events'),
  ('attribution', 'attribution_messages', 10000, 'attribution', 'hot_events'),
  ('install', 'install_messages', 50000, 'install', 'hot_events'),
  ('app_event', 'app_event_messages', 5000, 'app_event', 'hot_events'),
  ('vast', 'vast_messages', 100000, 'vast', 'hot_events'),
  ('generic_interaction', 'generic_interactions', 1000000, 'generic_interaction', 'interactions'),
  ('ad_interaction', 'ad_interactions', 10000, 'ad_interaction', 'interactions'),
  ('nrt_ad_interaction', 'ad_interactions', 10000, 'nrt_ad_interaction', 'hot_events')"""

# Rows as text, in the order of the columns' names, and 60 bits of their hash.
COLUMNS = sorted([*ROW.split(", "), "event_date", "event_class"])
TEXT = ", ".join(
    f"coalesce(CAST({'epoch_us(request_ts)' if name == 'request_ts' else name} AS STRING), '~')" for name in COLUMNS
)
CONTENT = f"sum(CAST(concat('0x', substr(md5(concat_ws('|', {TEXT})), 1, 15)) AS BIGINT))"

# The same without the date, per date and key bucket of two copies.
PLAIN = ", ".join(
    f"coalesce(CAST({'epoch_us(request_ts)' if name == 'request_ts' else name} AS STRING), '~')" for name in COLUMNS if name != "event_date"
)
PLAIN_ROW = f"CAST(concat('0x', substr(md5(concat_ws('|', {PLAIN})), 1, 15)) AS BIGINT)"
BUCKET = "CAST(CAST(concat('0x', substr(md5(unique_id), 1, 7)) AS BIGINT) % 16 AS INT)"
LEAF = f"event_date, {BUCKET} AS bucket, count(*) AS n, sum(user_id) AS ids, sum({PLAIN_ROW}) AS content"
BOTH = f"""
, leaves AS (
  SELECT coalesce(x.event_date, y.event_date) AS event_date, coalesce(x.bucket, y.bucket) AS bucket, x.n AS sn, y.n AS dn,
    concat_ws(' ', x.n, x.ids, x.content) AS s, concat_ws(' ', y.n, y.ids, y.content) AS d
  FROM (SELECT {LEAF} FROM cls WHERE event_class <> 'unclassified' AND event_date <> DATE '2024-01-30' GROUP BY ALL) x
  FULL JOIN (SELECT {LEAF} FROM (SELECT * REPLACE (CASE WHEN event_date = DATE '2024-01-10' THEN 0 ELSE has_vast END AS has_vast) FROM defect) z
    WHERE event_date <> DATE '2024-01-05' GROUP BY ALL) y ON x.event_date = y.event_date AND x.bucket = y.bucket
)"""

# Where each field of the feed goes, in the feed's order. Written out here
# too, so that the library's own list is compared with something else.
TARGETS = """
client_id country state city app_ver connection_type os_ver user_language unique_id cell_id ad_group_id
audience_segments device_resolution hostname location_src partner_id delivery_slab user_delivery_slab
nth_impression utm_source utm_medium utm_campaign install_delivery_slab install_cpi optimised_on
top_campaign_ids top_campaign_ecpms predicted_install_probability campaign_predicted_ctr promovdo_id
promo_topic topic_id topic_name dhtv_channel_id dhtv_type buzz_content_partner dhtv_source_key dhtv_relevance
dhtv_urgency dhtv_party_leaning pubname vdogroupkey article_id autoplaypref second_bidder_campaign
second_bidder_ecpm entity_id entity_type entity_subtype contentcontext parentcontentcontext product_ids
recopolicy event_year event_month event_day event_hour install_campaign_app_id install_campaign_app_id
""".split()


def mapped(i: int) -> str:
    """What the i-th field of the feed holds."""
    return f"CASE WHEN k % 7 <> {i} % 7 THEN concat(event_type, '-', (k + {i}) % 100) END"


KEYS = ("unique_id", "event_year", "event_month", "event_day", "event_hour")
PLAIN_TARGETS = ", ".join(f"{mapped(i)} AS {name}" for i, name in enumerate(TARGETS) if name not in KEYS and TARGETS.count(name) == 1)
MAPPED = f"{PLAIN_TARGETS}, coalesce({mapped(len(TARGETS) - 2)}, {mapped(len(TARGETS) - 1)}) AS install_campaign_app_id"

SPANS = """
, spans AS (
  SELECT n AS interval_id, lo, lo + to_minutes(CASE WHEN n % 40 = 0 THEN 11 * 1440 WHEN n % 7 = 0 THEN 20 ELSE 70 END) AS hi
  FROM (SELECT DISTINCT CAST(o_orderkey % 300 AS INT) AS n FROM orders) k, LATERAL (SELECT TIMESTAMP '2024-01-03' + to_minutes(n * 95) AS lo) l
)"""

QUERIES = {
    # sources and sinks
    "event_source": "SELECT event_id, ts, user_id, event_type, value, props FROM events",
    "hot_upsert_sink": f"""
SELECT {ROW}, cell_id, topic_name, install_campaign_app_id FROM ad JOIN (
  SELECT unique_id, CAST(arg_max(k, event_id) AS STRING) AS cell_id, arg_max(event_type, event_id) AS topic_name,
    arg_max(CASE WHEN k % 2 = 0 THEN concat('app', k) END, event_id) AS install_campaign_app_id
  FROM (SELECT *, row_number() OVER (PARTITION BY unique_id, kind ORDER BY ts DESC, event_id DESC) AS n FROM raw) r
  WHERE n = 1 GROUP BY unique_id) m USING (unique_id)""",
    "hot_mapped_fields": f"""
SELECT unique_id, {MAPPED} FROM raw QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ts DESC, event_id DESC) = 1""",
    "bucketed_enrich": f"SELECT {ROW}, nation, segment FROM ad LEFT JOIN users USING (user_id)",
    "cold_orc_sink": f"SELECT {ROW}, event_class FROM cls WHERE event_class <> 'unclassified'",
    "cold_orc_sink_day": f"SELECT {ROW}, event_class FROM cls WHERE event_class <> 'unclassified' AND event_date = DATE '2024-01-23'",
    "interaction_append": f"SELECT event_id, user_id, event_type, {parts('ts')} FROM events",
    "ad_interaction_flag": f"SELECT {ROW} FROM ad",
    "bad_records_sink": "SELECT 'request' AS app, CAST(0 AS BIGINT) AS batch_id, fault AS reason, payload FROM message WHERE fault IS NOT NULL",
    "migrate_hour": f"SELECT {ROW} FROM ad WHERE event_year = 2024 AND event_month = 1 AND event_day = 29 AND event_hour = 10",
    "migrate_day": f"SELECT {ROW} FROM cls WHERE event_date = DATE '2024-01-29'",
    "partition_sync": """
SELECT coalesce(s.event_date, d.event_date) AS event_date, s.n AS src_rows, d.n AS dst_rows,
  s.ids AS src_id_sum, d.ids AS dst_id_sum,
  CASE WHEN s.n IS NULL THEN 'keep' WHEN d.n IS NULL THEN 'copy'
    WHEN s.n = d.n AND s.ids = d.ids AND s.content = d.content THEN 'skip' ELSE 'update' END AS action
FROM (SELECT event_date, count(*) AS n, CAST(sum(user_id) AS DECIMAL(30,0)) AS ids, {content} AS content FROM cls
      WHERE event_class <> 'unclassified' AND event_date <> DATE '2024-01-30' GROUP BY event_date) s
FULL JOIN (SELECT event_date, count(*) AS n, CAST(sum(user_id) AS DECIMAL(30,0)) AS ids, {content} AS content
      FROM (SELECT * REPLACE (CASE WHEN event_date = DATE '2024-01-10' THEN 0 ELSE has_vast END AS has_vast) FROM defect) x
      WHERE event_date <> DATE '2024-01-05' GROUP BY event_date) d ON s.event_date = d.event_date""".format(content=CONTENT),
    "partition_prints": """
{both},
dates AS (
  SELECT event_date, CASE WHEN sum(sn) IS NULL THEN 'keep' WHEN sum(dn) IS NULL THEN 'copy'
    WHEN bool_and(s IS NOT DISTINCT FROM d) THEN 'skip' ELSE 'update' END AS action FROM leaves GROUP BY event_date)
SELECT event_date, bucket, 'update' AS action FROM leaves JOIN dates USING (event_date) WHERE action = 'update' AND s IS DISTINCT FROM d
UNION ALL SELECT event_date, CAST(NULL AS INT), action FROM dates WHERE action <> 'update'""".replace("{both}", BOTH),
    "sync_differences": """
SELECT coalesce(s.event_date, d.event_date) AS event_date, unique_id,
  CASE WHEN d.row IS NULL THEN 'new' WHEN s.row IS NULL THEN 'gone' ELSE 'changed' END AS status
FROM (SELECT event_date, unique_id, {row} AS row FROM cls
      WHERE event_class <> 'unclassified' AND event_date NOT IN (DATE '2024-01-30', DATE '2024-01-05')) s
FULL JOIN (SELECT event_date, unique_id, {row} AS row
      FROM (SELECT * REPLACE (CASE WHEN event_date = DATE '2024-01-10' THEN 0 ELSE has_vast END AS has_vast) FROM defect) x
      WHERE event_date NOT IN (DATE '2024-01-30', DATE '2024-01-05')) d USING (unique_id)
WHERE s.row IS DISTINCT FROM d.row""".replace("{row}", PLAIN_ROW),
    "users_dim_load": """
SELECT user_id, name, nation, coalesce(o_orderpriority, segment) AS segment, DATE '2024-01-30' AS load_date
FROM users LEFT JOIN (
  SELECT o_custkey, o_orderpriority,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders
) o ON user_id = o_custkey AND rn = 1""",
    "stream_metrics": "SELECT 'generic_interaction' AS query, CAST(0 AS BIGINT) AS batch_id, count(*) AS input_rows FROM events",
    "rate_limited_source": """
SELECT 'app_event' AS app, i AS batch_id, least(5000, n - 5000 * i) AS input_rows, n AS all_rows, kept AS all_kept
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE fault IS NULL) AS kept FROM message) m, range(200) r(i) WHERE 5000 * i < n""",
    "batch_metrics": """
SELECT kind AS app, CAST(0 AS BIGINT) AS batch_id,
  max(CASE WHEN fault IS NULL OR fault NOT IN ('unparseable') THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END) AS last_ts,
  count(*) AS input_rows, count(*) FILTER (WHERE fault IS NULL) AS kept_rows,
  count(*) FILTER (WHERE fault = 'unparseable') AS null_users,
  count(*) FILTER (WHERE fault = 'unparseable') AS unparseable, count(*) FILTER (WHERE fault = 'bad_value') AS bad_value,
  count(*) FILTER (WHERE fault = 'missing_key') AS missing_key, CAST(0 AS BIGINT) AS too_late, CAST(0 AS BIGINT) AS future
FROM message GROUP BY kind""",
    # projections
    "rename_map": f"SELECT event_id, unique_id, {MAPPED}, {parts('ts')} FROM raw",
    "rename_coalesce": """
SELECT event_id, CASE WHEN k % 3 = 0 THEN concat('app', k) WHEN k % 2 = 0 THEN concat('id', k) END
  AS install_campaign_app_id FROM raw""",
    "partition_columns_last": f"SELECT {ROW} FROM ad",
    "utc_parts": f"""
SELECT event_id, {", ".join(f"CASE WHEN k <> 50 THEN CAST({fn}(ts) AS INT) END AS {fn}" for fn in ("year", "month", "day", "hour"))}
FROM raw""",
    "calendar_offsets": f"""
SELECT label, {parts('moved', 'year, month, day, hour')}, sum(n)::BIGINT AS orders FROM (
  SELECT label, o_orderdate + to_hours(h) AS moved, n FROM (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1) o,
    (VALUES {OFFSET_VALUES}) v(label, h)) x GROUP BY ALL""",
    "legacy_schema_align": f"SELECT {ROW} FROM ad",
    "week_number": f"""
SELECT CAST(o_orderdate AS DATE) AS order_date, {WEEK_U.format(d="o_orderdate")} AS week_number, count(*) AS orders
FROM orders GROUP BY ALL""",
    "parse_events": """
SELECT event_id AS message_id,
  CASE WHEN event_id % 97 <> 0 AND event_id % 89 <> 0 THEN unique_id END AS unique_id,
  CASE WHEN event_id % 97 <> 0 THEN ts END AS ts,
  CASE WHEN event_id % 97 <> 0 THEN request_ts END AS request_ts,
  CASE WHEN event_id % 97 <> 0 THEN zone END AS zone,
  CASE WHEN event_id % 97 = 0 THEN payload END AS corrupt,
  event_id % 83 = 0 AND event_id % 97 <> 0 AS bad_value
FROM message""",
    "partition_derivation": f"SELECT event_id, unique_id, {parts('request_ts')} FROM raw",
    # filters
    "partition_slice": f"SELECT {ROW} FROM ad WHERE event_year = 2024 AND event_month = 1 AND event_day = 23",
    "fill_filter": f"SELECT {ROW} FROM zeros WHERE {FILL}",
    "nofill_filter": f"SELECT {ROW} FROM zeros WHERE {NOFILL}",
    "classify_events": f"SELECT {ROW}, {CLASS} AS event_class FROM zeros",
    "unclassified_audit": f"""
SELECT CAST(request_ts AS DATE) AS event_date,
  CASE WHEN has_request = 1 THEN 'zero_flag' ELSE 'no_request' END AS reason, count(*) AS rows
FROM zeros WHERE {CLASS} = 'unclassified' GROUP BY ALL""",
    "click_filter": f"SELECT {ROW} FROM cls WHERE has_click = 1 AND event_date > DATE '2024-01-15' AND event_date <= DATE '2024-01-23'",
    "rolling_window_filter": f"SELECT {ROW} FROM cls WHERE event_date > DATE '2024-01-15' AND event_date <= DATE '2024-01-30'",
    "history_filter": f"SELECT {ROW} FROM cls WHERE event_date <= DATE '2024-01-23'",
    "zone_filter": f"SELECT {ROW} FROM ad WHERE zone IN {ZONES}",
    "late_event_filter": "SELECT event_id, ts, event_type, 'kept' AS status FROM raw WHERE event_date BETWEEN DATE '2024-01-19' AND DATE '2024-01-27'"
    " UNION ALL SELECT event_id, ts, event_type, CASE WHEN event_date < DATE '2024-01-19' THEN 'too_late' ELSE 'future' END FROM raw"
    " WHERE event_date < DATE '2024-01-19' OR event_date > DATE '2024-01-27'",
    "appevents_retention": "SELECT event_id, ts, user_id, value FROM raw WHERE kind = 'app_event' AND event_date >= DATE '2024-01-10'",
    # merges and joins
    "lifecycle_merge": f"SELECT {ROW} FROM ad",
    "merge_increment": f"SELECT {ROW} FROM ad",
    "user_enrich": f"SELECT {ROW}, nation, segment FROM ad LEFT JOIN users USING (user_id)",
    "reconcile_join": "SELECT event_date, event_hour, event_class, hot_rows, cold_rows FROM rec_hour",
    "missing_partitions": """
SELECT event_date, event_hour FROM hour_list EXCEPT
SELECT event_date, event_hour FROM cls WHERE event_class = 'nofill'""",
    "unprocessed_hours": """
SELECT DATE '2024-01-29' AS event_date, h.event_hour, coalesce(retries, 0) AS retries
FROM (SELECT DISTINCT event_hour FROM hour_list) h LEFT JOIN ledger ON current_hour = h.event_hour
WHERE is_processed IS NULL OR (is_processed = 0 AND retries < 3)""",
    "stream_lookup": "SELECT event_id, user_id, event_type, nation, segment FROM events LEFT JOIN users USING (user_id)",
    # aggregations
    "daily_class_counts": "SELECT event_date, event_class, count(*) AS rows FROM cls GROUP BY ALL",
    "hourly_counts": """
SELECT CAST(h AS INT) AS event_hour, coalesce(n, 0) AS rows FROM range(24) r(h) LEFT JOIN (
  SELECT event_hour, count(*) AS n FROM cls WHERE event_class = 'fill' AND event_date = DATE '2024-01-23' GROUP BY 1
) c ON h = event_hour""",
    "count_pct_diff": "SELECT event_date, event_class, hot_rows, cold_rows, pct_diff FROM pct_day",
    "reconcile_gate": "SELECT event_date, passed FROM gate_day",
    "hourly_mismatch_alerts": """
SELECT event_date, event_hour, event_class, pct_diff, concat('Tier counts of ', event_class,
  ' differ by 1 percent or more for hour ', event_hour, ' of ', CAST(event_date AS STRING)) AS message
FROM pct_hour WHERE abs(pct_diff) >= 1""",
    "monitor_counts": f"""
SELECT event_date, event_hour, {", ".join(f"count(*) FILTER (WHERE {f} = 1) AS {f.removeprefix('has_')}s" for f in FLAGS)}
FROM cls GROUP BY ALL""",
    "monitor_rollup": """
SELECT event_date, event_hour, CAST(grouping(event_date, event_hour) AS INT) AS grouping,
  count(*) FILTER (WHERE has_click = 1) AS clicks, count(*) FILTER (WHERE has_impression = 1) AS impressions
FROM cls GROUP BY ROLLUP (event_date, event_hour)""",
    "availability_report": """
SELECT 'hot' AS tier, event_class, min(event_date) AS first_date, max(event_date) AS last_date, count(*) AS rows FROM hot GROUP BY ALL
UNION ALL SELECT 'cold', event_class, min(event_date), max(event_date), count(*) FROM cold GROUP BY ALL""",
    "partition_inventory": f"SELECT {P}, count(*) AS rows, min(request_ts) AS first_ts, max(request_ts) AS last_ts FROM ad GROUP BY ALL",
    "action_digest": """
SELECT status, string_agg(item, '<br>' ORDER BY item) AS report FROM (
  SELECT action AS status, concat(CAST(lower_date AS STRING), printf(' %02d:00 to ', lower_hour), CAST(upper_date AS STRING),
    printf(' %02d:00', upper_hour)) AS item
  FROM drops) x GROUP BY status""",
    # views
    "tier_view": f"""
SELECT {ROW} FROM hot WHERE event_date > DATE '2024-01-23' AND event_date <= DATE '2024-01-30'
UNION ALL SELECT {ROW} FROM cold WHERE event_date > DATE '2024-01-15' AND event_date <= DATE '2024-01-23'""",
    "clicks_view": f"""
SELECT {ROW} FROM hot WHERE has_click = 1 AND event_date > DATE '2024-01-23' AND event_date <= DATE '2024-01-30'
UNION ALL SELECT {ROW} FROM cold WHERE has_click = 1 AND event_date <= DATE '2024-01-23'""",
    "view_definition": f"""
SELECT {ROW} FROM hot WHERE event_date > DATE '2024-01-23' AND event_date <= DATE '2024-01-30'
UNION ALL SELECT {ROW} FROM cold WHERE event_class = 'fill' AND event_date > DATE '2024-01-15' AND event_date <= DATE '2024-01-23'""",
    "tier_overlap_audit": """
SELECT event_date, count(*) AS overlap_keys FROM (
  SELECT event_date, unique_id FROM hot INTERSECT SELECT event_date, unique_id FROM cold) x GROUP BY event_date""",
    # lifecycle
    "range_plan_halfday": """
SELECT CAST(d + INTERVAL 2 DAY AS DATE) AS lower_date, lower_hour,
  CAST(d + CASE WHEN lower_hour = 12 THEN INTERVAL 3 DAY ELSE INTERVAL 2 DAY END AS DATE) AS upper_date,
  CASE WHEN lower_hour = 12 THEN 0 ELSE 12 END AS upper_hour
FROM (SELECT DISTINCT o_orderdate AS d FROM orders) o CROSS JOIN halves""",
    "range_plan_day": """
SELECT CAST(d + INTERVAL 2 DAY AS DATE) AS lower_date, 0 AS lower_hour,
  CAST(d + INTERVAL 3 DAY AS DATE) AS upper_date, 0 AS upper_hour
FROM (SELECT DISTINCT o_orderdate AS d FROM orders) o""",
    "range_assign": """
SELECT unique_id, event_hour, CASE WHEN event_date <> DATE '2024-01-13' THEN event_date END AS lower_date,
  CASE WHEN event_date <> DATE '2024-01-13' THEN CASE WHEN event_hour < 12 THEN 0 ELSE 12 END END AS lower_hour,
  event_date <> DATE '2024-01-13' AS covered FROM cls""",
    "interval_assign": f"""{SPANS}
SELECT unique_id, request_ts, interval_id, lo, hi, interval_id IS NOT NULL AS covered
FROM ad LEFT JOIN spans ON lo <= request_ts AND request_ts < hi""",
    "interval_overlaps": f"""{SPANS}
SELECT a.interval_id AS first, b.interval_id AS second, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi
FROM spans a JOIN spans b ON a.interval_id < b.interval_id AND a.lo < b.hi AND b.lo < a.hi""",
    "gated_drop_plan": "SELECT lower_date, lower_hour, upper_date, upper_hour, action, reason, residue FROM drops",
    "partition_discovery": """
SELECT DISTINCT concat('event_year=', event_year, '/event_month=', event_month, '/event_day=', event_day,
  '/event_hour=', event_hour) AS partition,
  CASE WHEN event_date <= DATE '2024-01-23' THEN 'present' ELSE 'added' END AS status
FROM cls WHERE event_class = 'fill'""",
    "compact_to_clicks": f"SELECT {ROW} FROM cls WHERE event_class = 'fill' AND (event_date <> DATE '2024-01-15' OR has_click = 1)",
    "nofill_retention": f"SELECT {ROW} FROM cls WHERE event_class = 'nofill' AND event_date > DATE '2024-01-15'",
    "nofill_retention_plan": """
SELECT DISTINCT 'day' AS level, event_year AS year, event_month AS month, event_day AS day
FROM cls WHERE event_class = 'nofill' AND event_date <= DATE '2024-02-01'
UNION ALL SELECT DISTINCT 'month', event_year, event_month, CAST(NULL AS INT) FROM cls WHERE event_class = 'nofill'""",
    "failed_day_reset": """
SELECT k.event_class, CAST(h AS INT) AS hour, CASE WHEN n > 0 THEN 'dropped' ELSE 'absent' END AS status
FROM range(24) r(h) CROSS JOIN (VALUES ('fill'), ('nofill')) k(event_class)
LEFT JOIN (SELECT event_class, event_hour, count(*) AS n FROM cls WHERE event_date = DATE '2024-01-23' GROUP BY ALL) c
  ON h = event_hour AND c.event_class = k.event_class""",
    "tier_plan": """
SELECT event_date, age_days, unnest(CASE WHEN age_days < -2 THEN ['none'] WHEN age_days = -2 THEN ['create']
  WHEN age_days < 7 THEN ['hot'] WHEN age_days = 7 THEN ['sink', 'drop_hot'] WHEN age_days < 15 THEN ['cold']
  WHEN age_days = 15 THEN ['compact', 'delete_nofill'] ELSE ['clicks_only'] END) AS action
FROM (SELECT CAST(d AS DATE) AS event_date, CAST(date_diff('day', d, TIMESTAMP '2024-01-30') AS INT) AS age_days
  FROM (SELECT unnest(generate_series(CAST(min(CAST(ts AS DATE)) AS TIMESTAMP),
    max(CAST(ts AS DATE)) + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS d FROM events) x) y""",
    "daily_chain": """
SELECT 'sink' AS stage, 'ok' AS status, count(*) AS rows FROM cls WHERE event_class <> 'unclassified' AND event_date = DATE '2024-01-23'
UNION ALL SELECT 'view', 'ok', count(*) FROM cls WHERE event_class <> 'unclassified' AND event_date = DATE '2024-01-23'
UNION ALL SELECT 'reconcile', 'ok', 0 UNION ALL SELECT 'drop', 'ok', 2""",
    # streaming
    "checkpoint_resume": f"SELECT {ROW} FROM ad",
    "stream_registry": f"""
SELECT r.kind, topic, max_records, checkpoint, target, coalesce(n, 0) AS events
FROM (VALUES {REGISTRY}) r(kind, topic, max_records, checkpoint, target)
LEFT JOIN (SELECT kind, count(*) AS n FROM raw GROUP BY kind) e ON r.kind = e.kind""",
    "bad_record_routing": """
SELECT kind AS app, CAST(0 AS BIGINT) AS batch_id, reason, payload FROM (
  SELECT *, CASE WHEN fault IS NOT NULL THEN fault
    WHEN event_date < DATE '2024-01-27' - CASE WHEN kind = 'app_event' THEN INTERVAL 20 DAY ELSE INTERVAL 18 DAY END THEN 'too_late'
    WHEN event_date > DATE '2024-01-29' THEN 'future' END AS reason FROM message) m
WHERE reason IS NOT NULL""",
    "bad_record_cadence": """
SELECT 'request' AS app, CASE WHEN slot = 0 THEN CAST(0 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS batch_id,
  fault AS reason, count(*) AS rows
FROM (SELECT fault, CASE WHEN event_date <= DATE '2024-01-10' THEN 0 WHEN event_date <= DATE '2024-01-20' THEN 1 ELSE 2 END AS slot
  FROM message WHERE fault IS NOT NULL) m GROUP BY ALL""",
    "stream_late_data": merge(
        "raw",
        "event_date >= DATE '2024-01-24' OR (kind = 'app_event' AND event_date >= DATE '2024-01-10')",
    ),
    "stream_hourly_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS rows FROM events GROUP BY ALL",
    "stream_dedupe": f"SELECT event_id, user_id, event_type, {parts('ts')} FROM events",
    "stream_daily_rollup": """
SELECT CAST(h AS DATE) AS event_date, event_type, CAST(sum(n) AS BIGINT) AS rows, max(n) AS busiest
FROM (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n FROM events GROUP BY ALL) x GROUP BY ALL""",
    "stream_freshness": f"""
SELECT r.kind, last_ts, CAST(date_sub('hour', last_ts, TIMESTAMP '2024-01-31 00:00:00') AS BIGINT) AS lag_hours,
  coalesce(date_sub('hour', last_ts, TIMESTAMP '2024-01-31 00:00:00') > 1, true) AS stale
FROM (VALUES {REGISTRY}) r(kind, topic, max_records, checkpoint, target)
LEFT JOIN (SELECT kind, max(ts) AS last_ts FROM raw GROUP BY kind) e ON r.kind = e.kind""",
    # profile and ledger
    "profile_hour": f"""
SELECT user_id, zone, {PROFILE} FROM cls WHERE event_date = DATE '2024-01-29' AND event_hour = 10
  AND zone IN {ZONES} AND (has_impression = 1 OR has_click = 1) GROUP BY ALL""",
    "profile_week": f"""
SELECT *, CASE WHEN impressions <> 0 THEN clicks / impressions END AS ctr FROM (
  SELECT event_year AS profile_year, {WEEK_U.format(d="event_date")} AS week_number, user_id, zone, {PROFILE}
  FROM cls WHERE zone IN {ZONES} AND (has_impression = 1 OR has_click = 1) GROUP BY ALL) x""",
    "profile_corrected": f"""
SELECT *, CASE WHEN impressions <> 0 THEN clicks / impressions END AS ctr FROM (
  SELECT event_year AS profile_year, {WEEK_U.format(d="event_date")} AS week_number, user_id, zone, {PROFILE}
  FROM cls WHERE zone IN {ZONES} AND (has_impression = 1 OR has_click = 1) GROUP BY ALL) x""",
    "profile_backfill": f"""
SELECT user_id, zone, {PROFILE} FROM cold WHERE event_class = 'fill' AND event_date = DATE '2024-01-23' AND event_hour = 10
  AND zone IN {ZONES} AND (has_impression = 1 OR has_click = 1) GROUP BY ALL""",
    "profile_change_gate": "SELECT event_date, event_hour, expected, written, pct_diff, passed FROM change_gate",
    "ledger_append": f"""
SELECT 'profile_hourly' AS job_name, {parts('h', 'current_year, current_month, current_day, current_hour')},
  {parts('h + INTERVAL 1 HOUR', 'next_year, next_month, next_day, next_hour')},
  {WEEK_U.format(d="h")} AS week_number, is_processed, retries
FROM (SELECT DISTINCT date_trunc('hour', ts) AS h FROM events) x CROSS JOIN LATERAL (
  SELECT 0 AS is_processed, 1 AS retries
  UNION ALL SELECT CASE WHEN hour(h) % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN hour(h) % 2 = 0 THEN 1 ELSE 2 END) y""",
    "reprocess_plan": """
SELECT coalesce(l.event_date, g.event_date) AS event_date, coalesce(l.event_hour, g.event_hour) AS event_hour,
  coalesce(retries, 0) + 1 AS retries,
  CASE WHEN is_processed IS NULL THEN 'never_recorded' WHEN is_processed = 0 THEN 'unprocessed'
    ELSE 'count_mismatch' END AS reason
FROM (SELECT DATE '2024-01-29' AS event_date, current_hour AS event_hour, is_processed, retries FROM ledger) l
FULL JOIN change_gate g ON l.event_date = g.event_date AND l.event_hour = g.event_hour
WHERE coalesce(retries, 0) < 10 AND (is_processed IS NULL OR is_processed = 0 OR NOT passed)""",
}


def sql() -> dict[str, str]:
    return {name: INPUTS + body for name, body in QUERIES.items()}
