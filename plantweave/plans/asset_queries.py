"""Lifecycle, cooldowns, commands, observability and alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plantweave.operators import alerts, commands, lifecycle, observability, throttle
from plantweave.plans import views as v
from plantweave.plans.drift_queries import sql_cooldown
from plantweave.plans.registry import query

STALE_MS = 2 * 86_400_000
HOUR_MS = v.HOUR_MS
_REASON = f"'no_data_for_{STALE_MS // 1000}s'"
_LIFE = f"""{v.ACTIVITY},
before_rows AS (SELECT *, CASE WHEN kind = 'data' THEN 0 ELSE 1 END AS rnk FROM activity),
seen AS (SELECT *, max(CASE WHEN kind = 'data' THEN ts END) OVER w AS d, max(CASE WHEN kind = 'death' THEN ts END) OVER w AS x FROM before_rows
  WINDOW w AS (PARTITION BY asset_id ORDER BY ts, rnk, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
st AS (SELECT *, d IS NOT NULL AND x IS NOT NULL AND x >= d AS off FROM seen),
life AS (
  SELECT asset_id, 'online' AS previous_state, 'stale' AS new_state, d + {STALE_MS} AS timestamp_ms, {_REASON} AS reason FROM st
    WHERE d IS NOT NULL AND NOT off AND ts - d > {STALE_MS}
  UNION ALL SELECT asset_id, CASE WHEN d IS NULL THEN NULL WHEN off THEN 'offline' ELSE 'stale' END, 'online', ts,
    CASE WHEN d IS NULL THEN 'first_seen' ELSE 'data_received' END FROM st WHERE kind = 'data' AND (d IS NULL OR off OR ts - d > {STALE_MS})
  UNION ALL SELECT asset_id, CASE WHEN ts - d > {STALE_MS} THEN 'stale' ELSE 'online' END, 'offline', ts, 'ddeath' FROM st
    WHERE kind = 'death' AND d IS NOT NULL AND NOT off
  UNION ALL SELECT asset_id, 'online', 'stale', d + {STALE_MS}, {_REASON} FROM (SELECT asset_id, max(CASE WHEN kind = 'data' THEN ts END) AS d,
      max(CASE WHEN kind = 'death' THEN ts END) AS x FROM activity GROUP BY asset_id) WHERE (x IS NULL OR x < d) AND {v.AS_OF_MS} - d > {STALE_MS}),
states AS (SELECT asset_id, CASE WHEN x >= d THEN 'offline' WHEN {v.AS_OF_MS} - d > {STALE_MS} THEN 'stale' ELSE 'online' END AS state,
    first_seen_ms, d AS last_seen_ms FROM (SELECT asset_id, max(CASE WHEN kind = 'data' THEN ts END) AS d,
      max(CASE WHEN kind = 'death' THEN ts END) AS x, min(CASE WHEN kind = 'data' THEN ts END) AS first_seen_ms FROM activity GROUP BY asset_id) WHERE d IS NOT NULL)"""


def life_events(spark, sf):
    return lifecycle.events(v.activity(spark, sf), v.AS_OF_MS, STALE_MS)


def states(spark, sf):
    return lifecycle.status(v.activity(spark, sf), v.AS_OF_MS, STALE_MS)


@query("lifecycle_events", f"WITH {_LIFE} SELECT asset_id, previous_state, new_state, timestamp_ms, reason FROM life")
def lifecycle_events(spark, sf):
    return life_events(spark, sf)


_TOPICS_OF = """asset_topics AS (SELECT DISTINCT asset_id, topic FROM topics)"""
_LIFE_TOPICS = f"{v.TOPICS}, {_TOPICS_OF}, {_LIFE}"


def topics_of(spark, sf):
    return lifecycle.asset_topics(v.topics(spark, sf))


@query(
    "asset_status",
    f"""WITH {_LIFE_TOPICS} SELECT s.asset_id, state, first_seen_ms, last_seen_ms, round(({v.AS_OF_MS} - last_seen_ms) / 1000.0::DOUBLE, 3) AS age_s,
      (SELECT count(*) FROM asset_topics t WHERE t.asset_id = s.asset_id) AS topic_count FROM states s""",
)
def asset_status(spark, sf):
    rows = lifecycle.status_with_topics(states(spark, sf), topics_of(spark, sf))
    return rows.withColumn("age_s", F.round("age_s", 3))


@query("asset_topics", f"WITH {_LIFE_TOPICS} SELECT asset_id, topic FROM asset_topics")
def asset_topics(spark, sf):
    return topics_of(spark, sf)


@query(
    "asset_state_counts",
    f"""WITH {_LIFE} SELECT count(*) FILTER (state = 'online') AS online, count(*) FILTER (state = 'stale') AS stale,
      count(*) FILTER (state = 'offline') AS offline, count(*) AS total FROM states""",
)
def asset_state_counts(spark, sf):
    return lifecycle.state_counts(states(spark, sf))


@query(
    "lifecycle_payloads",
    f"""WITH {_LIFE} SELECT 'UNS/Sys/Lifecycle/' || {v.sql_segment("replace(asset_id, 'https://', '')", 128)} AS topic,
      '{{"assetId": "' || asset_id || '", "previousState": ' || coalesce('"' || previous_state || '"', 'null') || ', "newState": "' || new_state
      || '", "timestamp": ' || timestamp_ms || ', "reason": "' || reason || '"}}' AS payload FROM life""",
)
def lifecycle_payloads(spark, sf):
    return lifecycle.event_payloads(life_events(spark, sf))


@query(
    "offline_tombstones",
    f"WITH {_LIFE_TOPICS} SELECT topic, CAST(NULL AS VARCHAR) AS payload FROM asset_topics JOIN states USING (asset_id) WHERE state = 'offline'",
)
def offline_tombstones(spark, sf):
    return lifecycle.clear_offline_topics(states(spark, sf), topics_of(spark, sf))


@query("assets_removed", f"WITH {_LIFE} SELECT asset_id, state FROM states WHERE state <> 'offline'")
def assets_removed(spark, sf):
    current = states(spark, sf)
    gone = current.filter("state = 'offline'").select("asset_id")
    return lifecycle.remove_assets(current, gone).select("asset_id", "state")


@query(
    "lifecycle_gauges",
    f"""WITH {_LIFE} SELECT {v.AS_OF_MS} AS ts, 'assets_' || s AS name, CAST((SELECT count(*) FROM states WHERE state = s) AS DOUBLE) AS value
    FROM (VALUES ('online'), ('stale'), ('offline')) t(s)""",
)
def lifecycle_gauges(spark, sf):
    return lifecycle.gauges(states(spark, sf), F.lit(v.AS_OF_MS))


# -- cooldown -----------------------------------------------------------------

COOLDOWN_MS = 5 * HOUR_MS


@query(
    "alert_cooldown",
    f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ts, event_id FROM events),
    {sql_cooldown('e', 'user_id', 'ts', COOLDOWN_MS)} SELECT k AS user_id, t AS ts, (SELECT min(event_id) FROM e WHERE user_id = k AND ts = t) AS event_id FROM fired""",
)
def alert_cooldown(spark, sf):
    rows = v.events(spark, sf).select("user_id", "ts", "event_id")
    return throttle.cooldown(rows, ["user_id"], "ts", ["event_id"], COOLDOWN_MS)


@query(
    "file_debounce",
    f"""WITH RECURSIVE e AS (SELECT 'file-' || user_id || '.json' AS path, (epoch_us(ts) // 1000) // 3600 AS ts FROM events),
    {sql_cooldown('e', 'path', 'ts', 2000)} SELECT k AS path, t AS ts FROM fired""",
)
def file_debounce(spark, sf):
    rows = v.events(spark, sf).select(
        F.concat(F.lit("file-"), F.col("user_id"), F.lit(".json")).alias("path"),
        F.floor(F.col("ts") / 3600).cast("bigint").alias("ts"),
    )
    return throttle.cooldown_times(rows, ["path"], "ts", 2000)


# -- commands -----------------------------------------------------------------


def parsed(spark, sf):
    return commands.parse(v.commands(spark, sf))


def finished(spark, sf):
    authorised = commands.authorise(parsed(spark, sf)[0])
    return commands.with_outcomes(authorised, v.command_outcomes(spark, sf))


@query("command_messages", f"WITH {v.COMMANDS} SELECT event_id, topic FROM cmd0")
def command_messages(spark, sf):
    return commands.command_messages(v.commands(spark, sf)).select("event_id", "topic")


@query("commands_parsed", f"WITH {v.COMMANDS} SELECT event_id, submodel_id, property_path, value_json, correlation_id, requestor FROM cmds")
def commands_parsed(spark, sf):
    return parsed(spark, sf)[0].drop("ts", "topic", "payload")


@query("commands_rejected", f"WITH {v.COMMANDS} SELECT event_id, bad AS reason FROM cmd1 WHERE bad IS NOT NULL")
def commands_rejected(spark, sf):
    return parsed(spark, sf)[1].select("event_id", "reason")


@query("commands_authorised", f"WITH {v.COMMANDS} SELECT event_id, error IS NULL AS authorised, error FROM authd")
def commands_authorised(spark, sf):
    return commands.authorise(parsed(spark, sf)[0]).select("event_id", "authorised", "error")


@query(
    "write_intents",
    f"""WITH {v.COMMANDS} SELECT event_id, submodel_id, regexp_replace(array_to_string([CASE WHEN regexp_full_match(s, 'a[0-9]+a')
      THEN '[' || replace(s, 'a', '') || ']' ELSE '.' || s END FOR s IN string_split(property_path, '/')], ''), '^\\.', '') AS api_path,
      value_json FROM authd WHERE error IS NULL""",
)
def write_intents(spark, sf):
    return commands.write_intents(commands.authorise(parsed(spark, sf)[0]))


_ANSWER = """topic || CASE WHEN result = 'success' THEN '/ack' ELSE '/nak' END"""
_CORR = """CASE WHEN correlation_id IS NULL THEN '' ELSE ', "correlationId": "' || correlation_id || '"' END"""
_RESPONSE = f"""CASE WHEN result = 'success' THEN '{{"success": true, "timestamp": ' || ts || {_CORR} || '}}'
  ELSE '{{"success": false, "errors": ["' || reason || '"], "timestamp": ' || ts || {_CORR} || '}}' END"""


@query("command_responses", f"WITH {v.COMMANDS} SELECT event_id, {_ANSWER} AS topic, {_RESPONSE} AS payload FROM fin")
def command_responses(spark, sf):
    return commands.responses(finished(spark, sf))


@query("command_denials_only", f"WITH {v.COMMANDS} SELECT event_id, {_ANSWER} AS topic FROM fin WHERE result = 'denied'")
def command_denials_only(spark, sf):
    return commands.responses(finished(spark, sf), confirm=False).select("event_id", "topic")


def _entry(name: str, topic: str, value: str, result: str, reason: str) -> str:
    opt = lambda key, e: f"coalesce(', \"{key}\": ' || {e}, '')"
    quote = lambda e: f"'\"' || {e} || '\"'"
    return (
        f"'{{\"audit_event\": \"' || {name} || '\", \"topic\": \"' || {topic} || '\", \"timestamp_ms\": ' || ts || ', \"submodel_id\": \"' || submodel_id"
        f" || '\", \"property_path\": \"' || property_path || '\"' || {opt('value', value)} || {opt('result', quote(result))} || {opt('reason', quote(reason))}"
        f" || {opt('correlation_id', quote('correlation_id'))} || {opt('requestor', quote('requestor'))} || '}}'"
    )


def _audit_sql(shown: str) -> str:
    value = f"CASE WHEN value_json <> 'null' THEN {shown} END"
    none = "CAST(NULL AS VARCHAR)"
    done = "CASE WHEN result = 'denied' THEN 'write_validated' ELSE 'write_executed' END"
    answered = "CASE WHEN result = 'success' THEN 'success' ELSE 'denied' END"
    received = "'write_command_received'"
    sent = "'write_response_sent'"
    return f"""WITH {v.COMMANDS} SELECT event_id, 1 AS step, {received} AS audit_event, {_entry(received, 'topic', value, none, none)} AS entry FROM fin
    UNION ALL SELECT event_id, 2, {done}, {_entry(done, 'topic', value, 'result', 'reason')} FROM fin
    UNION ALL SELECT event_id, 3, {sent}, {_entry(sent, _ANSWER, none, answered, 'reason')} FROM fin"""


@query("command_audit", _audit_sql("value_json"))
def command_audit(spark, sf):
    return commands.audit_trail(finished(spark, sf))


@query("command_audit_redacted", _audit_sql("'\"[REDACTED]\"'"))
def command_audit_redacted(spark, sf):
    return commands.audit_trail(finished(spark, sf), redact=True)


@query(
    "command_totals",
    f"""WITH {v.COMMANDS} SELECT count(*) FILTER (result = 'success') AS write_count, count(*) FILTER (result = 'failed') AS error_count,
      count(*) FILTER (result <> 'denied') AS allowed, count(*) FILTER (result = 'denied') AS denied FROM fin""",
)
def command_totals(spark, sf):
    return commands.totals(finished(spark, sf))


# -- samples and alerts -------------------------------------------------------

_COUNTER = f"""ev AS (SELECT event_type, 'plant-' || (user_id % 3) AS instance, value, epoch_us(ts) // 1000 AS ms FROM events),
steps AS (SELECT event_type, instance, (ms // {HOUR_MS} + 1) * {HOUR_MS} AS ts, count(*) AS n FROM ev GROUP BY ALL),
grid AS (SELECT s.event_type, s.instance, g.ts FROM (SELECT DISTINCT event_type, instance FROM steps) s,
  (SELECT unnest(range(min(ts), max(ts) + 1, {HOUR_MS})) AS ts FROM steps) g),
counters AS (SELECT 'events_total' AS name, event_type, instance, ts, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY event_type, instance ORDER BY ts) AS DOUBLE) AS value
  FROM grid LEFT JOIN steps USING (event_type, instance, ts)),
inc AS (SELECT *, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS inc FROM counters WINDOW w AS (PARTITION BY event_type, instance ORDER BY ts))"""
LABELS = ["event_type", "instance"]


def plant_events(spark, sf):
    return v.events(spark, sf).withColumn("instance", F.concat(F.lit("plant-"), F.col("user_id") % 3))


def counters(spark, sf):
    return observability.counter_samples(plant_events(spark, sf), "events_total", LABELS, "ts", HOUR_MS)


@query("counter_samples", f"WITH {_COUNTER} SELECT name, event_type, instance, ts, value FROM counters")
def counter_samples(spark, sf):
    return counters(spark, sf)


@query(
    "gauge_last",
    "SELECT 'value' AS name, event_type, arg_max(value, event_id) AS value FROM events GROUP BY event_type",
)
def gauge_last(spark, sf):
    rows = v.events(spark, sf).select(F.lit("value").alias("name"), "event_type", F.col("event_id").alias("ts"), "value")
    return observability.gauge_last(rows, ["event_type"])


BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
_HIST = f"""hist AS (SELECT event_type, le, count(*) FILTER (value <= le) AS cumulative FROM events,
  (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in BOUNDS)}, 'inf'::DOUBLE]) AS le) GROUP BY ALL)"""


@query("value_histogram", f"WITH {_HIST} SELECT event_type, le, cumulative FROM hist")
def value_histogram(spark, sf):
    return observability.histogram(v.events(spark, sf), ["event_type"], "value", BOUNDS)


@query(
    "alert_increase",
    f"""WITH {_COUNTER} SELECT event_type, instance, ts, increase, round(increase / {6 * HOUR_MS / 1000}, 9) AS rate FROM (
      SELECT *, sum(inc) OVER (PARTITION BY event_type, instance ORDER BY ts RANGE BETWEEN {5 * HOUR_MS} PRECEDING AND CURRENT ROW) AS increase FROM inc) WHERE increase IS NOT NULL""",
)
def alert_increase(spark, sf):
    grown = alerts.increase(counters(spark, sf), LABELS, 6 * HOUR_MS, HOUR_MS)
    return grown.select(*LABELS, "ts", "increase", F.round("rate", 9).alias("rate"))


@query(
    "alert_changes",
    f"""WITH {_COUNTER}, c AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value <> lag(value) OVER w THEN 1 ELSE 0 END AS ch FROM counters
      WINDOW w AS (PARTITION BY event_type, instance ORDER BY ts))
    SELECT event_type, instance, ts, CAST(sum(ch) OVER (PARTITION BY event_type, instance ORDER BY ts RANGE BETWEEN {11 * HOUR_MS} PRECEDING AND CURRENT ROW) AS BIGINT) AS changes FROM c""",
)
def alert_changes(spark, sf):
    return alerts.changes(counters(spark, sf), LABELS, 12 * HOUR_MS, HOUR_MS).drop("name")


@query(
    "alert_quantile",
    f"""WITH {_HIST}, r AS (SELECT *, lag(le) OVER w AS lo, coalesce(lag(cumulative) OVER w, 0) AS below, 0.95 * max(cumulative) OVER (PARTITION BY event_type) AS rank
      FROM hist WINDOW w AS (PARTITION BY event_type ORDER BY le))
    SELECT event_type, round(CASE WHEN isinf(le) THEN lo ELSE coalesce(lo, 0) + (le - coalesce(lo, 0)) * (rank - below) / (cumulative - below)::DOUBLE END, 9) AS quantile
    FROM r WHERE cumulative >= rank AND below < rank""",
)
def alert_quantile(spark, sf):
    buckets = observability.histogram(v.events(spark, sf), ["event_type"], "value", BOUNDS)
    found = alerts.bucket_quantile(buckets, ["event_type"], 0.95)
    return found.select("event_type", F.round("quantile", 9).alias("quantile"))


_RATE = f"""{_COUNTER}, rates AS (SELECT event_type, instance, ts, sum(inc) OVER (PARTITION BY event_type, instance ORDER BY ts
  RANGE BETWEEN {5 * HOUR_MS} PRECEDING AND CURRENT ROW) AS increase FROM inc)"""


def _increase_of(spark, sf, kind):
    grown = alerts.increase(counters(spark, sf), LABELS, 6 * HOUR_MS, HOUR_MS)
    return grown.filter(F.col("event_type") == kind)


@query(
    "alert_ratio",
    f"""WITH {_RATE} SELECT a.instance, a.ts, round(a.increase / nullif(b.increase, 0), 9) AS ratio FROM rates a JOIN rates b USING (instance, ts)
    WHERE a.event_type = 'error' AND b.event_type = 'view' AND a.increase IS NOT NULL AND b.increase IS NOT NULL""",
)
def alert_ratio(spark, sf):
    left, right = _increase_of(spark, sf, "error"), _increase_of(spark, sf, "view")
    found = alerts.ratio(left, right, ["instance", "ts"], "increase")
    return found.select("instance", "ts", F.round("ratio", 9).alias("ratio"))


@query(
    "alert_conjunction",
    f"""WITH {_RATE} SELECT DISTINCT a.instance, a.ts FROM rates a WHERE event_type = 'error' AND increase > 0
      AND EXISTS (SELECT 1 FROM rates b WHERE b.instance = a.instance AND b.ts = a.ts AND b.event_type = 'view' AND b.increase > 0)
      AND EXISTS (SELECT 1 FROM rates b WHERE b.instance = a.instance AND b.ts = a.ts AND b.event_type = 'click' AND b.increase > 0)""",
)
def alert_conjunction(spark, sf):
    conditions = [_increase_of(spark, sf, kind).filter("increase > 0") for kind in ("error", "view", "click")]
    return alerts.all_of(conditions, ["instance", "ts"])


@query(
    "alert_held_for",
    f"""WITH {_RATE}, h AS (SELECT instance, ts, ts - row_number() OVER (PARTITION BY instance ORDER BY ts) * {HOUR_MS} AS isl FROM rates WHERE event_type = 'error' AND increase > 0),
    s AS (SELECT instance, ts, min(ts) OVER (PARTITION BY instance, isl) AS active_since FROM h)
    SELECT instance, ts, active_since FROM s WHERE ts - active_since >= {4 * HOUR_MS}""",
)
def alert_held_for(spark, sf):
    holding = _increase_of(spark, sf, "error").filter("increase > 0").select("instance", "ts")
    return alerts.held_for(holding, ["instance"], HOUR_MS, 4 * HOUR_MS)


# Which counters and gauges of the rule catalogue stand for which events of the tables.
_COUNTS = [
    ("uns_published_total", "", "event_type IN ('click', 'view')"),
    ("sparkplug_data_total", "", "event_type = 'click'"),
    ("sparkplug_births_total", "dbirth", "event_type = 'signup'"),
    ("errors_total", "sparkplug_birth", "event_type = 'error' AND k % 10 = 0"),
    ("errors_total", "repository", "event_type = 'error' AND k % 10 <> 0"),
    ("validation_errors_total", "value_out_of_range", "event_type = 'purchase'"),
    ("drift_events_total", "added", "event_type = 'signup' AND k % 2 = 0"),
    ("streaming_drift_detected_total", "high", "value > 100 AND value <= 200"),
    ("streaming_drift_detected_total", "critical", "value > 200"),
    ("asset_lifecycle_events_total", "offline", "event_type = 'error'"),
    ("bidirectional_writes_total", "failure", "event_type = 'purchase' AND k % 3 = 0"),
    ("bidirectional_validations_total", "denied", "event_type = 'purchase' AND k % 3 <> 0"),
    ("aas_write_retries_total", "", "event_type = 'purchase' AND k % 4 = 0"),
    ("semantic_cache_hits_total", "", "k % 2 = 0"),
    ("semantic_cache_misses_total", "", "k % 2 = 1"),
]
_GAUGES = [
    ("streaming_drift_anomaly_score", "max(value) / 500"),
    ("fidelity_overall", "min(k) / 100.0D"),
    ("fidelity_entropy_loss", "max(k) / 100.0D"),
    ("assets_stale", "cast(count(*) as double)"),
    ("assets_online", "cast(min(k) % 3 as double)"),
    ("assets_gone", "cast(max(k) % 2 as double)"),
    ("mqtt_connected", "1.0D"),
    ("tracked_topics", "cast(count(*) as double)"),
    ("active_devices", "cast(min(k) % 2 as double)"),
]
# Ranges of the catalogue are minutes; the samples are hourly, so minutes become hours.
SCALE = 12


def rule_samples(spark, sf):
    """Hourly samples per instance for every counter and gauge of the rules."""
    rows = plant_events(spark, sf)
    pairs = [F.when(F.expr(cond), F.struct(F.lit(n).alias("name"), F.lit(lab).alias("label"))) for n, lab, cond in _COUNTS]
    counted = rows.select("instance", "ts", F.inline(F.array_compact(F.array(*pairs))))
    counter = (
        counted.groupBy("name", "label", "instance", ((F.floor(F.col("ts") / HOUR_MS) + 1) * HOUR_MS).cast("bigint").alias("ts"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    span = counter.agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi"))).scalar()
    series = counter.select("name", "label", "instance").distinct().withColumn("_span", span)
    grid = series.select("name", "label", "instance", F.explode(F.sequence("_span.lo", "_span.hi", F.lit(HOUR_MS))).alias("ts"))
    running = Window.partitionBy("name", "label", "instance").orderBy("ts")
    filled = grid.join(counter, ["name", "label", "instance", "ts"], "left").select(
        "name", "label", "instance", "ts", F.sum(F.coalesce("n", F.lit(0))).over(running).cast("double").alias("value")
    )
    step = ((F.floor(F.col("ts") / HOUR_MS) + 1) * HOUR_MS).cast("bigint").alias("ts")
    wide = rows.groupBy("instance", step).agg(*[F.expr(e).alias(n) for n, e in _GAUGES])
    gauges = wide.select(
        "instance", "ts",
        F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit("").alias("label"), F.col(n).alias("value")) for n, _ in _GAUGES])),
    ).select("name", "label", "instance", "ts", "value")
    return filled.unionByName(gauges)


def _rules_sql() -> str:
    counts = " UNION ALL ".join(f"SELECT '{n}' AS name, '{lab}' AS label, instance, ts FROM rows_in WHERE {c}" for n, lab, c in _COUNTS)
    gauges = " UNION ALL ".join(
        f"SELECT '{n}', '', instance, ts, {e.replace('D', '::DOUBLE') if e.endswith('D') else e} FROM rows_in GROUP BY instance, ts" for n, e in _GAUGES
    )
    values = []
    for rule, severity, hold, terms in alerts.RULES:
        for i, (kind, metric, label, span, op, threshold) in enumerate(terms):
            lab = "NULL" if label is None else f"'{label}'"
            values.append(f"('{rule}', '{severity}', {hold * SCALE * 1000}, {len(terms)}, {i}, '{kind}', '{metric}', {lab}, {span * SCALE * 1000}, '{op}', {float(threshold)}::DOUBLE)")
    return f"""WITH rows_in AS (SELECT 'plant-' || (user_id % 3) AS instance, ((epoch_us(ts) // 1000) // {HOUR_MS} + 1) * {HOUR_MS} AS ts,
      event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
    cnt AS (SELECT name, label, instance, ts, count(*) AS n FROM ({counts}) GROUP BY ALL),
    grid AS (SELECT s.*, g.ts FROM (SELECT DISTINCT name, label, instance FROM cnt) s, (SELECT unnest(range(min(ts), max(ts) + 1, {HOUR_MS})) AS ts FROM cnt) g),
    ctr AS (SELECT name, label, instance, ts, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY name, label, instance ORDER BY ts) AS rn
      FROM grid LEFT JOIN cnt USING (name, label, instance, ts)),
    gauges(name, label, instance, ts, value) AS ({gauges}),
    rules AS (SELECT * FROM (VALUES {', '.join(values)}) t(rule, severity, for_ms, terms, term, kind, metric, label, range_ms, op, threshold)),
    steps AS (SELECT DISTINCT ts FROM grid),
    vals AS (
      SELECT r.rule, r.severity, r.for_ms, r.terms, r.term, r.op, r.threshold, c.instance, s.ts,
        CASE r.kind WHEN 'increase' THEN CAST(sum(n) AS DOUBLE) ELSE sum(n) / (r.range_ms / 1000.0::DOUBLE) END AS value
      FROM rules r JOIN ctr c ON c.name = r.metric AND (r.label IS NULL OR r.label = c.label) AND c.rn > 1
      JOIN steps s ON s.ts >= c.ts AND s.ts < c.ts + greatest(r.range_ms, {HOUR_MS}) WHERE r.kind IN ('increase', 'rate')
      GROUP BY r.rule, r.severity, r.for_ms, r.terms, r.term, r.kind, r.op, r.threshold, r.range_ms, c.instance, s.ts
      UNION ALL
      SELECT r.rule, r.severity, r.for_ms, r.terms, r.term, r.op, r.threshold, c.instance, s.ts,
        sum(n) FILTER (c.name = r.metric) / nullif(CAST(sum(n) AS DOUBLE), 0)
      FROM rules r JOIN ctr c ON c.name IN ('semantic_cache_hits_total', 'semantic_cache_misses_total') AND c.rn > 1
      JOIN steps s ON s.ts >= c.ts AND s.ts < c.ts + greatest(r.range_ms, {HOUR_MS}) WHERE r.kind = 'ratio'
      GROUP BY r.rule, r.severity, r.for_ms, r.terms, r.term, r.op, r.threshold, c.instance, s.ts
      UNION ALL
      SELECT r.rule, r.severity, r.for_ms, r.terms, r.term, r.op, r.threshold, g.instance, g.ts, CASE WHEN r.op = '<' THEN min(value) ELSE max(value) END
      FROM rules r JOIN gauges g ON g.name = r.metric WHERE r.kind = 'gauge'
      GROUP BY r.rule, r.severity, r.for_ms, r.terms, r.term, r.op, r.threshold, g.instance, g.ts),
    hold AS (SELECT rule, severity, for_ms, instance, ts FROM vals WHERE CASE op WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold ELSE value = threshold END
      GROUP BY rule, severity, for_ms, terms, instance, ts HAVING count(*) = terms),
    isl AS (SELECT *, ts - row_number() OVER (PARTITION BY rule, instance ORDER BY ts) * {HOUR_MS} AS isl FROM hold),
    act AS (SELECT *, min(ts) OVER (PARTITION BY rule, instance, isl) AS active_since FROM isl)
    SELECT rule, severity, instance, ts, active_since FROM act WHERE ts - active_since >= for_ms"""


@query("alert_rules", _rules_sql())
def alert_rules(spark, sf):
    terms = alerts.rule_terms(spark, scale=SCALE)
    return alerts.evaluate(rule_samples(spark, sf), terms, HOUR_MS)
