"""Structural drift, value anomalies and fidelity."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantweave.functions import scoring
from plantweave.operators import anomaly, drift, fidelity, online
from plantweave.plans import views as v
from plantweave.plans.registry import query

DAY_MS = 86_400_000
_FP = "left(sha256(path || '|' || aas_type || '|' || value_type || '|' || coalesce(semantic_id, 'None') || '|' || coalesce(unit, 'None')), 16)"
_SNAP = f"""{v.METRICS},
snaps AS (SELECT asset_id, submodel, timestamp_ms // {DAY_MS} AS day, path, arg_max(aas_type, elem_order) AS aas_type,
    arg_max(value_type, elem_order) AS value_type,
    arg_max(struct_pack(s := semantic_id, u := unit), elem_order).s AS semantic_id,
    arg_max(struct_pack(s := semantic_id, u := unit), elem_order).u AS unit
  FROM metrics GROUP BY ALL),
days AS (SELECT DISTINCT asset_id, submodel, day FROM snaps),
nexts AS (SELECT *, lag(day) OVER (PARTITION BY asset_id, submodel ORDER BY day) AS prev FROM days),
cur AS (SELECT s.*, n.prev FROM snaps s JOIN nexts n USING (asset_id, submodel, day) WHERE n.prev IS NOT NULL),
old AS (SELECT s.* EXCLUDE (day), n.day AS day FROM snaps s JOIN nexts n ON s.asset_id = n.asset_id AND s.submodel = n.submodel AND s.day = n.prev),
both_sides AS (
  SELECT coalesce(c.asset_id, o.asset_id) AS asset_id, coalesce(c.submodel, o.submodel) AS submodel, coalesce(c.path, o.path) AS path,
    coalesce(c.day, o.day) AS day,
    CASE WHEN o.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed'
      WHEN c.value_type IS DISTINCT FROM o.value_type THEN 'type_changed' WHEN c.unit IS DISTINCT FROM o.unit THEN 'unit_changed'
      WHEN c.semantic_id IS DISTINCT FROM o.semantic_id THEN 'semantic_changed' END AS event_type,
    CASE WHEN o.path IS NOT NULL THEN '{{"aasType": "Property", "valueType": "' || o.value_type || '", "semanticId": '
      || coalesce('"' || o.semantic_id || '"', 'null') || ', "unit": ' || coalesce('"' || o.unit || '"', 'null') || '}}' END AS previous,
    CASE WHEN c.path IS NOT NULL THEN '{{"aasType": "Property", "valueType": "' || c.value_type || '", "semanticId": '
      || coalesce('"' || c.semantic_id || '"', 'null') || ', "unit": ' || coalesce('"' || c.unit || '"', 'null') || '}}' END AS current
  FROM cur c FULL JOIN old o ON c.asset_id = o.asset_id AND c.submodel = o.submodel AND c.path = o.path AND c.day = o.day),
events_drift AS (SELECT * FROM both_sides WHERE event_type IS NOT NULL)"""


def snapshots(spark, sf):
    """Fingerprints per asset and day."""
    rows = v.metrics(spark, sf).withColumn("day", F.floor(F.col("timestamp_ms") / DAY_MS).cast("bigint"))
    return drift.fingerprints(rows, ["day"])


def drift_events(spark, sf):
    return drift.detect_in_snapshots(snapshots(spark, sf), "day")


@query("fingerprints", f"WITH {_SNAP} SELECT asset_id, day, path, {_FP} AS fingerprint FROM snaps")
def fingerprints(spark, sf):
    return snapshots(spark, sf).select("asset_id", "day", "path", "fingerprint")


@query("structural_drift", f"WITH {_SNAP} SELECT asset_id, submodel, day, path, event_type FROM events_drift")
def structural_drift(spark, sf):
    return drift_events(spark, sf).select("asset_id", "submodel", "day", "path", "event_type")


_MID = 1_705_276_800_000 // DAY_MS
_TWO = f"""{v.METRICS},
half AS (SELECT asset_id, submodel, path, timestamp_ms < {_MID * DAY_MS} AS before, arg_max(value_type, elem_order) AS value_type,
    arg_max(struct_pack(s := semantic_id, u := unit), elem_order) AS su FROM metrics GROUP BY ALL),
pair AS (SELECT coalesce(a.asset_id, b.asset_id) AS asset_id, coalesce(a.path, b.path) AS path,
    CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.value_type <> b.value_type THEN 'type_changed'
      WHEN a.su.u IS DISTINCT FROM b.su.u THEN 'unit_changed' WHEN a.su.s IS DISTINCT FROM b.su.s THEN 'semantic_changed' END AS event_type
  FROM (SELECT * FROM half WHERE before) a FULL JOIN (SELECT * FROM half WHERE NOT before) b USING (asset_id, submodel, path))"""


def halves(spark, sf):
    rows = v.metrics(spark, sf)
    cut = F.col("timestamp_ms") < _MID * DAY_MS
    return drift.fingerprints(rows.filter(cut)), drift.fingerprints(rows.filter(~cut))


@query("drift_switches", f"WITH {_TWO} SELECT asset_id, path, event_type FROM pair WHERE event_type IN ('type_changed', 'unit_changed', 'semantic_changed')")
def drift_switches(spark, sf):
    stored, current = halves(spark, sf)
    events = drift.detect(stored, current, additions=False, removals=False)
    return events.select("asset_id", "path", "event_type")


@query(
    "drift_summary",
    f"""WITH {_SNAP} SELECT asset_id, count(*) FILTER (event_type = 'added') AS additions, count(*) FILTER (event_type = 'removed') AS removals,
      count(*) FILTER (event_type NOT IN ('added', 'removed')) AS changes, true AS has_drift FROM events_drift GROUP BY asset_id""",
)
def drift_summary(spark, sf):
    return drift.summary(drift_events(spark, sf))


@query(
    "drift_alerts",
    f"""WITH {_SNAP} SELECT 'UNS/Sys/DriftAlerts/' || {v.sql_segment("replace(asset_id, 'https://', '')", 128)} AS topic,
      '{{"eventType": "' || event_type || '", "assetId": "' || asset_id || '", "metricPath": "' || path || '", "timestamp": ' || (day * {DAY_MS})
      || coalesce(', "previous": ' || previous, '') || coalesce(', "current": ' || current, '') || '}}' AS payload FROM events_drift""",
)
def drift_alerts(spark, sf):
    return drift.alerts(drift_events(spark, sf), F.col("day") * DAY_MS)


@query(
    "drift_pass_counts",
    f"WITH {_TWO}, touched AS (SELECT DISTINCT asset_id FROM half WHERE NOT before) SELECT event_type, count(*) AS n FROM pair WHERE event_type IS NOT NULL AND asset_id IN (SELECT asset_id FROM touched) GROUP BY event_type",
)
def drift_pass_counts(spark, sf):
    rows = v.metrics(spark, sf)
    cut = F.col("timestamp_ms") < _MID * DAY_MS
    stored = drift.fingerprints(rows.filter(cut))
    counts, _, _ = drift.check_and_store(stored, rows.filter(~cut), F.lit(_MID * DAY_MS))
    return counts


@query(
    "fingerprints_replaced",
    f"""WITH {_TWO}, touched AS (SELECT DISTINCT asset_id FROM half WHERE NOT before)
    SELECT asset_id, path, value_type FROM half WHERE NOT before OR asset_id NOT IN (SELECT asset_id FROM touched)""",
)
def fingerprints_replaced(spark, sf):
    stored, current = halves(spark, sf)
    return drift.replace_fingerprints(stored, current).select("asset_id", "path", "value_type")


@query(
    "fingerprints_cleared",
    f"""WITH {_TWO} SELECT (SELECT count(DISTINCT asset_id) FROM half WHERE before) AS tracked,
      count(*) AS cleared FROM half WHERE before AND asset_id IN (SELECT asset_id FROM half WHERE NOT before AND path = 'Events.click.value')""",
)
def fingerprints_cleared(spark, sf):
    stored, current = halves(spark, sf)
    gone = current.filter("path = 'Events.click.value'").select("asset_id").distinct()
    _, cleared = drift.clear_asset(stored, gone)
    tracked = drift.tracked_assets(stored).agg(F.count(F.lit(1))).scalar()
    return cleared.select(tracked.alias("tracked"), "cleared")


_HASHES = f"""{_SNAP}, hashes AS (SELECT asset_id, submodel, day, left(sha256(array_to_string(list_sort(list(
    path || '|' || aas_type || '|' || value_type || '|' || coalesce(semantic_id, 'None'))), '|')), 16) AS schema_hash, count(*) AS metric_count
  FROM snaps GROUP BY ALL)"""


def schema_hashes_of(spark, sf):
    return drift.schema_hashes(snapshots(spark, sf), ["asset_id", "submodel", "day"])


@query("schema_hashes", f"WITH {_HASHES} SELECT asset_id, day, schema_hash, metric_count FROM hashes")
def schema_hashes(spark, sf):
    return schema_hashes_of(spark, sf).drop("submodel")


_EVOLVED = f"""{_HASHES}, evolved AS (SELECT asset_id, submodel, day, previous_hash, schema_hash AS current_hash, metric_count FROM (SELECT *, lag(schema_hash)
  OVER (PARTITION BY asset_id, submodel ORDER BY day) AS previous_hash FROM hashes) WHERE previous_hash <> schema_hash)"""


@query(
    "schema_evolution",
    f"""WITH {_EVOLVED} SELECT asset_id, day, 'schema_evolution' AS drift_type, 'medium' AS severity, 0.95::DOUBLE AS confidence,
      1.0::DOUBLE AS anomaly_score, 'alert' AS suggested_action, previous_hash, current_hash, metric_count FROM evolved""",
)
def schema_evolution(spark, sf):
    return drift.schema_evolution(schema_hashes_of(spark, sf), "day").drop("submodel", "is_drift")


# -- value anomalies ----------------------------------------------------------

T, D, W, SEED = anomaly.TREES, anomaly.DEPTH, anomaly.WINDOW, anomaly.SEED
_HEX = "CAST('0x' || substr({}, {}, 8) AS BIGINT)"
_FEATURES = f"""{v.METRICS},
feat AS (SELECT asset_id, path, timestamp_ms, elem_order, value_num, timestamp_ms // {DAY_MS} AS day,
    [value_num, ({_HEX.format('md5(value_type)', 1)} % 1000) / 1000.0::DOUBLE,
     least((length(path) - length(replace(replace(path, '.', ''), '[', ''))) / 10.0::DOUBLE, 1.0),
     CASE WHEN coalesce(semantic_id, '') <> '' THEN 1.0 ELSE 0.0 END, CASE WHEN coalesce(unit, '') <> '' THEN 1.0 ELSE 0.0 END] AS f
  FROM metrics WHERE value_num IS NOT NULL)"""
_NODES = f"""nodes AS (SELECT tree, node, CAST({_HEX.format('h', 1)} % 5 AS INTEGER) AS dim, {_HEX.format('h', 9)} / 4294967296.0::DOUBLE AS split
  FROM (SELECT t AS tree, n AS node, md5('{SEED}:' || t || ':' || n) AS h FROM range({T}) a(t), range({(1 << D) - 1}) b(n)))"""
_FOREST = f"""{_FEATURES}, {_NODES},
ranges AS (SELECT asset_id, day + 1 AS win, count(*) AS n,
    [min(f[1]), min(f[2]), min(f[3]), min(f[4]), min(f[5])] AS lo, [max(f[1]), max(f[2]), max(f[3]), max(f[4]), max(f[5])] AS hi
  FROM feat GROUP BY asset_id, day),
roles AS (SELECT true AS is_ref, day + 1 AS win, * FROM feat UNION ALL SELECT false, day, * FROM feat),
scaled AS (SELECT is_ref, win, asset_id, elem_order, [CASE WHEN hi[i] = lo[i] THEN 0.5 ELSE (f[i] - lo[i]) / (hi[i] - lo[i]) END FOR i IN [1, 2, 3, 4, 5]] AS x
  FROM roles JOIN ranges USING (asset_id, win)),
walk(is_ref, win, asset_id, elem_order, x, tree, lvl, node) AS (
  SELECT is_ref, win, asset_id, elem_order, x, t, 0, 0 FROM scaled, range({T}) a(t)
  UNION ALL SELECT w.is_ref, w.win, w.asset_id, w.elem_order, w.x, w.tree, lvl + 1, CAST(w.node * 2 + CASE WHEN x[dim + 1] < split THEN 1 ELSE 2 END AS INTEGER)
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE lvl < {D - 1}),
mass AS (SELECT asset_id, win, tree, node, count(*) AS n, least(count(*), {W}) AS mass FROM walk WHERE is_ref GROUP BY ALL),
total AS (SELECT w.asset_id, w.win, w.elem_order, coalesce(sum(m.n), 0) AS uncapped, coalesce(sum(mass), 0) AS total FROM walk w LEFT JOIN mass m
  ON m.asset_id = w.asset_id AND m.win = w.win AND m.tree = w.tree AND m.node = w.node WHERE NOT w.is_ref GROUP BY ALL),
scores AS (SELECT f.asset_id, path, timestamp_ms, f.elem_order, value_num, coalesce(r.n, 0) AS observations,
    coalesce(1.0::DOUBLE - uncapped / CAST(r.n * {T * D} AS DOUBLE), 0.5) AS score
  FROM feat f LEFT JOIN ranges r ON r.asset_id = f.asset_id AND r.win = f.day
  LEFT JOIN total t ON t.asset_id = f.asset_id AND t.win = f.day AND t.elem_order = f.elem_order),
conf AS (SELECT *, (1.0 - exp(-observations / {W}.0::DOUBLE)) * abs(score - 0.5) * 2 AS confidence,
    CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM scores),
results AS (SELECT *, score >= 0.3 AS is_drift, CASE WHEN score < 0.3 THEN 'none' WHEN confidence < 0.3 THEN 'monitor'
    WHEN severity = 'critical' THEN 'quarantine' WHEN severity = 'high' THEN 'alert' ELSE 'auto_accept' END AS suggested_action FROM conf)"""


@query("anomaly_features", f"WITH {_FEATURES} SELECT elem_order, f[1] AS f0, f[2] AS f1, f[3] AS f2, f[4] AS f3, f[5] AS f4 FROM feat")
def anomaly_features(spark, sf):
    f = anomaly.features()
    rows = v.metrics(spark, sf).filter("value_num IS NOT NULL")
    return rows.select("elem_order", *[F.get(f, F.lit(i)).alias(f"f{i}") for i in range(5)])


@query(
    "anomaly_mass",
    f"""WITH RECURSIVE {_FOREST} SELECT asset_id, win AS "window", tree, count(*) AS nodes, CAST(sum(mass) AS BIGINT) AS mass,
      CAST(sum(mass * node) AS BIGINT) AS weighted FROM mass GROUP BY ALL""",
)
def anomaly_mass(spark, sf):
    return anomaly.tree_totals(v.metrics(spark, sf))


@query("anomaly_scores", f"WITH RECURSIVE {_FOREST} SELECT asset_id, elem_order, observations, round(score, 9) AS score FROM scores")
def anomaly_scores(spark, sf):
    return anomaly.score(v.metrics(spark, sf)).select(
        "asset_id", "elem_order", "observations", F.round("anomaly_score", 9).alias("score")
    )


@query(
    "anomaly_scores_cumulative",
    f"""WITH RECURSIVE {_FOREST} SELECT f.elem_order, round(coalesce(1.0::DOUBLE - total / {W * T * D}.0::DOUBLE, 0.5), 9) AS score
    FROM feat f LEFT JOIN total t ON t.asset_id = f.asset_id AND t.win = f.day AND t.elem_order = f.elem_order""",
)
def anomaly_scores_cumulative(spark, sf):
    scores = anomaly.score(v.metrics(spark, sf), mode="cumulative")
    return scores.select("elem_order", F.round("anomaly_score", 9).alias("score"))


_X = [1, 2, 3, 4, 5]
ORDERED_FOREST = f"""{_FEATURES}, {_NODES},
placed AS (SELECT *, row_number() OVER a AS seq, [{", ".join(f"min(f[{i}]) OVER b" for i in _X)}] AS lo, [{", ".join(f"max(f[{i}]) OVER b" for i in _X)}] AS hi
  FROM feat WINDOW a AS (PARTITION BY asset_id ORDER BY timestamp_ms, elem_order),
    b AS (PARTITION BY asset_id ORDER BY timestamp_ms, elem_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
roles AS (SELECT false AS counts, asset_id, seq, f, lo, hi FROM placed WHERE seq > 1
  UNION ALL SELECT true, asset_id, seq, f, [least(lo[i], f[i]) FOR i IN {_X}], [greatest(hi[i], f[i]) FOR i IN {_X}] FROM placed),
scaled AS (SELECT counts, asset_id, seq, [CASE WHEN hi[i] > lo[i] THEN (f[i] - lo[i]) / (hi[i] - lo[i]) ELSE 0.5 END FOR i IN {_X}] AS x FROM roles),
walk(counts, asset_id, seq, x, tree, lvl, node) AS (
  SELECT counts, asset_id, seq, x, t, 0, 0 FROM scaled, range({T}) a(t)
  UNION ALL SELECT w.counts, w.asset_id, w.seq, w.x, w.tree, lvl + 1, CAST(w.node * 2 + CASE WHEN x[dim + 1] < split THEN 1 ELSE 2 END AS INTEGER)
  FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE lvl < {D - 1}),
passed AS (SELECT counts, asset_id, seq, count(*) FILTER (counts) OVER (PARTITION BY asset_id, tree, node ORDER BY seq, counts
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM walk),
total AS (SELECT asset_id, seq, sum(least(n, {W})) AS total FROM passed WHERE NOT counts GROUP BY ALL),
scores AS (SELECT p.*, seq AS observations, coalesce(1.0::DOUBLE - total / {W * T * D}.0::DOUBLE, 0.5) AS score
  FROM placed p LEFT JOIN total USING (asset_id, seq))"""


def scores_in_order(spark, sf):
    return online.score_then_update(v.metrics(spark, sf))


@query(
    "anomaly_scores_in_order",
    f"WITH RECURSIVE {ORDERED_FOREST} SELECT asset_id, elem_order, observations, round(score, 9) AS score FROM scores",
)
def anomaly_scores_in_order(spark, sf):
    return scores_in_order(spark, sf).select(
        "asset_id", "elem_order", "observations", F.round("anomaly_score", 9).alias("score")
    )


def results_of(spark, sf):
    return anomaly.classify(anomaly.score(v.metrics(spark, sf)))


@query(
    "anomaly_results",
    f"""WITH RECURSIVE {_FOREST} SELECT elem_order, is_drift, CASE WHEN is_drift THEN severity ELSE 'low' END AS severity,
      round(confidence, 9) AS confidence, suggested_action FROM results""",
)
def anomaly_results(spark, sf):
    return results_of(spark, sf).select(
        "elem_order", "is_drift", "severity", F.round("confidence", 9).alias("confidence"), "suggested_action"
    )


@query(
    "anomaly_batch",
    f"""WITH RECURSIVE {_FOREST}, {_EVOLVED.split(v.METRICS + ',', 1)[1]}
    SELECT asset_id, timestamp_ms, 'value_anomaly' AS drift_type, severity, path FROM results WHERE is_drift
    UNION ALL SELECT asset_id, day * {DAY_MS}, 'schema_evolution', 'medium', '' FROM evolved""",
)
def anomaly_batch(spark, sf):
    evolved = drift.schema_evolution(schema_hashes_of(spark, sf), "day").withColumn(
        "timestamp_ms", F.col("day") * DAY_MS
    )
    both = anomaly.detect_batch(v.metrics(spark, sf), evolved)
    return both.select("asset_id", "timestamp_ms", "drift_type", "severity", "path")


@query(
    "anomaly_observations",
    f"""WITH RECURSIVE {_FOREST}, per_tree AS (SELECT asset_id, win, tree, CAST(sum(mass) // {(1 << (D + 1)) - 1} AS BIGINT) AS n FROM mass GROUP BY ALL)
    SELECT asset_id, win AS "window", CAST(sum(p.n) // {T} AS BIGINT) AS estimate, any_value(r.n) AS reference_rows
    FROM per_tree p JOIN ranges r USING (asset_id, win) GROUP BY ALL""",
)
def anomaly_observations(spark, sf):
    rows = v.metrics(spark, sf)
    return anomaly.observation_estimate(anomaly.tree_totals(rows), anomaly.reference_windows(rows))


_DRIFTS = "drifts AS (SELECT * FROM results WHERE is_drift)"


@query(
    "anomaly_history",
    f"""WITH RECURSIVE {_FOREST}, {_DRIFTS} SELECT asset_id, timestamp_ms, path, severity FROM
    (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY timestamp_ms DESC, path) AS rn FROM drifts) WHERE rn <= 3""",
)
def anomaly_history(spark, sf):
    drifts = results_of(spark, sf).filter("is_drift")
    return anomaly.history(drifts, 3).select("asset_id", "timestamp_ms", "path", "severity")


COOLDOWN_MS = 6 * 3_600_000


def sql_cooldown(source: str, key: str, ts: str, cooldown_ms: int) -> str:
    """Recursive SQL for the greedy cooldown over ``source``; defines ``fired(key, t)``."""
    return f"""times AS (SELECT {key} AS k, list_sort(list(DISTINCT {ts})) AS ts FROM {source} GROUP BY ALL),
fired(k, t) AS (SELECT k, ts[1] FROM times UNION ALL
  SELECT f.k, list_filter(times.ts, lambda x: x >= f.t + {cooldown_ms})[1] FROM fired f JOIN times ON times.k = f.k
  WHERE times.ts[-1] >= f.t + {cooldown_ms})"""


@query(
    "anomaly_alerts",
    f"""WITH RECURSIVE {_FOREST}, severe AS (SELECT * FROM results WHERE is_drift AND severity IN ('high', 'critical')),
    {sql_cooldown('severe', 'asset_id', 'timestamp_ms', COOLDOWN_MS)}
    SELECT k AS asset_id, t AS timestamp_ms, 'UNS/Sys/StreamingDriftAlerts/' || {v.sql_segment("replace(k, 'https://', '')")} AS topic FROM fired""",
)
def anomaly_alerts(spark, sf):
    drifts = results_of(spark, sf).filter("is_drift").select(*anomaly.RESULT)
    return anomaly.severe_alerts(drifts, COOLDOWN_MS).select("asset_id", "timestamp_ms", "topic")


@query("anomaly_counts", f"WITH RECURSIVE {_FOREST}, {_DRIFTS} SELECT 'value_anomaly' AS drift_type, severity, count(*) AS n FROM drifts GROUP BY ALL")
def anomaly_counts(spark, sf):
    return anomaly.result_counts(results_of(spark, sf).filter("is_drift"))


@query(
    "anomaly_last_scores",
    f"WITH RECURSIVE {_FOREST}, {_DRIFTS} SELECT asset_id, round(arg_max(score, timestamp_ms), 9) AS last_score FROM drifts GROUP BY asset_id",
)
def anomaly_last_scores(spark, sf):
    last = anomaly.last_scores(results_of(spark, sf).filter("is_drift"))
    return last.select("asset_id", F.round("last_score", 9).alias("last_score"))


# -- fidelity -----------------------------------------------------------------


def sql_fidelity(keys: str, collapsed: bool = False) -> str:
    kept = "collapsed" if collapsed else "keys"
    return f"""{v.METRICS}, day_metrics AS (SELECT *, timestamp_ms // {DAY_MS} AS day FROM metrics),
fa AS (SELECT {keys}, count(*) AS n, avg((CASE WHEN path LIKE '%.%' OR path LIKE '%[%' THEN 1.0::DOUBLE ELSE 0.5 END)
      * CASE WHEN submodel_semantic_id IS NULL THEN 0.9 ELSE 1.0 END * CASE WHEN contains(lower(path), 'unnamed') THEN 0.8 ELSE 1.0 END) AS structural,
    count(semantic_id) AS sid, sum(len(semantic_keys)) AS keys, count(*) FILTER (len(semantic_keys) > 0) AS collapsed,
    count(unit) AS units, count(submodel_semantic_id) AS ctx, count(*) FILTER (contains(lower(path), 'unnamed')) AS unnamed,
    count(*) FILTER (value_num IS NOT NULL AND unit IS NULL) AS no_unit,
    avg(length(path) - length(replace(replace(path, '.', ''), '[', ''))) AS depth
  FROM day_metrics GROUP BY ALL),
fb AS (SELECT *, 0.7::DOUBLE * sid / n + CASE WHEN keys > 0 THEN 0.3 ELSE 0.0 END AS semantic,
    CASE WHEN {kept} >= keys OR keys <= 1 THEN 0.0::DOUBLE ELSE 1 - CASE WHEN {kept} > 1 THEN log2({kept}) ELSE 0 END / log2(keys) END AS entropy FROM fa),
fc AS (SELECT *, 0.3 * structural + 0.5 * semantic + 0.2 * (1.0 - entropy) AS overall FROM fb),
fid AS (SELECT *, CASE WHEN overall >= 0.95 THEN 'A+' WHEN overall >= 0.9 THEN 'A' WHEN overall >= 0.85 THEN 'B+' WHEN overall >= 0.8 THEN 'B'
    WHEN overall >= 0.7 THEN 'C' WHEN overall >= 0.6 THEN 'D' ELSE 'F' END AS grade,
    list_filter([CASE WHEN sid < n THEN 'Metrics without a meaning: ' || (n - sid) || ' (' || CAST(round_even((n - sid) / n::DOUBLE * 100, 0) AS BIGINT) || '% of the asset)' END,
      CASE WHEN unnamed > 0 THEN 'Elements without a name: ' || unnamed END,
      CASE WHEN no_unit > 0 THEN 'Numbers without a unit: ' || no_unit END,
      CASE WHEN n - ctx > n * 0.5 THEN 'Most metrics stand in a submodel without a meaning' END,
      CASE WHEN structural < 0.7 THEN 'Much of the hierarchy is lost in the paths' END,
      CASE WHEN semantic < 0.7 THEN 'Too few metrics say what they mean' END,
      CASE WHEN entropy > 0.3 THEN 'Different meanings fall together; keep all keys of a reference' END], lambda x: x IS NOT NULL) AS recs FROM fc)"""


_COLS = """round(overall, 9) AS overall_score, round(structural, 9) AS structural_fidelity, round(semantic, 9) AS semantic_fidelity,
  round(entropy, 9) AS entropy_loss, n AS metric_count, grade, round(depth, 9) AS avg_path_depth, CAST(keys AS BIGINT) AS total_semantic_keys,
  sid AS metrics_with_semantic_id, units AS metrics_with_unit, ctx AS metrics_with_submodel_context"""


def _rounded(report, *keys):
    scores = ["overall_score", "structural_fidelity", "semantic_fidelity", "entropy_loss", "avg_path_depth"]
    rest = ["metric_count", "grade", "total_semantic_keys", "metrics_with_semantic_id", "metrics_with_unit", "metrics_with_submodel_context"]
    return report.select(*keys, *[F.round(c, 9).alias(c) for c in scores], *rest)


@query("fidelity_report", f"WITH {sql_fidelity('asset_id')} SELECT asset_id, {_COLS} FROM fid")
def fidelity_report(spark, sf):
    return _rounded(fidelity.report(v.metrics(spark, sf)), "asset_id")


@query("fidelity_report_collapsed", f"WITH {sql_fidelity('asset_id', True)} SELECT asset_id, {_COLS} FROM fid")
def fidelity_report_collapsed(spark, sf):
    return _rounded(fidelity.report(v.metrics(spark, sf), collapsed_keys=True), "asset_id")


@query(
    "fidelity_recommendations",
    f"WITH {sql_fidelity('asset_id')} SELECT asset_id, array_to_string(recs, '; ') AS recommendations FROM fid",
)
def fidelity_recommendations(spark, sf):
    report = fidelity.report(v.metrics(spark, sf))
    return report.select("asset_id", F.array_join("recommendations", "; ").alias("recommendations"))


def daily_reports(spark, sf):
    rows = v.metrics(spark, sf).withColumn("day", F.floor(F.col("timestamp_ms") / DAY_MS).cast("bigint"))
    return fidelity.report(rows, ["asset_id", "day"]).withColumn("timestamp_ms", F.col("day") * DAY_MS)


@query(
    "fidelity_trend",
    f"""WITH {sql_fidelity('asset_id, day')} SELECT asset_id, day, round(overall, 9) AS overall_score, grade FROM
    (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY day DESC) AS rn FROM fid) WHERE rn <= 5""",
)
def fidelity_trend(spark, sf):
    latest = fidelity.trend(daily_reports(spark, sf), 5)
    return latest.select("asset_id", "day", F.round("overall_score", 9).alias("overall_score"), "grade")


@query(
    "fidelity_alerts",
    f"""WITH RECURSIVE {sql_fidelity('asset_id, day')}, low AS (SELECT *, day * {DAY_MS} AS ts_ms FROM fid WHERE overall < 0.75),
    {sql_cooldown('low', 'asset_id', 'ts_ms', 3 * DAY_MS)}
    SELECT asset_id, ts_ms AS timestamp_ms, 'UNS/Sys/FidelityAlerts/' || {v.sql_segment("replace(asset_id, 'https://', '')")} AS topic, grade,
      CASE WHEN len(recs) > 0 THEN array_to_string(recs[1:2], ', ') ELSE 'no recommendations' END AS advice
    FROM low JOIN fired ON k = asset_id AND t = ts_ms""",
)
def fidelity_alerts(spark, sf):
    alerts = fidelity.low_score_alerts(daily_reports(spark, sf), 0.75, 3 * DAY_MS)
    return alerts.select("asset_id", "timestamp_ms", "topic", "grade", "advice")


@query(
    "entropy_loss",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN kept >= orig OR orig <= 1 THEN 0.0::DOUBLE
      ELSE 1 - CASE WHEN kept > 1 THEN log2(kept) ELSE 0 END / log2(orig) END, 9) AS loss
    FROM (SELECT *, CAST(l_quantity AS INTEGER) AS orig, CAST(l_linenumber AS INTEGER) AS kept FROM lineitem)""",
)
def entropy_loss(spark, sf):
    loss = scoring.entropy_loss(F.col("l_quantity").cast("int"), F.col("l_linenumber"))
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(loss, 9).alias("loss")
    )
