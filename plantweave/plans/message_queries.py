"""Device messages: aliases, births, data, sessions, audit and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantweave.functions import semantics
from plantweave.operators import messages
from plantweave.operators.ordered import latest_per_key
from plantweave.plans import views as v
from plantweave.plans.registry import query
from plantweave.plans.semantic_queries import _METRIC_PROPS, _code, _list_json, _q, _sql_entries

CUT_MS = 1_705_276_800_000

_ALIASES = f"""{v.TOPICS},
keyed AS (SELECT device_id, path, device_id || '/' || path AS metric_path, min(timestamp_ms) AS first_ms, max(timestamp_ms) AS last_accessed FROM topics GROUP BY ALL),
aliases AS (SELECT *, row_number() OVER (ORDER BY first_ms, metric_path) AS alias FROM keyed)"""


def _device_rows(spark, sf):
    return v.topics(spark, sf)


def aliases_of(spark, sf):
    return messages.assign_aliases(_device_rows(spark, sf).select("device_id", "path", "timestamp_ms"))


@query("aliases", f"WITH {_ALIASES} SELECT device_id, path, alias FROM aliases")
def aliases(spark, sf):
    return aliases_of(spark, sf).select("device_id", "path", "alias")


@query(
    "aliases_extended",
    f"""WITH {v.TOPICS}, keyed AS (SELECT device_id, device_id || '/' || path AS metric_path, min(timestamp_ms) AS first_ms,
        min(CASE WHEN event_type IN ('click', 'view') THEN timestamp_ms END) AS early_ms FROM topics GROUP BY ALL),
      old AS (SELECT metric_path, row_number() OVER (ORDER BY early_ms, metric_path) AS alias FROM keyed WHERE early_ms IS NOT NULL),
      new AS (SELECT metric_path, (SELECT max(alias) FROM old) + row_number() OVER (ORDER BY first_ms, metric_path) AS alias FROM keyed
        WHERE metric_path NOT IN (SELECT metric_path FROM old))
    SELECT * FROM old UNION ALL SELECT * FROM new""",
)
def aliases_extended(spark, sf):
    rows = _device_rows(spark, sf).select("device_id", "path", "timestamp_ms")
    early = messages.assign_aliases(rows.filter(F.col("path").isin("Events.click.value", "Events.view.value")))
    later = messages.assign_aliases(rows, early)
    return early.unionByName(later).select("metric_path", "alias")


@query(
    "alias_lookup",
    f"""WITH {_ALIASES}, nums AS (SELECT l_partkey AS alias FROM lineitem GROUP BY ALL)
    SELECT i.alias, a.metric_path FROM nums i LEFT JOIN aliases a USING (alias)""",
)
def alias_lookup(spark, sf):
    ids = v.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("alias")).distinct()
    return messages.paths_of_aliases(ids, aliases_of(spark, sf))


@query(
    "device_aliases",
    f"""WITH {_ALIASES}, d AS (SELECT DISTINCT device_id FROM topics WHERE unit = 'USD') SELECT device_id, metric_path, alias FROM aliases JOIN d USING (device_id)""",
)
def device_aliases(spark, sf):
    devices = _device_rows(spark, sf).filter("unit = 'USD'").select("device_id").distinct()
    return messages.device_aliases(aliases_of(spark, sf), devices).select("device_id", "metric_path", "alias")


@query(
    "aliases_evicted",
    f"""WITH {_ALIASES} SELECT metric_path, alias FROM (SELECT *, row_number() OVER (ORDER BY last_accessed, alias) AS rn FROM aliases)
    WHERE rn <= CASE WHEN (SELECT count(*) FROM aliases) >= 50 THEN 5 ELSE 0 END""",
)
def aliases_evicted(spark, sf):
    return messages.evict_aliases(aliases_of(spark, sf), 50)[1].select("metric_path", "alias")


@query(
    "aliases_cleared",
    f"""WITH {_ALIASES} SELECT count(*) AS cleared, (SELECT count(*) FROM aliases) AS total FROM aliases
      WHERE device_id IN (SELECT device_id FROM topics WHERE unit = 'USD')""",
)
def aliases_cleared(spark, sf):
    devices = _device_rows(spark, sf).filter("unit = 'USD'").select("device_id").distinct()
    table = aliases_of(spark, sf)
    _, cleared = messages.clear_device(table, devices)
    return cleared.withColumn("total", table.agg(F.count(F.lit(1))).scalar())


@query(
    "typed_slots",
    f"""WITH {v.METRICS} SELECT event_id, {_code('value_type')} AS datatype,
      CASE WHEN value_type = 'xs:int' THEN CAST(value AS BIGINT) END AS int_value,
      CASE WHEN value_type = 'xs:double' THEN CAST(value AS DOUBLE) END AS double_value,
      CASE WHEN value_type = 'xs:boolean' THEN value = 'true' END AS boolean_value,
      CASE WHEN value_type = 'xs:string' THEN value END AS string_value, value_json IS NULL AS is_null FROM metrics""",
)
def typed_slots(spark, sf):
    slot = messages.typed_slot(F.col("value_type"), F.col("value"), F.col("value_json"))
    rows = v.metrics(spark, sf).select(F.col("elem_order").cast("bigint").alias("event_id"), slot.alias("s"))
    return rows.select(
        "event_id", "s.datatype", "s.int_value", "s.double_value", "s.boolean_value", "s.string_value", "s.is_null"
    )


_EXTRA = {**_METRIC_PROPS, "unit": "coalesce(unit, 'none')", "retries": "CAST(k AS VARCHAR)"}


@query(
    "property_sets",
    f"""WITH {v.METRICS}, p AS (SELECT event_id, string_split({_sql_entries(_EXTRA)}, '&') AS entries FROM metrics)
    SELECT event_id, array_to_string([split_part(e, '=', 1) || ':' || (CASE WHEN regexp_full_match(e, '[^=]*=-?[0-9]+') THEN 4
      WHEN regexp_full_match(e, '[^=]*=-?[0-9]+\\.[0-9]+') THEN 10 ELSE 12 END) FOR e IN entries], ',') AS types FROM p""",
)
def property_sets(spark, sf):
    rows = v.events(spark, sf).select("event_id", F.col("k").cast("string").alias("k"))
    m = v.metrics(spark, sf).withColumn("event_id", F.col("elem_order").cast("bigint")).join(rows, "event_id")
    extra = F.create_map(F.lit("aas:unit"), F.coalesce("unit", F.lit("none")), F.lit("aas:retries"), F.col("k"))
    props = messages.override_properties(semantics.metric_properties(), extra)
    types = F.transform(
        F.array_sort(messages.property_set(props)),
        lambda e: F.concat_ws(":", e["key"], e["type"].cast("string")),
    )
    return m.select("event_id", F.array_join(types, ",").alias("types"))


_ROUTED = f"""{_ALIASES},
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id, path ORDER BY timestamp_ms DESC, elem_order DESC) AS rn FROM topics) WHERE rn = 1),
born AS (SELECT DISTINCT device_id FROM topics WHERE timestamp_ms < {CUT_MS} AND unit = 'USD'),
routed AS (SELECT c.*, CASE WHEN b.device_id IS NULL THEN 'DBIRTH' WHEN c.timestamp_ms >= {CUT_MS} THEN 'DDATA' END AS kind
  FROM cur c LEFT JOIN born b USING (device_id)),
msg AS (SELECT r.*, a.alias FROM routed r JOIN aliases a USING (device_id, path) WHERE kind IS NOT NULL)"""


def routed(spark, sf):
    """Current metrics per device as births or data, with their aliases."""
    rows = _device_rows(spark, sf)
    current = messages.device_state(rows).withColumn("changed", F.col("timestamp_ms") >= CUT_MS)
    births = rows.filter((F.col("timestamp_ms") < CUT_MS) & (F.col("unit") == "USD")).select("device_id")
    table = aliases_of(spark, sf).select("device_id", "path", "alias")
    return messages.route(current, births).join(table, ["device_id", "path"])


@query("messages_routed", f"WITH {_ROUTED} SELECT device_id, path, kind, alias FROM msg")
def messages_routed(spark, sf):
    return routed(spark, sf).select("device_id", "path", "kind", "alias")


_BIRTH = f"""'{{"name": ' || {_q('path')} || ', "value": ' || value_json || ', "value_type": ' || {_q('value_type')} || ', "timestamp_ms": ' || timestamp_ms
  || ', "alias": ' || alias || ', "semantic_id": ' || {_q('semantic_id')} || ', "unit": ' || {_q('unit')} || ', "aas_source": ' || {_q('aas_source')}
  || ', "aas_type": ' || {_q('aas_type')} || ', "submodel_semantic_id": ' || {_q('submodel_semantic_id')} || ', "semantic_keys": ' || {_list_json('semantic_keys')} || '}}'"""
_DATA = f"""'{{"name": "", "value": ' || value_json || ', "value_type": ' || {_q('value_type')} || ', "timestamp_ms": ' || timestamp_ms || ', "alias": ' || alias || '}}'"""


def _bodies_sql(kind: str, metric: str) -> str:
    return f"""WITH {_ROUTED}, p AS (SELECT device_id, alias, {metric} AS j, (row_number() OVER (PARTITION BY device_id ORDER BY alias) - 1) // 3 AS part FROM msg WHERE kind = '{kind}')
    SELECT device_id, part, count(*) AS metric_count, '[' || string_agg(j, ', ' ORDER BY alias) || ']' AS metrics FROM p GROUP BY ALL"""


@query("device_births", _bodies_sql("DBIRTH", _BIRTH))
def device_births(spark, sf):
    births = routed(spark, sf).filter("kind = 'DBIRTH'")
    return messages.bodies(births, ["device_id"], messages.birth_metric(), part_size=3)


@query("device_data", _bodies_sql("DDATA", _DATA))
def device_data(spark, sf):
    data = routed(spark, sf).filter("kind = 'DDATA'")
    return messages.bodies(data, ["device_id"], messages.data_metric(), part_size=3)


@query(
    "active_devices",
    f"""WITH {v.MESSAGES} SELECT node, device_id FROM log WHERE device_id IS NOT NULL GROUP BY ALL HAVING arg_max(kind, seq_order) <> 'DDEATH'""",
)
def active_devices(spark, sf):
    return messages.active_devices(v.message_log(spark, sf))


@query(
    "shutdown_deaths",
    f"""WITH {v.MESSAGES} SELECT node, device_id, 'DDEATH' AS kind, '[]' AS metrics FROM log WHERE device_id IS NOT NULL
    GROUP BY node, device_id HAVING arg_max(log.kind, seq_order) <> 'DDEATH'""",
)
def shutdown_deaths(spark, sf):
    return messages.shutdown_deaths(v.message_log(spark, sf))


@query("message_sessions", f"WITH {v.MESSAGES} SELECT seq_order, node, kind, bd_seq, seq FROM messages")
def message_sessions(spark, sf):
    return messages.sessions(v.message_log(spark, sf)).select("seq_order", "node", "kind", "bd_seq", "seq")


@query(
    "node_births",
    f"""WITH {v.MESSAGES} SELECT node, bd_seq, '{{"timestamp": ' || ts || ', "seq": ' || seq || ', "metrics": [{{"name": "bdSeq", "value": ' || bd_seq
      || ', "value_type": "xs:long", "timestamp_ms": ' || ts || '}}, {{"name": "Node Control/Rebirth", "value": false, "value_type": "xs:boolean", "timestamp_ms": ' || ts || '}}]}}' AS birth,
      '[{{"name": "bdSeq", "value": ' || bd_seq || ', "datatype": 4}}]' AS death FROM messages WHERE kind = 'NBIRTH'""",
)
def node_births(spark, sf):
    births = messages.sessions(v.message_log(spark, sf)).filter("kind = 'NBIRTH'")
    body = messages.node_birth_metrics(F.col("bd_seq"), F.col("ts"))
    return births.select(
        "node", "bd_seq", messages.message_payload(F.col("ts"), F.col("seq"), body).alias("birth"),
        messages.node_death_metrics(F.col("bd_seq")).alias("death"),
    )


@query(
    "device_state",
    f"""WITH {v.TOPICS} SELECT device_id, path, arg_max(value_json, elem_order) AS value_json FROM topics GROUP BY ALL""",
)
def device_state(spark, sf):
    return messages.device_state(_device_rows(spark, sf)).select("device_id", "path", "value_json")


@query(
    "device_state_replaced",
    f"""WITH {v.TOPICS}, s AS (SELECT device_id, path, timestamp_ms < {CUT_MS} AS old, arg_max(value_json, elem_order) AS value_json FROM topics GROUP BY ALL)
    SELECT device_id, path, value_json FROM s WHERE NOT old OR device_id NOT IN (SELECT device_id FROM s WHERE NOT old)""",
)
def device_state_replaced(spark, sf):
    rows = _device_rows(spark, sf)
    old = messages.device_state(rows.filter(F.col("timestamp_ms") < CUT_MS))
    full = messages.device_state(rows.filter(F.col("timestamp_ms") >= CUT_MS))
    return messages.replace_state(old, full).select("device_id", "path", "value_json")


_STORE = f"""{v.MESSAGES}, births AS (SELECT device_id, arg_max(struct_pack(ts := ts, seq := seq, k := k), seq_order) AS b FROM messages WHERE kind = 'DBIRTH' GROUP BY device_id)"""


def stored_births(spark, sf):
    births = messages.sessions(v.message_log(spark, sf)).filter("kind = 'DBIRTH'")
    rows = births.select("device_id", "ts", "seq_order", "seq", F.concat(F.lit("birth-"), "k").alias("payload"))
    return messages.latest_births(rows)


@query("stored_births", f"WITH {_STORE} SELECT device_id, b.ts AS ts, b.seq AS seq, 'birth-' || b.k AS payload FROM births")
def stored_births_query(spark, sf):
    return stored_births(spark, sf).select("device_id", "ts", "seq", "payload")


@query(
    "stored_births_removed",
    f"""WITH {_STORE} SELECT device_id FROM births WHERE device_id NOT IN (SELECT device_id FROM messages WHERE device_id IS NOT NULL
      GROUP BY device_id HAVING arg_max(kind, struct_pack(ts := ts, n := seq_order)) = 'DDEATH')""",
)
def stored_births_removed(spark, sf):
    """Births of the devices whose last message is not a death."""
    log = messages.sessions(v.message_log(spark, sf)).filter("device_id IS NOT NULL")
    last = latest_per_key(log.select("device_id", "kind", "ts", "seq_order"), ["device_id"], ["ts", "seq_order"])
    return messages.remove_births(stored_births(spark, sf), last.filter("kind = 'DDEATH'").select("device_id")).select("device_id")


_CMD_METRICS = """CASE WHEN k % 5 = 0 THEN 'Node Control/Rebirth' WHEN k % 5 = 1 THEN 'Rebirth' ELSE 'Limit' END AS name,
  CASE WHEN k % 3 = 0 THEN 'true' WHEN k % 3 = 1 THEN ' Yes ' WHEN k % 2 = 0 THEN '0' ELSE 'off' END AS value"""
_REQUESTS = f"""ev AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
cm AS (SELECT *, {_CMD_METRICS} FROM ev),
requests AS (SELECT event_id, 'dev-' || user_id AS device_id, ts FROM cm WHERE contains(name, 'Rebirth') AND lower(trim(value)) IN ('true', 'yes'))"""


def requests_of(spark, sf):
    k = F.col("k")
    name = F.when(k % 5 == 0, "Node Control/Rebirth").when(k % 5 == 1, "Rebirth").otherwise("Limit")
    value = F.when(k % 3 == 0, "true").when(k % 3 == 1, " Yes ").when(k % 2 == 0, "0").otherwise("off")
    items = F.array(F.struct(F.lit("Other").alias("name"), F.lit("1").alias("value")), F.struct(name.alias("name"), value.alias("value")))
    rows = v.events(spark, sf).withColumn("metrics", items)
    return rows.filter(messages.requests_rebirth(F.col("metrics"))).select(
        "event_id", F.concat(F.lit("dev-"), "user_id").alias("device_id"), "ts"
    )


@query("rebirth_requests", f"WITH {_REQUESTS} SELECT event_id, device_id, ts FROM requests")
def rebirth_requests(spark, sf):
    return requests_of(spark, sf)


@query(
    "rebirths",
    f"""WITH {_REQUESTS}, {_STORE}, state AS (SELECT user_id, count(DISTINCT event_type) AS n FROM events WHERE event_type <> 'view' AND user_id % 2 = 0 GROUP BY user_id),
    known AS (SELECT coalesce('dev-' || s.user_id, b.device_id) AS device_id, n FROM state s FULL JOIN births b ON 'dev-' || s.user_id = b.device_id),
    placed AS (SELECT 'node-' || (CAST(substr(device_id, 5) AS BIGINT) % 3) AS node, device_id, n FROM known),
    whole AS (SELECT 'node-' || (user_id % 3) AS node, max(epoch_us(ts) // 1000) AS node_ts FROM events
      WHERE user_id % 3 < 2 AND event_id IN (SELECT event_id FROM requests WHERE device_id LIKE '%7') GROUP BY ALL),
    own AS (SELECT device_id, max(ts) AS own_ts FROM requests GROUP BY device_id)
    SELECT node, device_id, greatest(own_ts, node_ts) AS ts, CASE WHEN n > 0 THEN 'state' ELSE 'stored' END AS source, coalesce(n, 0) AS metric_count
    FROM placed LEFT JOIN own USING (device_id) LEFT JOIN whole USING (node) WHERE own_ts IS NOT NULL OR node_ts IS NOT NULL""",
)
def rebirths(spark, sf):
    # Devices belong to the node that their number names; two of the three nodes ask as a whole.
    node = F.concat(F.lit("node-"), F.substring("device_id", 5, 20).cast("long") % 3)
    asked = requests_of(spark, sf).withColumn("node", node)
    whole = asked.filter(F.col("device_id").endswith("7") & (F.col("node") != "node-2"))
    state = (
        v.events(spark, sf).filter("event_type <> 'view' AND user_id % 2 = 0")
        .select(F.concat(F.lit("dev-"), "user_id").alias("device_id"), F.col("event_type").alias("path")).distinct()
    )
    requests = asked.select("node", "device_id", "ts").unionByName(
        whole.select("node", F.lit(None).cast("string").alias("device_id"), "ts")
    )
    return messages.rebirths(requests, state.withColumn("node", node), stored_births(spark, sf).withColumn("node", node))


_FAULTY = f"""{v.MESSAGES}, m AS (SELECT node, device_id, kind, ts, seq_order, CASE WHEN seq_order % 97 = 0 THEN 1 ELSE 0 END AS qos, seq_order % 89 = 0 AS retain,
    CASE WHEN seq_order % 101 = 0 THEN (seq + 7) % 256 ELSE seq END AS seq, CASE WHEN seq_order % 103 = 0 THEN bd_seq + 2 ELSE bd_seq END AS bd_seq FROM messages),
pl AS (SELECT *, lag(seq) OVER w AS p_seq, lag(bd_seq) OVER w AS p_bd FROM m WINDOW w AS (PARTITION BY node ORDER BY ts, seq_order)),
b AS (SELECT node, bd_seq, device_id, min(seq_order) AS born FROM m WHERE kind = 'DBIRTH' GROUP BY ALL),
j AS (SELECT pl.*, b.born FROM pl LEFT JOIN b USING (node, bd_seq, device_id)),
a AS (SELECT node, count(*) FILTER (qos <> 0) AS qos, count(*) FILTER (retain) AS retain,
    count(*) FILTER (p_bd IS NOT DISTINCT FROM bd_seq AND seq <> (p_seq + 1) % 256) AS seq_step,
    count(*) FILTER (p_bd IS DISTINCT FROM bd_seq AND seq <> 0) AS seq_restart,
    count(*) FILTER (p_bd IS NOT NULL AND p_bd <> bd_seq AND bd_seq <> p_bd + 1) AS bd_seq_step,
    count(*) FILTER (kind = 'DDATA' AND NOT coalesce(born <= seq_order, false)) AS birth_before_data FROM j GROUP BY node)"""


@query("messages_early", f"WITH {v.MESSAGES} SELECT seq_order, node, kind FROM numbered WHERE bd_seq < 0")
def messages_early(spark, sf):
    return messages.early_messages(v.message_log(spark, sf)).select("seq_order", "node", "kind")


@query(
    "message_audit",
    f"""WITH {_FAULTY}, early AS (SELECT node, count(*) AS before_node_birth FROM numbered WHERE bd_seq < 0 GROUP BY node),
    c AS (SELECT node, coalesce(qos, 0) AS qos, coalesce(retain, 0) AS retain, coalesce(seq_step, 0) AS seq_step,
      coalesce(seq_restart, 0) AS seq_restart, coalesce(bd_seq_step, 0) AS bd_seq_step,
      coalesce(birth_before_data, 0) AS birth_before_data, coalesce(before_node_birth, 0) AS before_node_birth
      FROM a FULL JOIN early USING (node))
    SELECT node, rule, violations FROM (UNPIVOT c ON qos, retain, seq_step, seq_restart, bd_seq_step, birth_before_data, before_node_birth
      INTO NAME rule VALUE violations)""",
)
def message_audit(spark, sf):
    n = F.col("seq_order")
    sent = v.message_log(spark, sf)
    log = messages.sessions(sent).select(
        "node", "device_id", "kind", "ts", "seq_order",
        F.when(n % 97 == 0, 1).otherwise(0).alias("qos"),
        (n % 89 == 0).alias("retain"),
        F.when(n % 101 == 0, (F.col("seq") + 7) % 256).otherwise(F.col("seq")).alias("seq"),
        F.when(n % 103 == 0, F.col("bd_seq") + 2).otherwise(F.col("bd_seq")).alias("bd_seq"),
    )
    return messages.audit(log, messages.early_messages(sent))


@query(
    "status_row",
    f"""WITH {v.MESSAGES}, act AS (SELECT node, device_id FROM log WHERE device_id IS NOT NULL GROUP BY ALL HAVING arg_max(kind, seq_order) <> 'DDEATH')
    SELECT CASE WHEN max(ts) >= {v.AS_OF_MS} - 172800000 THEN 'healthy' ELSE 'degraded' END AS status, max(ts) >= {v.AS_OF_MS} - 172800000 AS connected,
      (SELECT count(*) FROM act) AS active_devices, count(*) FILTER (kind IN ('NBIRTH', 'DBIRTH')) AS births, (SELECT count(DISTINCT user_id) FROM events) AS published FROM log""",
)
def status_row(spark, sf):
    from plantweave.operators.observability import status_row as build

    published = v.events(spark, sf).select("user_id").distinct()
    return build(v.message_log(spark, sf), published, F.lit(v.AS_OF_MS), 172_800_000)
