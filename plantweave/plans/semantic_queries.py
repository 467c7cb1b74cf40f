"""Semantic pointers, contexts, payloads, validation and change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantweave.functions import semantics, types
from plantweave.operators import dedup, semantic, validation
from plantweave.plans import views as v
from plantweave.plans.registry import query
from plantweave.sources.sinks import retained

PREFIX = "UNS/Sys/Context"
SOURCE = "plantweave"


def _dictionary(sid: str) -> str:
    web = f"(starts_with({sid}, 'http://') OR starts_with({sid}, 'https://'))"
    return f"""CASE WHEN {sid} IS NULL OR {sid} = '' THEN 'unknown'
      WHEN starts_with({sid}, '0173-1#') OR starts_with({sid}, '0173-1---') THEN 'ECLASS'
      WHEN starts_with({sid}, '0112/') THEN 'IEC_CDD'
      WHEN {web} AND contains(lower({sid}), 'eclass') THEN 'ECLASS'
      WHEN {web} AND (contains(lower({sid}), 'iec') OR contains(lower({sid}), 'cdd')) THEN 'IEC_CDD'
      WHEN {web} AND contains({sid}, 'admin-shell.io') THEN 'IDTA' WHEN {web} THEN 'IRI' ELSE 'custom' END"""


def _version(sid: str) -> str:
    return f"CASE WHEN len(string_split({sid}, '#')) >= 3 THEN string_split({sid}, '#')[-1] ELSE '1.0' END"


def _hash(sid: str) -> str:
    return f"left(sha256({sid}), 16)"


_IDS = """ids AS (SELECT DISTINCT semantic_id AS sid FROM metrics WHERE semantic_id IS NOT NULL
  UNION SELECT url FROM pages UNION SELECT p_brand || '#' || p_type || '#' || p_size FROM part
  UNION SELECT '0173-1---' || p_name FROM part)"""


@query(
    "semantic_pointers",
    f"WITH {v.METRICS}, {_IDS} SELECT sid, {_hash('sid')} AS hash, {_dictionary('sid')} AS dictionary, {_version('sid')} AS version FROM ids",
)
def semantic_pointers(spark, sf):
    part = v.table(spark, sf, "part")
    ids = (
        v.metrics(spark, sf).filter("semantic_id IS NOT NULL").select(F.col("semantic_id").alias("sid"))
        .union(v.table(spark, sf, "pages").select("url"))
        .union(part.select(F.concat_ws("#", "p_brand", "p_type", F.col("p_size").cast("string"))))
        .union(part.select(F.concat(F.lit("0173-1---"), "p_name")))
        .distinct()
    )
    sid = F.col("sid")
    return ids.select(
        "sid", semantics.pointer_hash(sid).alias("hash"), semantics.dictionary(sid).alias("dictionary"),
        semantics.version(sid).alias("version"),
    )


_CONTEXTS = f"""cand AS (SELECT *, {_hash('semantic_id')} AS hash FROM metrics WHERE semantic_id IS NOT NULL),
contexts AS (SELECT hash, semantic_id, {_dictionary('semantic_id')} AS dictionary, {_version('semantic_id')} AS version,
    CAST(NULL AS VARCHAR) AS definition, CAST(NULL AS VARCHAR) AS preferred_name, unit, value_type AS data_type,
    CASE WHEN list_contains(semantic_keys, semantic_id) THEN semantic_keys ELSE list_prepend(semantic_id, semantic_keys) END AS hierarchy
  FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY timestamp_ms, elem_order) AS rn FROM cand) WHERE rn = 1)"""


def contexts_table(spark, sf):
    return semantic.register(semantic.contexts_of_metrics(v.metrics(spark, sf)))


@query(
    "contexts_registered",
    f"""WITH {v.METRICS}, {_CONTEXTS} SELECT hash, semantic_id, dictionary, version, unit, data_type,
      array_to_string(hierarchy, '|') AS hierarchy FROM contexts""",
)
def contexts_registered(spark, sf):
    return contexts_table(spark, sf).select(
        "hash", "semantic_id", "dictionary", "version", "unit", "data_type", F.array_join("hierarchy", "|").alias("hierarchy")
    )


@query(
    "contexts_insert_only",
    f"""WITH {v.METRICS}, {_CONTEXTS} SELECT hash, semantic_id, unit FROM contexts
      WHERE hash NOT IN (SELECT hash FROM cand WHERE event_type IN ('click', 'purchase'))""",
)
def contexts_insert_only(spark, sf):
    candidates = semantic.contexts_of_metrics(v.metrics(spark, sf))
    known = candidates.filter(F.col("semantic_id").contains("AAO677") | F.col("semantic_id").contains("price"))
    return semantic.register(candidates, semantic.register(known)).select("hash", "semantic_id", "unit")


@query(
    "contexts_resolved",
    f"""WITH {v.METRICS}, {_CONTEXTS}, refs AS (SELECT event_id, coalesce({_hash('semantic_id')}, 'none') AS hash FROM metrics)
    SELECT event_id, r.hash, c.semantic_id, c.dictionary, c.data_type FROM refs r LEFT JOIN contexts c USING (hash)""",
)
def contexts_resolved(spark, sf):
    rows = v.metrics(spark, sf).select(
        F.col("elem_order").cast("bigint").alias("event_id"),
        F.coalesce(semantics.pointer_hash(F.col("semantic_id")), F.lit("none")).alias("hash"),
    )
    found = semantic.resolve(rows, contexts_table(spark, sf))
    return found.select("event_id", "hash", "semantic_id", "dictionary", "data_type")


@query(
    "contexts_reverse_lookup",
    f"""WITH {v.METRICS}, {_CONTEXTS}, ids AS (SELECT DISTINCT semantic_id FROM metrics WHERE semantic_id IS NOT NULL UNION SELECT url FROM pages)
    SELECT semantic_id, c.hash, c.dictionary, c.version FROM ids LEFT JOIN contexts c USING (semantic_id)""",
)
def contexts_reverse_lookup(spark, sf):
    ids = (
        v.metrics(spark, sf).filter("semantic_id IS NOT NULL").select("semantic_id")
        .union(v.table(spark, sf, "pages").select("url")).distinct()
    )
    return semantic.resolve_by_semantic_id(ids, contexts_table(spark, sf))


@query(
    "contexts_membership",
    f"""WITH {v.METRICS}, {_CONTEXTS} SELECT count(*) AS rows_registered, count(DISTINCT m.semantic_id) AS ids_registered,
      (SELECT count(*) FROM contexts) AS total FROM metrics m WHERE {_hash('semantic_id')} IN (SELECT hash FROM contexts)""",
)
def contexts_membership(spark, sf):
    contexts = contexts_table(spark, sf)
    rows = v.metrics(spark, sf).select("semantic_id", semantics.pointer_hash(F.col("semantic_id")).alias("hash"))
    return semantic.registered(rows, contexts).agg(
        F.count(F.lit(1)).alias("rows_registered"),
        F.countDistinct("semantic_id").alias("ids_registered"),
        F.first(contexts.agg(F.count(F.lit(1))).scalar()).alias("total"),
    )


def _q(expr: str) -> str:
    return f"coalesce(CAST(to_json(CAST({expr} AS VARCHAR)) AS VARCHAR), 'null')"


_INLINE = f"""'{{"value": ' || value_json || ', "timestamp": ' || timestamp_ms || ', "semanticId": ' || {_q('semantic_id')}
  || ', "unit": ' || {_q('unit')} || ', "valueType": ' || {_q('value_type')} || ', "source": "{SOURCE}", "aasUri": "events.parquet"}}'"""
_POINTER = f"""'{{"value": ' || value_json || ', "timestamp": ' || timestamp_ms || ', "ptr": "' || {_hash('semantic_id')} || '"}}'"""
_HYBRID = f"""'{{"value": ' || value_json || ', "timestamp": ' || timestamp_ms || ', "ptr": "' || {_hash('semantic_id')} || '"'
  || CASE WHEN unit IS NULL THEN '' ELSE ', "unit": ' || {_q('unit')} END || ', "valueType": ' || {_q('value_type')} || '}}'"""
_NO_META = """'{"value": ' || value_json || ', "timestamp": ' || timestamp_ms || '}'"""


def _payload_query(name, mode, sql, **options):
    @query(name, f"WITH {v.METRICS} SELECT event_id, {sql} AS payload FROM metrics")
    def run(spark, sf):
        return v.metrics(spark, sf).select(
            F.col("elem_order").cast("bigint").alias("event_id"),
            semantics.payload(mode, None, SOURCE, **options).alias("payload"),
        )

    return run


payload_inline = _payload_query("payload_inline", "inline", _INLINE)
payload_pointer = _payload_query(
    "payload_pointer", "pointer", f"CASE WHEN semantic_id IS NULL THEN {_INLINE} ELSE {_POINTER} END"
)
payload_hybrid = _payload_query(
    "payload_hybrid", "hybrid", f"CASE WHEN semantic_id IS NULL THEN {_INLINE} ELSE {_HYBRID} END"
)
payload_value_only = _payload_query(
    "payload_value_only", "inline", _NO_META, use_properties=True, metadata_fallback=False
)


def _entries(props):
    pairs = F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), "&")


def _sql_entries(pairs: dict[str, str]) -> str:
    items = ", ".join(f"'aas:{k}=' || nullif({e}, '')" for k, e in pairs.items())
    return f"array_to_string(list_sort([x FOR x IN [{items}] IF x IS NOT NULL]), '&')"


_USER = {"semanticId": "semantic_id", "unit": "unit", "valueType": "value_type", "aasType": "aas_type", "source": "aas_source"}
_PTR = {"ptr": _hash("semantic_id"), "dict": _dictionary("semantic_id"), "ver": _version("semantic_id")}


@query(
    "user_properties",
    f"""WITH {v.METRICS} SELECT event_id, {_sql_entries(_USER)} AS inline_props,
      CASE WHEN semantic_id IS NULL THEN {_sql_entries(_USER)} ELSE {_sql_entries(_PTR)} END AS pointer_props FROM metrics""",
)
def user_properties(spark, sf):
    return v.metrics(spark, sf).select(
        F.col("elem_order").cast("bigint").alias("event_id"),
        _entries(semantics.user_properties("inline", None)).alias("inline_props"),
        _entries(semantics.user_properties("pointer", None)).alias("pointer_props"),
    )


def _list_json(expr: str) -> str:
    return f"'[' || array_to_string([{_q('x')} FOR x IN {expr}], ', ') || ']'"


_METRIC_PROPS = {
    "semanticId": "semantic_id",
    "semanticKeys": f"CASE WHEN len(semantic_keys) > 1 THEN {_list_json('semantic_keys')} END",
    "unit": "unit", "aasType": "aas_type", "aasSource": "aas_source", "submodelSemanticId": "submodel_semantic_id",
}


@query(
    "metric_properties",
    f"""WITH {v.METRICS} SELECT event_id, {_sql_entries(_METRIC_PROPS)} AS props,
      {_sql_entries({**_METRIC_PROPS, 'fidelityScore': "CAST(CAST(CASE WHEN unit IS NULL THEN 0.5 ELSE 0.75 END AS DOUBLE) AS VARCHAR)"})} AS scored FROM metrics""",
)
def metric_properties(spark, sf):
    score = F.when(F.col("unit").isNull(), 0.5).otherwise(0.75)
    return v.metrics(spark, sf).select(
        F.col("elem_order").cast("bigint").alias("event_id"),
        _entries(semantics.metric_properties()).alias("props"),
        _entries(semantics.metric_properties(score)).alias("scored"),
    )


_CONTEXT_PROPS = {
    "semanticId": "semantic_id", "semanticDictionary": "dictionary", "semanticVersion": "version", "semanticHash": "hash",
    "unit": "unit", "semanticKeys": f"CASE WHEN len(hierarchy) > 1 THEN {_list_json('hierarchy')} END",
}


@query("context_properties", f"WITH {v.METRICS}, {_CONTEXTS} SELECT hash, {_sql_entries(_CONTEXT_PROPS)} AS props FROM contexts")
def context_properties(spark, sf):
    return contexts_table(spark, sf).select("hash", _entries(semantics.context_properties()).alias("props"))


_CTX_JSON = f"""'{{"semanticId": ' || {_q('semantic_id')} || ', "dictionary": ' || {_q('dictionary')} || ', "version": ' || {_q('version')}
  || ', "definition": null, "preferredName": null, "unit": ' || {_q('unit')} || ', "dataType": ' || {_q('data_type')}
  || ', "hierarchy": ' || {_list_json('hierarchy')} || '}}'"""


@query(
    "contexts_distributed",
    f"""WITH {v.METRICS}, {_CONTEXTS} SELECT '{PREFIX}/' || dictionary || '/' || hash AS topic, {_CTX_JSON} AS payload FROM contexts""",
)
def contexts_distributed(spark, sf):
    return semantic.publish_contexts(contexts_table(spark, sf), PREFIX).select("topic", "payload")


@query(
    "contexts_redistributed",
    f"""WITH {v.METRICS}, {_CONTEXTS}, seen AS (SELECT DISTINCT {_hash('semantic_id')} AS hash FROM metrics WHERE event_type = 'click')
    SELECT '{PREFIX}/' || dictionary || '/' || hash AS topic, 'sent' AS action FROM contexts WHERE hash NOT IN (SELECT hash FROM seen)
    UNION ALL SELECT '{PREFIX}/' || dictionary || '/' || hash, 'cleared' FROM contexts WHERE hash IN (SELECT hash FROM seen)""",
)
def contexts_redistributed(spark, sf):
    contexts = contexts_table(spark, sf)
    published = contexts.filter(F.col("semantic_id").contains("AAO677"))
    sent = semantic.publish_contexts(contexts, PREFIX, published).select("topic", F.lit("sent").alias("action"))
    cleared = semantic.clear_contexts(published, PREFIX).select("topic", F.lit("cleared").alias("action"))
    return sent.union(cleared)


@query(
    "pointers_found_or_created",
    f"""WITH {v.METRICS}, {_CONTEXTS} SELECT event_id, c.hash, c.dictionary, coalesce(event_type <> 'click' AND c.hash IS NOT NULL, false) AS created
    FROM metrics m LEFT JOIN contexts c USING (semantic_id)""",
)
def pointers_found_or_created(spark, sf):
    rows = v.metrics(spark, sf)
    known = contexts_table(spark, sf).filter(F.col("semantic_id").contains("AAO677"))
    pointed, new, _ = semantic.find_or_create(rows, known, PREFIX)
    flagged = pointed.join(new.select("hash").withColumn("_new", F.lit(True)), "hash", "left")
    return flagged.select(
        F.col("elem_order").cast("bigint").alias("event_id"), "hash", "dictionary",
        F.coalesce("_new", F.lit(False)).alias("created"),
    )


# -- validation ---------------------------------------------------------------

_E = "struct_pack(error_type := {0}, message := {1}, semantic_id := {2}, expected := {3}, actual := {4})"
_V = "CAST(value_num AS VARCHAR)"
_CHECKS = [
    ("semantic_id IS NULL", _E.format("'missing_semantic_id'", "'Property element requires a semantic ID'", "CAST(NULL AS VARCHAR)", "'non-empty semantic ID'", "'None'")),
    ("value_num < min_value", _E.format("'value_out_of_range'", f"'Value ' || {_V} || ' is below minimum ' || min_value", "semantic_id", "'>= ' || min_value", _V)),
    ("value_num > max_value", _E.format("'value_out_of_range'", f"'Value ' || {_V} || ' exceeds maximum ' || max_value", "semantic_id", "'<= ' || max_value", _V)),
    ("unit_expected IS NOT NULL AND unit IS DISTINCT FROM unit_expected", _E.format("'unit_mismatch'", "'Unit ''' || coalesce(unit, 'None') || ''' does not match expected ''' || unit_expected || ''''", "semantic_id", "unit_expected", "coalesce(unit, 'None')")),
    ("pattern IS NOT NULL AND value_type = 'xs:string' AND NOT regexp_matches(value, '^(?:' || pattern || ')')", _E.format("'pattern_mismatch'", "'Value ''' || value || ''' does not match pattern ''' || pattern || ''''", "semantic_id", "pattern", "value")),
]
_VALIDATED = f"""{v.METRICS}, {v.CONSTRAINTS_SQL},
validated AS (SELECT m.*, list_filter([{', '.join(f'CASE WHEN {c} THEN {e} END' for c, e in _CHECKS)}], lambda x: x IS NOT NULL) AS errors
  FROM metrics m LEFT JOIN constraints USING (semantic_id))"""


def validated(spark, sf):
    return validation.validate(v.metrics(spark, sf), v.constraints(spark))


@query(
    "validation_errors",
    f"""WITH {_VALIDATED} SELECT event_id, e.error_type, e.message, path, e.semantic_id AS semantic_id, e.expected, e.actual
    FROM (SELECT event_id, path, unnest(errors) AS e FROM validated)""",
)
def validation_errors(spark, sf):
    return validated(spark, sf).select(F.col("elem_order").cast("bigint").alias("event_id"), F.inline("errors"))


@query(
    "validation_batches",
    f"""WITH {_VALIDATED} SELECT asset_id, submodel, count(*) FILTER (len(errors) = 0) AS valid_count,
      count(*) FILTER (len(errors) > 0) AS invalid_count, CAST(sum(len(errors)) AS BIGINT) AS total_errors FROM validated GROUP BY ALL""",
)
def validation_batches(spark, sf):
    return validation.batch_result(validated(spark, sf))


@query("validation_rejects", f"WITH {_VALIDATED} SELECT event_id, value_json, true AS use_properties FROM validated WHERE len(errors) = 0")
def validation_rejects(spark, sf):
    kept = validation.enforce(v.metrics(spark, sf), v.constraints(spark), level=2, reject_invalid=True)
    return kept.select(F.col("elem_order").cast("bigint").alias("event_id"), "value_json", "use_properties")


@query(
    "validation_counts",
    f"""WITH {_VALIDATED} SELECT 'result' AS kind, CASE WHEN len(errors) = 0 THEN 'valid' ELSE 'invalid' END AS label, count(*) AS n
    FROM validated GROUP BY ALL UNION ALL
    SELECT 'error_type', e.error_type, count(*) FROM (SELECT unnest(errors) AS e FROM validated) GROUP BY ALL""",
)
def validation_counts(spark, sf):
    return validation.counts(validated(spark, sf))


# -- change detection ---------------------------------------------------------

_SERIES = f"""{v.TOPICS}, seen AS (SELECT *, sha256(value_json) AS hash,
  lag(sha256(value_json)) OVER (PARTITION BY topic ORDER BY timestamp_ms, elem_order) AS previous FROM topics)"""


def _topic_values(spark, sf):
    return v.topics(spark, sf).select("topic", "timestamp_ms", "elem_order", "value_json", "value_type")


@query("value_hashes", f"WITH {v.METRICS} SELECT event_id, sha256(value_json) AS hash FROM metrics")
def value_hashes(spark, sf):
    return v.metrics(spark, sf).select(
        F.col("elem_order").cast("bigint").alias("event_id"), dedup.value_hash(F.col("value_json")).alias("hash")
    )


@query("changed_values", f"WITH {_SERIES} SELECT event_id, topic, hash FROM seen WHERE hash IS DISTINCT FROM previous")
def changed_values(spark, sf):
    changed = dedup.changed_in_series(_topic_values(spark, sf))
    return changed.select(F.col("elem_order").cast("bigint").alias("event_id"), "topic", "hash")


TTL_MS = 2 * 86_400_000


@query(
    "changed_values_ttl",
    f"""WITH RECURSIVE {_SERIES},
    times AS (SELECT topic, list_sort(list(DISTINCT timestamp_ms)) AS ts FROM topics GROUP BY topic),
    created(topic, t) AS (SELECT topic, ts[1] FROM times UNION ALL
      SELECT c.topic, list_filter(times.ts, lambda x: x >= c.t + {TTL_MS})[1] FROM created c JOIN times USING (topic)
      WHERE times.ts[-1] >= c.t + {TTL_MS}),
    firsts AS (SELECT topic, timestamp_ms AS t, min(elem_order) AS elem_order FROM topics GROUP BY ALL)
    SELECT s.event_id, s.topic, c.t IS NOT NULL AS created FROM seen s
    LEFT JOIN (SELECT topic, t, elem_order FROM created JOIN firsts USING (topic, t)) c
      ON c.topic = s.topic AND c.t = s.timestamp_ms AND c.elem_order = s.elem_order
    WHERE s.hash IS DISTINCT FROM s.previous OR c.t IS NOT NULL""",
)
def changed_values_ttl(spark, sf):
    changed = dedup.changed_in_series_with_ttl(_topic_values(spark, sf), TTL_MS)
    return changed.select(F.col("elem_order").cast("bigint").alias("event_id"), "topic", "created")


CUT_MS = 1_705_276_800_000  # 2024-01-15T00:00:00Z
_HASHES = f"""{v.TOPICS},
stored AS (SELECT topic, sha256(arg_max(value_json, elem_order)) AS hash, max(timestamp_ms) AS updated_at, min(timestamp_ms) AS created_at
  FROM topics WHERE timestamp_ms < {CUT_MS} GROUP BY topic),
cur AS (SELECT topic, arg_max(value_json, elem_order) AS value_json, max(timestamp_ms) AS timestamp_ms FROM topics
  WHERE timestamp_ms >= {CUT_MS} GROUP BY topic),
changed AS (SELECT c.*, sha256(c.value_json) AS hash FROM cur c LEFT JOIN stored s USING (topic) WHERE sha256(c.value_json) IS DISTINCT FROM s.hash)"""


def _stored_and_current(spark, sf):
    rows = _topic_values(spark, sf).drop("value_type")
    last = F.max_by("value_json", F.struct("timestamp_ms", "elem_order")).alias("value_json")
    before = rows.filter(F.col("timestamp_ms") < CUT_MS).groupBy("topic").agg(
        last, F.max("timestamp_ms").alias("updated_at"), F.min("timestamp_ms").alias("created_at")
    )
    stored = before.select("topic", dedup.value_hash(F.col("value_json")).alias("hash"), "updated_at", "created_at")
    current = rows.filter(F.col("timestamp_ms") >= CUT_MS).groupBy("topic").agg(
        last, F.max("timestamp_ms").alias("timestamp_ms")
    )
    return stored, current


@query("changed_since_stored", f"WITH {_HASHES} SELECT topic, value_json, hash FROM changed")
def changed_since_stored(spark, sf):
    stored, current = _stored_and_current(spark, sf)
    return dedup.changed_since(current, stored).select("topic", "value_json", "hash")


@query(
    "hashes_merged",
    f"""WITH {_HASHES} SELECT coalesce(s.topic, c.topic) AS topic, coalesce(c.hash, s.hash) AS hash,
      coalesce(c.timestamp_ms, s.updated_at) AS updated_at, coalesce(s.created_at, c.timestamp_ms) AS created_at
    FROM stored s FULL JOIN changed c ON s.topic = c.topic""",
)
def hashes_merged(spark, sf):
    stored, current = _stored_and_current(spark, sf)
    return dedup.merge_hashes(stored, dedup.changed_since(current, stored), F.col("timestamp_ms"))


@query("hashes_not_expired", f"WITH {_HASHES} SELECT topic, created_at FROM stored WHERE created_at > {CUT_MS - 10 * 86_400_000}")
def hashes_not_expired(spark, sf):
    stored, _ = _stored_and_current(spark, sf)
    return dedup.not_expired(stored, CUT_MS, 10 * 86_400_000).select("topic", "created_at")


@query("hashes_capped", f"WITH {_HASHES} SELECT topic, created_at FROM stored ORDER BY created_at DESC, topic LIMIT 100")
def hashes_capped(spark, sf):
    stored, _ = _stored_and_current(spark, sf)
    return dedup.cap_entries(stored, 100).select("topic", "created_at")


@query("hashes_tracked", f"WITH {_HASHES} SELECT count(*) AS tracked_topics FROM stored")
def hashes_tracked(spark, sf):
    return dedup.tracked_count(_stored_and_current(spark, sf)[0])


@query(
    "retained_topics",
    f"""WITH {v.TOPICS}, p AS (SELECT topic, timestamp_ms, elem_order, CASE WHEN event_type = 'error' THEN NULL ELSE {_INLINE} END AS payload FROM topics),
    l AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY timestamp_ms DESC, elem_order DESC) AS rn FROM
      (SELECT t.device_id, p.* FROM p JOIN (SELECT topic, elem_order, device_id FROM topics) t USING (topic, elem_order)))
    SELECT device_id AS topic, payload FROM l WHERE rn = 1 AND payload IS NOT NULL""",
)
def retained_topics(spark, sf):
    payload = F.when(~F.col("path").contains(".error."), semantics.payload("inline", None, SOURCE))
    rows = v.topics(spark, sf).select(
        F.col("device_id").alias("topic"), payload.alias("payload"), "timestamp_ms", "elem_order"
    )
    return retained(rows, ["timestamp_ms", "elem_order"]).select("topic", "payload")


@query(
    "current_payloads",
    f"""WITH {_SERIES} SELECT topic, arg_max({_INLINE}, elem_order) AS payload, count(*) AS changes
    FROM seen WHERE hash IS DISTINCT FROM previous GROUP BY topic""",
)
def current_payloads(spark, sf):
    """Current payload per topic from changed values only: the flagship query."""
    changed = dedup.changed_in_series(
        v.topics(spark, sf).select(
            "topic", "timestamp_ms", "elem_order", "value_json", "semantic_id", "unit", "value_type", "aas_source"
        )
    )
    fields = ["value_json", "semantic_id", "unit", "value_type", "aas_source", "timestamp_ms"]
    last = changed.groupBy("topic").agg(
        F.max_by(F.struct(*fields), F.struct("timestamp_ms", "elem_order")).alias("m"),
        F.count(F.lit(1)).alias("changes"),
    )
    # The payload is built once per topic, from its last changed row.
    payload = semantics.payload("inline", None, SOURCE)
    return last.select("topic", "changes", "m.*").select("topic", payload.alias("payload"), "changes")


# -- type codes ---------------------------------------------------------------


def _code(t: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {c}" for k, c in types.XSD_CODES.items())
    return f"CASE lower({t}) {whens} ELSE 12 END"


@query(
    "type_codes",
    f"""WITH {v.METRICS} SELECT event_id, {_code('value_type')} AS xsd_code, {_code("'XS:' || event_type")} AS other_code,
      CASE value_type WHEN 'xs:boolean' THEN 11 WHEN 'xs:string' THEN 12 WHEN 'xs:int' THEN 3 ELSE 10 END AS inferred FROM metrics""",
)
def type_codes(spark, sf):
    other = F.concat(F.lit("XS:"), F.regexp_extract("path", r"\.(\w+)\.", 1))
    return v.metrics(spark, sf).select(
        F.col("elem_order").cast("bigint").alias("event_id"),
        types.xsd_code(F.col("value_type")).alias("xsd_code"),
        types.xsd_code(other).alias("other_code"),
        types.infer_code(F.col("value_json")).alias("inferred"),
    )


@query(
    "typed_values",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS as_int, l_extendedprice AS as_double,
      l_linestatus = 'O' AS as_bool, CAST(to_json(l_returnflag) AS VARCHAR) AS as_text FROM lineitem""",
)
def typed_values(spark, sf):
    line = v.table(spark, sf, "lineitem")
    whole = types.typed_value(F.lit("xs:int"), F.col("l_quantity").cast("bigint").cast("string"))
    real = types.typed_value(F.lit("xs:double"), F.col("l_extendedprice").cast("string"))
    flag = types.typed_value(F.lit("xs:boolean"), F.when(F.col("l_linestatus") == "O", "1").otherwise("false"))
    text = types.typed_value(F.lit("xs:string"), F.col("l_returnflag"))
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        whole["value_num"].cast("bigint").alias("as_int"),
        real["value_num"].alias("as_double"),
        flag["value_bool"].alias("as_bool"),
        text["value_json"].alias("as_text"),
    )


