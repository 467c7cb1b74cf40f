"""Asset views over the driver tables: metrics, documents, activity, commands, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantweave.functions.json import json_object, quoted
from plantweave.operators import mapping
from plantweave.sources.rules import MappingRules, constraint_rules, mapping_rules

ASSET = "https://example.com/aas/user-"
AS_OF_MS = 1_706_745_600_000  # 2024-02-01T00:00:00Z, after the last event
HOUR_MS = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds of a time without zone, whatever the session's zone is."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    millis = F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("bigint")
    return seconds * 1000 + millis


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with epoch ms and the integer ``k`` of the props."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        epoch_ms(F.col("ts")).alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def metrics_of(rows: DataFrame) -> DataFrame:
    """Metric rows of event rows; works on batch and streaming frames."""
    kind, k, value = F.col("event_type"), F.col("k"), F.col("value")
    value_type = (
        F.when(k % 7 == 0, "xs:int")
        .when(k % 11 == 0, "xs:string")
        .when(k % 13 == 0, "xs:boolean")
        .otherwise("xs:double")
    )
    flag = k % 2 == 0
    text = (
        F.when(k % 7 == 0, F.floor(value).cast("string"))
        .when(k % 11 == 0, F.concat(F.lit("S-"), k.cast("string")))
        .when(k % 13 == 0, flag.cast("string"))
        .otherwise(value.cast("string"))
    )
    number = (
        F.when(k % 7 == 0, F.floor(value).cast("double"))
        .when(k % 11 == 0, None)
        .when(k % 13 == 0, flag.cast("double"))
        .otherwise(value)
    )
    semantic_id = (
        F.when(kind == "click", "0173-1#02-AAO677#002")
        .when((kind == "view") & (k % 17 != 0), "0112/2///61360_4#AAA001")
        .when(kind == "signup", "https://admin-shell.io/zvei/signup")
        .when(kind == "purchase", "https://eclass.example.org/price")
    )
    keys = (
        F.when(semantic_id.isNull(), F.array().cast("array<string>"))
        .when(kind == "purchase", F.array(semantic_id, F.lit("0173-1#02-AAO677#002")))
        .otherwise(F.array(semantic_id))
    )
    unit = (
        F.when((kind == "purchase") & (k % 5 == 0), "USD")
        .when(kind == "purchase", "EUR")
        .when(kind == "click", "1")
    )
    is_text = (k % 7 != 0) & (k % 11 == 0)
    return rows.select(
        F.concat(F.lit(ASSET), F.col("user_id")).alias("asset_id"),
        F.lit("Events").alias("submodel"),
        F.concat(F.lit("Events."), kind, F.lit(".value")).alias("path"),
        text.alias("value"),
        number.alias("value_num"),
        F.when((k % 7 != 0) & (k % 11 != 0) & (k % 13 == 0), flag).alias("value_bool"),
        F.when(is_text, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text).alias("value_json"),
        F.lit("Property").alias("aas_type"),
        value_type.alias("value_type"),
        semantic_id.alias("semantic_id"),
        keys.alias("semantic_keys"),
        unit.alias("unit"),
        F.lit("events.parquet").alias("aas_source"),
        F.col("ts").alias("timestamp_ms"),
        F.when(F.col("user_id") % 3 != 0, "https://admin-shell.io/idta/Events/1/0").alias(
            "submodel_semantic_id"
        ),
        F.lpad(F.col("event_id").cast("string"), 20, "0").alias("elem_order"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_of(events(spark, sf_dir))


METRICS = """ev AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
m0 AS (SELECT *, CASE WHEN event_type = 'click' THEN '0173-1#02-AAO677#002'
         WHEN event_type = 'view' AND k % 17 <> 0 THEN '0112/2///61360_4#AAA001'
         WHEN event_type = 'signup' THEN 'https://admin-shell.io/zvei/signup'
         WHEN event_type = 'purchase' THEN 'https://eclass.example.org/price' END AS semantic_id,
       CASE WHEN k % 7 = 0 THEN 'xs:int' WHEN k % 11 = 0 THEN 'xs:string'
         WHEN k % 13 = 0 THEN 'xs:boolean' ELSE 'xs:double' END AS value_type FROM ev),
metrics AS (
  SELECT 'https://example.com/aas/user-' || user_id AS asset_id, 'Events' AS submodel,
    'Events.' || event_type || '.value' AS path,
    CASE value_type WHEN 'xs:int' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
      WHEN 'xs:string' THEN 'S-' || k WHEN 'xs:boolean' THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
      ELSE CAST(value AS VARCHAR) END AS value,
    CASE value_type WHEN 'xs:int' THEN floor(value) WHEN 'xs:string' THEN NULL
      WHEN 'xs:boolean' THEN CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END ELSE value END AS value_num,
    CASE value_type WHEN 'xs:int' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)
      WHEN 'xs:string' THEN '"S-' || k || '"' WHEN 'xs:boolean' THEN CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
      ELSE CAST(value AS VARCHAR) END AS value_json,
    'Property' AS aas_type, value_type, semantic_id,
    CASE WHEN semantic_id IS NULL THEN CAST([] AS VARCHAR[])
      WHEN event_type = 'purchase' THEN [semantic_id, '0173-1#02-AAO677#002'] ELSE [semantic_id] END AS semantic_keys,
    CASE WHEN event_type = 'purchase' AND k % 5 = 0 THEN 'USD' WHEN event_type = 'purchase' THEN 'EUR'
      WHEN event_type = 'click' THEN '1' END AS unit,
    'events.parquet' AS aas_source, ts AS timestamp_ms,
    CASE WHEN user_id % 3 <> 0 THEN 'https://admin-shell.io/idta/Events/1/0' END AS submodel_semantic_id,
    lpad(CAST(event_id AS VARCHAR), 20, '0') AS elem_order, event_id, user_id, event_type, k
  FROM m0)"""

# Mapping rules of the views: three exact assets, two overlapping patterns, a default.
MAPPING = {
    "default": {"enterprise": "Acme Corp", "site": "Plant 1"},
    "assets": {
        ASSET + "1": {"enterprise": "Acme", "site": "Berlin", "area": "Hall A", "line": "Line+1", "asset": "Robot #1"},
        ASSET + "2": {"enterprise": "Acme", "site": "Berlin", "area": "Hall A", "line": "Line/2"},
        ASSET + "13": {"enterprise": "Acme", "asset": "Press"},
    },
    "patterns": [
        {"pattern": "*/user-1?", "enterprise": "Beta", "site": "Paris", "line": "L1"},
        {"pattern": "https://*/user-1*", "enterprise": "Gamma", "area": "A 1"},
    ],
}


def rules(spark: SparkSession) -> MappingRules:
    return mapping_rules(spark, MAPPING)


def sql_segment(expr: str, n: int = 64) -> str:
    """SQL for one clean topic segment."""
    ws = (
        r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
        r"\x{202f}\x{205f}\x{3000}]+"
    )
    c = (
        f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize({expr}), "
        f"'{ws}', '_', 'g'), '[+#/\\x00]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
    )
    cut = f"CASE WHEN length({c}) > {n} THEN regexp_replace(left({c}, {n}), '_[^_]*$', '') ELSE {c} END"
    return f"coalesce(nullif({cut}, ''), 'unnamed')"


def sql_topic(expr: str) -> str:
    parts = f"[{sql_segment('s')} FOR s IN string_split({expr}, '/') IF s <> '']"
    return f"coalesce(nullif(array_to_string({parts}, '/'), ''), 'unnamed')"


def sql_metric_path(expr: str) -> str:
    replaced = f"regexp_replace(replace({expr}, '.', '/'), '\\[(\\d+)\\]', '/a\\1a', 'g')"
    return sql_topic(replaced)


_LEVEL = {
    level: "CASE asset_id "
    + " ".join(f"WHEN '{a}' THEN '{r.get(level, '')}'" for a, r in MAPPING["assets"].items())
    + " ELSE CASE WHEN regexp_full_match(asset_id, '.*/user-1.') THEN '"
    + MAPPING["patterns"][0].get(level, "")
    + "' WHEN regexp_full_match(asset_id, 'https://.*/user-1.*') THEN '"
    + MAPPING["patterns"][1].get(level, "")
    + f"' ELSE '{MAPPING['default'].get(level, '')}' END END"
    for level in mapping.LEVELS
}
IDENTITIES = f"""ids AS (SELECT DISTINCT asset_id FROM metrics),
raw_levels AS (SELECT asset_id, {', '.join(f'{e} AS {k}' for k, e in _LEVEL.items())} FROM ids),
identities AS (
  SELECT asset_id, {sql_segment('enterprise')} AS enterprise,
    CASE WHEN site = '' THEN '' ELSE {sql_segment('site')} END AS site,
    CASE WHEN area = '' THEN '' ELSE {sql_segment('area')} END AS area,
    CASE WHEN line = '' THEN '' ELSE {sql_segment('line')} END AS line,
    {sql_segment("CASE WHEN asset = '' THEN regexp_extract(regexp_extract(asset_id, '[^/]*$'), '[^#]*$') ELSE asset END")} AS asset
  FROM raw_levels),
prefixes AS (
  SELECT *, concat_ws('/', nullif(enterprise, ''), nullif(site, ''), nullif(area, ''), nullif(line, ''),
    nullif(asset, '')) AS prefix FROM identities)"""

TOPICS = f"""{METRICS}, {IDENTITIES},
paths AS (SELECT path, {sql_metric_path("substr(path, 8)")} AS topic_path FROM (SELECT DISTINCT path FROM metrics)),
topics AS (
  SELECT m.*, p.prefix || '/context/Events/' || paths.topic_path AS topic,
    coalesce(nullif(p.asset, ''), m.submodel) AS device_id
  FROM metrics m JOIN prefixes p USING (asset_id) JOIN paths USING (path))"""


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.with_topics(metrics(spark, sf_dir), rules(spark))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of several tables as candidate topic segments."""
    parts = [
        ("documents", F.col("doc_id"), F.col("text")),
        ("pages", F.col("page_id"), F.col("url")),
        ("part", F.col("p_partkey"), F.col("p_name")),
        ("customer", F.col("c_custkey"), F.col("c_name")),
    ]
    out = None
    for name, key, text in parts:
        rows = table(spark, sf_dir, name).select(
            F.lit(name).alias("origin"), key.alias("id"), text.alias("segment")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


SEGMENTS = """segments AS (
  SELECT 'documents' AS origin, doc_id AS id, text AS segment FROM documents
  UNION ALL SELECT 'pages', page_id, url FROM pages
  UNION ALL SELECT 'part', p_partkey, p_name FROM part
  UNION ALL SELECT 'customer', c_custkey, c_name FROM customer)"""

CONSTRAINTS = {
    "0173-1#02-AAO677#002": {"min": 5, "max": 150, "unit": "1", "pattern": "S-[1-6]"},
    "0112/2///61360_4#AAA001": {"min": 10.5, "max": 100.25},
    "https://admin-shell.io/zvei/signup": {"pattern": "S-[0-9]$"},
    "https://eclass.example.org/price": {"max": 120, "unit": "EUR", "pattern": "("},
}


def constraints(spark: SparkSession) -> DataFrame:
    return constraint_rules(spark, CONSTRAINTS)


CONSTRAINTS_SQL = """constraints AS (SELECT * FROM (VALUES
  ('0173-1#02-AAO677#002', 5.0::DOUBLE, 150.0::DOUBLE, '1', 'S-[1-6]'),
  ('0112/2///61360_4#AAA001', 10.5, 100.25, NULL, NULL),
  ('https://admin-shell.io/zvei/signup', NULL, NULL, NULL, 'S-[0-9]$'),
  ('https://eclass.example.org/price', NULL, 120.0, 'EUR', NULL))
  t(semantic_id, min_value, max_value, unit_expected, pattern))"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data and death rows per asset: an error event is a death."""
    return events(spark, sf_dir).select(
        F.concat(F.lit(ASSET), F.col("user_id")).alias("asset_id"),
        "ts",
        F.when(F.col("event_type") == "error", "death").otherwise("data").alias("kind"),
        F.col("event_id").alias("seq"),
    )


ACTIVITY = """activity AS (
  SELECT 'https://example.com/aas/user-' || user_id AS asset_id, epoch_us(ts) // 1000 AS ts,
    CASE WHEN event_type = 'error' THEN 'death' ELSE 'data' END AS kind, event_id AS seq FROM events)"""


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of three edge nodes: a rare view starts a node session."""
    kind, k = F.col("event_type"), F.col("k")
    message = (
        F.when((kind == "view") & (k % 10 == 0), "NBIRTH")
        .when(kind == "view", "DBIRTH")
        .when(kind == "error", "DDEATH")
        .otherwise("DDATA")
    )
    return events(spark, sf_dir).select(
        F.concat(F.lit("node-"), F.col("user_id") % 3).alias("node"),
        F.when(message != "NBIRTH", F.concat(F.lit("dev-"), F.col("user_id"))).alias("device_id"),
        message.alias("kind"),
        "ts",
        F.col("event_id").alias("seq_order"),
        k.alias("k"),
    )


MESSAGES = """log AS (
  SELECT 'node-' || (user_id % 3) AS node,
    CASE WHEN kind <> 'NBIRTH' THEN 'dev-' || user_id END AS device_id, kind, ts, seq_order, k
  FROM (SELECT user_id, epoch_us(ts) // 1000 AS ts, event_id AS seq_order,
      CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
      CASE WHEN event_type = 'view' AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 = 0 THEN 'NBIRTH'
        WHEN event_type = 'view' THEN 'DBIRTH' WHEN event_type = 'error' THEN 'DDEATH' ELSE 'DDATA' END AS kind
    FROM events)),
numbered AS (
  SELECT *, sum(CASE WHEN kind = 'NBIRTH' THEN 1 ELSE 0 END)
      OVER (PARTITION BY node ORDER BY ts, seq_order) - 1 AS bd_seq FROM log),
messages AS (
  SELECT node, device_id, kind, ts, seq_order, k, CAST(bd_seq AS BIGINT) AS bd_seq,
    CAST((row_number() OVER (PARTITION BY node, bd_seq ORDER BY ts, seq_order) - 1) % 256 AS INTEGER) AS seq
  FROM numbered WHERE bd_seq >= 0)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command messages of events; some malformed, some answers, some not commands."""
    e = events(spark, sf_dir)
    area = (
        F.when(F.col("k") % 3 == 0, "Setpoints")
        .when(F.col("k") % 3 == 1, "Identification")
        .otherwise("readonly")
    )
    area = F.when(F.col("k") % 4 == 0, "Configuration").otherwise(area)
    root = F.when(F.col("event_id") % 19 == 0, "cmd/").when(
        F.col("event_id") % 23 == 0, F.lit("Acme/data/")
    ).otherwise(F.concat(F.lit("Acme/P"), F.col("user_id") % 5, F.lit("/cmd/")))
    tail = F.when(F.col("event_id") % 29 == 0, "").otherwise(
        F.concat(F.lit("/"), area, F.lit("/a"), F.col("k") % 3, F.lit("a/Value"))
    )
    answer = F.when(F.col("event_id") % 17 == 0, "/ack").otherwise("")
    body = (
        F.when(F.col("event_id") % 13 == 0, F.lit('{"value": '))
        .when(F.col("event_id") % 31 == 0, F.lit("[1, 2]"))
        .when(F.col("event_id") % 37 == 0, F.lit('{"val": 1}'))
        .when(F.col("event_id") % 41 == 0, F.lit('{"value": null}'))
        .otherwise(
            json_object(
                ("value", F.col("k")),
                ("correlationId", F.when(F.col("k") % 2 == 0, quoted(F.concat(F.lit("c-"), F.col("event_id"))))),
                ("requestor", F.when(F.col("k") % 5 == 0, quoted(F.concat(F.lit("user-"), F.col("user_id"))))),
            )
        )
    )
    return e.select(
        "event_id", "ts", F.concat(root, F.col("event_type"), tail, answer).alias("topic"), body.alias("payload")
    )


COMMANDS = """msgs AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts,
    CASE WHEN event_id % 19 = 0 THEN 'cmd/' WHEN event_id % 23 = 0 THEN 'Acme/data/'
      ELSE 'Acme/P' || (user_id % 5) || '/cmd/' END || event_type
    || CASE WHEN event_id % 29 = 0 THEN '' ELSE '/' || CASE WHEN k % 4 = 0 THEN 'Configuration' WHEN k % 3 = 0 THEN 'Setpoints'
        WHEN k % 3 = 1 THEN 'Identification' ELSE 'readonly' END || '/a' || (k % 3) || 'a/Value' END
    || CASE WHEN event_id % 17 = 0 THEN '/ack' ELSE '' END AS topic,
    CASE WHEN event_id % 13 = 0 THEN '{"value": ' WHEN event_id % 31 = 0 THEN '[1, 2]'
      WHEN event_id % 37 = 0 THEN '{"val": 1}' WHEN event_id % 41 = 0 THEN '{"value": null}'
      ELSE '{"value": ' || k || CASE WHEN k % 2 = 0 THEN ', "correlationId": "c-' || event_id || '"' ELSE '' END
        || CASE WHEN k % 5 = 0 THEN ', "requestor": "user-' || user_id || '"' ELSE '' END || '}' END AS payload
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
cmd0 AS (
  SELECT *, CASE WHEN instr(topic, '/cmd/') > 0 THEN substr(topic, instr(topic, '/cmd/') + 5)
      ELSE substr(topic, 5) END AS rest,
    CASE WHEN json_valid(payload) THEN payload END AS doc
  FROM msgs WHERE (contains(topic, '/cmd/') OR starts_with(topic, 'cmd/'))
    AND NOT ends_with(topic, '/ack') AND NOT ends_with(topic, '/nak')),
cmd1 AS (
  SELECT *, CASE WHEN instr(rest, '/') = 0 THEN 'invalid_path' WHEN doc IS NULL THEN 'invalid_json'
      WHEN json_type(doc) <> 'OBJECT' OR NOT list_contains(json_keys(doc), 'value') THEN 'missing_value' END AS bad
  FROM cmd0),
cmds AS (
  SELECT event_id, ts, topic, payload, split_part(rest, '/', 1) AS submodel_id,
    substr(rest, instr(rest, '/') + 1) AS property_path,
    coalesce(CAST(json_extract(doc, '$.value') AS VARCHAR), 'null') AS value_json,
    json_extract_string(doc, '$.correlationId') AS correlation_id,
    json_extract_string(doc, '$.requestor') AS requestor
  FROM cmd1 WHERE bad IS NULL),
auth AS (
  SELECT *, submodel_id || '/' || property_path AS full_path FROM cmds),
authd AS (
  SELECT *, CASE WHEN regexp_full_match(full_path, '.*/Identification/.*') THEN
        'Path ''' || full_path || ''' matches denied pattern ''*/Identification/*'''
      WHEN regexp_full_match(full_path, '.*/readonly/.*') THEN
        'Path ''' || full_path || ''' matches denied pattern ''*/readonly/*'''
      WHEN NOT (regexp_full_match(full_path, '.*/Setpoints/.*') OR regexp_full_match(full_path, '.*/Configuration/.*'))
        THEN 'Path ''' || full_path || ''' not in allowed patterns' END AS error FROM auth),
fin AS (
  SELECT *, CASE WHEN error IS NOT NULL THEN 'denied' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'success' END AS result,
    coalesce(error, CASE WHEN event_id % 7 = 0 THEN 'repository refused the write' END) AS reason FROM authd)"""


def command_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the external writer answered."""
    failure = F.when(F.col("event_id") % 7 == 0, "repository refused the write")
    return table(spark, sf_dir, "events").select("event_id", failure.alias("failure"))


def part_quantities(lineitem: DataFrame) -> DataFrame:
    """Quantity range of each part and all its quantities in line order."""
    lines = F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))
    return lineitem.groupBy("l_partkey").agg(
        F.min("l_quantity").alias("qmin"), F.max("l_quantity").alias("qmax"), F.sort_array(lines).alias("lines")
    )


def _documents_sql() -> str:
    """SQL expression for the document of a part row."""

    def text(expr: str) -> str:
        return f"btrim(to_json(array({expr})), '[]')"

    def obj(*fields: tuple[str, str]) -> str:
        entries = ", ".join(f"'\"{key}\": ' || {value}" for key, value in fields)
        return f"concat('{{', concat_ws(', ', {entries}), '}}')"

    def arr(*items: str) -> str:
        return f"concat('[', concat_ws(',', {', '.join(items)}), ']')"

    def word(value: str) -> str:
        return f"'\"{value}\"'"

    def element(kind: str, name: str | None, *fields: tuple[str, str]) -> str:
        named = [("idShort", word(name))] if name else []
        return obj(("modelType", word(kind)), *named, *fields)

    def prop(name: str | None, value_type: str, value: str, *more: tuple[str, str]) -> str:
        return element("Property", name, ("valueType", word(value_type)), ("value", value), *more)

    def ref(*values: str) -> str:
        keys = [obj(("type", word("GlobalReference")), ("value", v)) for v in values]
        return obj(("type", word("ExternalReference")), ("keys", arr(*keys)))

    def number(expr: str) -> str:
        return f"'\"' || cast({expr} as string) || '\"'"

    def when(condition: str, value: str) -> str:
        return f"case when {condition} then {value} end"

    key = "cast(p_partkey as string)"
    brand = text("p_brand")
    titles = arr(
        obj(("language", word("de")), ("text", f"'\"Teil ' || {key} || '\"'")),
        when("p_partkey % 2 = 0", obj(("language", word("en")), ("text", f"'\"Part ' || {key} || '\"'"))),
    )
    inner = arr(
        prop("Large", "xs:boolean", "'\"' || cast(p_size > 25 as string) || '\"'"),
        element("File", "Sheet", ("value", word("/sheet.pdf"))),
    )
    dimensions = arr(
        prop("Size", "xs:integer", "cast(p_size as string)"),
        element("Range", "Quantity", ("valueType", word("xs:double")), ("min", number("qmin")),
                ("max", when("p_partkey % 3 <> 0", number("qmax")))),
        element("SubmodelElementCollection", None, ("value", inner)),
        element("SubmodelElementCollection", "Empty", ("value", "'[]'")),
    )
    line = prop(None, "xs:double", number("x.l_quantity"))
    lines = f"coalesce(concat('[', array_join(transform(lines, x -> {line}), ','), ']'), '[]')"
    unit = obj(("dataSpecificationContent", obj(("unit", word("EUR")))))
    elements = arr(
        prop("Name", "xs:string", text("p_name"), ("semanticId", ref(word("0173-1#02-AAO677#002"), brand))),
        prop("Price", "xs:double", number("p_retailprice"), ("embeddedDataSpecifications", arr(unit))),
        element("MultiLanguageProperty", "Title", ("value", titles)),
        element("SubmodelElementCollection", "Dimensions", ("value", dimensions)),
        element("SubmodelElementList", "Quantities", ("value", lines)),
        element("ReferenceElement", "Brand", ("value", ref(word("urn:brand"), brand))),
        element("Entity", "Maker", ("entityType", word("SelfManagedEntity")),
                ("globalAssetId", when("p_partkey % 2 = 0", f"'\"urn:maker:' || {key} || '\"'")),
                ("statements", arr(prop("Type", "xs:string", text("p_type"))))),
        element("RelationshipElement", "MadeBy", ("first", ref(f"'\"' || {key} || '\"'")),
                ("second", when("p_partkey % 2 = 1", ref(brand)))),
        element("Blob", "Image", ("value", word("AAAA"))),
        element("Capability", "Grip"),
    )
    submodel_id = f"'\"urn:sm:' || {key} || '\"'"
    submodel = obj(
        ("modelType", word("Submodel")), ("idShort", word("TechnicalData")), ("id", submodel_id),
        ("semanticId", ref(word("https://admin-shell.io/idta/TechnicalData/1/2"))),
        ("submodelElements", elements),
    )

    def shell(suffix: str) -> str:
        asset = f"'\"https://example.com/aas/part-' || {key} || '{suffix}\"'"
        reference = obj(("type", word("ModelReference")),
                        ("keys", arr(obj(("type", word("Submodel")), ("value", submodel_id)))))
        return obj(
            ("modelType", word("AssetAdministrationShell")), ("id", f"'\"urn:shell:' || {key} || '\"'"),
            ("assetInformation", obj(("assetKind", word("Instance")), ("globalAssetId", asset))),
            ("submodels", arr(reference)),
        )

    shells = arr(when("p_partkey % 7 = 0", shell("-old")), when("p_partkey % 11 <> 0", shell("")))
    doc = obj(("assetAdministrationShells", shells), ("submodels", arr(submodel)))
    # Broken documents: one in 97 with a stray brace, one in 89 a bare string.
    return f"""concat(case when p_partkey % 89 = 0 then '"text"' else {doc} end,
      case when p_partkey % 97 = 0 then '{{' else '' end)"""


def documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One asset document per part, nested up to four levels; some are broken."""
    # Documents are much larger than the part rows they come from: spread the rows first.
    part = table(spark, sf_dir, "part").repartition(
        spark.sparkContext.defaultParallelism, "p_partkey"
    )
    lines = part_quantities(table(spark, sf_dir, "lineitem"))
    joined = part.join(lines, part.p_partkey == lines.l_partkey, "left")
    return joined.select(
        F.expr("concat('part-', p_partkey, '.json')").alias("source"),
        (F.lit(1_704_067_200_000) + F.col("p_partkey")).alias("event_ts"),
        F.expr(_documents_sql()).alias("content"),
    )
