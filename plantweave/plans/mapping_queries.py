"""Topic text, hierarchy mapping and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantweave.functions import text
from plantweave.operators import mapping
from plantweave.plans import views as v
from plantweave.plans.registry import query


@query("sanitize_segment", f"WITH {v.SEGMENTS} SELECT origin, id, {v.sql_segment('segment')} AS clean FROM segments")
def sanitize_segment(spark, sf):
    return v.segments(spark, sf).select("origin", "id", text.sanitize_segment(F.col("segment")).alias("clean"))


@query("sanitize_topic", f"WITH {v.SEGMENTS} SELECT origin, id, {v.sql_topic('segment')} AS topic FROM segments")
def sanitize_topic(spark, sf):
    return v.segments(spark, sf).select("origin", "id", text.sanitize_topic(F.col("segment")).alias("topic"))


@query(
    "metric_path_to_topic",
    f"""WITH s AS (SELECT p_partkey, replace(p_name, ' ', '.') || '[' || p_size || '].' || p_type || '[0][' || p_partkey || ']' AS path FROM part)
    SELECT p_partkey, {v.sql_metric_path('path')} AS topic_path FROM s""",
)
def metric_path_to_topic(spark, sf):
    path = F.concat(
        F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("["), F.col("p_size"), F.lit("]."),
        F.col("p_type"), F.lit("[0]["), F.col("p_partkey"), F.lit("]"),
    )
    return v.table(spark, sf, "part").select("p_partkey", text.sanitize_metric_path(path).alias("topic_path"))


@query(
    "topic_path_to_api_path",
    """WITH s AS (SELECT p_partkey, replace(p_name, ' ', '/') || '/a' || p_size || 'a/' || p_size || '/a0a/idx_1/a' || p_type || 'a' AS path FROM part)
    SELECT p_partkey, regexp_replace(array_to_string([CASE WHEN regexp_full_match(s, 'a[0-9]+a')
      THEN '[' || replace(s, 'a', '') || ']' ELSE '.' || s END FOR s IN string_split(path, '/')], ''), '^\\.', '') AS api_path FROM s""",
)
def topic_path_to_api_path(spark, sf):
    path = F.concat(
        F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("/a"), F.col("p_size"), F.lit("a/"), F.col("p_size"),
        F.lit("/a0a/idx_1/a"), F.col("p_type"), F.lit("a"),
    )
    return v.table(spark, sf, "part").select("p_partkey", text.topic_path_to_api_path(path).alias("api_path"))


@query("asset_identities", f"WITH {v.METRICS}, {v.IDENTITIES} SELECT asset_id, enterprise, site, area, line, asset, prefix FROM prefixes")
def asset_identities(spark, sf):
    ids = mapping.resolve_identities(v.metrics(spark, sf), v.rules(spark))
    return ids.withColumn("prefix", mapping.topic_prefix())


@query(
    "glob_match",
    """WITH u AS (SELECT page_id, url FROM pages), g AS (SELECT * FROM (VALUES
      ('https://*', 'https://.*'), ('*[0-4]', '.*[0-4]'), ('*[!0-4]', '.*[^0-4]'), ('http?://*/*', 'http.://.*/.*')) t(pattern, re))
    SELECT page_id, pattern FROM u JOIN g ON regexp_full_match(url, re)""",
)
def glob_match(spark, sf):
    globs = ["https://*", "*[0-4]", "*[!0-4]", "http?://*/*"]
    hits = F.array_compact(
        F.array(*[F.when(F.col("url").rlike(text.glob_to_regex(g)), F.lit(g)) for g in globs])
    )
    return v.table(spark, sf, "pages").select("page_id", F.explode(hits).alias("pattern"))


@query("topics", f"WITH {v.TOPICS} SELECT DISTINCT asset_id, path, topic, device_id FROM topics")
def topics(spark, sf):
    # Topics depend on the asset and the path only: reduce first, map what is left.
    pairs = v.metrics(spark, sf).select("asset_id", "submodel", "path").distinct()
    return mapping.with_topics(pairs, v.rules(spark)).select("asset_id", "path", "topic", "device_id")


@query(
    "topics_last_wins",
    f"""WITH {v.TOPICS} SELECT asset_id, topic, arg_max(path, elem_order) AS path, arg_max(value_json, elem_order) AS value_json
    FROM topics GROUP BY asset_id, submodel, topic""",
)
def topics_last_wins(spark, sf):
    last = mapping.last_metric_per_topic(
        v.topics(spark, sf).select("asset_id", "submodel", "topic", "elem_order", "path", "value_json")
    )
    return last.select("asset_id", "topic", "path", "value_json")


@query(
    "topic_collisions",
    """WITH s AS (SELECT DISTINCT 'x' AS asset_id, p_brand AS submodel, p_name || CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE ' ' END AS path FROM part),
    t AS (SELECT submodel, path, replace(rtrim(path, '/ '), ' ', '_') AS topic FROM s)
    SELECT submodel, topic, count(DISTINCT path) AS paths FROM t GROUP BY ALL HAVING count(DISTINCT path) > 1""",
)
def topic_collisions(spark, sf):
    tail = F.when(F.col("p_partkey") % 2 == 0, "/").otherwise(" ")
    rows = v.table(spark, sf, "part").select(
        F.lit("x").alias("asset_id"), F.col("p_brand").alias("submodel"), F.concat("p_name", tail).alias("path")
    )
    named = rows.withColumn("topic", text.sanitize_segment(F.col("path")))
    return mapping.topic_collisions(named).select("submodel", "topic", "paths")


@query(
    "device_topics",
    f"""WITH {v.MESSAGES} SELECT DISTINCT concat_ws('/', 'spBv1.0', 'plant', kind, node, device_id) AS topic FROM log""",
)
def device_topics(spark, sf):
    topic = mapping.device_topic("plant", F.col("kind"), F.col("node"), F.col("device_id"))
    return v.message_log(spark, sf).select(topic.alias("topic")).distinct()


_BARE = "replace(replace(url, 'https://', ''), 'http://', '')"


@query(
    "alert_topics",
    f"""SELECT page_id, 'UNS/Sys/DriftAlerts/' || {v.sql_segment(_BARE, 128)} AS drift,
      'UNS/Sys/Lifecycle/' || {v.sql_segment(_BARE, 128)} AS lifecycle,
      'UNS/Sys/FidelityAlerts/' || {v.sql_segment(f"replace({_BARE}, ':', '_')")} AS fidelity FROM pages""",
)
def alert_topics(spark, sf):
    url = F.col("url")
    return v.table(spark, sf, "pages").select(
        "page_id",
        mapping.alert_topic("UNS/Sys/DriftAlerts", url).alias("drift"),
        mapping.alert_topic("UNS/Sys/Lifecycle", url).alias("lifecycle"),
        mapping.alert_topic("UNS/Sys/FidelityAlerts", url, 64, colons=True).alias("fidelity"),
    )


@query(
    "topic_filters",
    f"""WITH {v.TOPICS}, t AS (SELECT DISTINCT topic FROM topics), f AS (SELECT * FROM (VALUES
      ('Acme/#', 'Acme(/.*)?'), ('+/+/+/context/#', '[^/]*/[^/]*/[^/]*/context(/.*)?'), ('#', '.*'),
      ('Gamma/A_1/+/context/Events/click/value', 'Gamma/A_1/[^/]*/context/Events/click/value')) f(filter, re))
    SELECT topic, filter FROM t JOIN f ON regexp_full_match(topic, re)""",
)
def topic_filters(spark, sf):
    distinct = topics(spark, sf).select("topic").distinct()
    filters = ["Acme/#", "+/+/+/context/#", "#", "Gamma/A_1/+/context/Events/click/value"]
    return mapping.match_topic_filters(distinct, filters)
