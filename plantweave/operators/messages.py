"""Device messages as rows: aliases, births, data, deaths, sessions and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantweave.functions import types
from plantweave.functions.json import json_object, or_null, quoted, string_list
from plantweave.operators.ordered import (
    first_rows,
    lag_in_order,
    latest_per_key,
    number_globally,
    number_in_order,
    running_before,
)


def alias_key() -> Column:
    return F.concat(F.col("device_id"), F.lit("/"), F.col("path"))


def assign_aliases(metrics: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Alias rows for keys without one, numbered in first-seen order after the highest.

    The order (first time, key) is fixed, so a repeated run gives the same numbers.
    """
    new = (
        metrics.groupBy("device_id", "path")
        .agg(F.min("timestamp_ms").alias("first_ms"), F.max("timestamp_ms").alias("last_accessed"))
        .withColumn("metric_path", alias_key())
    )
    base = F.lit(1).cast("bigint")
    if aliases is not None:
        new = new.join(aliases.select("metric_path"), "metric_path", "left_anti")
        base = F.coalesce(aliases.select(F.max("alias") + 1).scalar(), base)
    numbered = number_globally(new, ["first_ms", "metric_path"], "_n")
    return numbered.select(
        "device_id", "path", "metric_path", (F.col("_n") + base).alias("alias"), "first_ms", "last_accessed"
    )


def touch_aliases(aliases: DataFrame, accesses: DataFrame) -> DataFrame:
    """Move ``last_accessed`` to the latest access of each key."""
    seen = accesses.groupBy("metric_path").agg(F.max("timestamp_ms").alias("_seen"))
    return (
        aliases.join(seen, "metric_path", "left")
        .withColumn("last_accessed", F.greatest("last_accessed", "_seen"))
        .select(*aliases.columns)
    )


def evict_aliases(aliases: DataFrame, max_entries: int) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted): at the cap the least recently used tenth of the cap goes."""
    full = aliases.count() >= max_entries
    oldest = first_rows(aliases, "last_accessed", ["alias"], max(1, max_entries // 10) if full else 0)
    return aliases.join(oldest.select("metric_path"), "metric_path", "left_anti"), oldest


def device_aliases(aliases: DataFrame, devices: DataFrame) -> DataFrame:
    return aliases.join(devices, "device_id", "left_semi")


def paths_of_aliases(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Metric path for each ``alias``; NULL when unknown."""
    return rows.join(aliases.select("alias", "metric_path"), "alias", "left")


def clear_device(aliases: DataFrame, devices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, number cleared)."""
    gone = aliases.join(devices, "device_id", "left_semi")
    return aliases.join(devices, "device_id", "left_anti"), gone.agg(
        F.count(F.lit(1)).alias("cleared")
    )


def typed_slot(value_type: Column, value: Column, value_json: Column) -> Column:
    """The value in the slot of its type code, all other slots NULL."""
    code = types.xsd_code(value_type)
    is_null = value_json.isNull() | (value_json == "null")
    number = F.when(value_json == "true", "1").when(value_json == "false", "0").otherwise(value)
    whole = F.bround(number.try_cast("double") - F.lit(0.0), 0)
    integral = F.coalesce(number.try_cast("decimal(38,0)"), whole.try_cast("decimal(38,0)"))

    def slot(condition: Column, content: Column) -> Column:
        return F.when(~is_null & condition, content)

    other = ~code.isin(*types.INT_CODES, *types.LONG_CODES, 9, 10, 11, 17)
    truthy = F.when(value_json.isin("true", "false"), value_json == "true").otherwise(
        ~value_json.isin("0", "0.0", '""')
    )
    return F.struct(
        code.alias("datatype"),
        is_null.alias("is_null"),
        slot(code.isin(types.INT_CODES), integral.try_cast("bigint")).alias("int_value"),
        slot(code.isin(types.LONG_CODES), integral).alias("long_value"),
        slot(code == 9, number.try_cast("float")).alias("float_value"),
        slot(code == 10, number.try_cast("double")).alias("double_value"),
        slot(code == 11, truthy).alias("boolean_value"),
        slot(other, value).alias("string_value"),
        slot(code == 17, value.cast("binary")).alias("bytes_value"),
    )


def property_set(props: Column) -> Column:
    """Property map as (key, type, value) structs; a NULL value has type 0."""
    return F.transform(
        F.map_entries(props),
        lambda e: F.struct(
            e["key"].alias("key"),
            F.when(e["value"].isNull(), 0)
            .when(F.lower(e["value"]).isin("true", "false"), 11)
            .when(e["value"].rlike(r"^-?[0-9]{1,18}$"), 4)
            .when(e["value"].rlike(r"^-?[0-9]+\.[0-9]+$"), 10)
            .otherwise(types.STRING_CODE)
            .alias("type"),
            e["value"].alias("value"),
        ),
    )


def override_properties(props: Column, extra: Column) -> Column:
    """Both maps in one; the extra map wins."""
    kept = F.map_filter(props, lambda k, _: ~F.array_contains(F.map_keys(extra), k))
    return F.map_concat(kept, extra)


def route(metrics: DataFrame, births: DataFrame) -> DataFrame:
    """Message kind per metric row: all rows for a birth, changed rows for data.

    ``metrics`` has a ``changed`` flag; ``births`` the ``device_id`` already born.
    """
    born = births.select("device_id").distinct().withColumn("_born", F.lit(True))
    routed = metrics.join(born, "device_id", "left").withColumn(
        "kind", F.when(F.col("_born").isNull(), "DBIRTH").when(F.col("changed"), "DDATA")
    )
    return routed.filter("kind IS NOT NULL").drop("_born")


def birth_metric() -> Column:
    """JSON of one metric in a birth."""
    text = lambda c: or_null(quoted(F.col(c)))
    return json_object(
        ("name", text("path")),
        ("value", F.col("value_json")),
        ("value_type", text("value_type")),
        ("timestamp_ms", F.col("timestamp_ms")),
        ("alias", F.col("alias")),
        ("semantic_id", text("semantic_id")),
        ("unit", text("unit")),
        ("aas_source", text("aas_source")),
        ("aas_type", text("aas_type")),
        ("submodel_semantic_id", text("submodel_semantic_id")),
        ("semantic_keys", or_null(string_list(F.col("semantic_keys")))),
    )


def data_metric() -> Column:
    """JSON of one metric in a data message: alias only."""
    return json_object(
        ("name", quoted(F.lit(""))),
        ("value", F.col("value_json")),
        ("value_type", or_null(quoted(F.col("value_type")))),
        ("timestamp_ms", F.col("timestamp_ms")),
        ("alias", F.col("alias")),
    )


def bodies(metrics: DataFrame, keys: list[str], metric: Column, part_size: int) -> DataFrame:
    """Metric lists per message, ordered by alias, at most ``part_size`` per part; the caller names the size.

    A message larger than that becomes several parts, so no list grows without bound
    and no metric is lost.
    """
    rows = metrics.select(*keys, "alias", metric.alias("_metric"))
    placed = number_in_order(rows, keys, ["alias"], "alias", "_n", width_ms=part_size)
    part = F.floor(F.col("_n") / part_size).cast("int").alias("part")
    listed = F.sort_array(F.collect_list(F.struct("alias", "_metric")))
    return (
        placed.groupBy(*keys, part)
        .agg(listed.alias("_all"))
        .select(
            *keys,
            "part",
            F.size("_all").alias("metric_count"),
            F.concat(F.lit("["), F.array_join(F.col("_all._metric"), ", "), F.lit("]")).alias("metrics"),
        )
    )


def message_payload(ts: Column, seq: Column, metrics: Column) -> Column:
    return json_object(("timestamp", ts), ("seq", seq), ("metrics", metrics))


def node_birth_metrics(bd_seq: Column, ts: Column) -> Column:
    """Metric list of a node birth: session number and the rebirth control."""
    session = json_object(
        ("name", quoted(F.lit("bdSeq"))), ("value", bd_seq),
        ("value_type", quoted(F.lit("xs:long"))), ("timestamp_ms", ts),
    )
    control = json_object(
        ("name", quoted(F.lit("Node Control/Rebirth"))), ("value", F.lit("false")),
        ("value_type", quoted(F.lit("xs:boolean"))), ("timestamp_ms", ts),
    )
    return F.concat(F.lit("["), session, F.lit(", "), control, F.lit("]"))


def node_death_metrics(bd_seq: Column) -> Column:
    body = json_object(("name", quoted(F.lit("bdSeq"))), ("value", bd_seq), ("datatype", F.lit(4)))
    return F.concat(F.lit("["), body, F.lit("]"))


def active_devices(messages: DataFrame) -> DataFrame:
    """Devices whose latest message is not a death."""
    last = latest_per_key(
        messages.filter("device_id IS NOT NULL").select("node", "device_id", "kind", "ts", "seq_order"),
        ["node", "device_id"],
        ["ts", "seq_order"],
    )
    return last.filter("kind <> 'DDEATH'").select("node", "device_id")


def shutdown_deaths(messages: DataFrame) -> DataFrame:
    """A death row for every active device."""
    return active_devices(messages).select(
        "node", "device_id", F.lit("DDEATH").alias("kind"), F.lit("[]").alias("metrics")
    )


def _by_session(log: DataFrame) -> DataFrame:
    """The log with ``bd_seq``; -1 before the node's first birth."""
    start = (F.col("kind") == "NBIRTH").cast("int")
    counted = running_before(log, ["node"], ["ts", "seq_order"], "ts", {"_starts": ("sum", start)})
    return counted.select(*log.columns, (F.col("_starts") + start - 1).cast("bigint").alias("bd_seq"))


def sessions(log: DataFrame) -> DataFrame:
    """Add ``bd_seq`` and ``seq`` to a message log.

    ``log`` has node, kind, ts and a unique ``seq_order``. A node birth starts a
    session; the first is number 0. ``seq`` counts from 0 in each session and wraps
    at 256. Messages before a node's first birth have no session; :func:`early_messages`
    gives them.
    """
    numbered = _by_session(log).filter("bd_seq >= 0")
    placed = number_in_order(numbered, ["node", "bd_seq"], ["ts", "seq_order"], "ts", "_n")
    return placed.select(*log.columns, "bd_seq", (F.col("_n") % 256).cast("int").alias("seq"))


def early_messages(log: DataFrame) -> DataFrame:
    """The messages of a log that come before their node's first birth and cannot be sent."""
    return _by_session(log).filter("bd_seq < 0").drop("bd_seq")


def audit(messages: DataFrame, early: DataFrame) -> DataFrame:
    """Violations of the message rules, one row per rule and node with its count.

    ``messages`` are those of :func:`sessions`, ``early`` those of :func:`early_messages`.
    """
    order = ["ts", "seq_order"]
    seen = lag_in_order(messages, ["node"], order, "ts", {"p_seq": "seq", "p_bd": "bd_seq"})
    same = F.col("p_bd").eqNullSafe(F.col("bd_seq"))
    born = (
        messages.filter("kind = 'DBIRTH'")
        .groupBy("node", "bd_seq", "device_id")
        .agg(F.min(F.struct(*order)).alias("_born"))
    )
    joined = seen.join(born, ["node", "bd_seq", "device_id"], "left")
    unannounced = (F.col("kind") == "DDATA") & ~F.coalesce(
        F.col("_born") <= F.struct(*order), F.lit(False)
    )
    rules = {
        "qos": F.col("qos") != 0,
        "retain": F.col("retain"),
        "seq_step": same & (F.col("seq") != (F.col("p_seq") + 1) % 256),
        "seq_restart": ~same & (F.col("seq") != 0),
        "bd_seq_step": F.col("p_bd").isNotNull() & ~same & (F.col("bd_seq") != F.col("p_bd") + 1),
        "birth_before_data": unannounced,
    }
    counts = joined.groupBy("node").agg(*[F.count_if(c).alias(r) for r, c in rules.items()])
    unborn = early.groupBy("node").agg(F.count(F.lit(1)).alias("before_node_birth"))
    counts = counts.join(unborn, "node", "full_outer").fillna(0)
    names = [*rules, "before_node_birth"]
    pairs = [F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in names]
    return counts.select("node", F.inline(F.array(*pairs)))


def device_state(metrics: DataFrame) -> DataFrame:
    """Latest metric per device and path (merge); see :func:`replace_state`."""
    return latest_per_key(metrics, ["device_id", "path"], ["timestamp_ms", "elem_order"])


def replace_state(state: DataFrame, full: DataFrame) -> DataFrame:
    """State with every device of a full metric set replaced by that set."""
    devices = full.select("device_id").distinct()
    return state.join(devices, "device_id", "left_anti").unionByName(full.select(*state.columns))


def latest_births(births: DataFrame) -> DataFrame:
    """Stored birth per device: the latest."""
    return latest_per_key(births, ["device_id"], ["ts", "seq_order"])


def remove_births(births: DataFrame, devices: DataFrame) -> DataFrame:
    return births.join(devices, "device_id", "left_anti")


def requests_rebirth(metrics: Column) -> Column:
    """Whether a command's metrics ask for a rebirth.

    ``metrics`` is an array of structs with ``name`` and ``value`` (text).
    """
    yes = lambda v: F.lower(F.trim(v)).isin("true", "1", "yes", "y", "on") | (
        F.coalesce(v.try_cast("double"), F.lit(0.0)) != 0
    )
    return F.exists(metrics, lambda m: m["name"].contains("Rebirth") & yes(m["value"]))


def rebirths(requests: DataFrame, state: DataFrame, stored_births: DataFrame) -> DataFrame:
    """Births to replay for requests (node, device_id or NULL for all of the node, ts).

    ``state`` and ``stored_births`` name the node of each device. A request concerns its own node
    only: devices of other nodes may have the same name. Devices with current state get a full birth
    from it, others their stored birth with a new sequence number and time.
    """
    known = state.groupBy("node", "device_id").agg(F.count(F.lit(1)).alias("metric_count"))
    stored = stored_births.select("node", "device_id", "payload")
    devices = known.join(stored, ["node", "device_id"], "full_outer")
    # One request per device and per node before the join, however often they were sent.
    own = requests.filter("device_id IS NOT NULL").groupBy("node", "device_id").agg(F.max("ts").alias("own_ts"))
    whole = requests.filter("device_id IS NULL").groupBy("node").agg(F.max("ts").alias("node_ts"))
    asked = devices.join(own, ["node", "device_id"], "left").join(whole, "node", "left")
    return asked.filter("own_ts IS NOT NULL OR node_ts IS NOT NULL").select(
        "node",
        "device_id",
        F.greatest("own_ts", "node_ts").alias("ts"),
        F.when(F.col("metric_count") > 0, "state").otherwise("stored").alias("source"),
        F.coalesce("metric_count", F.lit(0)).cast("long").alias("metric_count"),
    )
