"""Write commands: select, parse, authorise, answer and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantweave.functions import text
from plantweave.functions.json import json_object, quoted, string_list

# Default write rules.
ALLOWED = ["*/Setpoints/*", "*/Configuration/*"]
DENIED = ["*/Identification/*", "*/readonly/*"]


def command_messages(messages: DataFrame) -> DataFrame:
    """Messages on command topics that are not answers."""
    topic = F.col("topic")
    is_command = topic.contains("/cmd/") | topic.startswith("cmd/")
    return messages.filter(is_command & ~topic.endswith("/ack") & ~topic.endswith("/nak"))


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(commands, rejected messages with the reason).

    Each payload is parsed once per row: the fields come out of a generator, and
    filters on them stay above it instead of being computed a second time below.
    """
    topic, where = F.col("topic"), F.instr(F.col("topic"), "/cmd/")
    after = F.when(where > 0, where + 5).otherwise(5)
    rest = F.substring(topic, after, F.length(topic))
    slash = F.instr(rest, "/")
    is_object = F.col("payload").rlike(r"^\s*\{")

    def fields(doc: Column) -> Column:
        text = lambda name: F.try_variant_get(doc, f"$.{name}", "string")
        value = F.try_variant_get(doc, "$.value", "variant")
        reason = (
            F.when(slash == 0, "invalid_path")
            .when(doc.isNull(), "invalid_json")
            .when(~is_object | value.isNull(), "missing_value")
        )
        return F.struct(
            F.substring(rest, F.lit(1), slash - 1).alias("submodel_id"),
            F.substring(rest, slash + 1, F.length(rest)).alias("property_path"),
            F.to_json(value).alias("value_json"),
            text("correlationId").alias("correlation_id"),
            text("requestor").alias("requestor"),
            reason.alias("reason"),
        )

    rows = command_messages(messages).select(
        *messages.columns, F.inline(F.transform(F.array(F.try_parse_json("payload")), fields))
    )
    commands = rows.filter("reason IS NULL").drop("reason")
    return commands, rows.filter("reason IS NOT NULL").select(*messages.columns, "reason")


def authorise(
    commands: DataFrame, allowed: list[str] | None = None, denied: list[str] | None = None
) -> DataFrame:
    """Add ``authorised`` and ``error``: the first matching deny wins, then any allow.

    The rules are a short ordered list; each is one constant regular expression, so
    commands are neither shuffled nor multiplied.
    """
    allowed = ALLOWED if allowed is None else allowed
    denied = DENIED if denied is None else denied
    path = F.concat(F.col("submodel_id"), F.lit("/"), F.col("property_path"))
    deny = F.coalesce(
        *[F.when(path.rlike(text.glob_to_regex(p)), F.lit(p)) for p in denied],
        F.lit(None).cast("string"),
    )
    allow = F.lit(False)
    for pattern in allowed:
        allow = allow | path.rlike(text.glob_to_regex(pattern))
    error = F.when(
        deny.isNotNull(),
        F.concat(F.lit("Path '"), path, F.lit("' matches denied pattern '"), deny, F.lit("'")),
    ).when(~allow, F.concat(F.lit("Path '"), path, F.lit("' not in allowed patterns")))
    return commands.withColumn("error", error).withColumn("authorised", F.col("error").isNull())


def write_intents(authorised: DataFrame) -> DataFrame:
    """Writes to carry out: submodel, path in bracket notation, value."""
    return authorised.filter("authorised").select(
        "event_id",
        "submodel_id",
        text.topic_path_to_api_path(F.col("property_path")).alias("api_path"),
        "value_json",
    )


def with_outcomes(authorised: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Add ``result`` and ``reason``: denied, success or failed.

    ``outcomes`` has ``event_id`` and ``failure`` (NULL on success).
    """
    joined = authorised.join(outcomes, "event_id", "left")
    result = (
        F.when(~F.col("authorised"), "denied")
        .when(F.col("failure").isNull(), "success")
        .otherwise("failed")
    )
    return joined.withColumn("result", result).withColumn(
        "reason", F.coalesce(F.col("error"), F.col("failure"))
    )


def responses(finished: DataFrame, confirm: bool = True) -> DataFrame:
    """Ack and nak rows; a denial is always answered, the rest when ``confirm``."""
    ok = F.col("result") == "success"
    correlation = F.nullif(F.col("correlation_id"), F.lit(""))
    payload = json_object(
        ("success", F.when(ok, "true").otherwise("false")),
        ("errors", F.when(~ok, string_list(F.array("reason")))),
        ("timestamp", F.col("ts")),
        ("correlationId", quoted(correlation)),
    )
    return finished.filter(F.lit(confirm) | (F.col("result") == "denied")).select(
        "event_id",
        F.concat(F.col("topic"), F.when(ok, "/ack").otherwise("/nak")).alias("topic"),
        payload.alias("payload"),
    )


def audit_trail(finished: DataFrame, confirm: bool = True, redact: bool = False) -> DataFrame:
    """The audit rows of every command, numbered by ``step``."""
    shown = F.when(F.col("value_json") != "null", quoted(F.lit("[REDACTED]")) if redact else F.col("value_json"))
    result, ok = F.col("result"), F.col("result") == "success"
    none = F.lit(None).cast("string")
    answer_topic = F.concat(F.col("topic"), F.when(ok, "/ack").otherwise("/nak"))

    def row(step: int, name: Column | str, topic: Column, value: Column, res: Column, reason: Column):
        name = F.lit(name) if isinstance(name, str) else name
        return F.struct(
            F.lit(step).alias("step"), name.alias("audit_event"), topic.alias("audit_topic"),
            value.alias("value"), res.alias("audit_result"), reason.alias("audit_reason"),
        )

    done = F.when(result == "denied", "write_validated").otherwise("write_executed")
    steps = [
        row(1, "write_command_received", F.col("topic"), shown, none, none),
        row(2, done, F.col("topic"), shown, result, F.col("reason")),
        F.when(
            F.lit(confirm) | (result == "denied"),
            row(3, "write_response_sent", answer_topic, none,
                F.when(ok, "success").otherwise("denied"), F.col("reason")),
        ),
    ]
    rows = finished.select(
        "event_id", "submodel_id", "property_path", "correlation_id", "requestor", "ts",
        F.inline(F.array_compact(F.array(*steps))),
    )
    entry = json_object(
        ("audit_event", quoted(F.col("audit_event"))),
        ("topic", quoted(F.col("audit_topic"))),
        ("timestamp_ms", F.col("ts")),
        ("submodel_id", quoted(F.col("submodel_id"))),
        ("property_path", quoted(F.col("property_path"))),
        ("value", F.col("value")),
        ("result", quoted(F.col("audit_result"))),
        ("reason", quoted(F.col("audit_reason"))),
        ("correlation_id", quoted(F.col("correlation_id"))),
        ("requestor", quoted(F.col("requestor"))),
    )
    return rows.select("event_id", "step", "audit_event", entry.alias("entry"))


def totals(finished: DataFrame) -> DataFrame:
    """Writes, errors, and allowed and denied checks."""
    result = F.col("result")
    return finished.agg(
        F.count_if(result == "success").alias("write_count"),
        F.count_if(result == "failed").alias("error_count"),
        F.count_if(result != "denied").alias("allowed"),
        F.count_if(result == "denied").alias("denied"),
    )
