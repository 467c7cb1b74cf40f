"""Asset documents: reading, quarantine and change tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """One row per file below ``path``: source, event time and whole content."""
    return (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.unix_millis("_metadata.file_modification_time").alias("event_ts"),
            F.col("value").alias("content"),
        )
    )


def stream_documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """New files as a stream. Edited files need a new name or :func:`changed_files`."""
    return (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
        .select(
            F.col("_metadata.file_path").alias("source"),
            F.unix_millis("_metadata.file_modification_time").alias("event_ts"),
            F.col("value").alias("content"),
        )
    )


def read_file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, hash) of every file by its bytes."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", F.sha2("content", 256).alias("hash"))
    )


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content hash is new or differs from the manifest of the last pass."""
    known = manifest.select("path", F.col("hash").alias("_known"))
    return (
        files.join(known, "path", "left")
        .filter(~F.col("hash").eqNullSafe(F.col("_known")))
        .drop("_known")
    )


def changed_objects(current: DataFrame, previous: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per (url, version_tag, content): whether it changed since the previous snapshot.

    Equal tags mean unchanged; otherwise the content hashes decide. ``keys`` tell which rows are the
    same object, the url if nothing else does. One row per current row, however many versions of its
    object the previous snapshot holds: one that is unchanged is enough. An object without any has changed.
    """
    keys = keys or ["url"]
    digest = F.coalesce(F.sha2("content", 256), F.lit("")).alias("_hash")
    tags = previous.select(*keys, F.col("version_tag").alias("_tag")).dropna().distinct().withColumn("_same_tag", F.lit(True))
    hashes = previous.select(*keys, digest).dropna().distinct().withColumn("_same_hash", F.lit(True))
    return (
        current.withColumn("_tag", F.col("version_tag")).withColumn("_hash", digest)
        .join(tags, [*keys, "_tag"], "left").join(hashes, [*keys, "_hash"], "left")
        .select("url", F.coalesce("_same_tag", "_same_hash").isNull().alias("changed"))
    )


def any_changed(flags: DataFrame) -> DataFrame:
    """One row: whether anything changed, which means everything is processed again."""
    return flags.agg(F.coalesce(F.bool_or("changed"), F.lit(False)).alias("any_changed"))


def with_doc(documents: DataFrame) -> DataFrame:
    """Add ``doc``, the parsed content, NULL for text that is not one JSON object.

    The text is parsed as the only member of a list, which also catches text after
    the end of the document.
    """
    members = F.try_parse_json(F.concat(F.lit("["), F.col("content"), F.lit("]")))
    one = F.try_variant_get("_members", "$[1]", "variant").isNull()
    opens = F.col("content").rlike(r"^\s*\{")
    return (
        documents.withColumn("_members", F.when(opens, members))
        .withColumn("doc", F.when(one, F.try_variant_get("_members", "$[0]", "variant")))
        .drop("_members")
    )


def parse_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with a parsed ``doc``, quarantined documents)."""
    parsed = with_doc(documents)
    return parsed.filter("doc IS NOT NULL"), parsed.filter("doc IS NULL").drop("doc")


def parse_states(documents: DataFrame) -> DataFrame:
    """(source, ok) of every document: both parts of :func:`parse_documents` in one pass over the texts."""
    return with_doc(documents).select("source", F.col("doc").isNotNull().alias("ok"))
