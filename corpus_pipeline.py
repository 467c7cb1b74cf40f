"""A corpus pipeline of five stages; each applies one operator to all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last return
the columns of ``documents``; the last returns packed pieces. Between stages the rows are
written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantweave.llm import pii, store, toxicity
from plantweave.llm.decontamination import find_contamination
from plantweave.llm.jaccard import similar_groups
from plantweave.llm.packing import pack_pieces, token_pieces

#: No SQL: a trained classifier, trees and a tokenizer decide. Tests compare with plain Python.
ORACLE_SQL = None


def tokenizer_path() -> str:
    """The public byte-level vocabulary; its package has the file on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under neutral column names, which clash with none of an operator's, and those names."""
    names = {c: f"c{i}__" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents whose score is 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    apart, names = _apart(docs)
    scored = toxicity.score(apart.withColumn("id__", F.lit(0)), model, "id__", names["text"], tuple(names.values()))
    return _back(scored.filter("score < 0.5"), names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of each group of linked documents the one with the smallest id stays.

    Among rows that repeat that id, or if no member has an id, one row stays.
    """
    # Rows get a number that stays the same in later passes; ids may be null or repeated.
    numbered = store.materialise(docs.withColumn("row__", F.monotonically_increasing_id()), "join-stage")
    by_row = numbered.select(F.col("row__").alias("doc_id"), "text")
    groups = store.materialise(similar_groups(by_row).select("doc_id", "component_id", "n_shingles"), "join-groups")
    ids = groups.join(numbered.select(F.col("row__").alias("doc_id"), F.col("doc_id").alias("id")), "doc_id")
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("doc_id").alias("row__"))
    first = ids.groupBy("component_id").agg(F.min(place).alias("first")).select("first.row__")
    return numbered.join(first, "row__", "left_semi").drop("row__")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: documents that hold a window of a benchmark item go."""
    apart, names = _apart(docs)
    found = find_contamination(
        apart.withColumn("id__", F.lit(0)),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
        id_column="id__",
        text_column=names["text"],
        keep=tuple(names.values()),
    )
    return _back(found.filter("n_hit = 0"), names)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: personal data is replaced by its kind in brackets; ``n_chars`` follows."""
    # Whole rows travel in one column, so no name of theirs can clash.
    apart = docs.select(F.struct(*docs.columns).alias("row__"), "text")
    found = pii.find_personal_data(apart, pii.train(docs)).withColumn("masked__", pii.redact(F.col("text"), F.col("spans")))
    new = {"text": F.col("masked__"), "n_chars": F.length("masked__").cast("long")}
    return found.select(*[new.get(c, F.col("row__")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: token pieces of at most 1024, packed into sequences."""
    pieces = token_pieces(docs, tokenizer_path())
    packed = pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
