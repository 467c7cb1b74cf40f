"""Stages of the pipeline against the operators' rules, on the driver's smallest tables and on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from check import TABLES, rows_of
from tests.llm.conftest import SF


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", ["op2_repeated_phrases", "op4_bit_sliced_topk", "op6_jaccard_join", "op10_decontamination"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_all_queries_are_registered():
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 11)} and "pipeline" in entry.queries()
    assert [n for n, _ in pipeline.STAGES] == [
        "toxicity", "ngram_jaccard_join", "benchmark_decontamination", "personal_data", "best_fit_packing",
    ]


def test_toxic_documents_go_and_clean_ones_stay(spark, docs):
    left = pipeline.drop_toxic(spark, docs, SF)
    assert left.columns == docs.columns
    scores = {r["doc_id"]: r["score"] for r in entry.queries()["op7_toxicity"](spark, SF).collect()}
    assert rows(left, "doc_id") == sorted(((i,) for i, s in scores.items() if s < 0.5), key=repr)


def test_one_document_of_each_group_stays(spark, docs):
    twice = docs.unionAll(docs.filter("doc_id < 20"))
    left = pipeline.drop_near_copies(spark, twice, SF)
    groups = entry.queries()["op6_jaccard_join"](spark, SF)
    assert rows(left, "doc_id") != [] and left.columns == docs.columns
    # The smallest id of each group; a document without words is a group of its own rows.
    want = {r["component_id"] for r in groups.filter("n_shingles > 0").collect()}
    assert {r[0] for r in rows(left.filter(F.trim("text") != ""), "doc_id")} == want
    assert len(rows(left.filter(F.trim("text") != ""), "doc_id")) == len(want)


def test_contaminated_documents_go(spark, docs):
    left = pipeline.drop_contaminated(spark, docs, SF)
    hit = {r["doc_id"] for r in entry.queries()["op10_decontamination"](spark, SF).filter("contaminated").collect()}
    assert hit and rows(left, "doc_id") == sorted(((r["doc_id"],) for r in docs.collect() if r["doc_id"] not in hit), key=repr)


def test_personal_data_is_masked(spark, docs):
    left = pipeline.mask_personal_data(spark, docs, SF)
    assert left.columns == docs.columns and left.count() == docs.count()
    again = pipeline.pii.base_spans(left).agg(F.sum(F.size("base"))).first()[0]
    assert again == 0
    assert left.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_stages_take_odd_rows(spark, odd_docs):
    """Rows with null ids and texts, repeated rows and other columns pass each stage."""
    for _, stage in pipeline.STAGES[:-1]:
        left = stage(spark, odd_docs.withColumn("row__x", F.lit(1)).withColumn("n_chars", F.lit(0)), SF)
        assert left.count() > 0 and "row__x" in left.columns
    kept = pipeline.drop_near_copies(spark, odd_docs, SF)
    # 1 and the two rows of 2 are one group; rows without words link with nothing.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted(
        [(False, i) for i in (1, 3, 4, 5, 6, 7, 8, 9)] + [(True, 0), (True, 0)]
    )
    assert pipeline.pack(spark, odd_docs, SF).count() >= odd_docs.count()


def test_run_gives_packed_pieces_of_what_is_left(spark):
    got = pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
