"""The registered queries: each applies one operator to its whole table; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plantweave.llm import language, pii, toxicity
from plantweave.llm.conversations import repair_conversations
from plantweave.llm.counting import count_edited
from plantweave.llm.decontamination import find_contamination
from plantweave.llm.extraction import extract_text
from plantweave.llm.jaccard import similar_groups
from plantweave.llm.mixing import mix_sources
from plantweave.llm.packing import pack_pieces, token_pieces
from plantweave.llm.phrases import remove_repeated_passages
from plantweave.llm.resampling import resample
from plantweave.llm.topk import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _fold(of: int) -> Column:
    """Remainder of the id's checksum; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of, F.lit(-1))


@query("op1_language_mixture")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.train(docs.filter(_fold(4) != 2))
    found = language.predict(docs, model)
    return found.select("doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query(
    "op2_repeated_phrases",
    r"""
    WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
    p AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w),
    win AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l FROM p),
    k AS (SELECT doc_id, i, array_to_string(l, ' ') AS k FROM win WHERE len(l) = 13),
    first AS (SELECT k, min(doc_id) AS m FROM k GROUP BY k),
    gone AS (SELECT DISTINCT doc_id, i + j AS i FROM k JOIN first USING (k), (SELECT unnest(range(13)) AS j) WHERE m < doc_id),
    left_over AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN left_over USING (doc_id)
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_html_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


@query(
    "op4_bit_sliced_topk",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
    FROM s QUALIFY rank <= 5
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(_table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_path())
    packed = pack_pieces(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query(
    "op6_jaccard_join",
    rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
    p AS (SELECT doc_id, len(ws) AS n, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w),
    win AS (
      SELECT doc_id, n, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS l FROM p),
    s AS (SELECT DISTINCT doc_id, array_to_string(l, ' ') AS g FROM win WHERE len(l) = 5 OR (n < 5 AND i = 0)),
    size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (
      SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
    SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
    FROM w LEFT JOIN size USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(_table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), _fold(5) > 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _span_text(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.train(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(_span_text(F.col("base")), 256).alias("base_sha256"),
        _span_text(F.col("spans")).alias("spans"),
    )


@query("op9_edit_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text under the edits a cleaning pass makes: personal data is masked, runs of marks go.

    Edits run from the end of the text to its start, so their positions hold as they are.
    """
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = r"([%*$&#!])\1\1++"
    found = pii.base_spans(pii.settled(docs.withColumn("marks", pii.matches(F.col("text"), marks)), ["marks"]))
    edit = lambda s, new: F.struct(s["start"].alias("start"), s["end"].alias("end"), new.alias("replacement"))
    mask = F.transform("base", lambda s: edit(s, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    drop = F.transform("marks", lambda s: edit(s, F.lit("")))
    edits = F.reverse(F.array_sort(F.concat(mask, drop)))
    counted = count_edited(found.select("doc_id", "text", edits.alias("edits")), corpus_pipeline.tokenizer_path())
    return counted.select("doc_id", "n_tokens", "n_edited", "n_edits", "n_encoded", F.sha2("edited", 256).alias("edited_sha256"))


@query(
    "op10_decontamination",
    rf"""
    WITH d AS (
      SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
    t AS (
      SELECT item_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark),
    keys AS (
      SELECT DISTINCT item_id::VARCHAR AS item, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS k
      FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM t WHERE len(ws) > 0)),
    p AS (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM d),
    win AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM p),
    found AS (
      SELECT doc_id, i, x.n, item FROM win JOIN (SELECT DISTINCT n FROM keys) x ON len(l) >= x.n
      JOIN keys ON keys.n = x.n AND keys.k = array_to_string(l[1 : x.n], ' ')),
    hit AS (
      SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
    named AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes; its table follows from the polynomial."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = f"list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: {step}))"
    hexed = f"hex(encode({text}))"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT)"
    read = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"(SELECT xor(list_reduce(list_prepend(4294967295, {octets}), {read}), 4294967295) FROM (SELECT {table} AS t))"


_BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op11_conversation_repair",
    rf"""
    WITH RECURSIVE raw AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
    dam AS (
      SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
      FROM raw WHERE kind <> 0),
    num AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
        rtrim(text, {_BLANKS}) AS bare FROM dam),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM num),
    fault AS (
      SELECT *, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
        left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS y FROM seen),
    counts AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
        count(*) FILTER (y IS NOT NULL AND y || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM fault GROUP BY conv_id),
    -- What may precede a role: (state, role, inserted roles, next state); states are the last role or 'e'.
    rule(state, role, ins, nxt) AS (VALUES
      ('e', 's', [], 's'), ('e', 'u', [], 'u'), ('e', 'a', ['user'], 'a'), ('s', 'u', [], 'u'), ('s', 'a', ['user'], 'a'),
      ('u', 'u', ['assistant'], 'u'), ('u', 'a', [], 'a'), ('a', 'u', [], 'u'), ('a', 'a', ['user'], 'a')),
    stay AS (
      SELECT f.conv_id, f.i, r.state, r.nxt, 3 * len(r.ins) + CASE WHEN r.role = f.x THEN 0 ELSE 3 END + CASE WHEN cut THEN 3 ELSE 0 END AS cost,
        repeat('I', len(r.ins)) || CASE WHEN r.role = f.x THEN 'K' ELSE 'R' END AS letters,
        list_append(list_transform(r.ins, lambda z: z || ':'),
          CASE WHEN r.role = f.x THEN f.role WHEN r.role = 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text) AS made
      FROM fault f JOIN rule r ON r.role = f.x OR r.role <> 's' WHERE NOT f.blank AND NOT f.dup),
    gone AS (SELECT conv_id, i, s.state, s.state AS nxt, 4 AS cost, 'D' AS letters, []::VARCHAR[] AS made
      FROM fault, (VALUES ('e'), ('s'), ('u'), ('a')) s(state)),
    move AS (SELECT * FROM stay UNION ALL SELECT * FROM gone),
    walk AS (
      SELECT conv_id, 0::BIGINT AS i, 'e' AS state, {{'cost': 0, 'audit': '', 'made': []::VARCHAR[]}} AS best FROM counts
      UNION ALL
      SELECT w.conv_id, w.i + 1, m.nxt,
        min({{'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.letters, 'made': list_concat(w.best.made, m.made)}})
      FROM walk w JOIN move m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 AND m.state = w.state
      GROUP BY w.conv_id, w.i, m.nxt),
    last AS (
      SELECT w.conv_id, min({{'cost': best.cost + 3 * len(t), 'audit': best.audit || repeat('I', len(t)), 'made': list_concat(best.made, t)}}) AS b
      FROM (SELECT *, CASE state WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE []::VARCHAR[] END AS t FROM walk) w
      JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i GROUP BY w.conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit,
      sha256(coalesce(array_to_string(b.made, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN last l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(_table(spark, sf_dir, "conversations"))


@query(
    "op12_source_mixture",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS k,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
    s AS (
      SELECT source, sum(size)::HUGEINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS w
      FROM d GROUP BY source),
    -- Rounds: the words left to share and the weights that share them; a source above three times its size leaves.
    round AS (
      SELECT 0 AS n, (SELECT sum(source_size) FROM s) AS rest, (SELECT sum(w) FROM s) AS weights
      UNION ALL
      SELECT * FROM (
        SELECT r.n + 1 AS n, (SELECT sum(source_size) FROM s) - sum(CASE WHEN s.w * r.rest > 3 * s.source_size * r.weights THEN 3 * s.source_size ELSE 0 END) AS rest,
          sum(CASE WHEN s.w * r.rest > 3 * s.source_size * r.weights THEN 0 ELSE s.w END) AS weights
        FROM round r, s WHERE r.weights > 0 GROUP BY r.n, r.rest, r.weights
        HAVING sum(CASE WHEN s.w * r.rest > 3 * s.source_size * r.weights THEN 0 ELSE s.w END) <> r.weights)),
    level AS (SELECT rest, weights FROM round QUALIFY row_number() OVER (ORDER BY n DESC) = 1),
    t AS (
      SELECT source, source_size, CASE WHEN weights = 0 OR w * rest > 3 * source_size * weights THEN (3 * source_size)::DOUBLE
        ELSE (w * rest)::DOUBLE / weights::DOUBLE END AS target FROM s, level),
    p AS (
      SELECT d.doc_id, size, source_size, target, floor(target)::HUGEINT AS words,
        sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS UNBOUNDED PRECEDING) - size AS place
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size::BIGINT AS source_size, target,
      CASE WHEN source_size = 0 THEN 0 ELSE size * (words // source_size) + greatest(0, least(size, words % source_size - place)) END::BIGINT AS taken
    FROM p
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).drop("source")


@query(
    "op13_importance_resampling",
    rf"""
    WITH d AS (
      SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
    b AS (SELECT coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM benchmark),
    dw AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM d) GROUP BY word),
    bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM b) GROUP BY word),
    words AS (SELECT word, {_crc32("word")} % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
    corpus AS (SELECT bucket, sum(n) AS n FROM dw JOIN words USING (word) GROUP BY bucket),
    target AS (SELECT bucket, sum(n) AS n FROM bw JOIN words USING (word) GROUP BY bucket),
    gain AS (
      SELECT w.word, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (S + 10000)::DOUBLE / ((coalesce(c.n, 0) + 1)::DOUBLE * (T + 10000)::DOUBLE)))::BIGINT AS g
      FROM words w LEFT JOIN corpus c USING (bucket) LEFT JOIN target t USING (bucket),
        (SELECT coalesce(sum(n), 0) AS S FROM corpus), (SELECT coalesce(sum(n), 0) AS T FROM target)),
    per AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(ws) AS word FROM (SELECT row_number() OVER () AS row, * FROM d)) GROUP BY row, word),
    total AS (SELECT row, sum(g * n) AS g FROM per JOIN gain USING (word) GROUP BY row),
    scored AS (
      SELECT doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE
          (coalesce(g, 0) - (((coalesce(g, 0) % len(ws)) + len(ws)) % len(ws))) // len(ws) END::BIGINT AS weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
      FROM (SELECT row_number() OVER () AS row, * FROM d) LEFT JOIN total USING (row)),
    s AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
    r AS (
      SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (
          PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS place FROM s)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM s WHERE n_features >= 20) THEN place END AS rank
    FROM r
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
