"""Operators against plain Python, and over odd rows (see conftest) and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plantweave.llm import language, pii, toxicity
from plantweave.llm.components import components
from plantweave.llm.counting import TokenTree, count_edited
from plantweave.llm.decontamination import find_contamination
from plantweave.llm.extraction import extract_text, main_text
from plantweave.llm.jaccard import similar_groups
from plantweave.llm.packing import Encoder, pack_pieces, plan_sequences, token_pieces
from plantweave.llm.phrases import remove_repeated_passages
from plantweave.llm.topk import top_k

PATH = public_tokenizers.path("byte_bpe_50k.json")
BLANK = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


# Repeated phrases


def removed_by_hand(rows, window=13):
    words = [(i, re.findall(BLANK, t or "")) for i, t in rows]
    last = float("inf")
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key, i_ = tuple(w[k : k + window]), last if i is None else i
            first[key] = min(first.get(key, i_), i_)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (last if i is None else i):
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return ordered(out)


@pytest.mark.parametrize("automaton_words", [500_000, 50])
def test_repeated_passages(odd_docs, docs, automaton_words):
    both = odd_docs.select("doc_id", "text").unionAll(docs.select(F.col("doc_id") + 100, "text"))
    got = remove_repeated_passages(both, block_bytes=100_000, automaton_words=automaton_words).collect()
    assert ordered(tuple(r) for r in got) == removed_by_hand(texts(both))


def test_repeated_passages_without_rows(no_docs):
    assert remove_repeated_passages(no_docs).collect() == []


# Jaccard join


def groups_by_hand(rows):
    sets = []
    for _, t in rows:
        w = re.findall(BLANK, (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        least[root(x)] += [i] if i is not None else []
    return ordered((i, len(sets[x]), min(least[root(x)], default=None)) for x, (i, _) in enumerate(rows))


def chain_of_copies(n=30):
    """Near copies that drift: neighbours link, the ends do not; and many share their words."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(n):
        for _ in range(3):
            words[rng.randrange(300)] = f"n{rng.random()}"
        rows.append((1000 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("few", [8, 2])
def test_similar_groups(spark, odd_docs, docs, few):
    chain = spark.createDataFrame(chain_of_copies(), "doc_id long, text string")
    both = odd_docs.select("doc_id", "text").unionAll(docs.select(F.col("doc_id") + 100, "text")).unionAll(chain)
    got = similar_groups(both, block_bytes=50_000, few=few, sketch_bits=10).collect()
    assert ordered(tuple(r) for r in got) == groups_by_hand(texts(both))


def test_similar_groups_without_rows(no_docs):
    assert similar_groups(no_docs).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        hi, lo = sorted((root(a), root(b)), reverse=True)
        parent[hi] = lo
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in joined}


# Decontamination


@pytest.mark.parametrize("block_bytes", [4 << 20, 400])
def test_contamination(spark, odd_docs, docs, block_bytes):
    items = [(1, "three four five six seven eight nine ten eleven twelve thirteen"), (1, "Four, FIVE six"), (2, ""), (3, None), (None, "short")]
    bench = spark.createDataFrame(items, "item_id long, text string").unionAll(
        spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id") + 10, "text")
    )
    both = odd_docs.select("doc_id", "text").unionAll(docs.select(F.col("doc_id") + 100, "text"))
    got = find_contamination(both, bench, benchmark_block_bytes=block_bytes).collect()
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for r in bench.collect():
        w = re.findall(word, (r["text"] or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("null" if r["item_id"] is None else str(r["item_id"]))
    want = []
    for i, t in texts(both):
        w = re.findall(word, (t or "").translate(LOWER))
        hit, names = [0] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [1] * n
                    names |= windows[tuple(w[k : k + n])]
        want.append((i, len(w), sum(hit), sorted(names)))
    assert ordered((r[0], r["n_words"], r["n_hit"], r["items"]) for r in got) == ordered(want)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in got)


def test_contamination_without_items_or_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in find_contamination(odd_docs, none).collect()] == [0] * odd_docs.count()
    assert find_contamination(no_docs, none).collect() == []


# Top-k


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(0, 0.2, 16).tolist()) for i in range(400)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (0, rows[3][1]), (502, None), (503, [None] * 16), (504, [float("nan")] * 16)]
    rows += [(None, rows[1][1]), (505, [float("inf")] + [0.0] * 15), (550, [1.0, 2.0]), (600, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = top_k(df, F.col("vec_id") % 50 == 0, block_rows=64, team_size=5)
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)))
    queries = {}
    for i, v in good:
        if i % 50 == 0:
            queries[i] = min(queries.get(i, list(v)), list(v))
    want = []
    for q, v in queries.items():
        near = sorted((-int(np.dot(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


# Packing


def test_pieces_are_the_tokenizers_ids(odd_docs, docs):
    both = odd_docs.select("doc_id", "text").unionAll(docs.select(F.col("doc_id") + 100, "text"))
    tokenizer = Encoder(PATH).tokenizer
    want = []
    for i, t in texts(both):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, n, a, b - a, np.array(ids[a:b], dtype="<u4").tobytes()) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    got = [(*r[:4], bytes(r["ids"])) for r in token_pieces(both, PATH).collect()]
    assert ordered(got) == ordered(want)


def test_latin_texts_encode_alike():
    own = Encoder(PATH)
    assert own.fast is not None
    rng = random.Random(2)
    letters = "abcXYZ éèüßñÉ  \n\t\r.,;!?'0123456789-_@#%<|endoftext|>’“”…—€\x00\x1c\x85\xa0ªº²½日ж"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        assert own.ids(text) == np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packed_sequences(odd_docs, docs, no_docs):
    both = odd_docs.select("doc_id", "text").unionAll(docs.select(F.col("doc_id") + 100, "text"))
    pieces = token_pieces(both, PATH).drop("ids").withColumn("n", F.lit("kept"))
    rows = pack_pieces(pieces).collect()
    held = defaultdict(list)
    for r in rows:
        assert r["n"] == "kept"
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert ordered(tuple(r)[:4] for r in rows) == ordered(tuple(r)[:4] for r in pieces.collect())
    assert pack_pieces(token_pieces(no_docs, PATH).drop("ids")).collect() == []


def test_plan_uses_every_piece_and_fills_gaps():
    rng = np.random.default_rng(0)
    counts = np.r_[0, rng.integers(0, 50, 1024)]
    used, total, sequences = Counter(), 0, 0
    for content, times in plan_sequences(counts):
        assert sum(content) <= 1024 and times > 0
        used.update({x: n * times for x, n in Counter(content).items()})
        total, sequences = total + sum(content) * times, sequences + times
    assert all(used[n] == counts[n] for n in range(1, 1025))
    assert sequences <= -(-total // 1024) * 1.006


# Edit-aware counts


def test_edits_count_like_encoding_again(spark):
    rng = random.Random(4)
    own = Encoder(PATH)
    letters = "ab cd  e,\n.é 1"
    for _ in range(150):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        tree = TokenTree(own, text)
        for _ in range(12):
            a = rng.randint(0, len(text) + 2)
            b = rng.randint(a, len(text) + 3)
            new = "".join(rng.choice(letters) for _ in range(rng.randint(0, 8)))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text
            assert tree.tokens == len(own.ids(text)) // 4
    rows = [(1, "a b c", [(0, 1, "x"), None, (9, 12, None)]), (2, None, None), (None, "", []), (1, "a b c", [(0, 1, "x")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,replacement:string>>")
    got = [tuple(r) for r in count_edited(df, PATH).select("doc_id", "n_tokens", "n_edited", "n_edits", "edited").collect()]
    assert ordered(got) == ordered([(1, 3, 3, 2, "x b c"), (2, 0, 0, 0, ""), (None, 0, 0, 0, ""), (1, 3, 3, 1, "x b c")])


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRICKY = [
    "a@b.c_x@y.z a@b.c.d@e.f me@host d@e..f",
    "1.2.3.4.5 999.1.1.1 00001.2.3.255 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 x 4111111111111112",
    "+1 (283) 555-6500 +1234 +44 20 7946 0958-",
    "\U0001f600 x@y.co.uk \U0001f600 10.0.0.1",
    "9" * 20_000,
    " ".join(f"u{i}@h{i}.org +1 555 {i:07d}" for i in range(400)),
]


def spans_by_hand(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn,
                "phone": 9 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(spark, odd_docs, docs):
    tricky = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    both = odd_docs.select("doc_id", "text").unionAll(docs.select(F.col("doc_id") + 100, "text")).unionAll(tricky)
    found = pii.find_personal_data(both, pii.train(both)).withColumn("masked", pii.redact(F.col("text"), F.col("spans"))).collect()
    assert len(found) == both.count()
    for r in found:
        text = r["text"] or ""
        base = [(s["kind"], s["start"], s["end"]) for s in r["base"]]
        assert base == spans_by_hand(text)
        spans = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert set(base) <= set(spans)
        merged = []
        for start, end, kind in sorted((s[1], s[2], s[0]) for s in spans):
            if merged and merged[-1][1] > start:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end, kind])
        out, at = "", 0
        for start, end, kind in merged:
            out, at = out + text[at:start] + f"[{kind.upper()}]", end
        assert (r["masked"] or "") == out + text[at:]


def test_personal_data_runs_no_python(odd_docs, no_docs):
    found = pii.find_personal_data(odd_docs.select("doc_id", "text"), pii.train(odd_docs))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert pii.find_personal_data(no_docs, pii.train(no_docs)).collect() == []


def test_trees_learn_which_features_are_confirmed():
    rows = [("card", 4, 0, 4, 3, 5, 2, 1, True, 900), ("card", 4, 0, 4, 3, 4, 1, 0, False, 900), ("ip", 1, 2, 3, 3, 5, 2, 1, False, 50)]
    model = pii.fit(rows)
    assert set(model.threshold) == {"card"}
    assert pii.fit([]).threshold == {}


# Toxicity


def test_toxicity(spark, docs, odd_docs, no_docs):
    rng = random.Random(6)
    plain = [f"word{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            words[rng.randrange(60)] = rng.choice(["vileness", "viler", "vilest"])
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, marks, F.col("doc_id") % 5 != 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [(i, i % 8 == 0) for i in range(0, 1200, 5)]
    assert sum((got[i] >= 0.5) == t for i, t in held) / len(held) > 0.97
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.train(no_docs, marks.limit(0), F.lit(True)) is None
    assert {r["score"] for r in toxicity.score(odd_docs, None).collect()} == {0.0}
    assert toxicity.score(no_docs, model).collect() == []


# Language


def test_language(docs, odd_docs, no_docs):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.train(docs.filter(~held))
    joined = language.predict(docs, model).join(docs.filter(held).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in joined) / len(joined) > 0.95
    assert all(0 < r["score"] <= 1 and abs(sum(r["shares"].values()) - 1) < 1e-6 for r in joined)
    odd = {(r["doc_id"], r["lang_pred"] == "und") for r in language.predict(odd_docs, model).collect()}
    assert {i for i, und in odd if und} == {3, 4, 5, None} and (None, False) in odd
    assert {r["lang_pred"] for r in language.predict(odd_docs, language.train(no_docs)).collect()} == {"und"}
    assert language.predict(no_docs, model).collect() == []


def test_a_mixed_text_has_both_shares(spark, docs):
    model = language.train(docs)
    some = {r["lang"]: r["text"] for r in docs.filter(F.length("text").between(1500, 4000)).select("lang", "text").collect()}
    df = spark.createDataFrame([(1, some["en"][:1500] + " " + some["de"][:1500])], "doc_id long, text string")
    shares = language.predict(df, model).first()["shares"]
    assert shares["en"] > 0.25 and shares["de"] > 0.25


# Main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a>News</a></ul></nav><div class="ad">Buy this and that for it.</div>
<article><h1>Title &amp; more</h1><p><b>It was the best  of
times.<br><p>Short&nbsp;one.</p><p>a &lt;b&gt; c</p><div class="comments"><p>I like the story that was told in it.</p></div></article>
<aside>Related</aside><form><input><p>Subscribe to the letter</p></form><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    assert main_text(PAGE) == "Title & more\nIt was the best of times.\nShort one.\na <b> c"
    prose = "It was the best of times, it was the worst of times, it was the age of wisdom and the age of foolishness for all. " * 3
    page = f"<div class=menu><a>One</a> <a>Two</a></div><div><h2>Head</h2><p>{prose}</p><p>Short.</p><p>{prose}</p></div><p>x <a>link text</a></p>"
    assert main_text(page) == "\n".join(["Head", prose.strip(), "Short.", prose.strip()])
    assert main_text(None) == main_text("") == main_text("<script>var a") == ""
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 5), (None, "u", "<article>a &#xD800; < b</article>", 5)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
