"""Cases in which an operator once did less than the whole job."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plantweave.llm import jaccard, pii
from plantweave.llm.counting import TokenTree
from plantweave.llm.extraction import main_text
from plantweave.llm.packing import Encoder
from tests.llm.test_operators import PATH, chain_of_copies, groups_by_hand, ordered, texts


def shard_of_one_group(nodes):
    """A shard in which these nodes share one shingle."""
    rest = np.stack([nodes, np.full(len(nodes), 100 << 32)], axis=1)
    return pa.Table.from_pylist([{"shard": 0, "grams": np.full(len(nodes), 7, np.uint64).tobytes(), "rest": rest.tobytes()}])


def asked_for(rows):
    """Per block: how many documents it asks for."""
    return {r["block"]: len(set(np.frombuffer(r["other"], dtype=np.int64).tolist())) for r in rows if r["block"] is not None}


def test_each_block_asks_for_the_one_document_of_a_large_group():
    nodes = np.arange(1, 201, dtype=np.int64) << 20
    rows = jaccard._candidates(80, 8)(shard_of_one_group(nodes)).to_pylist()
    asked = asked_for(rows)
    assert len(asked) == 199 and set(asked.values()) == {1}


def test_one_document_against_many_is_asked_for_by_them():
    one, many = np.int64(500) << 20, np.arange(1, 101, dtype=np.int64) << 20
    asked = asked_for(jaccard._pair_rows(np.full(100, one), many))
    assert len(asked) == 100 and set(asked.values()) == {1}


def test_groups_in_bounded_inboxes(spark, odd_docs, docs):
    """Inboxes and replies cut into many parts give the same groups."""
    chain = spark.createDataFrame(chain_of_copies(), "doc_id long, text string")
    both = odd_docs.select("doc_id", "text").unionAll(docs.select(F.col("doc_id") + 100, "text")).unionAll(chain)
    got = jaccard.similar_groups(both, block_bytes=50_000, few=2, sketch_bits=10, inbox_bytes=2_000).collect()
    assert ordered(tuple(r) for r in got) == groups_by_hand(texts(both))


PROSE = ("It was the best of times, it was the worst of times, it was the age of wisdom and the age of foolishness for all. " * 3).strip()
SIDE = "This is the text of a part at the side that is not of the page and that no one has to read at all."
WRAPPERS = [
    '<div class="site has-sidebar">', '<div class="content no-sidebar">', '<div class="page sticky-header">',
    '<div class="post type-post hentry tag-news">', '<div id="page" class="nav-open"><div class="wrap with-menu">', '<form id="aspnetForm">',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_hints_do_not_put_out_a_whole_page(wrapper, inner):
    ends = "</div></div>" if wrapper.count("<div") == 2 else "</form>" if "form" in wrapper else "</div>"
    page = f"{wrapper}<div class=sidebar><p>{SIDE}</p></div><{inner}><p>{PROSE}</p><p>{PROSE}</p></{inner}>{ends}"
    assert main_text(page) == f"{PROSE}\n{PROSE}"


def test_hints_inside_and_beside_the_article_still_count():
    comments = f'<div id="comments"><article class="comment"><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></article></div>'
    for page in (f"<article><p>{PROSE}</p></article>{comments}", f"<main><article><p>{PROSE}</p></article>{comments}</main>"):
        assert main_text(page) == PROSE
        assert main_text(f'<div class="page sticky-header">{page}</div>') == PROSE
    assert main_text(f'<main><p>{PROSE}</p><div class="newsletter"><p>{SIDE}</p></div></main>') == PROSE
    assert main_text(f'<main><div class="page sticky-header"><p>{PROSE}</p></div></main>') == PROSE
    assert main_text(f"<article><p>{PROSE}</p><form><p>{SIDE}</p></form></article>") == PROSE


@pytest.mark.parametrize("number", ["06 12 34 56 78", "+33/6/12/34/56/78", "1-2-3-4-5"])
def test_numbers_in_short_groups_are_candidates_of_any_text(spark, number):
    docs = spark.createDataFrame([(f"call {number} now",), (f"call {number} now, room 123",)], "text string")
    for row in pii.candidates(pii.base_spans(docs)).collect():
        found = [row["text"][s["start"] : s["end"]] for s in row["loose"] if s["kind"] == "phone"]
        assert number in found


def test_ids_are_those_of_the_untouched_file():
    plain, own = Tokenizer.from_file(PATH), Encoder(PATH)
    for text in ("<|endoftext|>", "a <|endoftext|> b", "é  <|endoftext|>\n x", "日 <|endoftext|>", "<|endoftext", "plain text"):
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.ids(text), dtype="<u4").tolist() == want
        assert (50256 in want) == ("<|endoftext|>" in text)


def test_counts_under_edits_of_added_tokens():
    plain, own, rng = Tokenizer.from_file(PATH), Encoder(PATH), random.Random(5)
    pieces = ["<|endoftext|>", "<|endoftext|", ">", "<", " ", "  ", "\n", "\n ", "a", " word", "|"]
    for _ in range(60):
        text = "".join(rng.choices(pieces, k=12))
        tree = TokenTree(own, text)
        assert tree.tokens == len(plain.encode(text, add_special_tokens=False).ids), repr(text)
        for _ in range(25):
            start = rng.randint(0, len(text))
            end = min(len(text), start + rng.randint(0, 4))
            new = "".join(rng.choices(pieces, k=rng.randint(0, 2)))
            tree.edit(start, end, new)
            text = text[:start] + new + text[end:]
            assert tree.text() == text and tree.tokens == len(plain.encode(text, add_special_tokens=False).ids), repr(text)


def drifting(copies: int, singles: int) -> list[tuple[int, str]]:
    """Near copies that drift away from the first, and texts that share most words with them but link with none."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(copies):
        base[rng.randrange(90)] = f"x{i}"
        rows.append((i, " ".join(base if i % 4 else base[: 80 + i % 9])))
    for i in range(singles):
        rows.append((copies + i, " ".join([*(f"w{k}" for k in range(40)), *(f"s{i}_{k}" for k in range(30))])))
    rng.shuffle(rows)
    return rows


def roots_by_brute_force(rows: list[tuple[int, str]], percent: int = 80) -> dict[int, int]:
    sets = {}
    for i, text in rows:
        words = text.split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("percent", [80, 60])
def test_drifting_copies_and_texts_that_do_not_link(spark, percent):
    rows = drifting(160, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.similar_groups(docs, percent=percent, block_bytes=8_000, few=3, sketch_bits=10).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == roots_by_brute_force(rows, percent)


def test_pairs_of_a_large_group_grow_with_its_size():
    """Near copies that share many shingles, each shingle held by other nine tenths of them."""

    def pairs(n: int) -> int:
        rng, found = np.random.default_rng(1), set()
        for _ in range(60):
            nodes = np.flatnonzero(rng.random(n) < 0.9)
            for row in jaccard._candidates(80, 8)(shard_of_one_group(nodes)).to_pylist():
                if row["block"] is not None:
                    found |= set(zip(np.frombuffer(row["mine"], np.int64), np.frombuffer(row["other"], np.int64)))
        return len(found)

    few, many = pairs(200), pairs(1600)
    assert many < 12 * few and many < 6 * 1600


def test_rounds_across_components_form_each_pair_once_and_all_of_them():
    n = 150
    rng = np.random.default_rng(3)
    table = pa.table({
        "node": rng.permutation(n), "root": rng.integers(0, 6, n), "n": rng.integers(50, 70, n), "pos": np.zeros(n, dtype=np.int64),
    })
    own = {k: table.column(k).to_numpy() for k in ("node", "root", "n")}
    want = set()
    for i in range(n):
        for j in range(i):
            if own["root"][i] != own["root"][j] and 100 * min(own["n"][i], own["n"][j]) >= 80 * max(own["n"][i], own["n"][j]):
                want.add(tuple(sorted((int(own["node"][i]), int(own["node"][j])))))
    seen = []
    for near, far in jaccard._ROUNDS:
        for row in jaccard._across(80, near, far)(table).to_pylist():
            pairs = zip(np.frombuffer(row["mine"], np.int64), np.frombuffer(row["other"], np.int64))
            seen += [tuple(sorted(map(int, p))) for p in pairs]
    assert len(seen) == len(set(seen)) and set(seen) == want
