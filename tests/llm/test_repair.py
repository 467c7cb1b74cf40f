"""Conversation repair against exhaustive search, plain loops and SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from plantweave.llm import conversations, queries, repair
from plantweave.llm.repair import Fold, Row, search

ALLOWED = re.compile(r"(s?(ua)+)?")


def by_hand(rows):
    """(cost, audit) of the cheapest edits, by trying all of them with up to two inserts at each place."""
    best = None
    places = len(rows) + 1
    choices = [["D"] if r.forced else ["K", "Ru", "Ra", "D"] for r in rows]
    for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=places):
        for edits in itertools.product(*choices):
            roles, audit, cost = inserts[0], "I" * len(inserts[0]), 3 * sum(map(len, inserts))
            for row, edit, more in zip(rows, edits, inserts[1:]):
                cost += {"K": 0, "R": 3, "D": 4}[edit[0]] + (3 if row.truncated and edit != "D" else 0)
                roles += {"K": row.initial, "D": ""}.get(edit, edit[1:]) + more
                audit += edit[0] + "I" * len(more)
            if ALLOWED.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def some_rows(rng, n, more=0):
    return [Row(rng.choice("ssuuuaaax"), rng.random() < 0.2, rng.random() < 0.2, rng.randint(0, more)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_search_finds_the_best_of_all_edits(seed):
    rows = some_rows(random.Random(seed), seed % 5)
    assert search(rows, repair.EMPTY, repair.WHOLE) == by_hand(rows)


def dynamic(rows):
    """The same optimum by dynamic programming, for long sequences."""
    open_ = {repair.EMPTY: (0, "")}
    for row in rows:
        new = {}
        for state, (cost, audit) in open_.items():
            for c, letters, after in repair._choices(row, state):
                one = (cost + c + 4 * row.more, audit + letters + "D" * row.more)
                new[after] = min(one, new.get(after, one))
        open_ = new
    return min((c + 3 * repair._CLOSE[s], a + "I" * repair._CLOSE[s]) for s, (c, a) in open_.items())


@pytest.mark.parametrize("seed", range(30))
def test_pieces_fold_to_the_search_over_the_whole(seed):
    rng = random.Random(seed)
    rows = some_rows(rng, rng.randint(1, 300), more=2)
    want = dynamic(rows)
    assert search(rows, repair.EMPTY, repair.WHOLE) == want
    fold, parts, at, held = Fold(), [], 0, 0
    while at < len(rows):
        piece = rows[at : at + rng.randint(1, 40)]
        at += len(piece)
        paths = {(a, b): f for a in range(4) for b in range(4) if (f := search(piece, a, b))}
        parts += fold.add(at, paths)
        held = max(held, len(fold.pending))
    cost, end, left = fold.close()
    assert (cost, "".join(a for _, a in parts + left) + end) == want
    assert [t for t, _ in parts + left] == sorted(t for t, _ in parts + left)
    assert held <= 16  # pieces are settled as the fold goes on


def test_search_stays_small_on_long_sequences(monkeypatch):
    """Dominance and bounds keep the number of prefixes in proportion to the rows on ordinary damage."""
    steps = []
    for n in (100, 200, 400):
        rows = [Row("ua"[(i + i // 9) % 2], i % 11 == 0, i % 7 == 0, 0) for i in range(n)]
        made = [0]

        class Counted(dict):
            def __setitem__(self, key, value):
                made[0] += 1
                super().__setitem__(key, value)

        monkeypatch.setattr(repair, "_Reached", Counted)
        assert search(rows, repair.EMPTY, repair.WHOLE) == dynamic(rows)
        steps.append(made[0])
    assert steps[2] <= 3 * steps[1] <= 9 * steps[0]


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def repaired_by_hand(rows):
    result, after = [], damaged_by_hand(rows)
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in after if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        units, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            units.append(Row(role[:1], fault in ("blank", "duplicate"), fault == "truncated", 0))
        cost, audit = dynamic(units)
        turns = {r[0] for r in own if r[0] is not None}
        illegal = sum(a.initial + b.initial not in ("su", "ua", "au") for a, b in zip(units, units[1:]))
        out, at = [], iter(own)
        for letter in audit:
            due = "assistant" if out and out[-1].startswith("u") else "user"
            if letter == "I":
                out.append(due + ":")
                continue
            _, role, text = next(at)
            if letter != "D":
                out.append(f"{role if letter == 'K' else due}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
        result.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha))
    return sorted(result, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, conv string, part int, audit string"


def talk(rng, conv, n):
    texts = ["Yes.", "No!", "why", "", " \n", "Long text. And more?", "Ünï. ", None, "日本"]
    roles = ["user", "assistant", "system", "tool", "", None]
    rows = []
    for i in range(n):
        turn = rng.choice([i, i, i, i // 2, None])
        rows.append((conv, turn, rng.choice(roles[:2] * 4 + roles), rng.choice(texts) if rng.random() < 0.5 else f"text {i}.", "x", i, "K"))
    return rows


@pytest.mark.parametrize("piece", [3, 64])
def test_odd_rows(spark, piece):
    """Nulls in any column, equal rows, ties, blank and long texts, clashing names; one conversation holds most rows."""
    rng = random.Random(piece)
    rows = [r for c in [*range(30), None] for r in talk(rng, c, rng.randint(1, 7))] + talk(rng, 99, 400)
    rows += [(7, 1, "user", "word " * 200_000 + ".", "x", 0, "D")] * 3
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = conversations.repair_conversations(df, piece=piece).collect()
    assert sorted(map(tuple, got), key=str) == repaired_by_hand([r[:4] for r in rows])


def test_empty_table(spark):
    assert conversations.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conversations.repair_conversations(spark.createDataFrame([(conv, 0, "user", "a.", "x", 0, "")], SCHEMA)).first()
    assert tuple(got) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_are_alternating(spark):
    """What the audit leaves is an allowed sequence of roles."""
    rows = [r for c in range(20) for r in talk(random.Random(c), c, 6)]
    for row in conversations.repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect():
        kept = sum(letter != "D" for letter in row["audit"])
        assert set(row["audit"]) <= set("KRDI") and (kept % 2 == 0 or kept >= 3)


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    rows = [r for c in [*range(40), None] for r in talk(random.Random(c), c, 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cur = con.execute(queries.ORACLES["op11_conversation_repair"])
    names = [d[0] for d in cur.description]
    got = queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).select(*[F.col(n) for n in names]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(cur.fetchall(), key=str)
