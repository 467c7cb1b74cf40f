"""Personal data by candidate gradient boosting, with DataFrame functions only.

Exact patterns with checks (digit sums, ranges, lengths) give the base spans. Looser
generators propose more, overlapping spans. All candidates of the corpus are counted by
their format and context features, a table whose size is bounded by the features' values.
Boosted trees of depth two learn from those counts which features go with a confirmed span;
a threshold per kind, calibrated on the confirmed ones, picks which other candidates are
redacted as well. The trees are applied as column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Patterns as Java reads them. Possessive repeats and the guards in front change no match
# (a run of the class either matches from its start, or from where the last match ended).
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
_HOLDS = {"email": "@", "phone": "+"}
_LOOKS = {"ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}"}
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{3,4}(?:[\x20._-]?[0-9]{3,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00|\()?[0-9][\x20()./0-9-]{6,20}[0-9](?![0-9])",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_CHUNK = 128


def _parts(text: Column, kind: str, pattern: str, loose: bool) -> Column:
    """Matches of the pattern and the texts between them, as (hits, gaps)."""
    if loose:
        try_it = F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]") if kind == "email" else text.rlike("[0-9]{3}")
        try_it = text.rlike(r"[0-9] ?\. ?[0-9]") if kind == "ip" else try_it
        try_it = text.rlike(r"[0-9][\x20()./0-9-]{6,20}[0-9]") if kind == "phone" else try_it
    else:
        try_it = F.contains(text, F.lit(_HOLDS[kind])) if kind in _HOLDS else text.rlike(_LOOKS[kind])
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(try_it, found)


def settled(docs: DataFrame, names: list[str]) -> DataFrame:
    """The same rows; these columns are worked out once, however often they are used later.

    Spark copies an expression into each place that uses it, filters included, but not
    across a generated row.
    """
    others = [c for c in docs.columns if c not in names]
    packed = docs.select(*others, F.explode(F.array(F.struct(*names))).alias("settled__"))
    return packed.select(*others, *[F.col(f"settled__.{n}").alias(n) for n in names])


_EMPTY = "array<struct<kind:string,start:int,end:int,hit:string>>"


def _with_spans(docs: DataFrame, text: Column, patterns: dict[str, str], loose: bool) -> DataFrame:
    """``docs`` with a column per kind, ``spans_<kind>``: array of (kind, start, end, hit) in code points.

    A match ends after all gaps and matches up to it. Their lengths are summed per chunk
    first, so many matches in one text stay cheap. Each step is a column of its own that
    later ones use twice, or Spark would put its expression into the per-match function.
    """
    found = docs.withColumns({f"parts_{k}": _parts(text, k, patterns[k], loose) for k in KINDS})
    found = settled(found, [f"parts_{k}" for k in KINDS])
    add = lambda a, x: a + x
    zero = F.lit(0)

    def steps(k: str) -> Column:
        hits, gaps = F.col(f"parts_{k}.hits"), F.col(f"parts_{k}.gaps")
        return F.when(F.size(hits) > 0, F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h)))

    def sums(k: str) -> Column:
        own = F.col(f"steps_{k}")
        chunks = F.sequence(zero, F.floor((F.size(own) - 1) / _CHUNK).cast("int"))
        return F.when(
            F.size(own) > 0, F.transform(chunks, lambda j: F.aggregate(F.slice(own, j * _CHUNK + 1, F.lit(_CHUNK)), zero, add))
        )

    def spans(k: str) -> Column:
        own, before = F.col(f"steps_{k}"), F.col(f"sums_{k}")

        def located(h: Column, i: Column) -> Column:
            chunk = F.floor(i / _CHUNK).cast("int")
            end = F.aggregate(F.slice(before, F.lit(1), chunk), zero, add) + F.aggregate(
                F.slice(own, chunk * _CHUNK + 1, i % _CHUNK + 1), zero, add
            )
            return F.struct((end - F.length(h)).alias("start"), end.alias("end"), h.alias("hit"))

        return F.when(F.size(before) > 0, F.transform(F.col(f"parts_{k}.hits"), located))

    def named(k: str) -> Column:
        full = F.transform(
            f"places_{k}",
            lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")),
        )
        return F.when(F.size(f"places_{k}") > 0, full).otherwise(F.array().cast(_EMPTY))

    for name, make in (("steps", steps), ("sums", sums), ("places", spans), ("spans", named)):
        found = found.withColumns({f"{name}_{k}": make(k) for k in KINDS})
    found = found.drop(*[f"{p}_{k}" for p in ("parts", "steps", "sums", "places") for k in KINDS])
    return settled(found, [f"spans_{k}" for k in KINDS])


def matches(text: Column, pattern: str) -> Column:
    """array of (start, end) of a pattern's matches; for patterns with few matches a text."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    span = "struct<start:int,end:int>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def add(done: Column, s: Column) -> Column:
        begin = done["at"] + s["g"]
        found = F.struct(begin.alias("start"), (begin + s["h"]).alias("end"))
        return F.struct((begin + s["h"]).alias("at"), F.concat(done["out"], F.array(found)).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, add, lambda d: d["out"])).otherwise(F.array().cast(f"array<{span}>"))


def _luhn(digits: Column) -> Column:
    reverse = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with ``base``: confirmed spans (kind, start, end, hit), by kind as listed and then by start."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = _with_spans(docs, text, BASE, False)
    valid = [F.filter(F.col(f"spans_{k}"), lambda s: _valid(k, s["hit"])) for k in KINDS]
    return settled(found.withColumn("base", F.concat(*valid)).drop(*[f"spans_{k}" for k in KINDS]), ["base"])


#: Feature -> number of values. Their product, times kinds and labels, bounds the table of counts.
FEATURES = {"digits": 5, "groups": 4, "separator": 5, "prefix": 4, "before": 6, "after": 3, "check": 2}


def _features(kind: str, text: Column, span: Column) -> list[Column]:
    """Small numbers from the format of a candidate and the characters around it."""
    hit = span["hit"]
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    left = F.lower(F.substring(text, F.greatest(span["start"] - 15, F.lit(1)), F.least(span["start"], F.lit(16))))
    right = F.substring(text, span["end"] + 1, F.lit(1))
    groups = F.size(F.split(hit, "[^0-9A-Za-z]+"))
    case = lambda pairs, other: F.coalesce(*[F.when(c, F.lit(v)) for v, c in enumerate(pairs)], F.lit(other))
    return [
        case([n == 0, n < 7, n < 11, n < 13], 4),
        case([groups <= 1, groups <= 3, groups <= 5], 3),
        case([hit.rlike("[ ]"), hit.contains("-"), hit.rlike(r"[()/]"), hit.contains(".")], 4),
        case([hit.startswith("+"), hit.startswith("("), hit.startswith("0")], 3),
        case(
            [
                left == "",
                left.rlike("(?:tel|phone|call|fax|mobil|m[oó]vil|t[eé]l[eé]|anruf|llam)"),
                left.rlike("(?:mail|contact|kontakt|correo|courriel)"),
                left.rlike("(?:ip|host|server|addr|card|visa|master|karte|carte|tarjeta)"),
                left.rlike(r"[\p{L}\p{N}]$"),
            ],
            5,
        ),
        case([right == "", right.rlike(r"[\p{L}\p{N}]")], 2),
        _valid(kind, F.regexp_replace(hit, r"[\x20._-]", "" if kind == "card" else "$0")),
    ]


def candidates(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` (with ``base``) and ``loose``: candidates that no base span overlaps or that equal one.

    Each candidate is (kind, start, end, hit, confirmed, features).
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = _with_spans(docs, text, LOOSE, True)
    all_kinds = []
    for kind in KINDS:
        touching = lambda s: F.filter("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        marked = F.transform(
            F.col(f"spans_{kind}"),
            lambda s: F.struct(
                s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), touching(s).alias("near"),
                *[f.cast("int").alias(name) for name, f in zip(FEATURES, _features(kind, text, s))],
            ),
        )
        kept = F.filter(
            marked,
            lambda s: (F.size(s["near"]) == 0)
            | F.exists(s["near"], lambda b: (b["kind"] == kind) & (b["start"] == s["start"]) & (b["end"] == s["end"])),
        )
        all_kinds.append(kept)
    out = found.withColumn("loose", F.concat(*all_kinds))
    return settled(out.drop(*[f"spans_{k}" for k in KINDS]), ["loose"])


@dataclass
class Trees:
    """Boosted trees over feature values; each tree is (feature, value, left, right) or a number."""

    start: float
    trees: list = field(default_factory=list)
    threshold: dict = field(default_factory=dict)


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int, rate: float):
    """Tree by second-order gain; splits are ``feature <= value``."""
    total_g, total_h = slope.sum(), curve.sum()
    leaf = float(-rate * total_g / (total_h + 1.0))
    if not depth or not len(x):
        return leaf
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            g, h = slope[left].sum(), curve[left].sum()
            gain = g * g / (h + 1.0) + (total_g - g) ** 2 / (total_h - h + 1.0) - total_g**2 / (total_h + 1.0)
            if gain > best[0]:
                best = (gain, f, int(v))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return (
        best[1],
        best[2],
        _grow(x[left], slope[left], curve[left], depth - 1, rate),
        _grow(x[~left], slope[~left], curve[~left], depth - 1, rate),
    )


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _apply(tree[2], x), _apply(tree[3], x))


def fit(counts: list[tuple], rounds: int = 12, rate: float = 0.5, precision: float = 0.95, least: int = 20) -> Trees:
    """Trees and thresholds from rows (kind, *features, confirmed, n).

    A kind's threshold is the lowest score, of at least even odds, from which on at least
    ``precision`` of its candidates are confirmed, with ``least`` of them confirmed; without
    one, nothing is added.
    """
    if not counts:
        return Trees(0.0)
    x = np.array([(KINDS.index(r[0]), *r[1:-2]) for r in counts], dtype=np.int64)
    y = np.array([bool(r[-2]) for r in counts], dtype=float)
    n = np.array([r[-1] for r in counts], dtype=float)
    share = np.clip((n * y).sum() / n.sum(), 1e-6, 1 - 1e-6)
    model = Trees(float(np.log(share / (1 - share))))
    score = np.full(len(x), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, n * (p - y), n * p * (1 - p), 2, rate)
        model.trees.append(tree)
        score = score + _apply(tree, x)
    for k, kind in enumerate(KINDS):
        own = x[:, 0] == k
        for bar in np.unique(score[own & (score >= 0)]):
            above = own & (score >= bar - 1e-9)
            good, all_ = (n * y)[above].sum(), n[above].sum()
            if good >= max(least, precision * all_):
                model.threshold[kind] = float(bar) - 1e-6
                break
    return model


def _score(model: Trees, values: list[Column]) -> Column:
    def one(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(values[tree[0]] <= tree[1], one(tree[2])).otherwise(one(tree[3]))

    total = F.lit(model.start)
    for tree in model.trees:
        total = total + one(tree)
    return total


def train(docs: DataFrame, text_column: str = "text") -> Trees:
    """Trees from the counts of all candidates of the corpus."""
    rows = candidates(base_spans(docs.select(F.col(text_column).alias("text")))).select(F.explode_outer("loose").alias("c")).filter("c is not null")
    counted = rows.groupBy("c.kind", *[f"c.{f}" for f in FEATURES], (F.size("c.near") > 0).alias("confirmed")).agg(F.count("*").alias("n"))
    order = sorted(counted.collect())
    return fit([tuple(r) for r in order])


def find_personal_data(docs: DataFrame, model: Trees, text_column: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (kind, start, end): the base spans and those the trees add.

    Starts and ends are code points, ends exclusive; ``spans`` is sorted by kind as listed and
    start. A null or empty text has none. All columns stay; ``base``, ``spans`` and ``loose``
    would clash and are refused. Repeated rows each give a row.
    """
    clash = {"base", "spans", "loose"} & set(docs.columns)
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    found = base_spans(docs, text_column)
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    if not model.threshold:
        return found.withColumn("spans", plain)
    found = candidates(found, text_column)

    def chosen(s: Column) -> Column:
        kind = F.coalesce(*[F.when(s["kind"] == k, F.lit(i)) for i, k in enumerate(KINDS)])
        score = _score(model, [kind, *[s[f] for f in FEATURES]])
        passes = F.lit(False)
        for k, bar in model.threshold.items():
            passes = passes | ((s["kind"] == k) & (score >= bar))
        return (F.size(s["near"]) == 0) & passes

    picked = F.transform(F.filter("loose", chosen), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    found = settled(found.withColumn("added", picked), ["added"])
    both = F.concat(plain, F.col("added"))
    by_kind = [F.array_sort(F.filter(both, lambda s: s["kind"] == k)) for k in KINDS]
    return found.withColumn("spans", F.when(F.size("added") == 0, plain).otherwise(F.concat(*by_kind))).drop("loose", "added")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def add(done: Column, s: Column) -> Column:
        between = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.when(s["start"] >= done["at"], F.concat(done["out"], between, mark)).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], s["end"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, start, add, rest)).otherwise(text)
