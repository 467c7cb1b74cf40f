"""Topic and path text: cleaning, joining, and pattern translation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, the wildcards and the separator. A run of them and of
# underscores becomes one underscore.
UNSAFE_RUN = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}+#/\x00_]+"
)
UNNAMED = "unnamed"

_CLEAN = r"^[0-9A-Za-z.:,;()=\-]+(?:_[0-9A-Za-z.:,;()=\-]+)*$"


def nfc(text: Column) -> Column:
    """Canonical composition; only text with a non-ASCII character pays for it."""
    composed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)
    )
    return F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(text)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _clean_segment(text: Column, max_length: int) -> Column:
    clean = F.btrim(F.regexp_replace(nfc(text), UNSAFE_RUN, "_"), F.lit("_"))
    return _once(
        clean,
        lambda c: F.when(c == "", UNNAMED)
        .when(
            F.length(c) > max_length,
            F.regexp_replace(F.substring(c, 1, max_length), "_[^_]*$", ""),
        )
        .otherwise(c),
    )


def sanitize_segment(text: Column, max_length: int = 64) -> Column:
    """One topic segment: composed, no white space or wildcards, bounded length."""
    clean = (F.length(text) <= max_length) & text.rlike(_CLEAN)
    return (
        F.when(text.isNull() | (text == ""), F.lit(UNNAMED))
        .when(clean, text)
        .otherwise(_clean_segment(text, max_length))
    )


def sanitize_topic(topic: Column, separator: str = "/") -> Column:
    """Clean every non-empty segment of a topic and join them again."""
    parts = F.filter(F.split(topic, re.escape(separator)), lambda s: s != "")
    joined = F.array_join(F.transform(parts, lambda s: sanitize_segment(s)), separator)
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(UNNAMED))


def sanitize_metric_path(path: Column) -> Column:
    """``A.B[0].C`` becomes ``A/B/a0a/C`` with clean segments."""
    plain = path.rlike(r"^[0-9A-Za-z]{1,64}(?:\.[0-9A-Za-z]{1,64})*$")
    slashed = F.regexp_replace(F.replace(path, F.lit("."), F.lit("/")), r"\[(\d+)\]", "/a$1a")
    return F.when(plain, F.replace(path, F.lit("."), F.lit("/"))).otherwise(
        sanitize_topic(slashed)
    )


def topic_path_to_api_path(path: Column) -> Column:
    """Inverse of the index marker: ``List/a0a/Value`` becomes ``List[0].Value``."""
    pieces = F.transform(
        F.split(path, "/"),
        lambda part: F.when(
            part.rlike("^a[0-9]+a$"), F.concat(F.lit("["), F.regexp_replace(part, "a", ""), F.lit("]"))
        ).otherwise(F.concat(F.lit("."), part)),
    )
    return F.regexp_replace(F.array_join(pieces, ""), r"^\.", "")


def last_id_part(asset_id: Column) -> Column:
    """Text after the last ``/`` and then after the last ``#``."""
    return F.substring_index(F.substring_index(asset_id, "/", -1), "#", -1)


def without_scheme(asset_id: Column) -> Column:
    return F.replace(
        F.replace(asset_id, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")
    )


def join_topic(*parts: Column) -> Column:
    """Join the non-empty parts with ``/``."""
    return F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts])


def _glob_set(negated: str, members: str) -> str:
    """Bracket of a glob as a character class; a backward range holds nothing."""
    members = re.sub(r"(.)-(.)", lambda m: "" if m[1] > m[2] else m[0], members, flags=re.S)
    if not members:
        return "." if negated else "(?!)"
    return "[" + ("^" if negated else "") + re.sub(r"([\\\[\]^&])", r"\\\1", members) + "]"


def glob_to_regex(pattern: str) -> str:
    """Whole-string regular expression for a shell glob; ``*`` also crosses ``/``.

    A bracket that is empty or never closed is literal text.
    """
    body = re.sub(
        r"(\*)|(\?)|\[(?:(!)(\][^\]]*|[^\]]+)|(?!!)(\][^\]]*|[^\]]+))\]|(.)",
        lambda m: ".*" if m[1] else "." if m[2] else re.escape(m[6]) if m[6] is not None else _glob_set(m[3], m[4] or m[5]),
        pattern,
        flags=re.S,
    )
    return f"(?s)^{body}\\z"


def topic_filter_to_regex(topic_filter: str) -> str:
    """Regular expression for a subscription filter with ``+`` and a final ``#``."""
    levels = topic_filter.split("/")
    tail = ""
    if levels[-1] == "#":
        levels = levels[:-1]
        tail = "(?:/.*)?" if levels else ".*"
    body = "/".join("[^/]*" if level == "+" else re.escape(level) for level in levels)
    hidden = r"(?!\$)" if not topic_filter.startswith("$") else ""
    return f"(?s)^{hidden}{body}{tail}\\z"
