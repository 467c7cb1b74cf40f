"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block-level tags. The first pass decides the clear ones:
what stands in navigation, adverts, forms and the like is out; so is what is mostly links;
long blocks with many stop words are in, and so are blocks of the element that the page
itself marks as its article. A form, or a class or id that hints at such a part, does not
put out what holds the article or most of the text. In the second pass the blocks that are
short, or fair but not clear, take the label of the nearest decided neighbours.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantweave.llm import store

# Common function words of four languages.
STOP_WORDS = frozenset(
    """
    the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which
    one you were all her she there would their we him been has when who will no more if out so up said what its
    der die das und ist von den mit des im ein eine zu für auf dem nicht sich als auch es an werden aus er hat dass
    sie nach bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis
    le la les de des et un une du en est que qui dans pour par sur au pas plus ne se ce il sont avec aux ou son sa
    elle nous vous mais comme tout cette ses leur
    el los las una y que del se con por para su al lo como más pero sus le ya este sí porque esta entre cuando muy sin
    """.split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*|[^>]*)(?:>|\Z)",
    re.S,
)
_HINTS = re.compile(r"""\b(class|id|role|aria-label|hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr"
    r"|notices?|alert|sidebars?|side-?bar|menus?|nav\w*|breadcrumbs?|footers?|headers?|masthead|topbar|toolbar|comments?"
    r"|commentlist|disqus|repl(?:y|ies)|responses|related|recommend\w*|share|sharing|social|newsletter|subscri\w+|signup"
    r"|popup|modal|overlay|widgets?|pagination|pager|login|search|skip-?link|tags?|author-?box|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
# Names of states and topics, which say nothing of what their element is.
_STATES = re.compile(r"(?:has|no|not|with|without|is|category|tag(?![_-](?:cloud|list|links?)))[_-]", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
_RAW = frozenset("script style textarea title xmp noscript template svg math iframe object canvas select option datalist".split())
_FORMS = frozenset(("form", "fieldset"))
_OUT = frozenset("nav footer aside button menu dialog label input head audio video applet".split())
_MAIN = frozenset(("article", "main"))
_BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th
    thead tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass(frozen=True)
class Rules:
    """Thresholds: densities are shares of words (stop words) and of characters (links)."""

    link_density: float = 0.33
    short: int = 70
    long: int = 200
    stop_high: float = 0.30
    stop_low: float = 0.12


@dataclass
class Block:
    text: str
    linked: int
    out: bool
    main: bool
    heading: bool
    place: int  # number of the element that holds the block
    hints: tuple[int, ...] = ()  # numbers of the elements around it that hint at no content
    mains: tuple[tuple[int, str], ...] = ()  # numbers and tags of the articles around it
    label: str = ""


def _marked_out(tag: str, attrs: str) -> bool:
    if tag in _OUT:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _HINTS.findall(attrs):
        value, name = value.strip("\"'"), name.lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
    return False


def _hinted_out(tag: str, attrs: str) -> bool:
    """Whether a form, or a name in a class or id, hints that the element is no content."""
    if tag in _FORMS:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _HINTS.findall(attrs):
        value, name = value.strip("\"'"), name.lower()
        if name == "role" and value.lower() == "form":
            return True
        if name in ("class", "id") and any(_BOILERPLATE.search(x) and not _STATES.match(x) for x in value.split()):
            return True
    return False


def _follow_hints(found: list[Block]) -> None:
    """Put out what stands in hinted elements, but for those that hold the article or most of the text.

    The article is the one in the fewest hinted elements, of these an ``article`` before a
    ``main``, then the longest. A hinted element inside it must not hold most of its text;
    without any article none may hold most of the page's. Links do not count as text.
    """
    size: Counter[int] = Counter()
    around: dict[tuple[int, str], tuple[int, ...]] = {}
    total = 0
    for b in found:
        n = 0 if b.out else len(b.text) - b.linked
        if n <= 0:
            continue
        total += n
        size.update(dict.fromkeys([*b.hints, *(number for number, _ in b.mains)], n))
        for m in b.mains:
            if m not in around:
                around[m] = tuple(h for h in b.hints if h < m[0])  # numbers grow inwards
    article = min(around, key=lambda m: (len(around[m]), m[1] != "article", -size[m[0]]), default=None)
    hints = {h for b in found for h in b.hints}
    if article is None:
        wrong = {h for h in hints if 2 * size[h] > total}
    else:
        inside = {h for b in found if article in b.mains for h in b.hints if h > article[0]}
        wrong = {*around[article], *(h for h in inside if 2 * size[h] > size[article[0]])}
    for b in found:
        b.out = b.out or any(h not in wrong for h in b.hints)


def _raw_end(page: str, tag: str, start: int) -> int:
    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, start)
    return found.end() if found else len(page)


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, with how much of each is linked and where it stands."""
    out: list[Block] = []
    # Open elements, whether they are marked as no content, their numbers, and whether they hint at no content.
    stack: list[tuple[str, bool, int, bool]] = []
    parts: list[str] = []
    linked = breaks = 0
    heading = False

    def close() -> None:
        nonlocal linked, parts, breaks
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            place = next((n for t, _, n, _ in reversed(stack) if t not in ("p", "a") and t not in _HEADINGS), 0)
            is_out = any(x for _, x, _, _ in stack)
            hints = tuple(n for _, _, n, h in stack if h)
            mains = tuple((n, t) for t, _, n, _ in stack if t in _MAIN)
            out.append(Block(text, min(linked, len(text)), is_out, bool(mains), heading, place, hints=hints, mains=mains))
        parts, linked, breaks = [], 0, 0

    def add(piece: str) -> None:
        nonlocal linked, breaks
        if piece:
            parts.append(piece)
            if piece.strip():
                breaks = 0
                if any(t == "a" for t, _, _, _ in stack):
                    linked += len(" ".join(html.unescape(piece).split()))

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        token = _TOKEN.match(page, lt) if lt >= 0 else None
        if lt < 0:
            add(page[at:])
            break
        if token is None:  # a lone "<" is text
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if tag == "br":
            breaks += 1
            if breaks >= 2:
                close()
            else:
                parts.append(" ")
            continue
        if tag in _BLOCK:
            close()
            if stack and stack[-1][0] == "p":  # a paragraph ends where another block begins or ends
                stack.pop()
        if token["end"]:
            if any(t == tag for t, _, _, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            heading = heading and tag not in _HEADINGS
            continue
        if tag in _RAW:
            at = _raw_end(page, tag, at)
            continue
        if tag in _VOID or token["attrs"].endswith("/") and tag not in _BLOCK:
            continue
        if tag in _MAIN:
            # What was never closed before the article does not swallow it.
            closed = {t: re.search(f"</{t}", page[at:], re.I) is not None for t, x, _, h in stack if x or h}
            stack = [(t, x and closed[t], n, h and closed[t]) for t, x, n, h in stack]
        if tag in _HEADINGS:
            heading = True
        marked, hinted = _marked_out(tag, token["attrs"]), _hinted_out(tag, token["attrs"])
        if tag in _BLOCK and tag not in ("hr", "html", "body") or tag == "a" or marked or hinted:
            if tag in ("li", "td", "th", "tr", "dd", "dt") and stack and stack[-1][0] == tag:
                stack.pop()
            inside_main = any(t in _MAIN for t, _, _, _ in stack)
            page_header = tag == "header" and not inside_main
            stack.append((tag, page_header or marked, at, hinted))
    close()
    _follow_hints(out)
    return out


def _first_pass(block: Block, rules: Rules) -> str:
    words = [w.strip(".,;:!?()\"'").lower() for w in block.text.split()]
    stops = sum(w in STOP_WORDS for w in words) / len(words)
    if block.out or block.linked / len(block.text) > rules.link_density:
        return "bad"
    if block.main:
        return "good"
    if "©" in block.text:
        return "bad"
    if len(block.text) < rules.short:
        return "bad" if block.linked else "short"
    if stops >= rules.stop_high:
        return "good" if len(block.text) > rules.long else "fair"
    return "fair" if stops >= rules.stop_low else "bad"


def label_blocks(found: list[Block], rules: Rules = Rules()) -> None:
    """Both passes; every block ends up ``good`` or ``bad``."""
    first = [_first_pass(b, rules) for b in found]

    def decided(labels: list[str]) -> tuple[list[int | None], list[int | None]]:
        """For each block the nearest decided ones before and after it."""
        before: list[int | None] = []
        after: list[int | None] = []
        for order, out in ((range(len(labels)), before), (range(len(labels) - 1, -1, -1), after)):
            seen = None
            for i in order:
                out.append(seen)
                seen = i if labels[i] in ("good", "bad") else seen
        return before, after[::-1]

    # A fair block is out only between blocks that are out.
    before, after = decided(first)
    second = list(first)
    for i, label in enumerate(first):
        if label == "fair":
            near = [first[j] for j in (before[i], after[i]) if j is not None]
            second[i] = "good" if not near or "good" in near or "fair" in first[max(0, i - 1) : i] + first[i + 1 : i + 2] else "bad"
    # A short block is like the nearest decided one; a heading like the next one. Of two
    # that are equally near, the one in the same element counts, else the one that is out.
    before, after = decided(second)
    for i, block in enumerate(found):
        label, b, a = second[i], before[i], after[i]
        if label == "short":
            if a is not None and (b is None or block.heading or a - i < i - b):
                label = second[a]
            elif b is not None and (a is None or i - b < a - i or second[a] == second[b]):
                label = second[b]
            elif b is not None:
                same = [second[j] for j in (b, a) if found[j].place == block.place]
                label = same[0] if len(same) == 1 else "bad"
            else:
                label = "bad"
        block.label = label


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    found = blocks(page or "")
    label_blocks(found, rules)
    return "\n".join(b.text for b in found if b.label == "good")


def extract_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", rules: Rules = Rules()
) -> DataFrame:
    """Per page: ``id_column``, ``url_column``, ``text`` (good blocks, one a line) and ``n_chars`` (code points).

    Character references are decoded, white space in a block becomes one blank. A null,
    empty or content-free page has an empty text. Repeated rows each give a row; null ids
    and addresses stay null; other columns are not read.
    """
    schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in store.slices(batches, "html", 1 << 20):
            texts = [main_text(p, rules) for p in batch.column("html").to_pylist()]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]  # a reference may name half a surrogate pair
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string())], schema=schema)

    rows = pages.select(
        F.col(id_column).cast("long").alias("key"), F.col(url_column).cast("string").alias("url"), F.col(html_column).alias("html")
    )
    found = rows.mapInArrow(run, "key long, url string, text string")
    return found.select(
        F.col("key").alias(id_column), F.col("url").alias(url_column), "text", F.length("text").cast("long").alias("n_chars")
    )
