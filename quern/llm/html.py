"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import narrow_batches, per_text

# Common words of four languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it was on with as be at by this are from or an but not they his her you we he she had have has which were their".split(),
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind".split(),
    "fr": "le la les de des et un une du en que qui dans pour sur pas au par ce il ne se avec plus son sont aux ou mais nous vous est".split(),
    "es": "el la los las de y que en un una por con no para su al lo como más o pero sus le ha me si sin sobre este es se del".split(),
}
_STOPS = frozenset(w for words in STOP_WORDS.values() for w in words)
_WORD = re.compile(r"[^\W\d_]+")

#: Limits of the first pass: shares of linked characters, characters of a short and of a long block, shares of stop words.
LINKED, MOSTLY_LINKED, SHORT_CHARS, LONG_CHARS, FEW_STOPS, MANY_STOPS = 0.25, 0.5, 70, 200, 0.12, 0.25
#: A page is in the language whose list has the largest share of its longer blocks' words, in none of them below this share.
FOREIGN_STOPS = 0.12
#: Share of the good text, of its own and of what stands beside side parts, from which a doubtful side part is none.
MOST_GOOD = 0.75

_RAW = frozenset("script style noscript template textarea iframe svg math object select title".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NESTED = _BLOCKS - _VOID - {"p", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"} | {"a", "button", "span", "label"}
# Elements that never hold main text, and those that seldom do: as doubtful as a name that may stand for the whole page, or less so.
_OUTSIDE = frozenset("button head menu nav search".split())
_SELDOM = {"form": 1, "fieldset": 1, "dialog": 1, "aside": 2, "footer": 2, "header": 2}
_START = re.compile(r"<(?:(?P<note>!--|!\[CDATA\[|[!?])|(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*))")
_QUOTED = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
_END_OF_RAW = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in _RAW}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)

# Names of elements without main text; of such that may wrap it; words that say nothing; words that turn a name round.
_SIDE = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus respond replies reply share sharing related recommended newsletter subscribe subscription pagination pager copyright complementary contentinfo".split())
_PERHAPS = frozenset("banner social signup login popup modal overlay widget toolbar search alert dialog form".split())
_NEUTRAL = frozenset("area bar block body box container content group inner item items list outer panel section site text thread wrap wrapper".split())
_TURNED = frozenset("has no not with without is hide show js".split())
# Words of names that say how a page is laid out or what it holds, so that a side part's word beside them is in doubt.
_LAYOUT = frozenset("article column columns content document entry layout main page post posts primary single story view wide".split())
# Headings over reader comments, after a number or nothing.
_REMARKS = re.compile(r"\W*\d*\W*(?:reader |leser|user )?(?:comments?|responses?|replies|kommentare?|antworten|commentaires?|réponses?|comentarios?|respuestas?)\W*(?:\(?\d+\)?)?\W*", re.IGNORECASE)


def _named(value: str) -> int:
    """3 if a class, id or role names a side part, 2 if it does beside a word of layout, 1 if it may, 0 otherwise. Its last word that says something decides."""
    found = 0
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if not words or words[0] in _TURNED:
            continue
        last = next((w for w in reversed(words) if w not in _NEUTRAL), "")
        found = max(found, (2 if _LAYOUT.intersection(words) else 3) if last in _SIDE else 1 if last in _PERHAPS else 0)
    return found


def _aside(tag: str, attrs: str, in_article: bool) -> tuple[int, int]:
    """(2 for an element that is never main text, 1 where only dense text in it counts, else 0; 2 for a side part by tag or name, 1 for a doubtful one, else 0)."""
    if tag in _OUTSIDE:
        return 2, 0
    found, doubt = 0, 0 if tag == "header" and in_article else _SELDOM.get(tag, 0)
    for name, value in _ATTRIBUTE.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return 2, 0
        if name in ("class", "id", "role"):
            kind = _named(value)
            found, doubt = max(found, int(kind == 1)), max(doubt, kind - 1)
    return found, doubt


@dataclass(slots=True)
class Block:
    """A block's text, its characters inside links, whether it stands aside (2) or perhaps (1), its innermost article or main and side part (0: none)."""

    text: str
    linked: int
    aside: int
    article: int
    heading: bool
    side: int = 0


@dataclass(slots=True)
class SidePart:
    """An element that by its tag or name is a side part: the one around it (0: none), and whether that is in doubt."""

    parent: int
    doubtful: bool


def _tokens(page: str):
    """Yield (text before, tag or None, closing, attributes), the tag in small letters; linear in the page's length.

    Comments and raw elements come as None or as their tag with None as attributes. A quote
    that is never closed ends quoting for the rest of the page.
    """
    at, quotes = 0, True
    while m := _START.search(page, at):
        before, note = page[at : m.start()], m["note"]
        if note:
            close = {"!--": "-->", "![CDATA[": "]]>"}.get(note, ">")
            end = page.find(close, m.end())
            at = len(page) if end < 0 else end + len(close)
            yield before, None, False, ""
            continue
        tag = m["tag"].lower()
        end = -1
        if quotes:
            q = _QUOTED.match(page, m.end())
            quotes = q is not None
            end = q.end() if q else -1
        if end < 0:
            end = page.find(">", m.end()) + 1
            if not end:
                break
        attrs = page[m.end() : end - 1]
        at = end
        if tag in _RAW and not m["close"]:
            q = _END_OF_RAW[tag].search(page, end)
            at = q.end() if q else len(page)
            attrs = None
        yield before, tag, bool(m["close"]), attrs
    yield page[at:], None, False, ""


def blocks_of(page: str) -> tuple[list[Block], list[SidePart]]:
    """The blocks of a page in order, with the characters inside links and where they stand, and its side parts (the first stands for none)."""
    out: list[Block] = []
    sides = [SidePart(0, False)]
    stack: list[tuple[str, int, int, bool, int]] = []  # tag, aside, article, link, side
    held: Counter = Counter()
    aside, article, link, side, heading = 0, 0, False, 0, False
    parts: list[str] = []
    linked = articles = 0

    def end() -> None:
        nonlocal linked
        if parts:
            words = " ".join("".join(parts).split())
            if words:
                out.append(Block(words, linked, aside, article, heading, side))
            parts.clear()
        linked = 0

    for piece, tag, close, attrs in _tokens(page):
        if piece:
            piece = entities.unescape(piece)
            parts.append(piece)
            if link:
                linked += len("".join(piece.split()))
        if tag is None:
            continue
        if attrs is None:
            if tag in ("select", "textarea", "iframe", "object"):
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
        if tag in _BLOCKS:
            end()
            heading = not close and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag not in _NESTED or attrs.endswith("/") and tag in _VOID:
            continue
        if close:
            if held[tag]:
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                before = stack[i - 1] if i else ("", 0, 0, False, 0)
                if tag not in _BLOCKS and (stack[i][1], stack[i][4]) != (before[1], before[4]):
                    end()
                held.subtract(x[0] for x in stack[i:])
                del stack[i:]
            _, aside, article, link, side = stack[-1] if stack else ("", 0, 0, False, 0)
        else:
            kind, doubt = _aside(tag, attrs, article > 0) if tag != "main" else (0, 0)
            if tag == "article" and held["article"]:
                doubt = 2  # an article inside another one is a remark on it
            if (max(aside, kind) != aside or doubt) and tag not in _BLOCKS:
                end()
            if doubt:
                sides.append(SidePart(side, doubt == 1))
                side = len(sides) - 1
            if tag in ("article", "main"):
                articles += 1
                article = articles
            aside, link = max(aside, kind), link or tag == "a"
            stack.append((tag, aside, article, link, side))
            held[tag] += 1
    end()
    return out, sides


def _stops(b: Block, stops: frozenset = _STOPS) -> float:
    words = _WORD.findall(b.text.lower())
    return sum(w in stops for w in words) / max(1, len(words))


def language_list(blocks: list[Block]) -> frozenset | None:
    """The stop words that fit the page's longer blocks best, None if none fits: the page is in another language or too short to tell."""
    words = Counter(w for b in blocks if len(b.text) >= SHORT_CHARS for w in _WORD.findall(b.text.lower()))
    total = sum(words.values())
    best = max(STOP_WORDS.values(), key=lambda stops: sum(words[w] for w in set(stops)))
    if not total or sum(words[w] for w in set(best)) < FOREIGN_STOPS * total:
        return None
    return frozenset(best)


def first_pass(b: Block, stops: frozenset | None = _STOPS) -> str:
    """good, bad, or - where the block alone doesn't tell - near, long or short.

    stops: the stop words of the page's language; None, and length and links decide.
    """
    size = len(b.text)
    links, share = b.linked / max(1, size - b.text.count(" ")), 1.0 if stops is None else _stops(b, stops)
    if links > MOSTLY_LINKED:
        return "bad"
    if size < SHORT_CHARS:
        label = "short" if b.linked == 0 or b.article else "bad"
    elif links <= LINKED and size > LONG_CHARS and share >= MANY_STOPS:
        label = "good"
    elif share >= FEW_STOPS or b.article:
        label = "near"
    else:
        label = "long" if links <= LINKED and size > LONG_CHARS else "bad"
    # what perhaps stands aside must be good by itself
    return "bad" if b.aside and label != "good" else label


def main_sides(blocks: list[Block], labels: list[str], sides: list[SidePart]) -> list[bool]:
    """Which side parts are left out: not those that turn out to hold the page's text.

    A tag or a name is a presumption. It falls if the part holds at least half of all good text
    and, for a doubtful one, MOST_GOOD of its own and of the good text outside all side parts, for
    others, if no good text stands outside. Then those within it are looked at again.
    """
    n, out = len(sides), [True] * len(sides)
    out[0] = False
    good = [0] * n
    for b, label in zip(blocks, labels, strict=True):
        good[b.side] += len(b.text) * (label == "good")
    total, inside = sum(good), list(good)
    for i in range(n - 1, 0, -1):
        inside[sides[i].parent] += inside[i]
    if not total:
        return out
    for _ in range(8):
        gone = [False] * n
        for i in range(1, n):
            gone[i] = out[i] or gone[sides[i].parent]
        free = sum(g for g, x in zip(good, gone) if not x)
        fallen = [i for i in range(1, n) if out[i] and not gone[sides[i].parent] and 2 * inside[i] >= total and (inside[i] >= MOST_GOOD * (inside[i] + free) if sides[i].doubtful else not free)]
        if not fallen:
            break
        while fallen:  # a chain of parts around the same text falls at once
            i = fallen.pop()
            out[i] = False
            fallen += [j for j in range(i + 1, min(n, i + 2)) if sides[j].parent == i and inside[j] == inside[i] and out[j]]
    gone = [False] * n
    for i in range(1, n):
        gone[i] = out[i] or gone[sides[i].parent]
    return gone


def remarks(blocks: list[Block]) -> set[int]:
    """Numbers of the blocks of articles that follow a heading of reader comments, up to the next other heading outside them, and of that heading."""
    out: set[int] = set()
    under: int | None = None
    seen: set[int] = set()
    mine: set[int] = set()
    for i, b in enumerate(blocks):
        if b.article in mine:
            out.add(i)
        elif b.heading and not (under is not None and b.article and b.article not in seen):
            under = i if seen and _REMARKS.fullmatch(b.text) else None
        elif under is not None and b.article and b.article not in seen:
            mine.add(b.article)
            out |= {under, i}
        if b.article not in mine:
            seen.add(b.article)
    return out


def second_pass(blocks: list[Block], labels: list[str]) -> list[bool]:
    """Ambiguous blocks take the label of the nearest decided neighbours.

    In an article or main element its own neighbours count, the nearer one for a short block;
    where nothing in it is decided it is kept. Elsewhere a near block needs one good
    neighbour, a short or a long one two. A heading goes with what follows it. A page on which nothing
    is decided keeps what it has. If articles hold most of what is left, the rest goes.
    """
    regions: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        regions.setdefault(b.article, []).append(i)
    whole = list(range(len(blocks)))
    out = [x == "good" for x in labels]
    for region, own in regions.items():
        decided = any(labels[i] in ("good", "bad") for i in own)
        if not decided and region:
            for i in own:
                out[i] = True
            continue
        order = own if decided else whole
        before, last = {}, -1
        for i in order:
            before[i] = last
            last = i if labels[i] in ("good", "bad") else last
        after, last = {}, -1
        for i in reversed(order):
            after[i] = last
            last = i if labels[i] in ("good", "bad") else last
        for i in own:
            if labels[i] in ("good", "bad"):
                continue
            near = [(abs(i - j), labels[j] != "good") for j in (before[i], after[i]) if j >= 0]
            if not near:
                out[i] = True
            elif blocks[i].heading and after[i] >= 0:
                out[i] = labels[after[i]] == "good"
            elif labels[i] == "near":
                out[i] = not all(bad for _, bad in near)
            elif labels[i] == "long":
                out[i] = not any(bad for _, bad in near)
            else:
                out[i] = not min(near)[1] if region else not any(bad for _, bad in near)
    held = [len(b.text) * keep for b, keep in zip(blocks, out, strict=True)]
    rest = 2 * sum(n for b, n in zip(blocks, held, strict=True) if b.article) < sum(held)
    return [keep and (b.article > 0 or rest) for b, keep in zip(blocks, out, strict=True)]


def main_text(page: str | None) -> str:
    """The page's main text: kept blocks in page order, one line each."""
    if not page:
        return ""
    blocks, sides = blocks_of(page)
    blocks = [b for b in blocks if b.aside < 2]
    stops = language_list(blocks)
    labels = [first_pass(b, stops) for b in blocks]
    gone, told = main_sides(blocks, labels, sides), remarks(blocks)
    left = [i for i, b in enumerate(blocks) if not gone[b.side] and i not in told]
    blocks, labels = [blocks[i] for i in left], [labels[i] for i in left]
    return "\n".join(b.text for b, keep in zip(blocks, second_pass(blocks, labels), strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with text, the main text of each whole page; a null or empty page gives an empty text.

    First pass: length, link density and the density of the stop words of the page's language
    decide blocks; on a page in a language without a list of stop words length and links do.
    Elements that by tag or name hold notices, adverts, forms or comments are left out then,
    unless they hold the page's good text; menus and hidden elements never count. Second pass:
    the undecided inherit from the nearest decided blocks. White space inside a block becomes one
    space. A column of the result's name gives way; repeated rows stay.
    """
    narrow_batches(pages.sparkSession)

    def setup():
        return lambda batch: [main_text(p) for p in batch]

    out = pages.withColumn("_main", per_text(setup, pa.string(), html, as_bytes=False))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns if c != text], F.col("_main").alias(text))
