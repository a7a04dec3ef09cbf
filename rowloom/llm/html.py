"""Main text of web pages by two passes of block rules.

The first pass cuts a page into blocks at block-level tags and judges each by itself: where it stands,
how many of its characters are links, how long it is, and how dense its stop words are. The second
gives blocks too short to judge the label of the nearest decided neighbours: good between good
ones, bad between bad ones, otherwise that of the nearer by characters.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import text_batches

# fixed values: frequent function words of the languages on the pages
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for on with as was are be by at this from or an not but have had his her they you we
    der die das und ist nicht ein eine zu den von mit sich des auf für im dem auch es an als wie er sie wir ihr werden
    le la les de des et un une du en est que qui dans pour pas au sur ne ce plus par avec il elle nous vous sont
    el los las y del que se por con una su para no lo como más al sus pero son este esta
    """.split()
)
# fixed values: tags that end a block, tags without text, tags whose content is not main text
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td
    tfoot th thead tr ul
    """.split()
)
OUTSIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
#: sections that hold others and are closed explicitly
NESTING_TAGS = OUTSIDE_TAGS | frozenset("article main header section div ul ol table figure details dl td tr li span a".split())
MAIN_TAGS = frozenset(("article", "main"))
#: words in a class, id or role that mark what stands around the main text
_AROUND = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|respond|replies|cookies?|consent|gdpr|footer|masthead|menu|modal|nav|navbar|navigation"
    r"|newsletter|notices?|alert|paywall|popup|promo\w*|related|recommend\w*|share|sharing|sidebar|side|social|sponsor\w*|subscribe"
    r"|subscription|toolbar|widgets?|complementary|contentinfo|login|signup|site-header|page-header|topbar)(?:$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|textarea|select|button|title|object|canvas|audio|video)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
#: names of layouts that only mention what stands around: has-sidebar, content-sidebar-wrap
_LAYOUT = re.compile(r"(?:has|no|with|without|show|hide)[_-].*|(?:content|main|page|site|body|article|post)[_-].*[_-](?:wrap|wrapper|container|layout|grid)", re.I)
_SPACE = re.compile(r"\s+")
_EDGES = re.compile(r"^\W+|\W+$")

SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.15, 0.30
MOST_LINKS = 0.4
#: how many times as long dense text outside must be for an article section to be a teaser only
TEASER = 2


@dataclass
class Block:
    text: str
    link_share: float
    #: True inside an article or main section, False inside what stands around it, else None
    inside: bool | None
    #: in an article or main section within a section that only its name puts aside
    held: bool = False


def attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; one without a value has an empty one."""
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)}


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_NOT_SHOWN.search(found.get("style", "")))


def _around(found: dict[str, str]) -> bool:
    """Whether a class, id or role names something around the main text, other than as part of a layout."""
    names = " ".join(found.get(x, "") for x in ("class", "id", "role"))
    return bool(_AROUND.search(names)) and any(_AROUND.search(n) and not _LAYOUT.fullmatch(n) for n in names.split())


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order; those without text are left out."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool | None, bool, bool]] = []
    inside: bool | None = None
    #: put aside by name only, and again inside an article or main section there
    named = held = False
    in_link = False
    at = 0

    def end() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                link = len(_SPACE.sub(" ", html.unescape("".join(linked))).strip()) if linked else 0
                out.append(Block(text, link / len(text), inside, held))
        parts, linked = [], []

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            piece = page[at : token.start()]
            parts.append(piece)
            if in_link:
                linked.append(piece)
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            end()
        if tag == "a":
            in_link = not token["close"]
        if tag not in NESTING_TAGS:
            continue
        if token["close"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    _, inside, named, held = stack[k]
                    del stack[k:]
                    break
        elif not token["attrs"].rstrip().endswith("/"):
            if tag == "li" and stack and stack[-1][0] == "li":
                _, inside, named, held = stack.pop()
            stack.append((tag, inside, named, held))
            found = attributes(token["attrs"]) if token["attrs"] else {}
            hard = tag in OUTSIDE_TAGS or tag == "header" and inside is None or _hidden(found)
            if tag in MAIN_TAGS:
                if inside is None and not _hidden(found):
                    inside = True
                elif inside is False and named and not hard and not _around(found):
                    held = True
            elif inside is not False and (hard or _around(found)):
                inside, named = False, not hard
            elif named and (hard or _around(found)):
                # put aside within what is: an article further in does not count
                named = held = False
    if at < len(page):
        parts.append(page[at:])
        if in_link:
            linked.append(page[at:])
    end()
    return out


def _dense(block: Block) -> float:
    """Share of stop words."""
    words = block.text.split()
    return sum(_EDGES.sub("", w).lower() in STOP_WORDS for w in words) / len(words)


def _first_pass(block: Block, has_main: bool) -> str:
    if block.inside is False:
        return "bad"
    if block.inside and has_main:
        return "good"
    if block.link_share > MOST_LINKS and len(block.text.split()) > 1:
        return "bad"
    if len(block.text) < SHORT:
        return "bad" if block.link_share > 0 or has_main else "short"
    if has_main:
        return "bad"
    stops = _dense(block)
    if stops >= MANY_STOPS:
        return "good" if len(block.text) > LONG else "near"
    return "near" if stops >= FEW_STOPS else "bad"


def judged(found: list[Block]) -> list[bool]:
    """Whether each block is main text.

    An article or main section, where a page has one, holds all of it, unless much more dense text stands elsewhere.
    If a page has such sections only within what its names put aside, those are meant.
    """
    main = sum(len(b.text) for b in found if b.inside)
    aside = sum(len(b.text) for b in found if b.held)
    if aside > TEASER * main:
        for b in found:
            b.inside = True if b.held else b.inside
        main += aside
    elsewhere = sum(
        len(b.text) for b in found if b.inside is None and len(b.text) > LONG and b.link_share <= MOST_LINKS and _dense(b) >= MANY_STOPS
    )
    has_main = main > 0 and elsewhere <= TEASER * main
    labels = [_first_pass(b, has_main) for b in found]

    def beside(k: int, step: int, near: bool) -> tuple[str, int]:
        way, j = 0, k + step
        while 0 <= j < len(found):
            if labels[j] in ("good", "bad"):
                return labels[j], way
            if near and labels[j] == "near":
                return "good", way
            way += len(found[j].text)
            j += step
        return "start" if step < 0 else "bad", way

    out = [label == "good" for label in labels]
    for k, label in enumerate(labels):
        if label == "short":
            (a, x), (b, y) = beside(k, -1, True), beside(k, 1, True)
            # what comes before the first decided block goes with it
            out[k] = b == "good" if a == "start" else a == b == "good" or a != b and (a if x <= y else b) == "good"
        elif label == "near":
            out[k] = "good" in (beside(k, -1, False)[0], beside(k, 1, False)[0])
    if not has_main and not any(out):
        # nothing is long enough to be sure of: what is nearly good is all there is, or else what is short
        out = [label == ("near" if "near" in labels else "short") for label in labels]
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, judged(found)) if keep)


def main_text_column(page: Column) -> Column:
    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        return pa.array([main_text(value) for value in column.to_pylist()], pa.string())

    return extract(page)


def extract(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each of ``pages``; repeated rows stay, other columns are ignored.

    Null and empty pages have an empty text, as have pages without main text; null ids and urls pass through.
    Text that stands in no tag is a block like any other; markup that is cut off at the end is markup.
    """
    text_batches(pages.sparkSession)
    return pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), main_text_column(F.col(html_column)).alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))
