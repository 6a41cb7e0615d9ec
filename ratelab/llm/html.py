"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. First, each block is decided by its container, its share of
linked text, its length and its density of stop words (a container's name counts only while the page has its text elsewhere); then blocks left open take the label of the nearest
decided neighbour.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent words of four languages, kinds of tags, and names that sites give to page furniture.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be because been but by can could did do does for from had has have he her his how i if in
into is it its just like more my no not of on one only or other our out over said she so some such than that the their them then
there these they this to up was we were what when which who will with would you your
aber als am an auch auf aus bei bin bis bist da damit dann das dass dem den der des die dies diese doch du durch ein eine einem einen
einer er es für hat hatte ich ihr im in ist ja kann mit nach nicht noch nun nur ob oder sein sich sie sind so über um und uns unter
vom von vor war was wenn werden wie wir wird zu zum zur
al algo como con cuando de del desde donde e el ella ellos en entre era es esta este esto fue ha hasta hay la las le lo los más me mi
muy no nos o para pero por porque que quien se ser si sin sobre son su sus también te tiene un una y ya yo
au aux avec ce ces cette comme dans de des du elle elles en est et eu il ils je la le les leur lui mais me même mes moi mon ne nos
notre nous ou où par pas plus pour qu que qui sa sans se ses si son sont sur ta te tu un une vous
""".split())
BLOCK_TAGS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1
h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th
thead tr ul
""".split())
SKIPPED_TAGS = frozenset("script style title template noscript svg math iframe object embed canvas audio video map noframes select datalist".split())
RAW_TAGS = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu button textarea input label dialog search fieldset".split())
FURNITURE_NAMES = frozenset("""
ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment comments commentlist consent
cookie cookies copyright disclaimer discussion disqus dropdown footer form gdpr header legal login masthead menu menubar modal nav navbar
navigation newsletter notice notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply
respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar widget widgets
""".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
MAIN_TAGS = frozenset(["article", "main"])

SHORT = 70
LINKED = 1 / 3
STOP_DENSITY = 0.1

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """named: the containers around the block whose names are those of page furniture."""

    tag: str
    section: int
    furniture: bool
    named: tuple[int, ...] = ()
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: bool | None = None


@dataclass
class _Open:
    tag: str
    furniture: bool
    section: int
    skipped: bool
    named: tuple[int, ...] = ()


def _is_furniture(tag: str, rest: str, inside_main: bool) -> bool | None:
    """True by its tag, role or style; None where only its names say so."""
    if tag in FURNITURE_TAGS or tag == "header" and not inside_main:
        return True
    if not rest.strip("/ \n\t"):
        return False
    named = False
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), (a or b or c)
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in FURNITURE_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and tag not in ("body", "html"):
            words = {w.lower() for w in _NAME.findall(value)}
            found = words & FURNITURE_NAMES
            named = named or bool(found - {"header", "byline", "tags"} or found and not inside_main)
    return None if named else False


def blocks(page: str | None) -> list[Block]:
    """The non-empty blocks of a page in order, text decoded and with single blanks."""
    page = page or ""
    out: list[Block] = []
    stack: list[_Open] = [_Open("", False, 0, False)]
    state = {"sections": 0, "named": 0, "link": 0}  # link: how deep the element around the open link lies, and 1
    depth: Counter[str] = Counter()
    now = Block("", 0, False)

    def close() -> None:
        nonlocal now
        now.text = " ".join("".join(now.pieces).split())
        if now.text:
            out.append(now)
        now = Block(stack[-1].tag, stack[-1].section, stack[-1].furniture, stack[-1].named)

    def leave() -> str:
        tag = stack.pop().tag
        depth[tag] -= 1
        if len(stack) < state["link"]:
            state["link"] = 0
        return tag

    def say(raw: str, decode: bool = True) -> None:
        if raw and not stack[-1].skipped:
            said = html.unescape(raw) if decode and "&" in raw else raw
            now.pieces.append(said)
            if state["link"]:
                now.linked += len("".join(said.split()))

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        say(page[at:found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        if found["cdata"] is not None:
            say(found["cdata"], False)
        tag = (found["tag"] or "").lower()
        if not tag:
            continue
        if found["end"]:
            if tag == "a":
                state["link"] = 0
            if depth[tag] > 0:
                if tag in BLOCK_TAGS:
                    close()
                while leave() != tag:
                    pass
                if tag in BLOCK_TAGS:
                    now = Block(stack[-1].tag, stack[-1].section, stack[-1].furniture, stack[-1].named)
            elif tag in BLOCK_TAGS:
                close()
            continue
        if tag == "br":
            say(" ", False)
            continue
        if tag in BLOCK_TAGS:
            close()
            if stack[-1].tag == "p" and tag == "p":
                leave()
        if tag == "a" and ("href" in (names := [a[0].lower() for a in _ATTRIBUTE.findall(found["rest"])]) or not names):
            state["link"] = len(stack)  # an anchor that has a name but no target is no link
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(page, at)
            at = end.start()
            continue
        if tag in VOID_TAGS or found["rest"].endswith("/") and tag not in BLOCK_TAGS:
            continue
        top = stack[-1]
        section = top.section
        if tag in MAIN_TAGS or 'role="main"' in found["rest"] or "articleBody" in found["rest"]:
            state["sections"] += 1
            section = state["sections"]
        if tag in BLOCK_TAGS or tag in SKIPPED_TAGS or tag in FURNITURE_TAGS or tag == "span":
            told = _is_furniture(tag, found["rest"], section > 0)
            furniture, named = top.furniture or told is True, top.named
            if told is None:
                state["named"] += 1
                named = (*named, state["named"])
            stack.append(_Open(tag, furniture, section, top.skipped or tag in SKIPPED_TAGS, named))
            depth[tag] += 1
            if tag in BLOCK_TAGS or furniture != top.furniture or named != top.named:
                if tag not in BLOCK_TAGS:
                    close()
                now = Block(tag, section, furniture, named)
    close()
    return out


def _weigh_names(found: list[Block]) -> None:
    """Make furniture of what lies in a container named like furniture, unless that container holds the page's text.

    It does where most stop words of the page are inside it and no article or main section has text outside it: then
    the name speaks of the layout (`content has-sidebar`), not of its content.
    """
    inside: Counter[int] = Counter()
    total, articles = 0, []
    for b in found:
        if not b.furniture and b.linked <= LINKED * len("".join(b.text.split())):
            stops = sum(w in STOP_WORDS for w in _WORD.findall(b.text.lower()))
            total += stops
            inside.update(dict.fromkeys(b.named, stops))
            if b.section:
                articles.append(b.named)
    most = {c for c, stops in inside.items() if 2 * stops > total and all(c in named for named in articles)}
    for b in found:
        b.furniture = b.furniture or any(c not in most for c in b.named)


def decide(block: Block) -> bool | None:
    """First pass: True for main text, False for furniture, None for what only its neighbours can tell."""
    length = len("".join(block.text.split()))
    if block.furniture or block.linked > LINKED * length:
        return False
    if not block.section and re.match(r"(?:©|\(c\)|copyright\b)", block.text, re.I):
        return False
    words = _WORD.findall(block.text.lower())
    dense = bool(words) and sum(w in STOP_WORDS for w in words) >= STOP_DENSITY * len(words)
    return True if len(block.text) >= SHORT and dense else None


def label(found: list[Block]) -> None:
    """Both passes over the blocks of a page.

    A block left open takes the label of the nearest block decided in the first pass: inside an article or
    main section the nearest of that section that is no furniture, elsewhere the nearest of the page; between
    two equally near ones main text wins. Where there is none to ask, a block is main text.
    """
    _weigh_names(found)
    first = [decide(b) for b in found]
    before, after = _decided(found, first, range(len(found))), _decided(found, first, range(len(found) - 1, -1, -1))
    for i, b in enumerate(found):
        b.label = first[i]
        if b.label is None:
            near = [j for j in (before[i], after[i]) if j is not None]
            gap = min((abs(i - j) for j in near), default=0)
            b.label = not near or any(first[j] for j in near if abs(i - j) == gap)


def _decided(found: list[Block], first: list[bool | None], order: range) -> list[int | None]:
    """For each block the last one before it, in this order, whose label counts for it.

    Blocks of a section listen to decided blocks of their section that are no furniture; others to all.
    """
    out: list[int | None] = [None] * len(found)
    last: dict[int, int] = {}
    for i in order:
        b = found[i]
        out[i] = last.get(b.section)
        if first[i] is not None:
            last[0] = i
            if b.section and not b.furniture:
                last[b.section] = i
    return out


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null, empty and text-free pages."""
    found = blocks(page)
    label(found)
    return " ".join(b.text for b in found if b.label)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): the main text of every whole page, one row per row of pages.

    Null and empty pages have an empty text; null ids and urls and repeated rows are kept; an empty table gives
    an empty table; other columns stay out.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([main_text(p.as_py()) for p in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["page_id", "url", "text"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
