"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides each block
by itself: stop-word density, length and link density, together with the element
the block stands in (a menu, form or comment list is never text). Blocks too
short to tell, headings and blocks between the thresholds stay open. The second
pass gives an open block the label of its nearest decided neighbours in the same
region: equal labels at once, different ones by distance. A heading follows what
comes after it.

The page is read as HTML says: raw text of scripts, unclosed paragraphs and list
items, attribute quotes, comments, tags cut off at the end. Reading and deciding
are linear in the length of the page.

Defined cases: a null page is empty; a page without a decided block keeps the
open ones inside article or main elements, or all of them if it has no such
element; rows that repeat give repeated results; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usageloom.llm.arrays import column

# Frequent function words of the languages told apart, lower case.
STOP_WORDS = {
    "en": "the of and to a in is it that was for on are as with be at by this from or an not but which were they have has had you",
    "fr": "le la les de des du un une et est que qui dans pour pas sur au aux avec ne ce se il elle en par plus sont ou",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine dem im auch es an als wie aus bei nach war",
    "es": "el la los las de del y que en un una es se por con para no su al lo como más pero sus este ha o",
    "it": "il lo la gli di che e è un una per con non del della si da sono nel al",
    "pt": "o a os as do da dos das e é um uma que em para com não por no na se",
    "nl": "de het een en van ik te dat die in is niet op aan met voor er maar om",
}
_STOP = frozenset(w for words in STOP_WORDS.values() for w in words.split())

# Fixed values of the first pass: lengths in code points and densities.
SHORT = 70
LONG = 200
STOP_LOW = 0.15
STOP_HIGH = 0.25
LINK_HIGH = 0.5
#: Open elements that are kept apart; deeper ones count as part of their parent, so that work stays linear.
DEEPEST = 512

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " summary table tbody td tfoot th thead title tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and elements whose content is never text.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROPPED = frozenset("script style textarea title head iframe noscript template svg math object canvas audio video select option button".split())
#: Elements that hold no article, and those that hold one.
_OUTSIDE = frozenset("nav footer aside form dialog menu search fieldset".split())
_CONTENT = frozenset("article main".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "a": {"a"},
}
_SCOPE = frozenset("ul ol dl table article main section aside nav div body html form".split())

# Words in class, id and role that name page furniture, and those that name the article.
_FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter"
    " subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus"
    " reply replies respond pagination pager toolbar search contentinfo complementary skip copyright outbrain taboola"
    " comentarios commentaires kommentare discussion".split()
)
_HEADER = frozenset("header topbar".split())
_ARTICLE = frozenset("articlebody storybody postbody entrycontent postcontent articlecontent storycontent maincontent articletext bodytext".split())
_NOT = frozenset("no with without has".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*(?:>|\Z)"
    r"|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LETTERS = re.compile(r"[^\W\d_]+")
_RIGHTS = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved", re.I)

GOOD, BAD, OPEN = 1, 0, None


@dataclass
class Block:
    """One block of text with what the rules need to know about its place."""

    text: str
    links: int
    furniture: bool
    region: int
    heading: bool
    label: int | None = OPEN


@dataclass
class _Element:
    name: str
    furniture: bool
    dropped: bool
    link: bool
    region: int


@dataclass
class _Page:
    stack: list[_Element] = field(default_factory=lambda: [_Element("", False, False, False, 0)])
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    regions: int = 0
    block_of: _Element | None = None
    heading: bool = False

    def flush(self) -> None:
        """End the block being gathered."""
        text = " ".join(unescape("".join(self.parts)).split())
        if text and self.block_of is not None:
            place = self.block_of
            self.blocks.append(Block(text, min(self.links, len(text)), place.furniture, place.region, self.heading))
        self.parts, self.links, self.block_of, self.heading = [], 0, None, False

    def write(self, text: str) -> None:
        top = self.stack[-1]
        if top.dropped:
            return
        if self.block_of is None and not text.isspace():
            self.block_of = top
            self.heading = any(e.name in _HEADINGS for e in self.stack)
        # Furniture inside a block (a share button in a paragraph) is no part of it.
        if self.block_of is not None and top.furniture and not self.block_of.furniture:
            return
        self.parts.append(text)
        if top.link:
            self.links += len(" ".join(unescape(text).split()))

    def close(self, name: str) -> None:
        """Leave the innermost open element of a name with all inside it."""
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].name == name:
                del self.stack[at:]
                return

    def close_implied(self, name: str) -> None:
        if name in _BLOCKS:
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at].name == "p" or (self.stack[at].name in _HEADINGS and name in _HEADINGS):
                    del self.stack[at:]
                    break
                if self.stack[at].name in _SCOPE:
                    break
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].name in _CLOSES.get(name, ()):
                del self.stack[at:]
                return
            if self.stack[at].name in _SCOPE:
                return

    def open(self, name: str, attrs: str) -> None:
        above = self.stack[-1]
        furniture, region, content = above.furniture, above.region, name in _CONTENT
        words: set[str] = set()
        if attrs and name not in ("body", "html"):
            words, article, hidden = _named(attrs)
            content = content or article
            furniture = furniture or hidden or (bool(words & _FURNITURE) and not content) or (
                bool(words & _FURNITURE) and name == "article" and bool(words & {"comment", "comments", "reply", "related", "sponsored", "promo"})
            )
            if words & _HEADER and name != "header" and not region:
                furniture = True
        if name in _OUTSIDE or (name == "header" and not region):
            furniture = True
        if furniture and name in _CONTENT and not words and all(e.name == "form" for e in self.stack if e.furniture):
            # Some sites wrap the whole page into one form.
            furniture = False
        if content and not furniture and not region:
            self.regions += 1
            region = self.regions
        dropped = above.dropped or name in _DROPPED
        if len(self.stack) > DEEPEST:
            return
        self.stack.append(_Element(name, furniture, dropped, above.link or name == "a", region))


def _named(attrs: str) -> tuple[set[str], bool, bool]:
    """Words of class, id and role; whether they name an article; whether the element is hidden."""
    words: set[str] = set()
    article = hidden = False
    for key, double, single, bare in _ATTRIBUTE.findall(attrs):
        key, value = key.lower(), double or single or bare
        if key in ("class", "id", "role"):
            for name in value.split():
                parts = [w.lower() for w in _NAME.findall(name)]
                article = article or "".join(parts) in _ARTICLE
                words.update(w for w, before in zip(parts, ["", *parts]) if before not in _NOT)
            article = article or (key == "role" and value.strip().lower() in ("main", "article"))
        elif key == "itemprop":
            article = article or value.strip().lower() == "articlebody"
        elif key == "hidden" or (key == "style" and "display:none" in value.lower().replace(" ", "")):
            hidden = True
    return words, article, hidden


def blocks(html: str) -> list[Block]:
    """The blocks of a page in their order."""
    page, at = _Page(), 0
    while at < len(html):
        found = _TOKEN.match(html, at)
        at = found.end()
        name = found["name"]
        if name is None:
            token = found[0]
            if token[0] != "<" or token == "<":
                page.write(token)
            continue
        name = name.lower()
        if name in _BLOCKS:
            page.flush()
        elif name == "br":
            page.write(" ")
        if found["end"]:
            page.close(name)
            continue
        page.close_implied(name)
        if name in _VOID:
            continue
        page.open(name, found["attrs"])
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            at = end.start() if end else len(html)
        elif found["attrs"].endswith("/") and name in ("svg", "math", "iframe", "object"):
            page.stack.pop()
    page.flush()
    return page.blocks


def stop_density(text: str) -> float:
    """Share of stop words among the words of letters."""
    words = _LETTERS.findall(text.lower())
    return sum(w in _STOP for w in words) / len(words) if words else 0.0


def first_label(block: Block) -> int | None:
    """What a block is by itself; open if that can't be told."""
    if block.furniture:
        return BAD
    linked = block.links > LINK_HIGH * len(block.text)
    if block.heading:
        return OPEN
    if linked:
        return BAD
    if len(block.text) < SHORT:
        return OPEN if block.region or not _RIGHTS.search(block.text) else BAD
    density = stop_density(block.text)
    if density >= STOP_HIGH or (density >= STOP_LOW and len(block.text) >= LONG):
        return GOOD
    if not block.region and (density < STOP_LOW or _RIGHTS.search(block.text)):
        return BAD
    return OPEN


def decide(found: list[Block]) -> None:
    """Both passes: label the blocks of one page."""
    for block in found:
        block.label = first_label(block)
    regions: dict[int, list[Block]] = {}
    for block in found:
        if not block.furniture:
            regions.setdefault(block.region, []).append(block)
    inside = any(r for r in regions)
    for region, members in regions.items():
        _settle(members, GOOD if region or not inside else BAD)


def _settle(members: list[Block], alone: int) -> None:
    """Open blocks take the label of the nearest decided ones of their region."""
    first = [b.label for b in members]
    n = len(members)
    before, after = [(OPEN, n)] * n, [(OPEN, n)] * n
    label, gap = OPEN, n
    for i in range(n):
        before[i] = (label, gap)
        label, gap = (first[i], 1) if first[i] is not OPEN else (label, gap + 1)
    label, gap = OPEN, n
    for i in range(n - 1, -1, -1):
        after[i] = (label, gap)
        label, gap = (first[i], 1) if first[i] is not OPEN else (label, gap + 1)
    for i, block in enumerate(members):
        if block.label is not OPEN:
            continue
        (left, back), (right, ahead) = before[i], after[i]
        if left is OPEN and right is OPEN:
            block.label = alone
        elif block.heading and right is not OPEN:
            block.label = right
        elif left is OPEN or right is OPEN or left == right:
            block.label = right if left is OPEN else left
        else:
            block.label = left if back < ahead else right if ahead < back else BAD


def main_text(html: str) -> str:
    """The text blocks of a page, two line feeds between them."""
    found = blocks(html)
    decide(found)
    return "\n\n".join(b.text for b in found if b.label == GOOD)


def with_main_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """All columns of the table but ``html``, and the main text; it replaces a column of its name.

    Only the page itself crosses into Python, by a scalar Arrow function.
    """

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x or "") for x in column.to_pylist()], pa.string())

    own = [F.col(f"`{c}`") for c in pages.columns if c not in (html, name)]
    return pages.select(*own, extract(F.col(f"`{html}`")).alias(name))
