"""A forgiving reader of HTML: tokens with their place in the element tree.

Only what extraction needs: open elements with implied ends, raw-text
elements, comments, decoded character references, and for every piece of text
whether a menu, header, footer, sidebar, notice, advert, form or comment holds
it. A page that is cut off anywhere is read up to there. A class or id name, or
a form, drops nothing that holds the page's own article (`settle`).
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")
HIDDEN = re.compile(r"\shidden(?:[\s/]|$)|display\s*:\s*none", re.I)

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset(
    "head title script style noscript template nav footer aside menu dialog button select textarea fieldset iframe "
    "object embed svg canvas audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
# Words in class and id names that mark what is not the article.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos "
    "promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer footers "
    "masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications alert popup popups modal "
    "overlay newsletter subscribe subscription signup signin login share sharing shares social related recommended "
    "recommendations trending pagination pager widget widgets comment comments commentlist disqus respond replies reply "
    "search copyright disclaimer skip form paywall".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies reply".split())
PATH_DEPTH = 512  # elements below it are open like any other but share the path of the one there
LITTLE = 250  # characters beside a wrapper that may be its title and path
KNOWN_TAGS: dict[tuple[str, str, int], tuple[bool, int, str, str]] = {}  # what tags were told to be, per task
WITHIN = {name: re.compile(rf"/{name}(?:[./]|$)") for name in ("a", "h1")}
ABOUT_WORDS = frozenset("has with no without is".split())  # body classes such as has-sidebar
CLOSES = {  # a start tag ends open elements of these names
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}}
SCOPES = frozenset("ul ol dl table td th tr article section div main body html li blockquote".split())


@dataclass(slots=True)
class Element:
    name: str
    path: str
    dropped: bool
    region: int  # 2 inside an article, 1 inside the main part, 0 elsewhere
    doubts: tuple[int, ...]  # the elements around that are dropped by a name, unless they hold the article


@dataclass(slots=True)
class Piece:
    """A tag (text empty) or a text, with its element's path."""

    path: str
    text: str
    tag: str
    dropped: bool
    region: int
    breaks: bool
    doubts: tuple[int, ...] = ()


def words_of(value: str) -> list[str]:
    return [w.lower() for w in NAME_PART.findall(value)]


def marked(name: str, rest: str, region: int) -> tuple[bool, int, str, str]:
    """Whether a start tag opens something to drop, the region it opens, its first class, and the name that speaks for dropping it."""
    if not rest or rest.isspace() or rest == "/":  # most tags have no attributes
        return (name in DROPPED or name == "header" and not region, 2 if name == "article" else max(region, int(name == "main")), "",
                "form" if name == "form" else "")
    told = KNOWN_TAGS.get((name, rest, region))
    if told is None:
        told = with_attributes(name, rest, region)
        if len(rest) <= 200:  # tags of a host come again and again
            if len(KNOWN_TAGS) >= 20_000:
                KNOWN_TAGS.clear()
            KNOWN_TAGS[name, rest, region] = told
    return told


def with_attributes(name: str, rest: str, region: int) -> tuple[bool, int, str, str]:
    """`marked` for a tag that has attributes."""
    values: dict[str, str] = {}
    if "=" in rest:
        for key, a, b, c in ATTRIBUTE.findall(rest):
            values.setdefault(key.lower(), a or b or c)
    role = values.get("role", "").lower()
    named = values.get("class", "")
    if name == "article" or values.get("itemprop", "").lower() == "articlebody" or role == "article":
        region = 2
    elif name == "main" or role == "main":
        region = max(region, 1)
    dropped = name in DROPPED or role in DROPPED_ROLES
    if name == "header" and not region:
        dropped = True
    if HIDDEN.search(rest) or values.get("aria-hidden", "").lower() == "true":
        dropped = True
    doubt = "form" if name == "form" or role == "form" else ""
    if name not in ("html", "body", "main") and not dropped and (named or "id" in values):
        listed = words_of(named) + ["|"] + words_of(values.get("id", ""))
        for before, word in zip(["|", *listed], listed, strict=False):
            if word in DROPPED_WORDS and before not in ABOUT_WORDS or word == "header" and not region:
                doubt = word if doubt not in COMMENT_WORDS else doubt
    return dropped, region, named.split()[0] if named.split() else "", doubt


def settle(out: list[Piece], names: list[str], around: list[tuple[int, ...]], opens: list[tuple[int, int]]) -> None:
    """Drops the elements that a name speaks against (`names`, with those around each), outer ones first, but for the page's own article.

    Kept is what holds the main part, the heading, or an article that is not
    less than what else is left, where nothing outside has one; and what holds
    most of the text outside links, where little else is left. `opens` are the
    pieces that open a main part (1) or an article (2). A page that would lose
    all its text keeps these elements.
    """
    text: dict[tuple[int, ...], list[int]] = {}  # outside links, in all, in headings, main parts, articles
    linked: dict[str, tuple[bool, bool]] = {}
    for piece in out:
        if piece.tag or piece.dropped or not (size := len(piece.text.strip())):
            continue
        if (within := linked.get(piece.path)) is None:
            within = linked[piece.path] = tuple(bool(WITHIN[n].search(piece.path)) for n in ("a", "h1"))
        entry = text.setdefault(piece.doubts, [0] * 5)
        entry[1] += size
        if not within[0]:
            entry[0] += size
            entry[2] += size * within[1]
    for n, region in opens:
        if not out[n].dropped:
            text.setdefault(out[n].doubts, [0] * 5)[2 + region] += 1
    total = sum(e[0] for e in text.values())
    holds = [[0] * 5 for _ in names]
    for doubts, entry in text.items():
        for one in doubts:
            holds[one] = [x + y for x, y in zip(holds[one], entry, strict=True)]
    kept: set[int] = set()

    def left() -> list[int]:
        return [sum(c) for c in zip([0] * 5, *(e for d, e in text.items() if kept.issuperset(d)), strict=True)]

    rest = left()
    for one, (name, own) in enumerate(zip(names, holds, strict=True)):
        if not any(own) or not kept.issuperset(around[one]):
            continue
        comment = name in COMMENT_WORDS
        most = 2 * own[0] > total and (not any(rest[2:]) or rest[0] < LITTLE and not comment)
        if own[3] and not rest[3] or most or not comment and (own[2] and not rest[2] or own[4] and not rest[4] and own[0] >= rest[0]):
            kept.add(one)
            rest = left()
    if not rest[1]:
        return
    for piece in out:
        if piece.doubts and not kept.issuperset(piece.doubts):
            piece.dropped = True


def read(page: str) -> list[Piece]:
    """The pieces of a page in page order."""
    out: list[Piece] = []
    stack = [Element("", "", False, 0, ())]
    names: list[str] = []
    around: list[tuple[int, ...]] = []
    opens: list[tuple[int, int]] = []
    at, size = 0, len(page)
    while at < size:
        found = TOKEN.match(page, at)
        at = found.end()
        name = found["name"]
        if name is None:
            text = found[0]
            if text[0] != "<" or text == "<":
                top = stack[-1]
                out.append(Piece(top.path, html.unescape(text) if "&" in text else text, "", top.dropped, top.region, False, top.doubts))
            continue
        name = name.lower()
        if found["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == name:
                    top = stack[depth]
                    out.append(Piece(top.path, "", f"/{name}", top.dropped, top.region, name not in INLINE, top.doubts))
                    del stack[depth:]
                    break
            else:
                out.append(Piece(stack[-1].path, "", f"/{name}", stack[-1].dropped, stack[-1].region, name not in INLINE,
                                 stack[-1].doubts))
            continue
        if name not in INLINE and name not in VOID:
            # a block ends an open paragraph, and an item ends the item before it
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == "p" or stack[depth].name in CLOSES.get(name, ()):
                    del stack[depth:]
                    break
                if stack[depth].name in SCOPES:
                    break
        top = stack[-1]
        dropped, region, first, doubt = marked(name, found["rest"], top.region)
        doubts = top.doubts
        if doubt and not dropped and not top.dropped:
            names.append(doubt)
            around.append(doubts)
            doubts = (*doubts, len(names) - 1)
        if region > top.region:
            opens.append((len(out), region))
        path = top.path if len(stack) >= PATH_DEPTH else f"{top.path}/{name}.{first}" if first else f"{top.path}/{name}"
        out.append(Piece(path, "", name, top.dropped or dropped, region, name not in INLINE, doubts))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])|\Z", re.I).search(page, at)
            at = end.start()
            stack.append(Element(name, path, True, region, doubts))
        elif name not in VOID:
            stack.append(Element(name, path, top.dropped or dropped, region, doubts))
    if names:
        settle(out, names, around, opens)
    return out


@dataclass(slots=True)
class Block:
    text: str
    path: str
    dropped: bool
    region: int
    begin: int  # number of the first piece


def blocks(pieces: list[Piece]) -> list[Block]:
    """Texts between block tags, white space folded, empty ones left out."""
    out: list[Block] = []
    held: list[str] = []
    first: Piece | None = None
    begin = 0

    def close() -> None:
        nonlocal first
        text = SPACE.sub(" ", "".join(held)).strip()
        if text and first is not None:
            out.append(Block(text, first.path, first.dropped, first.region, begin))
        held.clear()
        first = None

    for n, piece in enumerate(pieces):
        if piece.breaks:
            close()
        elif piece.tag:
            if piece.tag == "br":
                held.append(" ")
        else:
            if first is not None and first.dropped != piece.dropped:
                close()
            if first is None and piece.text.strip():
                first, begin = piece, n
            held.append(piece.text)
    close()
    return out
