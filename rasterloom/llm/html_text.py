"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags; each block knows its words, its share of
linked words, those of its neighbours, whether it lies in an article, and which elements
around it tell of a menu, aside, form, footer and so on (by tag, or by a whole word at either
end of a class or id).  Such an element tells nothing if the article lies inside of it: a form
around the page, a wrapper with a telling class.  A decision tree, grown once on a small
labelled table of pages that ``labelled_pages`` writes from templates (with telling words on
content, too), keeps the main text.  Scripts, styles, templates, comments and markup never
reach a block; character references are decoded; white space in a block becomes one space.

Null or empty html: empty text.  Unclosed, misnested or cut-off markup is read as far as
it goes: a closing tag closes up to its opening one and is ignored if there is none, ``<``
that starts no tag is text, a tag that the page's end cuts off is dropped, and a raw-text
element or comment that never ends runs to the end of the page.  Quotes count only as the
value of an attribute.  Reading takes time in proportion to the page.  Texts are read whole
and nothing kept is shortened.  Repeated pages give equal rows, an empty table an empty one;
only the id, url and html columns are read, so others may have any name.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .trees import Tree, grow

# Fixed sets of HTML element names.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that are left out with all that they hold.
_RAW = frozenset("script style noscript template textarea iframe svg canvas select button noframes noembed audio video title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag, whatever it looks like.
_TEXT_ONLY = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in "script style textarea iframe noscript noembed noframes title".split()}
_ARTICLE = frozenset(("article", "main"))
#: What can't stand in an element that is left out, so that an unclosed one ends there.
_CANT_HOLD = {"select": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())} | dict.fromkeys(("button", "audio", "video", "canvas"), frozenset("article main section h1 h2 h3".split()))
#: What an opening tag ends: an open one of these, if it comes before any of those.
_ENDS = {tag: (frozenset(same.split()), frozenset("ul ol dl table menu dir".split())) for tag, same in {"li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th"}.items()}

#: A tag: possessive throughout, so a page is read once whatever it holds; the end is > or the page's end.
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+)(>|\Z)")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+)?+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)

#: Telling words in class, id and role.  Fixed values.
_HINTS = {
    "advert": "ad ads adv advert adverts advertisement advertising advertorial promo promoted promotion sponsor sponsored sponsors dfp adsense adsbygoogle teaser outbrain taboola affiliate",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs skip topbar toolbar sitemap tags categories",
    "aside": "sidebar aside related recommended recommendations widget widgets trending popular share sharing social complementary rail newsletter subscribe signup",
    "notice": "notice notices alert warning disclaimer legal banner toast",
    "consent": "cookie cookies consent gdpr modal popup overlay paywall privacy",
    "comment": "comment comments commentlist disqus replies respond discussion reviews",
    "footer": "footer foot copyright colophon contentinfo credits imprint",
    "header": "masthead header logo branding",
    "form": "form search login searchbox",
}
_KINDS = {word: kind for kind, words in _HINTS.items() for word in words.split()}
#: Words of main content; words after which a hint is only said to be there or not.
_MAIN = frozenset("article main content post entry story articlebody maincontent".split())
_SAYING = frozenset("no not non without with has is hide show lg md sm xs xl".split())
_PROSE = frozenset("text intro introduction lead copy prose paragraph quote summary abstract story".split())
#: Elements that make a form of what is around them.
_CONTROLS = frozenset("input textarea select button".split())
_BY_TAG = {"nav": "menu", "menu": "menu", "aside": "aside", "footer": "footer", "form": "form", "fieldset": "form", "dialog": "consent", "header": "header", "search": "form"}
_ORDER = tuple(_HINTS)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@lru_cache(maxsize=20_000)
def _hinted(names: str) -> tuple[frozenset[str], bool]:
    """Kinds that class and id words tell (the first or last part of a name), and whether one tells of main content."""
    kinds, main = set(), False
    for name in re.split(r"\s+", re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower()):
        parts = [p for p in re.split(r"[-_:]+|\d+", name) if p]
        if parts and parts[0] not in _SAYING:
            main = main or parts[-1] in _MAIN or (len(parts) > 1 and parts[-2] in _MAIN and parts[-1] in ("body", "text"))
            said = parts[-1:] if parts[-1] in _PROSE else (parts[0], parts[-1])
            kinds.update(_KINDS[word] for word in said if word in _KINDS)
    return frozenset(kinds), main


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), "".join(values))
    return found


def is_hidden(attributes: dict[str, str]) -> bool:
    """Whether an attribute of its own, or a style, hides the element."""
    if "hidden" in attributes and not attributes["hidden"].lower().startswith("until"):
        return True
    return attributes.get("aria-hidden", "").strip().lower() == "true" or bool(_NOT_SHOWN.search(attributes.get("style", "")))


class Around:
    """An element that tells of something: its kinds, the words in it, and whether an article begins or a control lies in it."""

    __slots__ = ("kinds", "outer", "words", "holds", "controls")

    def __init__(self, kinds: frozenset[str], outer: "Around | None", form: bool):
        self.kinds, self.outer, self.words, self.holds, self.controls = kinds, outer, 0, False, form


class Block:
    __slots__ = ("text", "words", "linked", "tag", "around", "main")

    def __init__(self, text: str, linked: int, tag: str, around: Around | None, main: bool):
        self.text, self.linked, self.tag, self.around, self.main = text, linked, tag, around, main
        self.words = text.count(" ") + 1


class _Open:
    """An open element: its tag, the nearest block tag, what is around, in main content, in a link."""

    __slots__ = ("tag", "block", "around", "main", "link")

    def __init__(self, tag: str, block: str, around: Around | None, main: bool, link: bool):
        self.tag, self.block, self.around, self.main, self.link = tag, block, around, main, link


class _Reader:
    def __init__(self):
        self.blocks: list[Block] = []
        self.pieces: list[str] = []
        self.linked = 0
        self.stack = [_Open("html", "body", None, False, False)]
        self.open: Counter[str] = Counter()

    def say(self, data: str) -> None:
        if data:
            self.pieces.append(data)
            if self.stack[-1].link:
                self.linked += len(data.split())

    def flush(self) -> None:
        if self.pieces:
            text = "".join(self.pieces)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            self.pieces.clear()
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, self.linked, top.block, top.around, top.main))
                if top.around is not None:
                    top.around.words += self.blocks[-1].words
        self.linked = 0

    def close_to(self, place: int) -> None:
        for gone in self.stack[place:]:
            self.open[gone.tag] -= 1
        del self.stack[place:]

    def close(self, tag: str) -> None:
        block = tag in _BLOCK
        if block:
            self.flush()
        if not self.open[tag]:
            return
        place = len(self.stack) - 1
        while self.stack[place].tag != tag:
            if not block and self.stack[place].tag in _BLOCK:
                return  # an inline end tag closes no block
            place -= 1
        self.close_to(place)

    def end_before(self, same: frozenset[str], walls: frozenset[str]) -> None:
        """Close the nearest open one of ``same``, unless one of ``walls`` comes first."""
        if any(self.open[t] for t in same):
            for place in range(len(self.stack) - 1, 0, -1):
                if self.stack[place].tag in same:
                    self.flush()
                    self.close_to(place)
                    return
                if self.stack[place].tag in walls:
                    return

    def control(self) -> None:
        around = self.stack[-1].around
        while around is not None and not around.controls:
            around.controls, around = True, around.outer

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        top = self.stack[-1]
        around, main = top.around, top.main
        content = tag in _ARTICLE
        if content or tag == "h1":
            outer = around
            while outer is not None and not outer.holds:
                outer.holds, outer = True, outer.outer
        if tag not in ("html", "body"):
            kinds: frozenset[str] = frozenset()
            if attributes and not content:
                names = " ".join(attributes[n] for n in ("class", "id", "role") if n in attributes)
                kinds, told = _hinted(names) if names else (kinds, False)
                main = main or told or attributes.get("itemprop", "").lower() == "articlebody"
            if tag in _BY_TAG and not (tag == "header" and main):
                kinds = kinds | {_BY_TAG[tag]}
            if kinds:
                around = Around(kinds, around, tag == "form")
        self.stack.append(_Open(tag, tag if tag in _BLOCK else top.block, around, main or content, top.link or tag == "a"))
        self.open[tag] += 1


_P = frozenset(("p",))


def blocks_of(page: str | None) -> list[Block]:
    if not page:
        return []
    reader = _Reader()
    skip, depth = "", 0  # the element left out, and how often it is open
    inside: Counter[str] = Counter()  # open elements of a hidden one
    at = cursor = 0
    while (start := page.find("<", cursor)) >= 0:
        follows = page[start + 1 : start + 2]
        named = page[start + 2 : start + 3] if follows == "/" else follows
        tagged = named.isascii() and named.isalpha()
        if not tagged and follows not in ("!", "?", "/"):
            cursor = start + 1  # a < that starts nothing
            continue
        if not skip:
            reader.say(page[at:start])
        if not tagged:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 2)
                at = cursor = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", start)
                at = cursor = len(page) if end < 0 else end + 1
            continue
        m = _TAG.match(page, start)
        at = cursor = m.end()
        if not m.group(3):
            break  # the page's end cuts a tag off
        tag, closing = m.group(1).lower(), follows == "/"
        if skip:
            if skip in _TEXT_ONLY and closing and tag == skip:
                depth = 0
            elif closing:
                if inside[tag]:
                    inside[tag] -= 1
                elif tag == skip:
                    depth -= 1
                elif reader.open[tag]:
                    depth = 0  # a hidden element that is never closed ends with its parent
                    skip = ""
                    reader.close(tag)
                    continue
            elif tag in _CANT_HOLD.get(skip, ()):  # left open: it ends where something begins that it can't hold
                skip, cursor = "", start
                at = start
                continue
            elif tag not in _VOID and not (tag == skip and tag in _CANT_HOLD):
                inside[tag] += 1
            if tag in _TEXT_ONLY and not closing:
                end = _TEXT_ONLY[tag].search(page, cursor)
                cursor = at = end.start() if end else len(page)
            if not depth:
                skip = ""
            continue
        if closing:
            reader.close(tag)
            continue
        if tag == "br":
            reader.pieces.append(" ")
            continue
        if tag in _BLOCK:
            reader.end_before(_P, _BLOCK - _P)
            if tag in _ENDS:
                reader.end_before(*_ENDS[tag])
            reader.flush()
        raw = m.group(2)
        if tag in _CONTROLS:
            reader.control()
        attributes = _attributes(raw) if "=" in raw or "hidden" in raw else {}
        if tag in _RAW or (attributes and tag not in _VOID and tag not in ("html", "body", "p", "li") and is_hidden(attributes)):
            if tag in _TEXT_ONLY:
                end = _TEXT_ONLY[tag].search(page, cursor)
                at = cursor = end.start() if end else len(page)
            if tag in _TEXT_ONLY or not raw.rstrip().endswith("/"):
                skip, depth = tag, 1
                inside.clear()
        elif tag not in _VOID:
            reader.start(tag, attributes)
    else:
        if not skip:
            reader.say(page[at:])
    reader.flush()
    return reader.blocks


N_FEATURES = 10 + len(_ORDER) + 5


def _telling(blocks: list[Block]) -> list[frozenset[str]]:
    """The kinds that hold for each block: not those of an element with the article inside of it."""
    total = sum(b.words for b in blocks)
    seen: dict[int, Around] = {}
    for b in blocks:
        around = b.around
        while around is not None and id(around) not in seen:
            seen[id(around)] = around
            around = around.outer
    # Words of inner elements count for the outer ones; inner ones were made later.
    own = list(seen.values())
    level: dict[int, int] = {}
    for a in own:
        chain = []
        while a is not None and id(a) not in level:
            chain.append(a)
            a = a.outer
        base = level[id(a)] if a is not None else 0
        for a in reversed(chain):
            base += 1
            level[id(a)] = base
    for a in sorted(own, key=lambda a: -level[id(a)]):
        if a.outer is not None:
            a.outer.words += a.words
    marked = any(b.main or b.tag == "h1" for b in blocks)
    told: dict[int, frozenset[str]] = {}
    for a in sorted(own, key=lambda a: level[id(a)]):
        wraps = a.words >= 0.3 * total if a.holds else not marked and a.words > 0.5 * total
        own = a.kinds if a.controls else a.kinds - {"form"}  # a name alone makes no form
        told[id(a)] = (told[id(a.outer)] if a.outer is not None else frozenset()) | (frozenset() if wraps else own)
    return [told[id(b.around)] if b.around is not None else frozenset() for b in blocks]


def block_features(blocks: list[Block]) -> Iterator[tuple]:
    """Words and link density of the block before, this one and the next; then its surroundings."""
    kinds = _telling(blocks)
    any_main = any(b.main for b in blocks)
    first = next((i for i, b in enumerate(blocks) if b.tag == "h1" and not kinds[i]), len(blocks))
    edge = (0.0, 0.0)
    flat = [edge, *((float(b.words), b.linked / b.words) for b in blocks), edge]
    for i, (b, told) in enumerate(zip(blocks, kinds, strict=True)):
        (pw, pl), (w, l), (nw, nl) = flat[i : i + 3]
        text = b.text
        yield (
            pw, pl, w, l, nw, nl, len(text) / b.words, float(text[-1] in ".!?:;。\"'”»…"), float("©" in text),
            float(b.tag in _HEADINGS), *(float(k in told) for k in _ORDER), float(b.main), float(any_main), float(b.tag == "li"),
            float(bool(told - {"notice"})), float(i >= first),
        )


# ---- the labelled table ----------------------------------------------------------------

_WORDS = {
    "en": "the of and to in is that for it as was with on by this from at which have are not they one all there when more time people water small river history found early later under study north city years made light stone".split(),
    "de": "der die und das von mit ist ein eine nicht auf werden sich auch nach wurde über durch zum zwischen Jahr Stadt Wasser Berg später früher Geschichte gegen alle Zeit".split(),
    "fr": "le la les de des et un une dans que qui est pour sur par avec ne pas ville année eau histoire petit grand après avant entre temps monde pierre".split(),
    "es": "el la los las de y en un una que es por con para su se no ciudad agua historia pequeño grande después antes entre tiempo mundo piedra río año".split(),
}


def labelled_pages(count: int = 3_000, seed: int = 5) -> Iterator[tuple[str, list[str]]]:
    """(html, main blocks) of invented pages: semantic, hint-word and plain layouts."""
    rng = np.random.default_rng(seed)

    def pick(seq):
        return seq[int(rng.integers(len(seq)))]

    def sentence(lang: str, low: int, high: int) -> str:
        words = [pick(_WORDS[lang]) for _ in range(int(rng.integers(low, high)))]
        return " ".join(words).capitalize() + pick([".", ".", ".", "!", "?"])

    for _ in range(count):
        lang, layout = pick(list(_WORDS)), int(rng.integers(5))
        links = lambda n: "".join(f"<li><a href='/{i}'>{sentence(lang, 1, 3)[:-1]}</a></li>" for i in range(n))  # noqa: E731, B023
        title = sentence(lang, 1, 9)[:-1]
        body = [" ".join(sentence(lang, 1 if rng.random() < 0.15 else 5, 16) for _ in range(int(rng.integers(1, 7)))) for _ in range(int(rng.integers(1, 9)))]
        if rng.random() < 0.35:  # a page of short paragraphs
            body = [sentence(lang, 2, int(rng.integers(4, 20))) for _ in range(int(rng.integers(1, 6)))]
        main, parts = [title], []
        for p in body:
            # Content that looks like something else: a linked line, a sign, a list, a telling class.
            shape = int(rng.integers(12)) if layout < 4 else 11
            if shape == 0:
                parts.append(f"<p><a href='/x'>{p}</a></p>")
            elif shape == 1:
                p = "© " + p
                parts.append(f"<p>{p}</p>")
            elif shape == 2:
                items = [sentence(lang, 1, 6)[:-1] for _ in range(int(rng.integers(2, 5)))]
                cover = pick(["{}", "<a href='/y'>{}</a>"])
                parts.append(f"<p>{p}</p><ul>" + "".join(f"<li>{cover.format(x)}</li>" for x in items) + "</ul>")
                main += [p, *items]
                continue
            elif shape == 3:
                parts.append(f"<div class='{pick(['alert-box', 'legal', 'notice', 'warning', 'alert', 'text-banner', 'toc-text', 'review-form', 'reply', 'tags-intro'])}'><p>{p}</p></div>")
            elif shape == 4:
                parts.append(f"<{(t := pick(['blockquote', 'div', 'h2', 'figcaption', 'fieldset', 'td']))}>{p}</{t}>")
            else:
                parts.append(f"<p>{p}</p>")
            main.append(p)
        heading = f"<h1>{title}</h1>"
        if layout == 4 and rng.random() < 0.4:  # no heading, or no element around it that tells
            heading, main = "", main[1:]
        if layout < 4 and rng.random() < 0.2:
            heading = f"<{(t := pick(['header', 'div']))} class='{pick(['header', 'post-header', 'entry-header'])}'>{heading}</{t}>"
        noise = {
            "nav": f"<nav><ul>{links(int(rng.integers(3, 9)))}</ul></nav>" if layout < 2 else f"<div class='menu'><ul>{links(6)}</ul></div>",
            "ad": f"<div class='{pick(['ad', 'ads', 'sponsored', 'promo', 'ad-banner'])}'>{sentence(lang, 4, 14)}</div>",
            "cookie": f"<div id='{pick(['cookie-notice', 'consent', 'gdpr'])}'><p>{sentence(lang, 6, 20)}</p><a href=#>OK</a></div>",
            "notice": f"<div class='{pick(['notice', 'alert', 'site-banner', 'legal', 'disclaimer'])}'><p>{sentence(lang, 4, 24)}</p></div>",
            "side": f"<aside><h3>{sentence(lang, 2, 4)}</h3><p>{sentence(lang, 5, 30)}</p><ul>{links(4)}</ul></aside>" if rng.random() < 0.6 else f"<div class='{pick(['sidebar', 'related', 'popular', 'widget'])}'><p>{sentence(lang, 5, 30)}</p><ul>{links(4)}</ul></div>",
            "teasers": "<div class='related'>" + "".join(f"<article><h3>{sentence(lang, 2, 5)}</h3><p>{sentence(lang, 4, 12)}</p></article>" for _ in range(2)) + "</div>" if len(" ".join(body).split()) > 90 else "",
            "comments": f"<{(t := pick(['section', 'div', 'ol']))} class='{pick(['comments', 'comment-list', 'reader-comments', 'replies'])}'><h3>{sentence(lang, 1, 3)}</h3><p>{sentence(lang, 5, 30)}</p><p>{sentence(lang, 3, 20)}</p></{t}>",
            "form": f"<form action=/s><label>{sentence(lang, 1, 4)}</label><p>{sentence(lang, 3, 9)}</p><input name=q></form>",
            "footer": f"<footer>&copy; {sentence(lang, 2, 6)} &middot; {sentence(lang, 3, 20)}</footer>" if layout < 3 else f"<div class=footer><p>© {sentence(lang, 3, 9)}</p></div>",
            "header": f"<header><p>{sentence(lang, 2, 12)}</p></header>" if layout < 3 else f"<div class='masthead'>{sentence(lang, 2, 8)}</div>",
        }
        clear = dict(noise)
        if rng.random() < 0.3:  # nothing but its links or its sign tells what this is
            noise["nav"] = f"<div><ul>{links(int(rng.integers(3, 9)))}</ul></div>"
            noise["side"] = f"<div><ul>{links(5)}</ul></div>"
            noise["footer"] = f"<div><p>© {sentence(lang, 3, 9)} · {sentence(lang, 1, 4)}</p></div>"
            noise["header"] = f"<div><p><a href=/>{sentence(lang, 1, 4)}</a> | <a href=/x>{sentence(lang, 1, 4)}</a></p></div>"
        wrap = {0: "<article{}>{}</article>", 1: "<main><article{}>{}</article></main>", 2: "<div class='post-content'>{1}</div>", 3: "<main{}>{}</main>", 4: pick(["<div>{1}</div>", "<div class='elementor-widget-container'>{1}</div>", "<section>{1}</section>", "{1}", "<div><div>{1}</div></div>", "<table><tr><td>{1}</td></tr></table>"])}[layout]
        named = f" class='{pick(['post tags popular', 'post', 'story sponsored', 'h-entry comments-open'])}'" if rng.random() < 0.3 else ""
        inner = "".join([heading, *parts])
        for name in ("ad", "comments", "form", "side", "teasers", "cookie"):
            if layout < 4 and rng.random() < 0.15:  # noise inside the article, at its end or after the heading
                inner = inner + clear[name] if rng.random() < 0.6 else heading + clear[name] + "".join(parts)
        if layout == 4 and rng.random() < 0.2:  # cells or bare divisions instead of paragraphs
            t = pick(["td", "div"])
            inner = inner.replace("<p>", f"<{t}>").replace("</p>", f"</{t}>")
        whole = wrap.format(named, inner)
        if layout < 4 and rng.random() < 0.4:  # a wrapper whose name speaks of something else
            whole = f"<div class='{pick(['content with-sidebar', 'page no-comments', 'has-ads', 'sidebar-left', 'layout popular', 'modal-open', 'header-fixed'])}'>{whole}</div>"
        before = "".join(noise[n] for n in ("header", "nav", "cookie", "notice", "ad", "form") if rng.random() < 0.5)
        after = "".join(noise[n] for n in ("side", "teasers", "comments", "ad", "notice", "form", "footer") if rng.random() < 0.5)
        page = before + whole + after if layout < 4 or rng.random() < 0.6 else whole
        if rng.random() < 0.15:
            page = f"<form id='aspnetForm' action='/'>{page.replace('<form action=/s>', '<div class=search-form>').replace('</form>', '</div>')}</form>"
        yield f"<html><head><title>{title}</title><script>var a='</p>';</script></head><body>{page}</body></html>", main


@cache
def block_tree() -> Tree:
    """The tree, grown on the labelled table; the same on every machine."""
    x, y = [], []
    for page, main in labelled_pages():
        blocks, wanted = blocks_of(page), set(main)
        for b, f in zip(blocks, block_features(blocks), strict=True):
            x.append(f)
            y.append(float(b.text in wanted))  # the generator knows
    return grow(np.array(x), np.array(y), depth=14, least=4)


def extract(page: str | None, tree: Tree | None = None) -> str:
    tree = tree or block_tree()
    blocks = blocks_of(page)
    return "\n\n".join(b.text for b, f in zip(blocks, block_features(blocks), strict=True) if tree.score(f) >= 0.5)


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row, map-only."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    tree = block_tree()

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(t.as_py(), tree) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
