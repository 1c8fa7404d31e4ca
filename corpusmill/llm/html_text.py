"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block of the page; menus, scripts and the like leave an empty gap. The weights of WINDOW successive lines, their
characters outside links, are summed at each line. A region begins at a surge of that curve, where it reaches a share of its highest point, and ends at a dive, where it
comes to nothing; the text between is kept. Markup weighs: an article's lines, and those beside a region in its container, are lifted onto the curve. What
is noise only by its name is judged by what it holds. Pages go through Arrow tasks without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Generator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

WINDOW = 3
#: Article elements stand for the page, and an element named by a layout word is a wrapper and no noise, only if they hold more than MOST of its text; one named otherwise and without a heading needs NEARLY_ALL.
MOST, NEARLY_ALL = 0.5, 0.95
#: Surge: a window that reaches this share of the page's highest one.
RISE = 0.1
#: Elements whose content is no main text, elements with raw content, elements that part blocks, elements without content.
NOISE = frozenset("nav footer aside form script style noscript template iframe svg button select textarea dialog menu head title canvas object fieldset datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div html main section td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar aside menu nav navbar navigation footer masthead topbar toolbar widget widgets related recommended share sharing social pagination pager skip".split()
)
#: Words of other people's or other pages' text: an article element inside is noise too. Inside layout words, such as a wrapper named after its sidebar, it is the article.
FOREIGN_WORDS = frozenset("comment comments commentlist disqus respond reply replies related recommended".split())
#: Words among these that also name subjects (market-share, notice-period): noise only in a class of such words and words of layout.
SUBJECT_WORDS = frozenset("alert alerts comment consent notice notices overlay promotion related recommended reply replies respond share sharing skip social sponsor sponsored subscription widget widgets".split())
LAYOUT_WORDS = frozenset("area articles bar block body bottom box btn button buttons container content count footer form header icons inline inner item items left line links list media message modal outer panel popup post posts right row section stories text this title toolbar tools top wrap wrapper".split())
#: The words among these after which a wrapper of the page may be named; adverts and notices hold no page.
OTHER_WORDS = NOISE_WORDS - frozenset("sidebar aside menu nav navbar navigation footer masthead topbar toolbar widget widgets".split())
RELATED_WORDS = frozenset("related recommended".split())
#: Elements of one sentence or paragraph, which hold no list of comments or articles.
PHRASES = frozenset("p span em strong b i u small h1 h2 h3 h4 h5 h6 blockquote q cite code pre dt dd td th caption figcaption".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alertdialog alert form".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"[>\"']")
#: A name and its value; quoted values are passed over whole, so that their words are no names.
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SENTENCE = re.compile(r"[.!?…:;][\"'»”’)\]]*$")
_PART = re.compile(r"[\s_:-]+")
#: A class that names a state, such as has-sidebar, says nothing of the element's own text.
_STATE = re.compile(r"(?<!\S)(?:has|with|no|without)[_:-]\S*")

GAP = ("", 0, False, -1)


def _attributes(source: str) -> dict[str, str]:
    """name -> value of a tag's attributes, in small letters; the first of a name counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        found.setdefault(name.lower(), (a or b or c).strip().lower())
    return found


def _noise(tag: str, source: str, in_article: bool) -> tuple[int, str]:
    """A level and what may save the element. 0: text; 1: noise by its name, in which an article is text; 2: noise for certain; 3: by name other people's or pages' text.

    What is named is saved by what it holds: "layout" and "form" by most of the text, "other" by nearly all or most of it and a main heading, "related" in an article by text outside links.
    """
    if tag in NOISE and tag != "form" or tag == "header" and not in_article:
        return 2, ""
    if tag in ("html", "body", "main"):
        return 0, ""
    found = _attributes(source) if source else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in NOISE_ROLES - ({"form"} if tag == "form" else set()):
        return 2, ""
    parts = _noise_words(found.get("class", "")) | _noise_words(found.get("id", ""))
    if tag in PHRASES:
        parts -= SUBJECT_WORDS
    if in_article and tag in ("section", "div") and parts and RELATED_WORDS.issuperset(x for name in ("class", "id") for x in _PART.split(found.get(name, "")) if x):
        return 3, "related"
    if not FOREIGN_WORDS.isdisjoint(parts):
        return 3, "other"
    if parts and tag != "article":
        return 1, "layout" if OTHER_WORDS.isdisjoint(parts) else "other"
    return (1, "form") if tag == "form" else (0, "")


def _noise_words(value: str) -> set[str]:
    """The noise words of a class or id: any part of a name, but words of subjects only beside words of noise and layout."""
    found: set[str] = set()
    for one in _STATE.sub(" ", value).split():
        parts = [x for x in _PART.split(one) if x and not x.isdigit()]
        own = NOISE_WORDS.intersection(parts)
        if own - SUBJECT_WORDS or all(x in NOISE_WORDS or x in LAYOUT_WORDS for x in parts):
            found |= own
    return found


def _tags(page: str) -> Generator[tuple[int, int, str, str, str], int | None, None]:
    """(start, end, slash, name, attributes) of tags and, without a name, of comments and declarations, each found by going on from the last: time linear in the page.

    A quote counts after an equals sign. One that is never closed counts no more, nor do later ones; a tag that is never closed takes the rest.
    """
    quotes, at = True, 0
    while (at := page.find("<", at)) >= 0:
        name = _NAME.match(page, at)
        if not name:
            after = page[at + 1 : at + 2]
            if after not in ("!", "?", "/"):
                at += 1
                continue
            mark = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
            end = page.find(mark, at)
            end = end + len(mark) if end >= 0 else len(page)
            yield at, end, "", "", ""
            at = end
            continue
        end = name.end()
        while quotes:
            m = _MARK.search(page, end)
            if m and m[0] == ">":
                end = m.end()
                break
            if m and not page[max(name.end(), m.start() - 8) : m.start()].rstrip().endswith("="):
                end = m.end()
                continue
            close = page.find(m[0], m.end()) if m else -1
            if close < 0:
                quotes = False
            end = close + 1
        if not quotes:
            end = page.find(">", name.end()) + 1 or len(page) + 1
        end = min(end, len(page))
        behind = yield at, end, name[1], name[2].lower(), page[name.end() : end].removesuffix(">")
        at = end
        if behind is not None:  # behind raw content
            at = behind
            yield at, at, "", "", ""


def _lines(page: str, wrappers: frozenset[int]) -> tuple[list[tuple[str, int, bool, int]], frozenset[int]]:
    """The lines, and the places of elements named by a layout word that hold most of the text outside links; those in wrappers are text."""
    lines: list[tuple[str, int, bool, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # element, noise, its place, its container's place
    held: list[list[int]] = []  # in each element of the stack: characters outside links, the same and those of other people's text, all, main headings
    named: dict[int, tuple[str, list[int]]] = {}  # place of an element that is noise by its name -> what may save it, and what it holds
    total, anchors = [0, 0, 0, 0], 0
    opened: Counter[str] = Counter()
    links = linked = at = 0

    def in_article() -> bool:
        return bool(opened["article"] or opened["main"])

    def pop() -> str:
        tag, _, place, _ = stack.pop()
        n = held.pop()
        if place in named:
            named[place] = named[place][0], n
        into = held[-1] if held else total
        for i in range(4):
            into[i] += n[i]
        opened[tag] -= 1
        return tag

    def end_line() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            # A sentence that is a link is a sentence; menus are made of names.
            own = 0 if text.count(" ") >= 4 and _SENTENCE.search(text) else min(linked, len(text))
            lines.append((text, own, in_article(), stack[-1][3] if stack else -1))
        parts.clear()
        linked = 0

    def gap() -> None:
        end_line()
        lines.extend([GAP] * WINDOW)

    def add(text: str) -> None:
        nonlocal linked
        level = stack[-1][1] if stack else 0
        if text and level != 2 and text.strip():
            n, into = len(text) - text.count(" "), held[-1] if held else total
            into[2] += n
            if not anchors:
                into[1] += n
                into[0] += n * (level != 3)
        if text and not (stack and stack[-1][1]):
            parts.append(text)
            linked += len(text) * bool(links)

    tags = _tags(page)
    for start, end, slash, tag, attributes in tags:
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "a":
            anchors = 0 if slash else 1
        if tag == "a" and not (stack and stack[-1][1]):
            links = max(0, links + (-1 if slash else 1))
        if tag in BLOCK and not (stack and stack[-1][1]):
            end_line()
        if slash:
            if opened[tag]:
                was = stack[-1][1]
                while pop() != tag:
                    pass
                if was and not (stack and stack[-1][1]):
                    gap()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            tags.send(at)
            continue
        if tag in VOID or attributes.rstrip().endswith("/"):
            add(" " if tag == "br" else "")
            continue
        outer = stack[-1][1] if stack else 0
        own, saved_by = _noise(tag, attributes, in_article())
        if saved_by and outer != 2:
            named[start] = saved_by, [0, 0, 0, 0]
            if start in wrappers:
                own = 0
        noise = 2 if 2 in (outer, own) else max(outer, own)
        if outer == 1 and noise == 1 and tag in ("article", "main"):
            noise = 0
        if tag in BLOCK or noise:
            if noise and not outer:
                gap()
            if tag == "p" and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
                pop()
            stack.append((tag, noise, start, start if tag in CONTAINER else stack[-1][3] if stack else -1))
            held.append([0, 0, 0, int(tag in ("h1", "main", "article"))])
            opened[tag] += 1
    add(page[at:])
    end_line()
    while stack:
        pop()

    def saves(saved_by: str, plain: int, outside: int, all_text: int, heads: int) -> bool:
        if saved_by == "related":
            return outside > MOST * all_text
        if saved_by == "other":
            return outside >= NEARLY_ALL * total[1] > 0 or heads > 0 and outside > MOST * total[1]
        return plain > MOST * total[0]

    return lines, frozenset(k for k, (saved_by, n) in named.items() if saves(saved_by, *n))


def lines_of(page: str) -> list[tuple[str, int, bool, int]]:
    """(text, characters in links, inside an article, place of the container) by block in page order; noise leaves WINDOW empty lines."""
    lines, wrappers = _lines(page, frozenset())
    return _lines(page, wrappers)[0] if wrappers else lines


def surges(weights: list[float], window: int, level: float) -> list[tuple[int, int]]:
    """[start, end) of the lines between surge and dive points of the curve of window sums.

    A surge is where the sum of a window is positive and reaches level, a dive where the following windows have come to nothing; lines of no weight at a region's ends are left out.
    """
    upto = [0.0]
    for w in weights:
        upto.append(upto[-1] + w)
    n = len(weights)
    sums = [upto[min(n, i + window)] - upto[i] for i in range(n)]
    out, start = [], None
    for i, total in enumerate([*sums, 0]):
        if start is None and total > 0 and total >= level - 1e-6:
            start = i
        elif start is not None and total <= 0:
            out.append((start, i))
            start = None
    trimmed = []
    for a, b in out:
        # A dive lies behind windows that come to nothing; a surge may begin late in a slow rise, whose first lines belong to it.
        while a > 0 and weights[a - 1] > 0:
            a -= 1
        while a < b and weights[a] <= 0:
            a += 1
        while b > a and weights[b - 1] <= 0:
            b -= 1
        trimmed.append((a, b))
    return trimmed


def main_text(page: str | None) -> str:
    """The kept blocks, joined by an empty line.

    A line weighs its characters outside links. Lines of the page's article, and those in a container that already holds a region, weigh as much as makes a
    surge, links of a container between two of its regions as well: markup weighs, the curve decides.
    """
    lines = lines_of(page or "")
    own = sum(len(t) - n for t, n, inside, _ in lines if inside)
    article = any(x[2] for x in lines) and own >= MOST * sum(len(t) - n for t, n, *_ in lines)
    if article:
        lines = [x if x[2] else GAP for x in lines]
    weights = [float(len(t) if inside else len(t) - n) for t, n, inside, _ in lines]
    level = RISE * max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
    if article:
        weights = [max(w, level) if line[0] else 0.0 for w, line in zip(weights, lines, strict=True)]
    first, last = {}, {}
    for a, b in surges(weights, WINDOW, level):
        for i in range(a, b):
            if weights[i] > 0:
                first.setdefault(lines[i][3], i)
                last[lines[i][3]] = i
    for i, (text, _, _, c) in enumerate(lines):
        if text and c in first and (weights[i] > 0 or first[c] < i < last[c]):
            weights[i] = max(weights[i], level)
    return "\n\n".join(lines[i][0] for a, b in surges(weights, WINDOW, level) for i in range(a, b) if lines[i][0])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> pages without html, with text and n_chars (code points).

    A null or empty page, or one without main text, gives an empty text and 0. Character references are decoded,
    white space in a block becomes one space, unclosed elements end with their parents. Repeated rows are
    treated alike; columns named text or n_chars are replaced, others kept.
    """

    def compute(batch: pa.RecordBatch) -> list:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        return [texts, [len(t) for t in texts]]

    return add_columns(pages, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], compute).drop("html")
