"""Flat text blocks of an HTML page, with what a classifier wants to know about each.

One pass over the markup, linear in its length however broken it is: block elements end a block,
inline elements do not, unclosed quotes, comments and elements are closed where browsers would or
at the end of the page.  Scripts, styles and other raw text are no text.  Character references are
decoded, white space becomes one space, blocks without text vanish.

A block's ``mark`` says what its containers say of it: 2 inside an article, 1 inside a main part, 0
nothing, -1 inside what is no article (menus, headers, footers, sidebars, notices, adverts, forms,
comments).  Inner containers overrule outer ones, but nothing inside comments or hidden parts
becomes an article again.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np

# Element names, and words in class, id and role attributes.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button center caption dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
EMPTY_TAGS = frozenset(["hr"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
RAW_TAGS = frozenset(["script", "style", "title", "textarea", "xmp"])
# Left out as well, but an end tag that is missing does not take the rest of the page along.
LEFT_OUT = frozenset(["noscript", "iframe", "template", "svg", "math", "object", "noembed", "noframes", "canvas"])
SPACING_TAGS = frozenset(["br", "wbr", "img", "input"])
IMPLIED_END = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "tr": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
NOT_ARTICLE_TAGS = frozenset("nav footer aside button select dialog menu search label legend".split())
NOT_ARTICLE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog status menu "
    "menubar toolbar".split()
)
NOT_ARTICLE_WORDS = re.compile(
    r"(?:nav(?:bar|igation)?|menus?|masthead|header|footer|sidebar|aside|ads?|advert\w*|adsense|sponsor\w*|"
    r"promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|"
    r"signup|login|shar(?:e|ing)|social|related|recommend\w*|breadcrumbs?|pagination|pager|toolbar|"
    r"widgets?|copyright|legal|disclaimer|form|search|teasers?)$"
)
COMMENT_WORDS = re.compile(r"(?:comment\w*|repl(?:y|ies)|respond|responses?|discussion|disqus|guestbook)$")
ARTICLE_WORDS = frozenset(["article", "articlebody", "post", "entry", "story", "blogpost"])
MAIN_WORDS = frozenset(["main", "content", "maincontent"])

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s/>=]|$)", re.I)
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_RIGHTS = re.compile(r"^(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in RAW_TAGS | LEFT_OUT}


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    mark: int
    tag: str


def _tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends the tag, quotes passed over; the page's end if there is none."""
    while True:
        stop = _STOP.search(page, at)
        if stop is None:
            return len(page)
        if stop.group() == ">":
            return stop.start()
        closing = page.find(stop.group(), stop.end())
        # A quote that is never closed quotes nothing; it is the last of its kind on the page.
        at = stop.end() if closing < 0 else closing + 1


def _own_mark(tag: str, attributes: str) -> tuple[int | None, bool]:
    """What an element says of itself (None: nothing), and whether that holds for all inside."""
    found = {}
    for name, *values in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        found.setdefault(name.lower(), "".join(values))
    if _HIDDEN.search(attributes) or _NO_DISPLAY.search(found.get("style", "")):
        return -1, True
    names = f"{found.get('class', '')} {found.get('id', '')}"
    words = [w.lower() for w in _WORD.findall(names)]
    role = found.get("role", "").lower()
    if any(COMMENT_WORDS.match(w) for w in words):
        return -1, True
    if tag in NOT_ARTICLE_TAGS or role in NOT_ARTICLE_ROLES:
        return -1, False
    if tag not in ("html", "body"):
        ours = ARTICLE_WORDS.intersection(words)
        against = [w for w in words if NOT_ARTICLE_WORDS.match(w)]
        if against and not (ours and set(against) == {"header"}):
            return -1, False
        if tag == "article" or role == "article" or ours or "articleBody" in found.get("itemprop", ""):
            return 2, False
        if tag == "main" or role == "main" or MAIN_WORDS.intersection(words):
            return 1, False
    return (-1, False) if tag == "form" else (None, False)


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in page order; none for a null or empty page."""
    found: list[Block] = []
    if not page:
        return found
    # Open block elements: name, mark, whether that holds for all inside, whether in a header of an
    # article, whether an element (and not only a name given to one) says that this is no article.
    stack: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
    open_tags: dict[str, int] = {}
    pieces: list[str] = []
    linked = 0
    link_depth = 0  # elements open where the link began; 0 outside of links
    size, at = len(page), 0

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = html.unescape(text)
        pieces.append(text)
        if link_depth:
            linked += len(text.split())

    def flush() -> None:
        nonlocal linked
        words = "".join(pieces).split() if pieces else None
        pieces.clear()
        if words:
            tag, mark, _, in_header, _ = stack[-1]
            if in_header and tag not in HEADINGS:
                mark = -1
            found.append(Block(" ".join(words), len(words), min(linked, len(words)), mark, tag))
        linked = 0

    def pop() -> str:
        nonlocal link_depth
        name = stack.pop()[0]
        open_tags[name] -= 1
        if link_depth > len(stack):
            link_depth = 0
        return name

    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            # ``<!-->`` and ``<!--->`` are whole comments.
            close = page.find("-->", start + 2)
            at = size if close < 0 else close + 3
            continue
        closing = page.startswith("/", start + 1)
        name = _NAME.match(page, start + 1 + closing)
        if name is None:
            if closing or page.startswith(("!", "?"), start + 1):
                close = page.find(">", start)
                at = size if close < 0 else close + 1
            else:
                add("<")
                at = start + 1
            continue
        tag = name.group().lower()
        end = _tag_end(page, name.end())
        at = end + 1
        if closing:
            if tag == "a":
                link_depth = 0
            elif tag in BLOCK_TAGS:
                flush()
                if open_tags.get(tag):
                    while pop() != tag:
                        pass
            elif tag in SPACING_TAGS:
                pieces.append(" ")
            continue
        if tag in RAW_TAGS or tag in LEFT_OUT:
            close = _CLOSING[tag].search(page, at)
            if close is not None:
                at = _tag_end(page, close.end()) + 1
            elif tag in RAW_TAGS:
                at = size
            continue
        if tag == "a":
            link_depth = len(stack)
        elif tag in SPACING_TAGS:
            pieces.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            ended = IMPLIED_END.get(tag, ())
            while stack[-1][0] == "p" or stack[-1][0] in ended:
                pop()
            if tag in EMPTY_TAGS:
                continue
            _, mark, lasting, in_header, other = stack[-1]
            if not lasting:
                own, lasting = _own_mark(tag, page[name.end() : end])
                if tag == "header" and own != 2:
                    # The header of an article may hold its title; that of a page does not.
                    if mark > 0:
                        in_header, own = True, None
                    else:
                        own = -1
                if own is not None and (own < 0 or mark >= 0):
                    mark = own if own < 0 else max(mark, own)
                elif own is not None and (tag == "main" or (tag == "article" and not other)):
                    mark = own
            stack.append((tag, mark, lasting, in_header, other or tag in NOT_ARTICLE_TAGS))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return found


# What containers say comes first, so that it decides where features split a table alike.
FEATURES = [
    "below_best", "mark", "best", "linked", "rights", "words", "sentence", "words_before",
    "words_after", "linked_before", "linked_after", "heading", "paragraph", "mark_before", "mark_after",
]


def features(found: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` for each block of a page; ``linked`` is a share of the words."""
    n = len(found)
    words = np.array([b.words for b in found], float)
    linked = np.array([b.linked for b in found], float) / np.maximum(words, 1)
    marks = np.array([b.mark for b in found], float)
    best = np.full(n, max(0.0, marks.max(initial=0.0)))

    def before(x: np.ndarray) -> np.ndarray:
        return np.r_[0.0, x[:-1]][:n]

    def after(x: np.ndarray) -> np.ndarray:
        return np.r_[x[1:], 0.0][:n]

    columns = {
        "below_best": best - marks,
        "mark": marks,
        "best": best,
        "linked": linked,
        "rights": [_RIGHTS.search(b.text) is not None for b in found],
        "words": words,
        "sentence": [b.text[-1] in ".!?:;…\"'”’»)" for b in found],
        "words_before": before(words),
        "words_after": after(words),
        "linked_before": before(linked),
        "linked_after": after(linked),
        "heading": [b.tag in HEADINGS for b in found],
        "paragraph": [b.tag in ("p", "blockquote", "pre") for b in found],
        "mark_before": before(marks),
        "mark_after": after(marks),
    }
    return np.column_stack([np.asarray(columns[name], float) for name in FEATURES])
