"""HTML to leaf blocks: a small forgiving reader for the block labeller.

Comments, declarations, and what stands in elements that are never text
(script, style, form controls and the like) are dropped; what stands in for a
script, an object or a film is a block of its own that the labeller judges. Block elements end a
block; inline markup and line breaks don't, a ``br`` is white space. Character
references are decoded. A block has the words of its tag path: element names,
and words of class, id and role of the elements it is in.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements that end a block (fixed values).
BLOCK = frozenset(
    "address article aside audio blockquote body button canvas caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav noscript object ol optgroup option "
    "p pre section summary table tbody td tfoot th thead tr ul video".split())
#: Elements whose content is never text of the page (fixed values).
SILENT = frozenset("datalist embed iframe script select style svg template textarea title".split())
#: Elements without content (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes first, if it is the innermost open block (fixed values).
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Block:
    path: tuple[str, ...]       # words of the tag path, outermost first
    text: str                   # white space made one space, trimmed
    links: float                # share of its characters inside links


def _element(tag: str, attrs: str) -> tuple[str, ...]:
    words = [tag]
    for _, a, b, c in _ATTR.findall(attrs):
        words += [f"{w.lower()}" for w in _WORDS.findall(a or b or c)]
    return tuple(words)


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page, in page order; none for NULL or empty pages."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = plain = 0
    in_link, silent, at = False, "", 0
    cache: dict[tuple[str, str], tuple[str, ...]] = {}

    def end() -> None:
        nonlocal linked, plain
        if held:
            text = " ".join("".join(held).split())
            if text:
                path = tuple(w for _, words in stack for w in words)
                out.append(Block(path, text, linked / max(1, linked + plain)))
            held.clear()
        linked = plain = 0

    def say(raw: str) -> None:
        nonlocal linked, plain
        text = html.unescape(raw) if "&" in raw else raw
        held.append(text)
        if in_link:
            linked += len(text)
        else:
            plain += len(text)

    while True:
        if silent:
            # up to its own end tag, whatever is in between
            stop = re.compile(rf"</{re.escape(silent)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            silent, at = "", stop.end() if stop else len(page)
        m = _TAG.search(page, at)
        if m is None:
            if at < len(page):
                say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        slash, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if tag == "a":
                in_link = False
            elif tag in BLOCK:
                end()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
            continue
        if tag in SILENT:
            if not attrs.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                silent = tag
            continue
        if tag == "br":
            held.append(" ")
        elif tag == "a":
            in_link = True
        elif tag in BLOCK:
            end()
            closing = CLOSES.get(tag, {"p"})
            while stack and stack[-1][0] in closing:
                stack.pop()
            if tag not in VOID:
                key = (tag, attrs)
                if key not in cache:
                    cache[key] = _element(tag, attrs) if attrs else (tag,)
                stack.append((tag, cache[key]))
    end()
    return out
