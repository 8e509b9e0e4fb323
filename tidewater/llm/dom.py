"""Pages of HTML as trees of blocks: block-level elements, and leaves that hold the text between their boundaries.

Inline markup melts into its block; only how much of a leaf's text is linked is kept. The tree is built in one pass with
the usual forgiveness: paragraphs, list items, cells and options end where the next one begins, end tags without a start
are ignored, and what is open at the end is closed. Comments, scripts, styles and the head's title hold no text.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?:(?P<attrs>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<broken>[^>]*+)(?:>|\Z))"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: How elements are grouped for the model; every element named here is a block, all others are inline.
GROUPS = {
    "leaf": (),
    "root": ("html", "body"),
    "nav": ("nav", "menu"),
    "header": ("header", "hgroup"),
    "footer": ("footer", "address"),
    "aside": ("aside",),
    "article": ("article",),
    "main": ("main",),
    "section": ("section",),
    "div": ("div", "center"),
    "p": ("p",),
    "heading": ("h1", "h2", "h3", "h4", "h5", "h6"),
    "list": ("ul", "ol", "dl", "dir"),
    "item": ("li", "dt", "dd"),
    "table": ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"),
    "form": ("form", "fieldset", "legend", "button", "select", "option", "optgroup", "label", "search", "output"),
    "figure": ("figure", "figcaption"),
    "quote": ("blockquote", "pre"),
    "fold": ("details", "summary", "dialog"),
}
GROUP_OF = {tag: k for k, tags in enumerate(GROUPS.values()) for tag in tags}
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noframes", "noembed", "xmp", "svg", "object", "canvas"}
VOID_BREAKS = {"hr"}
#: An element of the first kind ends an open one of the second, unless one of the third stands between.
ENDS = (
    (("li",), ("li",), ("ul", "ol", "dir", "menu")),
    (("dt", "dd"), ("dt", "dd"), ("dl",)),
    (("td", "th"), ("td", "th"), ("table", "tr")),
    (("tr", "tbody", "thead", "tfoot"), ("tr",), ("table",)),
    (("tbody", "thead", "tfoot"), ("tbody", "thead", "tfoot"), ("table",)),
    (("option", "optgroup"), ("option",), ("select",)),
)
IMPLIED = {tag: [(ended, stop) for own, ended, stop in ENDS if tag in own] for own, _, _ in ENDS for tag in own}


@dataclass
class Tree:
    """Nodes in page order, parents first: parent (-1 for the first), group, hints (see hints_of), text and linked characters of leaves."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    hints: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


#: Words of classes, ids and roles, by what they hint at. A word counts if a name's part is it, or begins with it and a star.
HINT_WORDS = {
    "advert": "ad ads adv advert* adsense adslot adbox adunit sponsor* promo* promoted dfp outbrain taboola affiliate",
    "menu": "nav nav* navigation menu* breadcrumb* toc tabs pagination pager skip toolbar dropdown topbar",
    "frame": "header masthead footer foot banner contentinfo copyright legal colophon sitehead sitefoot bottombar logo branding",
    "side": "sidebar* side rail aside widget* complementary secondary",
    "notice": "notice* cookie* consent gdpr popup modal overlay alert* dialog toast newsletter subscribe subscription signup paywall disclaimer warning announcement",
    "comment": "comment* reply replies respond responses discussion disqus reader readers feedback thread",
    "related": "related recommend* share sharing social more popular trending tags tagcloud teaser* recirc outro",
    "form": "form search login contact survey poll",
    "content": "article* content entry post story main body text prose copy maincontent page",
}
HINTS = [*HINT_WORDS, "hidden"]
_EXACT = {w: 1 << k for k, words in enumerate(HINT_WORDS.values()) for w in words.split() if not w.endswith("*")}
_BEGINS = [(w[:-1], 1 << k) for k, words in enumerate(HINT_WORDS.values()) for w in words.split() if w.endswith("*")]
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_KNOWN: dict[str, tuple[int, int]] = {}


def hints_of(attrs: str) -> tuple[int, int]:
    """What class, id, role and visibility hint at, as bits in the order of HINTS, and the label in data-main (-1 for none)."""
    known = _KNOWN.get(attrs)
    if known is None:
        bits, label = 0, -1
        for m in ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role"):
                for part in _PART.findall(value):
                    part = part.lower()
                    bits |= _EXACT.get(part, 0)
                    for begin, bit in _BEGINS:
                        if part.startswith(begin):
                            bits |= bit
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                bits |= 1 << len(HINT_WORDS)
            elif name == "data-main":
                label = int(value == "1")
        if len(_KNOWN) > 20_000:
            _KNOWN.clear()
        _KNOWN[attrs] = known = bits, label
    return known


def parse(page: str) -> Tree:
    """The tree of a page; its first node stands for the page itself."""
    tree = Tree()
    stack, names, opened, links = [0], ["html"], {"html": 1}, 0
    pieces: list[str] = []
    linked = 0

    def add(group: int, hints: int, label: int, text: str = "", link: int = 0) -> int:
        up = stack[-1] if tree.parent else -1
        tree.parent.append(up)
        tree.depth.append(tree.depth[up] + 1 if up >= 0 else 0)
        tree.group.append(group)
        tree.hints.append(hints)
        tree.label.append(label if label >= 0 else tree.label[up] if up >= 0 else 0)
        tree.text.append(text)
        tree.linked.append(link)
        return len(tree.parent) - 1

    def leaf() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                add(0, 0, -1, text, min(linked, len(text)))
            pieces.clear()
        linked = 0

    def close(at: int) -> None:
        """Ends the open elements from place at on."""
        leaf()
        for name in names[at:]:
            opened[name] -= 1
        del names[at:], stack[at:]

    def words(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = entities.unescape(text)
        pieces.append(text)
        if links > 0:
            linked += len(text.strip())

    add(GROUP_OF["html"], 0, 0)
    at, match = 0, TOKEN.search(page)
    while match:
        if match.start() > at:
            words(page[at : match.start()])
        at = match.end()
        name = (match["name"] or "").lower()
        if not name:
            pass
        elif name in RAW and not match["end"]:
            found = re.compile(f"</{re.escape(name)}", re.IGNORECASE).search(page, at)
            at = (page.find(">", found.end()) + 1 or len(page)) if found else len(page)
        elif name == "a":
            links = 0 if match["end"] else 1
        elif name == "br":
            pieces.append("\n")
        elif name in VOID_BREAKS:
            if opened.get("p"):
                close(len(names) - 1 - names[::-1].index("p"))
            leaf()
        elif name not in GROUP_OF or name in ("html", "body"):
            if name == "body" and not match["end"]:
                hints, label = hints_of(match["attrs"] or "")
                tree.hints[0] |= hints
        elif match["end"]:
            if opened.get(name):
                k = len(names) - 1
                while names[k] != name:
                    k -= 1
                close(k)
        else:
            if opened.get("p") and name not in ("button", "label", "select", "option", "output", "legend"):
                k = len(names) - 1
                while names[k] not in ("p", "button", "td", "th", "caption"):
                    k -= 1
                if names[k] == "p":
                    close(k)
            for ended, stop in IMPLIED.get(name, ()):
                if any(opened.get(e) for e in ended):
                    k = len(names) - 1
                    while k > 0 and names[k] not in ended and names[k] not in stop:
                        k -= 1
                    if names[k] in ended:
                        close(k)
            leaf()
            node = add(GROUP_OF[name], *hints_of(match["attrs"] or match["broken"] or ""))
            stack.append(node)
            names.append(name)
            opened[name] = opened.get(name, 0) + 1
        match = TOKEN.search(page, at)
    words(page[at:])
    leaf()
    return tree
