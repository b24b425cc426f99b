"""Pages as trees: a tolerant, linear parser, and features of every node (for operator 13).

Nodes are elements that lay out blocks, and text blocks as leaves. Inline elements, whose text belongs to the block
around them, make no nodes; only their links are counted. Elements without readable text (scripts, styles, controls) leave nothing.
"""

from __future__ import annotations

import html
import re

import numpy as np

#: Classes of attribute tokens (fixed values). A token counts for a class if it is one of its words, or the plural of one.
TOKENS = {
    "content": "article articlebody content main maincontent mainbody post postbody entry entrycontent body story text hentry blogpost prose markdown richtext reader page single document",
    "nav": "nav navbar navigation navigator menu submenu megamenu breadcrumb crumb pagination pager toc tab skip sitemap toolbar subnav dropdown",
    "header": "header masthead logo branding topbar siteheader pageheader tagline brand head top",
    "footer": "footer copyright colophon legal bottom imprint foot sitefooter pagefooter contentinfo",
    "side": "sidebar aside widget rail secondary complementary related recommended recommendation popular trending more latest archive tag tagcloud category blogroll teaser readmore sidecolumn",
    "ad": "ad adv advert advertisement advertising advertiser sponsor sponsored promo promotion promoted banner adsense adsbygoogle dfp commercial outbrain taboola affiliate adslot adunit adbox",
    "notice": "cookie consent gdpr ccpa notice notification alert popup modal overlay dialog toast paywall disclaimer privacy warning announcement interstitial infobar snackbar message lightbox",
    "form": "form login signin signup subscribe subscription newsletter search searchbox register registration contact poll survey input field fieldset",
    "comment": "comment commentlist commentsection commenter disqus reply respond response discussion guestbook thread",
    "social": "share sharing social follow like tweet facebook twitter print bookmark addthis sharethis socialbar",
}
CLASSES = list(TOKENS)
_BIT = {w: 1 << i for i, c in enumerate(CLASSES) for w in TOKENS[c].split()}
CONTENT, HIDDEN = 1, 1 << len(CLASSES)
N_BITS = len(CLASSES) + 1
BOILERPLATE = (1 << N_BITS) - 2
_ROLE = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "dialog": "notice", "alertdialog": "notice", "alert": "notice", "main": "content", "article": "content", "menu": "nav", "menubar": "nav"}
_TAG_BIT = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice", "article": "content", "main": "content"}

#: Groups of elements that lay out blocks; "text" are the leaves.
GROUPS = {
    "article": "article main", "section": "section", "div": "div center address hgroup search", "p": "p", "title": "h1", "heading": "h2 h3 h4 h5 h6", "item": "li dt dd",
    "list": "ul ol dl dir", "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset legend", "table": "table tbody thead tfoot tr td th caption",
    "quote": "blockquote pre figure figcaption listing xmp plaintext", "dialog": "dialog details summary", "root": "html body frameset noframes", "other": "hr",
}
GROUP = {t: i for i, g in enumerate(GROUPS) for t in GROUPS[g].split()}
OTHER, TEXT = list(GROUPS).index("other"), len(GROUPS)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame".split())
#: Their content isn't read as elements.
RAW = frozenset("script style textarea title noscript iframe noembed".split())
#: Their content is no text of the page.
SILENT = frozenset("template svg math select button option optgroup datalist object canvas audio video map progress meter output".split())
#: What a start tag closes: itself if open, up to the nearest of the second.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
_TABLE = ("table",)

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>=\"']++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>",
    re.S,
)
_OPEN = re.compile(r"</?[a-zA-Z]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|aria-label|style|hidden|aria-hidden|data-[a-z-]+)(?![^\s=/])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_UPPER, _DIGIT = re.compile("[A-Z]"), re.compile("[0-9]")
_SENTENCE = re.compile(r"[.!?;:,…。！？](?=\s|$)")


def token_bits(text: str) -> int:
    """Classes of the tokens of an attribute's value, whether joined by signs or by capitals."""
    bits = 0
    for word in re.split(r"[^A-Za-z]+", text):
        low = word.lower()
        parts = [low] if low in _BIT or low.removesuffix("s") in _BIT else [x.lower() for x in _WORD.findall(word)]
        for x in parts:
            bits |= _BIT.get(x) or _BIT.get(x.removesuffix("s")) or (_BIT.get(x[:-3] + "y", 0) if x.endswith("ies") else 0)
    return bits


class Reader:
    """Parses pages. Values of attributes repeat much, so their classes are remembered, up to ``memo`` of them."""

    def __init__(self, memo: int = 20_000):
        self.known: dict[str, int] = {}
        self.memo = memo

    def bits(self, tag: str, attrs: str) -> int:
        bits = 1 << CLASSES.index(_TAG_BIT[tag]) if tag in _TAG_BIT else 0
        if not attrs or attrs.isspace():
            return token_bits(tag) if "-" in tag else bits
        key = f"{tag} {attrs}"
        got = self.known.get(key)
        if got is None:
            got = bits | (token_bits(tag) if "-" in tag else 0)
            for m in _ATTR.finditer(attrs):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "role":
                    got |= sum(1 << CLASSES.index(_ROLE[r]) for r in {v.lower() for v in value.split()} if r in _ROLE)
                elif name == "style":
                    got |= HIDDEN if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else 0
                elif name == "hidden":
                    got |= HIDDEN
                elif name == "aria-hidden":
                    got |= HIDDEN if value.lower() == "true" else 0
                else:
                    got |= token_bits(value)
            if len(key) <= 256:
                if len(self.known) >= self.memo:
                    self.known.clear()
                self.known[key] = got
        return got

    def parse(self, page: str) -> Dom:
        """The tree of a page, in time linear in its length, at any depth."""
        return _parse(self, page)


class Dom:
    """Nodes in the order of their start: parent, group, bits of own attributes, bits of all above, depth; ``end``: where the subtree ends.

    stats: of each node's own text (leaves only): characters, words, characters in links, sentence signs, capitals, digits;
    inner: of inline elements and images directly in a node. texts: of the leaves, by node.
    """

    def __init__(self):
        self.parent, self.group, self.own, self.above, self.depth, self.end = [-1], [GROUP["body"]], [0], [0], [0], [0]
        self.inner: list[int] = [0]
        self.texts: dict[int, str] = {}
        self.linked: dict[int, int] = {}

    def add(self, parent: int, group: int, bits: int) -> int:
        self.parent.append(parent)
        self.group.append(group)
        self.own.append(bits)
        self.above.append(self.above[parent] | self.own[parent])
        self.depth.append(self.depth[parent] + 1)
        self.end.append(0)
        self.inner.append(0)
        return len(self.parent) - 1


def _parse(reader: Reader, page: str) -> Dom:
    dom = Dom()
    stack: list[tuple[str, int]] = [("body", 0)]  # elements that lay out blocks or are silent: (tag, node; -1 inside silent ones)
    open_at: dict[str, list[int]] = {}  # places in the stack, by tag
    here = silent = 0  # the nearest node; open silent elements
    link = 0  # size of the stack when the open link began, 0 if none is open
    run: list[str] = []
    linked = 0  # characters of the run in links

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                leaf = dom.add(here, TEXT, 0)
                dom.end[leaf] = leaf + 1
                dom.texts[leaf] = text
                dom.linked[leaf] = min(linked, len(text))
        linked = 0

    def pop_to(at: int) -> None:
        """Closes everything from place ``at`` of the stack on."""
        nonlocal here, silent, link
        while len(stack) > at:
            tag, node = stack.pop()
            open_at[tag].pop() if tag in open_at else None
            silent -= tag in SILENT
            if node >= 0:
                flush()
                dom.end[node] = len(dom.parent)
                here = dom.parent[node]
        link = link if link <= len(stack) else 0

    def last(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    def text(s: str) -> None:
        nonlocal linked
        if s and not silent:
            if "&" in s:
                s = html.unescape(s)
            run.append(s)
            linked += len(s.strip()) if link else 0

    def close_paragraph() -> None:
        if open_at.get("p") and open_at["p"][-1] > last(("td", "th", "table")):
            pop_to(open_at["p"][-1])

    at, n, final = 0, len(page), page.rfind(">")
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        m = _TAG.match(page, lt) if lt < final or page.startswith(("<!", "<?"), lt) else None
        if m is None:
            if lt > final and _OPEN.match(page, lt):  # a tag that breaks off at the end of the page
                break
            text("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if open_at.get(tag):
                pop_to(open_at[tag][-1])
            elif tag == "p":
                flush()
            elif tag == "br":
                text(" ")
            elif tag == "a":
                link = 0
            continue
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), m[3] or ""
        if tag in RAW:
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else n
        elif tag in ("html", "head", "body"):
            dom.own[0] |= reader.bits(tag, attrs) & HIDDEN
        elif tag in VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr" and not silent:
                close_paragraph()
                flush()
            dom.inner[here] += 1
        elif tag in GROUP or tag in SILENT or "-" in tag:
            if tag in SILENT and attrs.endswith("/"):
                continue
            node = -1
            if not silent and tag not in SILENT:
                if tag in GROUP:
                    close_paragraph()
                if tag in _CLOSES:
                    scope = last(_SCOPE.get(tag, _TABLE))
                    if inner := [open_at[t][-1] for t in _CLOSES[tag] if open_at.get(t) and open_at[t][-1] > scope]:
                        pop_to(min(inner))
                flush()
                here = node = dom.add(here, GROUP.get(tag, OTHER), reader.bits(tag, attrs))
            else:
                dom.inner[here] += 1
            silent += tag in SILENT
            open_at.setdefault(tag, []).append(len(stack))
            stack.append((tag, node))
        else:  # inline elements
            dom.inner[here] += 1
            link = len(stack) if tag == "a" else link
    pop_to(1)
    flush()
    dom.end[0] = len(dom.parent)
    return dom


#: Names of the columns of ``features``.
NAMES = (
    [f"own {c}" for c in (*CLASSES, "hidden")]
    + [f"above {c}" for c in (*CLASSES, "hidden")]
    + [f"is {g}" for g in (*GROUPS, "text")]
    + ["nearest class above", "depth below content", "page has content", "depth", "chars", "words", "link share", "chars per tag", "signs per word", "capitals", "digits", "rights sign",
       "share of page", "starts at", "ends at", "children", "place among siblings", "siblings", "siblings alike", "size to siblings", "leaves", "items", "chars per leaf",
       "link share of parent", "chars per tag of parent", "chars of parent", "share of parent", "after title", "title inside"]
)


def features(doms: list[Dom]) -> np.ndarray:
    """One row per node of all pages, in order; columns as NAMES. All of a node's columns come from its page alone."""
    sizes = np.array([len(d.parent) for d in doms])
    total = int(sizes.sum())
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype("i8") if len(sizes) else np.zeros(0, "i8")
    page = np.repeat(np.arange(len(doms)), sizes)
    flat = lambda name: np.fromiter((v for d in doms for v in getattr(d, name)), "i8", total)
    root = base[page]
    parent, end = flat("parent"), flat("end") + root
    is_root = parent < 0
    parent = np.where(is_root, np.arange(total), parent + root)
    group, own, above, depth, inner = flat("group"), flat("own"), flat("above"), flat("depth"), flat("inner")
    leaf = np.zeros((total, 7))
    for d, b in zip(doms, base.tolist(), strict=True):
        for i, t in d.texts.items():
            leaf[b + i] = len(t), t.count(" ") + 1, d.linked[i], len(_SENTENCE.findall(t)), len(_UPPER.findall(t)), len(_DIGIT.findall(t)), "©" in t
    upto = np.vstack([np.zeros(7), np.cumsum(leaf, axis=0)])
    me = np.arange(total)
    sub = upto[end] - upto[me]
    count = lambda of: (c := np.concatenate([[0], np.cumsum(of)]))[end] - c[me]
    is_leaf = group == TEXT
    tags = count(np.where(is_leaf, 0, 1 + inner))
    leaves = count(is_leaf)
    kids = np.bincount(parent[~is_root], minlength=total) if total else np.zeros(0)
    kid_chars = np.bincount(parent[~is_root], weights=sub[~is_root, 0], minlength=total)
    order = np.argsort(np.where(is_root, -1, parent), kind="stable")
    place = np.zeros(total, "i8")
    if total:
        sorted_parent = np.where(is_root, -1 - page, parent)[order]
        new = np.append(True, sorted_parent[1:] != sorted_parent[:-1])
        starts = np.flatnonzero(new)
        place[order] = me - starts[np.cumsum(new) - 1]
    alike_key = parent * 32 + group
    _, inverse, alike = np.unique(alike_key, return_inverse=True, return_counts=True)
    whole = sub[root]
    chars, siblings = sub[:, 0], np.maximum(kids[parent], 1)
    link_share, density = sub[:, 2] / np.maximum(chars, 1), chars / (1 + tags)
    before = upto[me, 0] - upto[root, 0]
    nearest, below = _nearest(doms, total)
    title = group == GROUP["h1"]
    titles = np.concatenate([[0], np.cumsum(title)])
    bit = lambda v: ((v[:, None] >> np.arange(N_BITS)) & 1).astype("f8")
    has_content = np.zeros(len(doms))
    np.maximum.at(has_content, page, np.isin(group, [GROUP["article"]]).astype("f8"))
    columns = [
        nearest, below, has_content[page], np.minimum(depth, 50), np.log1p(chars), np.log1p(sub[:, 1]), link_share, density, sub[:, 3] / np.maximum(sub[:, 1], 1), sub[:, 4] / np.maximum(chars, 1),
        sub[:, 5] / np.maximum(chars, 1), sub[:, 6] > 0, chars / np.maximum(whole[:, 0], 1), before / np.maximum(whole[:, 0], 1), (before + chars) / np.maximum(whole[:, 0], 1),
        kids, place, siblings, alike[inverse] / siblings, np.log1p(chars) - np.log1p(kid_chars[parent] / siblings), np.log1p(leaves), np.log1p(count(group == GROUP["li"])), chars / np.maximum(leaves, 1),
        link_share[parent], density[parent], np.log1p(chars[parent]), chars / np.maximum(chars[parent], 1), titles[me] > titles[root], titles[end] > titles[me],
    ]
    kinds = (group[:, None] == np.arange(TEXT + 1)).astype("f8")
    return np.hstack([bit(own), bit(above), kinds, np.column_stack([np.asarray(c, "f8") for c in columns])]) if total else np.zeros((0, len(NAMES)))


def _nearest(doms: list[Dom], total: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the nearest element above (or the node itself) with a class: 1 content, -1 other, 0 none; and levels below the nearest content."""
    sign, below = np.zeros(total), np.zeros(total)
    at = 0
    for d in doms:
        s, b = [0] * len(d.parent), [20] * len(d.parent)
        for i, p in enumerate(d.parent):
            own = d.own[i]
            s[i] = -1 if own & BOILERPLATE else 1 if own & CONTENT else s[p] if p >= 0 else 0
            b[i] = 0 if own & CONTENT and not own & BOILERPLATE else min(20, b[p] + 1) if p >= 0 else 20
        sign[at : at + len(s)], below[at : at + len(s)] = s, b
        at += len(s)
    return sign, below
