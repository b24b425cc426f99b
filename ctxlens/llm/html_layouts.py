"""Layouts with known labels, set from the blocks of sampled pages: what the trees of operator 13 learn from.

A layout puts an article into one of many containers, among menus, headers, footers, sidebars, notices, adverts, forms and comments, inside
and outside the article, which are named by their element, by their class or id, or not at all.
"""

from __future__ import annotations

import html

import numpy as np

#: Elements that name a kind of boilerplate by themselves.
ELEMENTS = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "notice": "dialog"}
#: Names that say nothing of what is inside.
PLAIN = ("", "", "row", "col", "wrapper", "container", "inner", "box", "outer", "c{}", "css-{}", "el{}", "block", "grid", "clearfix", "section{}", "mod-{}")
OUTSIDE = ("nav", "header", "footer", "side", "ad", "notice", "form", "comment", "social")


class _Page:
    def __init__(self, rng: np.random.Generator, blocks: list[str], tokens: dict[str, str]):
        self.rng, self.tokens = rng, {k: v.split() for k, v in tokens.items()}
        self.blocks = [b[:1500] for b in blocks] or [" ".join(f"w{x}" for x in rng.integers(0, 99, n)) + "." for n in (3, 9, 20, 40)]
        self.out: list[str] = []
        self.labels: list[bool] = []

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, of):
        return of[int(self.rng.integers(len(of)))]

    def number(self, lo: int, hi: int) -> int:
        return int(self.rng.integers(lo, hi + 1))

    def words(self, lo: int, hi: int) -> str:
        w = self.pick(self.blocks).split()
        k = self.number(lo, hi)
        at = self.number(0, max(0, len(w) - k))
        return " ".join(w[at : at + k])

    def text(self, s: str, label: bool) -> str:
        """The markup of a text block; at times with links or emphasis inside."""
        self.labels.append(label)
        w = html.escape(s, quote=False).split(" ")
        if len(w) > 6 and self.chance(0.15):
            a = self.number(0, len(w) - 3)
            tag = self.pick(("a href='/x'", "em", "strong", "span", "i", "code"))
            w[a], w[a + 1] = f"<{tag}>{w[a]}", f"{w[a + 1]}</{tag.split()[0]}>"
        if len(w) > 3 and self.chance(0.05):
            w[len(w) // 2] += "<br>"
        return " ".join(w)

    def put(self, *parts: str) -> None:
        self.out += parts

    def name(self, kind: str | None) -> str:
        """An attribute that names a kind, or nothing in particular."""
        if kind is None:
            word = self.pick(PLAIN).format(self.number(1, 99))
        else:
            word = self.pick(self.tokens[kind])
            extra = self.pick(("", "", "block", "box", "area", "wrap", "list", "inner", str(self.number(1, 9))))
            word = self.pick((f"{word}-{extra}", f"{extra}-{word}", f"{word}_{extra}", word + extra.title(), f"{word} {extra}", word)).strip("-_ ") if extra else word
            word = word + "s" if self.chance(0.2) and not word.endswith("s") else word
            word = f"{self.pick(PLAIN).format(3)} {word}".strip() if self.chance(0.2) else word
        return f' {self.pick(("class", "class", "class", "id"))}="{word}"' if word else ""

    def open(self, kind: str) -> str:
        """Starts the container of a kind of boilerplate; returns its element. Kinds that look like themselves may go unnamed."""
        how = self.rng.random()
        telling = kind in ("nav", "social")
        if kind in ELEMENTS and how < 0.5:
            tag = ELEMENTS[kind]
            self.put(f"<{tag}{self.name(kind) if self.chance(0.4) else self.name(None)}>")
        else:
            tag = self.pick(("div", "div", "div", "section", "aside" if kind in ("ad", "side", "social") else "div", "ul" if telling else "div", "p" if kind in ("ad", "notice") else "div"))
            self.put(f"<{tag}{self.name(None if telling and how > 0.9 else kind)}>")
        return tag

    def links(self, n: int, label: bool = False, item: str = "li") -> None:
        for _ in range(n):
            self.put(f"<{item}><a href='/{self.number(1, 999)}'>", html.escape(self.words(1, 4)), f"</a></{item}>")
            self.labels.append(label)

    def boilerplate(self, kind: str) -> None:
        tag = self.open(kind)
        block = "p" if tag != "p" else "span"
        if self.chance(0.25) and tag != "p":
            self.put(f"<div{self.name(None)}>")
            tag = f"div></{tag}"
        if kind in ("nav", "social"):
            inner = "ul" if not tag.endswith("ul") and self.chance(0.7) else ""
            self.put(f"<{inner}>" if inner else "")
            self.links(self.number(2, 10), item="li" if inner or tag == "ul" else self.pick(("div", "li")))
            self.put(f"</{inner}>" if inner else "")
        elif kind == "header":
            self.put(f"<{(t := self.pick(('div', 'p', 'h2', 'div', 'span', 'div', 'div', 'h1')))}>", self.text(self.words(1, 8), False), f"</{t}>")
            if self.chance(0.5):
                self.put("<p>", self.text(self.words(2, 10), False), "</p>")
        elif kind == "footer":
            if self.chance(0.5):
                self.links(self.number(1, 6), item=self.pick(("li", "div", "p")))
            s = self.words(2, 14)
            s = f"{self.pick(('© ', 'Copyright ', '© 2024 '))}{s}" if self.chance(0.6) else s
            self.put(f"<{(t := self.pick(('p', 'div', 'small')))}>", self.text(s, False), f"</{t}>")
            if self.chance(0.2):
                self.put("<p>", self.text(self.pick(self.blocks), False), "</p>")
        elif kind == "side":
            for _ in range(self.number(1, 3)):
                self.put("<h3>", self.text(self.words(1, 4), False), "</h3>")
                if self.chance(0.6):
                    self.put("<ul>")
                    self.links(self.number(2, 7))
                    self.put("</ul>")
                else:
                    self.put("<p>", self.text(self.pick(self.blocks) if self.chance(0.5) else self.words(4, 30), False), "</p>")
        elif kind in ("ad", "notice"):
            for i in range(self.number(1, 2)):
                bare = i == 0 and self.chance(0.6)
                self.put("" if bare else f"<{block}>" if block == "p" else "<br>", self.text(self.words(2, 30), False) if bare or block == "p" else "", "" if bare else f"</{block}>" if block == "p" else "")
                if bare:
                    break
            if self.chance(0.4):
                self.put(self.pick(("<button>OK</button>", "<img src='a.png'>", "<input type='button'>")))
        elif kind == "form":
            self.put(f"<{(t := self.pick(('p', 'label', 'h3')))}>", self.text(self.words(2, 20), False), f"</{t}>", "<input name='q'><button>Go</button>")
        elif kind == "comment":
            if self.chance(0.7):
                self.put("<h3>", self.text(self.words(1, 4), False), "</h3>")
            named = self.chance(0.6)
            for _ in range(self.number(1, 6)):
                self.put(f"<div{self.name('comment') if named else ''}>")
                if self.chance(0.5):
                    self.put(f"<{(t := self.pick(('b', 'div', 'h4', 'p')))}>")
                    if t == "b":  # inline: a part of the block that follows
                        self.put(self.words(1, 2), "</b><p>")
                        self.labels.append(False)
                    else:
                        self.put(self.text(self.words(1, 3), False), f"</{t}><p>")
                else:
                    self.put("<p>")
                self.put(self.text(self.pick(self.blocks) if self.chance(0.5) else self.words(2, 40), False), "</p></div>")
        self.put(f"</{tag}>")

    def paragraph(self) -> None:
        s = self.pick(self.blocks) if self.chance(0.75) else self.words(1, 25)
        how = self.rng.random()
        if how < 0.55:
            self.put("<p>", self.text(s, True), "</p>")
        elif how < 0.7:
            self.put("<p>", self.text(s, True), "\n")
        elif how < 0.8:
            self.put("<p><b>", self.text(s, True), "<br>\n<p>", self.text(self.words(2, 30), True), "</p>")
        elif how < 0.9:
            self.put(f"<div{self.name(None)}>", self.text(s, True), "</div>")
        else:
            self.put(f"<p{self.name(None)}>", self.text(s, True), "</p>")

    def article(self, boxed: bool) -> None:
        """The article's blocks, with what doesn't belong to it in between."""
        if self.chance(0.8):
            wrap = self.pick(("", "", "header", "header", "div") if boxed else ("", "", "", "div"))
            self.put(f"<{wrap}>" if wrap else "", "<h1>", self.text(self.words(1, 14), True), "</h1>", f"</{wrap}>" if wrap else "")
        inner = self.chance(0.25)
        self.put(f"<div{self.name('content' if self.chance(0.5) else None)}>" if inner else "")
        for _ in range(self.number(1, 14)):
            how = self.rng.random()
            if how < 0.72:
                self.paragraph()
            elif how < 0.79:
                self.put(f"<{(h := self.pick(('h2', 'h3', 'h4')))}>", self.text(self.words(1, 8), True), f"</{h}>")
            elif how < 0.83:
                self.put(f"<{(ul := self.pick(('ul', 'ol')))}>")
                for _ in range(self.number(1, 6)):
                    self.put("<li>", self.text(self.words(2, 20), True), self.pick(("", "</li>")))
                self.put(f"</{ul}>")
            elif how < 0.86:
                self.put("<blockquote><p>", self.text(self.words(5, 40), True), "</p></blockquote>")
            elif how < 0.88:
                self.put("<figure><img src='i.png'><figcaption>", self.text(self.words(3, 15), True), "</figcaption></figure>")
            elif how < 0.89:
                self.put("<pre>", self.text(self.words(3, 20), True), "</pre>")
            elif how < 0.91:
                self.put("<table><tr><th>", self.text(self.words(1, 3), True), "</th></tr>")
                for _ in range(self.number(1, 4)):
                    self.put("<tr><td>", self.text(self.words(1, 5), True), "<td>", self.text(self.words(1, 5), True), "</tr>")
                self.put("</table>")
            else:
                self.boilerplate(self.pick(("ad", "social", "side", "notice", "form", "ad", "nav")))
        self.put("</div>" if inner else "")
        for kind, p in (("social", 0.1), ("side", 0.1), ("form", 0.1), ("footer", 0.1), ("comment", 0.2)):
            if self.chance(p):
                self.boilerplate(kind)

    def contained(self) -> None:
        how = self.rng.random()
        tags = []
        if how < 0.35:
            tags = ["article"]
        elif how < 0.45:
            tags = ["main"]
        elif how < 0.55:
            tags = ["main", "article"]
        elif how < 0.8:
            tags = [f"div{self.name('content')}"]
        elif how < 0.85:
            tags = [f"section{self.name('content')}"]
        elif how < 0.93:
            tags = [f"div{self.name(None)}"]
        for t in tags:
            self.put(f"<{t}{self.name('content') if ' ' not in t and self.chance(0.2) else ''}>")
        self.article(bool(tags) and tags[0] in ("article", "main"))
        self.put(*[f"</{t.split()[0]}>" for t in reversed(tags)])


def lay_out(rng: np.random.Generator, blocks: list[str], tokens: dict[str, str]) -> tuple[str, list[bool]]:
    """A page, and of each of its text blocks in order whether it belongs to the article."""
    p = _Page(rng, blocks, tokens)
    if p.chance(0.03):
        return p.text(p.pick(p.blocks), True), p.labels
    p.put("<!DOCTYPE html><html><head><title>", p.words(1, 6).replace("<", ""), "</title><style>p{margin:0}</style><script>var t='<p>';</script></head>", f"<body{p.name(None)}>")
    table = p.chance(0.03)
    around = 0 if table else p.number(0, 3)
    before = [k for k, w in (("notice", 0.2), ("header", 0.5), ("nav", 0.7), ("nav", 0.2), ("form", 0.15), ("ad", 0.35), ("social", 0.1), ("side", 0.15)) if p.chance(w)]
    after = [k for k, w in (("comment", 0.3), ("ad", 0.2), ("side", 0.4), ("nav", 0.15), ("form", 0.2), ("social", 0.1), ("footer", 0.8), ("notice", 0.2)) if p.chance(w)]
    cut, end = p.number(0, len(before)), p.number(0, len(after))
    for k in before[:cut]:
        p.boilerplate(k)
    p.put(*[f"<div{p.name('content') if p.chance(0.1) else p.name(None)}>" for _ in range(around)])
    if table:
        p.put("<table><tr><td>")
        p.boilerplate("nav")
        p.put("<td>")
    for k in before[cut:]:
        p.boilerplate(k)
    p.contained()
    for k in after[:end]:
        p.boilerplate(k)
    p.put("</td></tr></table>" if table else "</div>" * around)
    for k in after[end:]:
        p.boilerplate(k)
    p.put(p.pick(("</body></html>", "")))
    return "".join(p.out), p.labels
