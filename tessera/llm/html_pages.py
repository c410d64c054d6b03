"""Labelled pages for HTML extraction, made by rule: layouts, furniture and invented words from a fixed seed.

A page is a list of parts in one of several layouts; each part says which of its blocks are content.
"""

from __future__ import annotations

import random

#: Invented syllables of the filler text.
SYLLABLES = "ka lo mi ter sen du vor ha nel pi ro ast em und que la tion er".split()
#: Class or id words of furniture, by the element that holds it.
FURNITURE = {
    "div": "ad ads advert advertisement banner sponsor sponsored promo promotion sidebar side widget cookie consent notice alert popup modal newsletter subscribe share social related recommended breadcrumb breadcrumbs menu navigation topbar footer header comments comment discussion replies login search".split(),
    "section": "comments related newsletter promo discussion sidebar notice sponsored".split(),
    "aside": ["", "sidebar", "related", "promo", "note"],
    "ul": "menu nav breadcrumb share social tags".split(),
}
CONTENT_NAMES = ["", "content", "main", "post", "entry", "article", "story", "body", "text", "page"]


class Maker:
    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        made = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        return " ".join(made)

    def sentence(self, low: int, high: int) -> str:
        style = self.rng.random()
        text = self.words(low, high).capitalize() + self.rng.choice(".....!?:")
        if style < 0.06:
            return text.upper()
        return text if style < 0.9 else text.replace(" ", self.rng.choice(["!! ", " | ", "*** ", "### "]))

    def prose(self) -> str:
        return " ".join(self.sentence(3, 25) for _ in range(self.rng.choice([1, 1, 2, 4, 8])))

    def links(self) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(self.rng.randint(2, 8)))

    def names(self, name: str) -> str:
        if not name:
            return ""
        return self.rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {self.rng.choice(["box", "wrap", "inner"])}"'])

    def furniture(self) -> str:
        """A part without content."""
        rng = self.rng
        kind = rng.choice(["nav", "nav", "header", "footer", "footer", "aside", "form", "div", "div", "div", "section", "ul", "comments"])
        if kind == "nav":
            return f"<nav><ul>{self.links()}</ul></nav>"
        if kind == "header":
            return f"<header><a href='/'>{self.words(1, 3)}</a>{rng.choice(['', '<p>' + self.words(2, 6) + '</p>'])}</header>"
        if kind == "footer":
            return f"<footer>{rng.choice(['&copy; ', ''])}{self.words(1, 4)} &middot; {self.prose()}</footer>"
        if kind == "form":
            return f"<form action='/s'><label>{self.words(1, 3)}</label><input name='q'><p>{self.sentence(2, 12)}</p><button>{self.words(1, 2)}</button></form>"
        if kind == "comments":
            tag = rng.choice(["section", "div", "ol"])
            inner = "".join(f"<{'li' if tag == 'ol' else 'div'} class='comment'><p>{self.prose()}</p></{'li' if tag == 'ol' else 'div'}>" for _ in range(rng.randint(1, 4)))
            return f"<{tag}{self.names(rng.choice(['comments', 'comment list', 'discussion', 'replies']))}><h3>{self.words(1, 3)}</h3>{inner}</{tag}>"
        if kind == "ul":
            return f"<ul{self.names(rng.choice(FURNITURE['ul']))}>{self.links()}</ul>"
        inner = rng.choice([self.prose(), f"<p>{self.prose()}</p>", f"<h3>{self.words(1, 3)}</h3><ul>{self.links()}</ul>", f"<p>{self.sentence(3, 20)}</p><a href='#'>{self.words(1, 3)}</a>"])
        return f"<{kind}{self.names(rng.choice(FURNITURE[kind]))}>{inner}</{kind}>"

    def content(self, blocks: list[str]) -> str:
        """A part of an article; its blocks are appended to ``blocks``."""
        rng = self.rng
        kind = rng.choice(["p"] * 9 + ["b", "h2", "ul", "ol", "blockquote", "table", "pre", "figure", "link"])

        def block(text: str) -> str:
            blocks.append(" ".join(text.split()))
            return text

        if kind in ("p", "b"):
            end = rng.choice(["</p>", "</p>", ""])
            return f"<p><b>{block(self.prose())}<br>" if kind == "b" else f"<p>{block(self.prose())}{end}"
        if kind == "h2":
            return f"<{(h := rng.choice(['h2', 'h3', 'h4']))}>{block(self.words(1, 6))}</{h}>"
        if kind in ("ul", "ol"):
            return f"<{kind}>{''.join(f'<li>{block(self.sentence(2, 15))}</li>' for _ in range(rng.randint(2, 5)))}</{kind}>"
        if kind == "blockquote":
            return f"<blockquote><p>{block(self.prose())}</p></blockquote>"
        if kind == "table":
            return f"<table>{''.join(f'<tr><td>{block(self.words(1, 3))}</td><td>{block(self.words(1, 3))}</td></tr>' for _ in range(rng.randint(1, 4)))}</table>"
        if kind == "pre":
            return f"<pre>{block(self.words(4, 20))}</pre>"
        if kind == "figure":
            return f"<figure><img src='x'><figcaption>{block(self.sentence(3, 12))}</figcaption></figure>"
        a, b, c = self.words(3, 12), self.words(1, 3), self.words(2, 9)
        block(f"{a} {b} {c}.")
        return f"<p>{a} <a href='/x'>{b}</a> {c}.</p>"

    def page(self) -> tuple[str, list[str]]:
        rng, blocks = self.rng, []
        title = self.words(2, 8)
        blocks.append(title)
        head = rng.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>", f"<div><h1>{title}</h1></div>"])
        parts = [head]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9, 18, 40, 80])):
            parts.append(self.content(blocks))
            if rng.random() < 0.1:
                parts.append(rng.choice([f"<div class='{rng.choice(['ad', 'advert', 'related', 'share', 'promo'])}'>{self.sentence(3, 14)}</div>", f"<aside>{self.prose()}</aside>"]))
        inner = "".join(parts)
        if rng.random() < 0.12:
            inner += self.furniture_of("comments")
        tag = rng.choice(["article", "article", "article", "article", "main", "div", "section"])
        name = rng.choice(CONTENT_NAMES) if tag in ("article", "main") else rng.choice(CONTENT_NAMES[1:])
        body = f"<{tag}{self.names(name)}>{inner}</{tag}>"
        if tag == "article" and rng.random() < 0.3:
            body = f"<main>{body}</main>"
        before = "".join(self.furniture() for _ in range(rng.randint(1, 3)))
        after = "".join(self.furniture() for _ in range(rng.randint(0, 3)))
        if rng.random() < 0.25:
            body = f"<div class='{rng.choice(['wrap', 'container', 'layout', 'row'])}'>{body}{self.furniture()}</div>"
        page = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>x='</p>'</script></head><body>{before}{body}{after}"
        return page + rng.choice(["</body></html>", "</body></html>", ""]), blocks

    def furniture_of(self, name: str) -> str:
        inner = "".join(f"<p>{self.prose()}</p>" for _ in range(self.rng.randint(1, 3)))
        return f"<section class='{name}'><h2>{self.words(1, 2)}</h2>{inner}</section>"


def labelled_pages(n: int = 220, seed: int = 11) -> list[tuple[str, list[str]]]:
    """[(page, its content blocks)]."""
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
