"""Labelled pages for the classifier of operator 7: made up, with many ways to mark up the same parts.

A page is drawn part by part.  Every block's text is unique in its page, so its
label is known however a parser cuts the page.
"""

from __future__ import annotations

import random

#: Pages that the model is fitted on (the bound of the sample); seeds below it are used.
FIT_PAGES = 300

_SYLLABLES = "an the er ion st re ou en ti ha le la de que der sch los ent ar on is al ne ma to vi".split()


class _Page:
    def __init__(self, seed: int, names: dict[str, list[str]]):
        self.r, self.names, self.truth, self.n = random.Random(seed), names, {}, 0

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def say(self, lo: int, hi: int, content: bool, end: str = "") -> str:
        """So many words, unlike any others of the page."""
        self.n += 1
        words = [self.word() for _ in range(self.r.randint(lo, hi))]
        words.insert(self.r.randrange(len(words) + 1), f"{self.word()}{self.n}")
        text = words[0].capitalize() + "".join((", " if self.r.random() < 0.06 else ". " if self.r.random() < 0.07 else " ") + w for w in words[1:]) + end
        self.truth[text] = content
        return text

    def name(self, part: str) -> str:
        """An attribute that names a part, or none."""
        return f' {self.r.choice(("class", "class", "id"))}="{self.r.choice(self.names[part])}"'

    def menu(self, tag: str, part: str) -> str:
        items = "".join(f'<li><a href="/{i}">{self.say(0, 2, False)}</a></li>' for i in range(self.r.randint(3, 8)))
        named = "" if tag in ("nav", "menu") and self.r.random() < 0.6 else self.name(part)
        return f"<{tag}{named}><ul>{items}</ul></{tag}>"

    def paragraph(self, content: bool = True) -> str:
        kind = self.r.random()
        text = self.say(0 if kind < 0.08 else 6, 60, content, ".")
        if kind > 0.85:
            return f"<p>{text}" if self.r.random() < 0.5 else f"<p><span>{text}</span></p>"
        return f"<div>{text}</div>" if kind > 0.78 else f"<p>{text}</p>"

    def article(self) -> str:
        r, body = self.r, []
        title = f"<h1>{self.say(2, 9, True)}</h1>"
        body.append(r.choice((title, f'<header class="{r.choice(("article-header", "entry-header", "post-header", "header"))}">{title}</header>', f'<div class="{r.choice(("article-header", "entry-title", "story-head"))}">{title}</div>')))
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.72:
                body.append(self.paragraph())
            elif kind < 0.80:
                body.append(f"<h2>{self.say(1, 6, True)}</h2>")
            elif kind < 0.87:
                body.append("<ul>" + "".join(f"<li>{self.say(2, 14, True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.90:
                body.append(f"<blockquote><p>{self.say(6, 30, True, '.')}</p></blockquote>")
            elif kind < 0.94:
                body.append(f"<div{self.name('ad')}>{self.say(3, 16, False, '.')}</div>")
            elif kind < 0.955:
                how = r.choice(("hidden", "style='display:none'", 'aria-hidden="true"'))
                body.append(f"<div {how}><p>{self.say(3, 30, False, '.')}</p></div>")
            elif kind < 0.965:
                body.append(f"<div{self.name('comments')}><p>{self.say(3, 40, False, '.')}</p></div>")
            elif kind < 0.985:
                body.append(f"<aside{self.name('related') if r.random() < 0.5 else ''}><h3>{self.say(1, 3, False)}</h3><p>{self.say(4, 14, False)}</p></aside>")
            else:
                body.append(f"<form><label>{self.say(1, 4, False)}</label><button>{self.say(0, 1, False)}</button></form>")
        inner = "".join(body)
        state = r.choice(("", "", ' class="post with-sidebar menu-open"', ' class="nav-fixed has-comments"', ' id="main"'))
        kind = r.random()
        if kind < 0.45:
            return f"<article{state}>{inner}</article>"
        if kind < 0.6:
            return f"<main{state}>{inner}</main>"
        if kind < 0.9:
            return f"<div{self.name('article')}>{inner}</div>"
        return f"<table><tr><td>{self.menu('div', 'menu')}</td><td{self.name('article')}>{inner}</td></tr></table>"

    def page(self) -> str:
        r, parts = self.r, []
        site = f"<a href='/'>{self.say(0, 2, False)}</a>"
        if r.random() < 0.6:
            tag = r.choice(("header", "div"))
            parts.append(f"<{tag}{self.name('header') if tag == 'div' or r.random() < 0.5 else ''}>{site}<p>{self.say(2, 7, False)}</p></{tag}>")
        if r.random() < 0.9:
            parts.append(self.menu(r.choice(("nav", "nav", "div")), "menu"))
        if r.random() < 0.4:
            parts.append(f"<div{self.name('notice')}><p>{self.say(8, 30, False, '.')}</p><button>{self.say(0, 1, False)}</button></div>")
        if r.random() < 0.5:
            parts.append(f"<div{self.name('ad')}>{self.say(4, 20, False, '.')}</div>")
        body = [self.article()]
        if r.random() < 0.5:
            tag = r.choice(("aside", "div"))
            side = f"<{tag}{self.name('sidebar') if tag == 'div' or r.random() < 0.5 else ''}><h3>{self.say(0, 3, False)}</h3><p>{self.say(3, 25, False, '.')}</p>{self.menu('div', 'related')}</{tag}>"
            body.insert(r.randrange(2), side)
        if r.random() < 0.4:
            said = "".join(f"<li><b>{self.say(0, 1, False)}</b><p>{self.say(3, 45, False, '.')}</p></li>" for _ in range(r.randint(1, 5)))
            tag = r.choice(("section", "div"))
            body.append(f"<{tag}{self.name('comments')}><h3>{self.say(0, 2, False)}</h3><ol>{said}</ol></{tag}>")
        parts += [f"<div{r.choice(('', ' class=\"wrapper\"', ' id=\"page\"'))}>{''.join(body)}</div>" if r.random() < 0.5 else "".join(body)]
        if r.random() < 0.9:
            tag = r.choice(("footer", "footer", "div"))
            parts.append(f"<{tag}{self.name('footer') if tag == 'div' or r.random() < 0.4 else ''}><p>&copy; {self.say(2, 10, False)}</p></{tag}>")
        head = "<head><title>x</title><script>if (a < b) { t('</p>') }</script><style>p{}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body{r.choice(('', ' class=\"has-sidebar menu-open\"'))}>{''.join(parts)}</body></html>"


#: Names of parts in the pages that the model is fitted on.
NAMES = {
    "menu": ["nav", "main-nav", "menu", "navbar", "top-menu", "navigation"],
    "header": ["header", "site-header", "masthead", "banner"],
    "notice": ["cookie-notice", "cookies", "consent", "alert", "notice"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo box"],
    "sidebar": ["sidebar", "sidebar-left", "widget", "widget area"],
    "related": ["related", "related-posts", "recommended", "share", "social"],
    "comments": ["comments", "comment-list", "comments-area", "respond"],
    "footer": ["footer", "site-footer", "footer-links", "copyright"],
    "article": ["post", "content", "entry-content", "article-body", "story", "main-content", "text", "col-8"],
}


def labelled(seed: int, names: dict[str, list[str]] | None = None) -> tuple[str, dict[str, bool]]:
    """A page and whether each text in it is content; the copyright mark is part of its block's text."""
    p = _Page(seed, names or NAMES)
    page = p.page()
    return page, p.truth | {f"© {t}": False for t, c in p.truth.items() if not c}
