"""Labelled pages for the page model: drawn from a grammar of page layouts, seeded, so always the same.

The main text stands in any of many containers, with usual, arbitrary or no names, or bare in the body, in few or
many paragraphs, or in lines without any; what surrounds it has telling tags, telling names or many links.

Elements of the main text carry data-main="1", what doesn't belong to it data-main="0"; the model never
sees these marks as features. Words are random syllables: nothing can be learned from what pages say.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ke li mo nu ra so te vi wa du fe go hi jo ka lu me no pi re si to un az el in or".split()


#: A page that begins with this is main text as a whole.
MAIN_ALL = "<!--main-->"

#: Usual names of parts of pages.
_PARTS = "box wrap wrapper inner top bottom left right block area list item container 1 2".split()
_MAIN_NAMES = "content main article post entry story text body post-body entry-content article-body article-text page-content main-content story-body blog-post detail single copy prose news".split()
_NAMES = {
    "nav": "menu nav navbar navigation main-menu breadcrumb breadcrumbs pagination pager topnav toc tabs links skip".split(),
    "header": "header masthead banner topbar site-header logo branding hero-bar site-title page-header".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion adsbygoogle taboola outbrain dfp adslot banner-ad commercial affiliate partner".split(),
    "notice": "cookie cookies cookie-notice cookie-banner consent notice gdpr alert popup modal notification onetrust cookiebot overlay dialog privacy disclaimer paywall message".split(),
    "side": "sidebar side widget related related-posts recommended trending popular more-stories teaser teasers rail rightcol most-read see-also".split(),
    "form": "newsletter signup subscribe search login register subscription mailing-list search-form searchbox".split(),
    "share": "share social share-buttons social-links tags sharing toolbar follow addthis print buttons tag-list".split(),
    "comments": "comments comment-list comments-area disqus responses replies discussion commentlist respond reactions".split(),
    "footer": "footer site-footer copyright legal bottom-bar foot imprint colophon credits".split(),
}


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, a: int, b: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(a, b)))

    def sentence(self) -> str:
        return self.words(1, 18).capitalize() + self.r.choice("....?!")

    def prose(self, a: int, b: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def maybe(self, chance: float, text: str) -> str:
        return text if self.r.random() < chance else ""

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def links(self, a: int, b: int, sep: str = "") -> str:
        return sep.join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(a, b)))

    def aside_text(self) -> str:
        return self.pick(self.prose(1, 2), self.words(1, 6), self.sentence(), f'<a href="#">{self.words(1, 5)}</a>', f"<p>{self.prose(1, 2)}</p>")

    def named(self, names: list[str], some: float = 0.0) -> str:
        """A class or id from the names, alone, beside another word, as a part of a longer name, or none."""
        if self.r.random() < some:
            return ""
        name = self.r.choice(names)
        value = self.pick(name, name, f"{name} {self.word()}", f"{self.word()}-{name}", f"{name}-{self.word()}", f"{name}_{self.r.choice(_PARTS)}", f"{name}-{self.r.choice(_PARTS)}")
        return f' {self.pick("class", "class", "id")}="{value}"'

    def boiler(self, kind: str) -> str:
        n = lambda some=0.0: self.named(_NAMES[kind], some)
        box = self.pick("div", "div", "section", "aside", "p") if kind in ("ad", "notice", "side") else self.pick("div", "div", "section")
        page = {
            "nav": lambda: self.pick(f"<nav{n(.6)}><ul>{self.links(1, 9)}</ul></nav>", f"<div{n()}><ul>{self.links(2, 8)}</ul></div>", f'<nav>{self.prose(0, 1)}<a href="/">{self.word()}</a> <a href="/x">{self.word()}</a></nav>', f"<ul{n()}>{self.links(3, 8)}</ul>", f"<ul>{self.links(3, 9)}</ul>", f'<nav><a href="/">{self.words(1, 2)}</a></nav>', f"<nav>{self.words(1, 4)}</nav>"),
            "header": lambda: self.pick(f"<header><h1>{self.words(1, 4)}</h1><p>{self.sentence()}</p></header>", f'<div{n()}><a href="/">{self.words(1, 3)}</a> {self.sentence()}</div>', f"<header{n(.5)}><img src='x.png'><span>{self.words(1, 5)}</span></header>", f"<div{n()}>{self.words(1, 5)}</div>", f"<header>{self.words(1, 4)}</header>"),
            "ad": lambda: f"<{box}{n()}>{self.aside_text()}</{box}>",
            "notice": lambda: f"<{box}{n()}>" + self.pick(f"<p>{self.prose(1, 3)}</p>", self.prose(1, 2)) + self.maybe(0.5, f"<button>{self.word()}</button>") + f"</{box}>",
            "side": lambda: self.pick(f"<aside><h3>{self.words(1, 3)}</h3><ul>{self.links(2, 6)}</ul></aside>", f"<{box}{n()}><h4>{self.words(1, 4)}</h4>{self.aside_text()}</{box}>", f"<aside><p>{self.prose(1, 3)}</p></aside>", f"<{box}{n()}>{self.prose(1, 2)}</{box}>", f"<div{n()}><ul>{self.links(2, 6)}</ul></div>"),
            "form": lambda: self.pick(f'<form action="/s"><label>{self.words(1, 3)}</label><input name="q"><button>{self.word()}</button></form>', f'<div{n()}><p>{self.sentence()}</p><form><input type="email"><button>{self.word()}</button></form></div>', f"<form{n(.5)}><p>{self.prose(1, 2)}</p><select><option>{self.word()}<option>{self.word()}</select></form>", f"<div{n()}>{self.prose(1, 2)}</div>", f"<button{n(.5)}>{self.words(1, 3)}</button>"),
            "share": lambda: f'<{box}{n()}><a href="#">{self.word()}</a><a href="#">{self.word()}</a>{self.maybe(.3, self.words(1, 3))}</{box}>',
            "comments": lambda: f"<{box}{n()}>{self.maybe(.7, '<h3>' + self.words(1, 3) + '</h3>')}" + "".join(self.pick(f'<div class="comment"><b>{self.word()}</b><p>{self.prose(1, 4)}</p></div>', f'<li class="comment"><p>{self.prose(1, 3)}</p></li>', f"<p>{self.prose(1, 3)}</p>") for _ in range(self.r.randint(1, 4))) + f"</{box}>",
            "footer": lambda: self.pick(f"<footer>&copy; {self.words(1, 3)}. {self.prose(0, 2)}</footer>", f"<footer{n(.6)}><p>{self.sentence()}</p><ul>{self.links(1, 4)}</ul></footer>", f"<div{n()}>&copy; {self.words(1, 4)} {self.sentence()}</div>", f"<footer><small>{self.prose(1, 3)}</small></footer>", f"<footer>{self.words(1, 5)}</footer>", f"<div{n()}><p>{self.prose(1, 2)}</p></div>"),
        }[kind]()
        at = min(page.index(">"), page.index(" ") if " " in page else len(page))
        return page[:at] + ' data-main="0"' + page[at:]

    def paragraph(self) -> str:
        text = self.prose(1, 6)
        if self.r.random() < 0.25:
            cut = text.split(" ")
            k = self.r.randrange(len(cut))
            cut[k] = self.pick(f'<a href="/{self.word()}">{cut[k]}</a>', f"<em>{cut[k]}</em>", f"<strong>{cut[k]}</strong>", f'<span class="{self.word()}">{cut[k]}</span>')
            text = " ".join(cut)
        if self.r.random() < 0.15:
            return f"<p><b>{text}<br>"  # never closed
        return self.pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p>{text}</p>", f'<p class="{self.word()}">{text}</p>')

    def piece(self) -> str:
        x = self.r.random()
        if x < 0.72:
            return self.paragraph()
        if x < 0.78:
            return f"<{(h := self.pick('h2', 'h3', 'h4'))}>{self.words(1, 6)}</{h}>"
        if x < 0.84:
            return f"<{(l := self.pick('ul', 'ol'))}>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.r.randint(1, 5))) + f"</{l}>"
        if x < 0.88:
            return f"<blockquote>{self.pick('<p>' + self.prose(1, 3) + '</p>', self.prose(1, 2))}</blockquote>"
        if x < 0.91:
            return f"<pre><code>{self.words(3, 12)}</code></pre>"
        if x < 0.94:
            return f"<figure><img src='{self.word()}.png'><figcaption>{self.sentence()}</figcaption></figure>"
        if x < 0.97:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>"
        return f"<div><p>{self.prose(1, 3)}</p></div>"

    def lines(self) -> str:
        """Text without paragraphs."""
        return self.pick("<br>", "<br><br>", "\n", "<br/>\n").join(self.prose(1, 4) for _ in range(self.r.choice([1, 1, 2, 3, 5])))

    def article(self) -> tuple[str, bool]:
        """The main text in its container, and whether it stands bare in the body."""
        if self.r.random() < 0.2:
            parts = [self.lines()]
        else:
            parts = [self.maybe(0.6, f"<h1>{self.words(1, 10)}</h1>")] + [self.piece() for _ in range(self.r.choice([1, 1, 1, 2, 2, 3, 4, 6, 9, 14]))]
            if self.r.random() < 0.25:
                parts = [self.maybe(0.4, parts[0])] + [f"<p>{self.prose(1, 3)}</p>" for _ in range(self.r.choice([1, 2, 2, 3, 5]))]
        for kind, chance in (("ad", 0.25), ("share", 0.15), ("side", 0.08), ("form", 0.08), ("nav", 0.05), ("notice", 0.05)):
            if self.r.random() < chance:
                parts.insert(self.r.randint(1, len(parts)), self.boiler(kind))
        if self.r.random() < 0.12:
            parts.append(self.boiler("comments"))
        body = self.maybe(0.2, "\n").join(parts)
        name = self.named(_MAIN_NAMES, 0.35) if self.r.random() < 0.8 else f' class="{self.word()}"'
        mark = ' data-main="1"'
        kind = self.r.choice(["article", "article", "main", "both", "div", "div", "div", "div", "section", "section", "td", "role", "wrap", "bare", "bare", "center"])
        if kind == "bare":
            return body, True
        if kind == "both":
            return f"<main{mark}><article{name}>{body}</article></main>", False
        if kind == "td":
            side = self.maybe(0.5, f'<td data-main="0" valign="top"><ul>{self.links(2, 6)}</ul></td>')
            return f'<table width="100%"><tr>{side}<td{mark}{self.maybe(.3, name)}>{body}</td></tr></table>', False
        if kind == "role":
            return f'<div{mark} role="main">{body}</div>', False
        if kind == "wrap":
            return f"<div{self.maybe(.5, name)}><div{mark}{name}>{body}</div></div>", False
        return f"<{kind}{mark}{name}>{body}</{kind}>", False

    def page(self) -> str:
        if self.r.random() < 0.01:
            return MAIN_ALL + self.prose(1, 8)
        b, busy = self.boiler, self.r.choice([0.4, 1, 1, 1.6])
        before = [self.maybe(busy * c, b(k)) for k, c in (("header", 0.35), ("nav", 0.6), ("notice", 0.2), ("ad", 0.35), ("form", 0.1), ("side", 0.12))]
        after = [self.maybe(busy * c, b(k)) for k, c in (("share", 0.15), ("comments", 0.2), ("side", 0.25), ("ad", 0.2), ("form", 0.15), ("notice", 0.15), ("footer", 0.6))]
        if self.r.random() < 0.3:
            self.r.shuffle(before)
        end = self.maybe(0.85, "</body></html>")
        main, bare = self.article()
        inner = "".join(before) + self.maybe(0.3, f"<!-- {self.words(1, 3)} -->") + main + "".join(after)
        if bare:
            return f'<html><head><title>{self.words(1, 6)}</title></head><body data-main="1">' + inner + end
        if self.r.random() < 0.25:
            inner = f"<div{self.named(['page', 'container', 'wrapper', 'site', 'layout', 'outer'], .3)}>" + inner + "</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>" + inner + end


def labelled_pages(count: int = 900, seed: int = 7) -> list[str]:
    return [_Writer(seed * 100_003 + k).page() for k in range(count)]
