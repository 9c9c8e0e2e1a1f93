"""Labelled pages to train the block labeller on: invented text in common page layouts.

Every layout draws its parts, their order, their elements and their class names at random, so that the
labeller learns from nested elements and names as well as from the semantic tags.
"""

from __future__ import annotations

import random

#: Names that parts of pages usually carry (fixed values)
PARTS = {
    "nav": ["nav", "menu", "navbar", "navigation", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "links", "tabs", "skip-link"],
    "header": ["header", "masthead", "site-header", "top-bar", "branding", "logo", "site-title", "tagline", "hero-banner"],
    "footer": ["footer", "site-footer", "copyright", "colophon", "bottom", "legal", "page-footer", "credits"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "side", "rail", "tags", "tagcloud", "more-stories", "teaser", "archive", "author-box", "bio"],
    "notice": ["notice", "cookie", "cookies", "consent", "alert", "banner", "gdpr", "popup", "modal", "overlay", "message", "warning", "announcement", "disclaimer", "paywall", "toast"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "adsense", "ad-slot", "banner-ad", "affiliate", "commercial", "dfp", "outbrain", "taboola"],
    "form": ["form", "search", "newsletter", "subscribe", "signup", "login", "contact-form", "search-form", "subscription", "feedback", "poll"],
    "comments": ["comments", "comment", "comment-list", "commentlist", "discussion", "replies", "reply", "reader-comments", "disqus", "responses", "respond", "thread", "user-comments"],
    "share": ["share", "social", "sharing", "share-buttons", "follow", "byline-tools", "print", "toolbar", "actions", "rating"],
}
BODY = ["article", "content", "post", "entry", "entry-content", "article-body", "story", "story-body", "main", "main-content", "post-content", "text", "body", "page-content", "blog-post", "single"]
#: Marks before the blocks of a page, private characters
MAIN, OTHER = "\ue000", "\ue001"
_SYLLABLES = "ba ko mi ren tal vo shi der un gel par que lo ion as ti mer zu far nel ol und sa pre wick dor ham est in og".split()


class Layout:
    def __init__(self, r: random.Random) -> None:
        self.r = r

    def words(self, least: int, most: int, stop: bool = True) -> str:
        r = self.r
        w = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
        if len(w) > 14:
            for i in range(6, len(w) - 3, r.randint(7, 14)):
                w[i] += r.choice([".", ",", ".", "!", "?"])
        return (" ".join(w)).capitalize() + (r.choice([".", ".", ".", "!", "?", ""]) if stop else "")

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{text}</a>'

    def mark(self, text: str, main: bool) -> str:
        """The text between marks that labels() finds again."""
        return f"{MAIN if main else OTHER}{text}"

    def part(self, kind: str, bare: float = 0.0) -> str:
        """A part that is no main text; with probability `bare`, nothing but its place and its text tells that."""
        r = self.r
        semantic = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}
        name = r.choice(PARTS[kind])
        if kind in semantic and r.random() < 0.55:
            tag, attribute = semantic[kind], f' class="{name}"' if kind == "comments" or r.random() < 0.5 else ""
        else:
            tag, attribute = r.choice(["div", "div", "section", "aside" if kind in ("ad", "aside", "notice", "share") else "div"]), r.choice([f' class="{name}"', f' id="{name}"', f' class="{r.choice(["block", "row", "box", "col"])} {name}"'])
        if r.random() < bare:
            tag, attribute = "div", ""
        m = lambda t: self.mark(t, False)
        if kind in ("nav", "share"):
            inner = "<ul>" + "".join(f"<li>{m(self.link(self.words(1, 3, False)))}</li>" for _ in range(r.randint(2, 8))) + "</ul>" if r.random() < 0.7 else m(" ".join(self.link(self.words(1, 2, False)) for _ in range(r.randint(2, 6))))
        elif kind == "header":
            inner = r.choice(["<h1>{}</h1>", "<div>{}</div>", "<p>{}</p>", "<h2>{}</h2>"]).format(m(self.words(1, 5, False))) + (f"<p>{m(self.words(3, 9))}</p>" if r.random() < 0.5 else "")
        elif kind == "footer":
            inner = r.choice(["{}", "<p>{}</p>"]).format(m(f"&copy; {self.words(2, 30)}")) + ("<ul>" + "".join(f"<li>{m(self.link(self.words(1, 2, False)))}</li>" for _ in range(3)) + "</ul>" if r.random() < 0.4 else "")
        elif kind == "aside":
            inner = f"<h{(k := r.randint(2, 4))}>{m(self.words(1, 4, False))}</h{k}>" + (
                "<ul>" + "".join(f"<li>{m(self.link(self.words(3, 9, False)))}</li>" for _ in range(r.randint(2, 6))) + "</ul>" if r.random() < 0.6 else "".join(f"<p>{m(self.words(5, 40))}</p>" for _ in range(r.randint(1, 3)))
            )
        elif kind == "form":
            inner = r.choice(["<p>{}</p>", "<label>{}</label>", "<h3>{}</h3>", "<div>{}</div>"]).format(m(self.words(2, 12))) + f'<input name="q"><button>{m(self.words(1, 2, False))}</button>'
        elif kind == "comments":
            one = lambda: r.choice(["<li>{}</li>", '<div class="comment">{}</div>', "<div>{}</div>", "{}"]).format((f"<p>{m(self.words(1, 2, False))}</p>" if r.random() < 0.3 else "") + f"<p>{m(self.words(3, 60))}</p>")
            inner = (f"<h{(k := r.randint(2, 4))}>{m(self.words(1, 3, False))}</h{k}>" if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 5)))
        else:
            inner = r.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<span>{}</span>", "<p>{}</p>"]).format(m(self.words(3, 35)))
            if kind == "notice" and r.random() < 0.25:
                return f"<noscript>{inner}</noscript>"
            if r.random() < 0.3:
                inner += m(self.link(self.words(1, 3, False)))
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def body(self) -> str:
        r = self.r
        m = lambda t: self.mark(t, True)
        out = [f"<h1>{m(self.words(2, 12, False))}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 2, r.randint(1, 12), r.randint(1, 12)])):
            kind = r.random()
            if kind < 0.04:
                out.append(m(self.words(2, 60)))
            elif kind < 0.70:
                text = self.words(1, 120)
                if r.random() < 0.2:
                    text = self.link(self.words(1, 4, False)) + " " + text
                out.append(f"<p>{m(text)}" + ("</p>" if r.random() < 0.8 else ""))
            elif kind < 0.80:
                out.append(f"<h{(k := r.randint(2, 4))}>{m(self.words(1, 8, False))}</h{k}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{m(self.words(1, 25))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.89:
                out.append(f"<blockquote>{m(self.words(4, 40))}</blockquote>")
            elif kind < 0.91:
                out.append(f"<pre>{m(self.words(4, 20))}</pre>")
            elif kind < 0.93:
                out.append("<table><tr>" + "".join(f"<td>{m(self.words(1, 4, False))}</td>" for _ in range(3)) + "</tr></table>")
            elif kind < 0.98:
                out.append(r.choice(["<noscript>{}</noscript>", "<object><p>{}</p></object>", "<figure><figcaption>{}</figcaption></figure>", "<math><mi>{}</mi></math>", "<details><summary>{}</summary></details>", "<dl><dt>{}</dt></dl>"]).format(m(self.words(4, 30))))
            else:
                out.append(f"<div>{m(self.words(4, 60))}</div>")
            if r.random() < 0.08:
                out.append(self.part(r.choice(["ad", "share", "notice", "form", "aside"])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        tag = r.choice(["article", "article", "article", "main", "main", "div", "div", "div", "section"])
        attribute = f' class="{r.choice(BODY)}"' if tag in ("div", "section") or r.random() < 0.4 else ""
        alone = r.random() < 0.2  # the article is in no element of its own
        bare = 0.0 if alone else 0.1
        before = [self.part(k, bare) for k in ("header", "nav", "notice", "ad", "nav", "form") if r.random() < 0.5]
        after = [self.part(k, bare) for k in ("share", "comments", "aside", "ad", "form", "notice", "footer", "footer") if r.random() < 0.5]
        # an article may come first or last, or be all of a page
        if r.random() < 0.25:
            before = []
        if r.random() < 0.15:
            after = []
        inside_after = [self.part(k) for k in ("share", "comments", "aside", "ad", "form") if r.random() < 0.2]
        text = f"<{tag}{attribute}>{self.body()}{''.join(inside_after)}</{tag}>"
        if alone:
            text = f"{self.body()}{''.join(inside_after)}"
        if r.random() < 0.4:
            text = f'<{(w := r.choice(["main", "div"]))}{r.choice(["", f""" id="{r.choice(BODY)}" """, """ class="wrapper" """])}>{text}</{w}>'
        if r.random() < 0.15:
            r.shuffle(before)
            before, after = [*before, *after[:1]], after[1:]
        head = f"<head><title>{self.words(2, 8, False)}</title><style>p{{}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{text}{''.join(after)}</body></html>"


def labelled_pages(n: int, seed: int = 11) -> list[tuple[str, list[tuple[str, bool]]]]:
    """n pages: the page, and its blocks' beginnings with whether they are main text."""
    from .html_blocks import Parser

    out, parser = [], Parser()
    for i in range(n):
        marked = Layout(random.Random(f"{seed}-{i}")).page()
        plain = marked.replace(MAIN, "").replace(OTHER, "")
        blocks = parser.blocks(marked)
        out.append((plain, [(t.replace(MAIN, "").replace(OTHER, ""), t.startswith(MAIN)) for t, _ in blocks]))
    return out
