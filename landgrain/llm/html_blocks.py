"""Leaf blocks of an HTML page with their features."""

from __future__ import annotations

import html as entities
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of an article: code, inert or replaced markup, form fields
RAW = frozenset("script style title textarea template iframe select datalist".split())
#: They stand inside a block
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math mi mn mo ms mtext mrow msup msub mfrac msqrt svg g text tspan".split())
#: Elements that name a part of the page; so does any with a class, an id or a role
SECTIONS = frozenset("article main nav header footer aside form section".split())
#: Opening one of these closes an open element of the set, up to the nearest holder
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "p": ({"p"}, {"td", "th", "caption", "button", "object"})}

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]+))""", re.I)
_SPACE = re.compile(r"\s+")


class Parser:
    """Cuts pages into blocks.

    An element has the features of all its ancestors, but of the nearest that names a part of the page ("near:"). With a `vocabulary`, the features that a model has weights
    for, others are left out, as their weight is 0: the features of a chain of elements are then bounded by the model and not
    by the page. Ancestor features are remembered by (parent's features, tag, attributes).
    """

    def __init__(self, vocabulary: frozenset[str] | None = None) -> None:
        self.vocabulary = vocabulary
        self.known: dict[tuple, frozenset] = {}
        self.ends: dict[str, re.Pattern] = {}

    def _features(self, above: frozenset, tag: str, attributes: str) -> frozenset:
        key = (above, tag, attributes)
        if key not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            own = {f"in:{tag}"}
            for m in _NAMES.finditer(attributes):
                own.update(f"as:{w}" for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()) if w)
            if len(own) > 1 or tag in SECTIONS:
                above = frozenset(x for x in above if not x.startswith("near:"))
                own.add(f"near:{tag}")
            if self.vocabulary is not None:
                own &= self.vocabulary
            self.known[key] = above if own <= above else above | own
        return self.known[key]

    def blocks(self, page: str | None) -> list[tuple[str, set[str]]]:
        """(text, features) of every leaf block with text, in page order."""
        page = page or ""
        out: list[tuple[str, set[str]]] = []
        stack: list[tuple[str, frozenset]] = [("", frozenset())]
        where: dict[str, list[int]] = {}  # places of a tag's open elements in the stack
        blocks_at: list[int] = [0]  # places of the elements that hold blocks
        held: list[str] = []
        linked = at = 0

        def close() -> None:
            nonlocal linked
            if held:
                text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
                if text:
                    out.append((text, self.describe(text, linked, stack[blocks_at[-1]])))
                held.clear()
            linked = 0

        def cut(i: int) -> None:
            """Close the open elements from place i on."""
            while len(stack) > i:
                where[stack.pop()[0]].pop()
            while blocks_at[-1] >= i:
                blocks_at.pop()

        last = lambda tags: max((where[t][-1] for t in tags if where.get(t)), default=0)
        n = len(page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                held.append(page[at:lt])
                linked += (lt - at) * bool(where.get("a"))
            if lt == n:
                break
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            nxt = page[lt + 1 : lt + 2]
            if nxt in ("!", "?"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = _TAG.match(page, lt)
            if not m:  # a bare < is text
                held.append("<")
                at = lt + 1
                continue
            at = m.end()
            tag, attributes = (m[1] or m[3]).lower(), m[2] or m[4] or ""
            if tag not in INLINE:
                close()
            elif tag in ("br", "img"):
                held.append(" ")
            if nxt == "/":
                if tag in VOID:
                    continue
                if where.get(tag):
                    cut(where[tag][-1])
                continue
            if tag in RAW and not attributes.endswith("/"):
                if tag not in self.ends:
                    self.ends[tag] = re.compile(rf"</{tag}\b[^>]*>", re.I)
                end = self.ends[tag].search(page, at)
                at = end.end() if end else n
                continue
            if tag in VOID or attributes.endswith("/") and tag in INLINE:
                continue
            for kind in ((tag,) if tag == "p" or tag in INLINE else ("p", tag)):  # any block closes an open paragraph
                if kind in CLOSES and (i := last(CLOSES[kind][0])) > last(CLOSES[kind][1]):
                    cut(i)
            stack.append((tag, self._features(stack[-1][1], tag, attributes)))
            where.setdefault(tag, []).append(len(stack) - 1)
            if tag not in INLINE:
                blocks_at.append(len(stack) - 1)
        close()
        return out

    @staticmethod
    def describe(text: str, linked: int, element: tuple[str, frozenset]) -> set[str]:
        words = text.count(" ") + 1
        share = min(1.0, linked / max(1, len(text)))
        return element[1] | {
            f"leaf:{element[0]}",
            f"words:{min(8, words.bit_length())}",
            f"link:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
            f"stop:{text[-1] in '.!?…:;\"”»'}",
            f"long,link:{words > 12},{share > 0.3}",
        } | ({"copyright"} if "©" in text or "(c)" in text.lower() else set())
