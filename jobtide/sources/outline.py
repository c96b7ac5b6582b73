"""Find the elements of an HTML page that a few selectors ask for.

This is the only row-wise Python that reads pages.  It runs inside ``mapInArrow``:
Spark splits the pages over tasks, and only the matched elements or cards, not
the page, go back to the JVM.  A reader holds a whole page, so what belongs
together on a page is put together here and never shuffled.  Everything that
is then done with it (which field is first, fallbacks, filtering) is Spark code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style"))
# Elements whose content is, or may become, more than text and tags; only the standard parser knows where they end.
_RAW = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp".split())
# A plain tag and the text after it; whatever this does not match is left to the standard parser.
_TAG = re.compile(r'<(?:([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\r\n\f]+[a-zA-Z][\w-]*="[^"]*")*)|/([a-zA-Z][a-zA-Z0-9]*))[ \t\r\n\f]*>([^<]*)')
_ATTRIBUTE = re.compile(r'([a-zA-Z][\w-]*)="([^"]*)"')
# An opening tag on the left ends an open element on the right, unless a boundary lies between.
_ENDS = {
    "li": (("li",), ("ul", "ol")),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "p": (("p",), ("div", "td", "li", "article", "section", "body")),
    "option": (("option",), ("select",)),
}
_NAME = re.compile(r"[/#.:\s]+")
_STEP = re.compile(
    r"(?P<tag>[A-Za-z][A-Za-z0-9]*|\*)?(?P<rest>(?:\#[\w-]+|\.[\w-]+|:nth-child\(\d+\)|:no-class|\[id\*=[\w-]+\])*)$"
)
_PART = re.compile(r"\#([\w-]+)|\.([\w-]+)|:nth-child\((\d+)\)|(:no-class)|\[id\*=([\w-]+)\]")


def _step_pattern(step: str) -> str:
    """One selector step as a pattern for one path segment (tag#id.class.class:n)."""
    parsed = _STEP.match(step)
    if not parsed:
        raise ValueError(f"cannot read selector step {step!r}")
    tag = parsed["tag"] if parsed["tag"] and parsed["tag"] != "*" else r"[^/#.:]+"
    tests = ""
    for by_id, by_class, nth, no_class, id_part in _PART.findall(parsed["rest"]):
        if by_id:
            tests += rf"(?=[^/]*#{re.escape(by_id)}[.:])"
        elif by_class:
            tests += rf"(?=[^/]*\.{re.escape(by_class)}[.:])"
        elif nth:
            tests += rf"(?=[^/]*:{nth}(?:/|$))"
        elif no_class:
            tests += r"(?=[^/.]*(?:/|$))"
        else:
            tests += rf"(?=[^/]*#[^/.:]*{re.escape(id_part)})"
    return tag.lower() + r"(?=[#.:])" + tests + r"[^/]*"


def selector_pattern(selector: str) -> re.Pattern[str]:
    """``ul.list > li a`` as a pattern for an element's path from the root."""
    pattern, joint = r"(?:^|/)", ""
    for step in selector.replace(">", " > ").split():
        if step == ">":
            joint = "/"
            continue
        pattern += joint + _step_pattern(step)
        joint = r"/(?:[^/]+/)*"
    return re.compile(pattern + "$")


@dataclass(frozen=True)
class Pick:
    """Elements wanted for one role; ``href`` must be found in their link if given."""

    selector: str
    href: str | None = None


class _Place:
    """A path from the root: whether it is a card's, the picks it satisfies, and the places found below it."""

    __slots__ = ("path", "tag", "classes", "is_card", "wanted", "below", "plain")

    def __init__(self, path: str, tag: str, classes: str, is_card: bool, wanted: list):
        self.path, self.tag, self.classes, self.is_card, self.wanted = path, tag, classes, is_card, wanted
        self.below: dict[tuple, _Place] = {}
        # The same by the source of a tag without a link, where places among siblings do not count.
        self.plain: dict[tuple, _Place] = {}


class _Element:
    """An open element."""

    __slots__ = ("place", "tag", "text_from", "card", "roles", "pos", "href", "lead", "children", "last_child")

    def __init__(self, place: _Place, text_from: int, card: int, roles: list[str], pos: int, href: str | None, lead: str | None):
        self.place, self.tag, self.text_from, self.card = place, place.tag, text_from, card
        self.roles, self.pos, self.href, self.lead = roles, pos, href, lead
        self.children, self.last_child = 0, ("", "")


_ELEMENT = ("role", "text", "href", "classes", "lead", "header", "before", "first")


class Found:
    """What was found on some pages, column by column; the fields of cards lie flat, with the places where each begins."""

    def __init__(self) -> None:
        self.item: list[int] = []
        self.columns: dict[str, list] = {name: [] for name in _ELEMENT}
        self.has_fields: list[bool] = []
        self.map_ends, self.roles = [0], []
        self.list_ends, self.texts, self.hrefs = [0], [], []

    @property
    def size(self) -> int:
        """Rows and the links they hold."""
        return len(self.item) + len(self.texts)

    def card(self, pos: int, fields: dict[str, list]) -> None:
        self.item.append(pos)
        self.has_fields.append(True)
        for role, links in fields.items():
            self.roles.append(role)
            for text, href in links:
                self.texts.append(text)
                self.hrefs.append(href)
            self.list_ends.append(len(self.texts))
        self.map_ends.append(len(self.roles))
        for column in self.columns.values():
            column.append(None)

    def element(self, pos: int, *values: object) -> None:
        self.item.append(pos)
        self.has_fields.append(False)
        self.map_ends.append(len(self.roles))
        for column, value in zip(self.columns.values(), values, strict=True):
            column.append(value)

    def arrays(self, names: list[str]) -> list[pa.Array]:
        """The columns called ``names`` as Arrow arrays."""
        links = pa.StructArray.from_arrays([pa.array(self.texts, pa.string()), pa.array(self.hrefs, pa.string())], names=["text", "href"])
        lists = pa.ListArray.from_arrays(pa.array(self.list_ends, pa.int32()), links)
        # A null offset makes the row's map null.
        starts = [start if there else None for start, there in zip(self.map_ends, self.has_fields)] + self.map_ends[-1:]
        maps = pa.MapArray.from_arrays(pa.array(starts, pa.int32()), pa.array(self.roles, pa.string()), lists)
        made = {"item": pa.array(self.item, pa.int64()), "fields": maps}
        made |= {n: pa.array(v, pa.bool_() if n == "first" else pa.string()) for n, v in self.columns.items()}
        return [made[n] for n in names]


@dataclass
class Outline:
    """Compiled picks.  With ``card`` set, only elements inside (or equal to) an
    element matching it count, numbered by that card.  ``lead`` names a heading tag: a
    block right after such a heading, and all it holds, carry the heading's text."""

    picks: dict[str, Pick]
    card: str | None = None
    lead: str | None = None
    # Elements of the role "header" with a text shorter than this head what follows them.
    header_below: int | None = None
    _plan: list = field(default_factory=list)

    def matches(self, html: str) -> list[tuple]:
        """(card, pos, role, text, href, classes, lead) in document order."""
        if not self._plan:
            self._plan.append(_Selectors(self))
        reader = _Reader(self._plan[0], self.lead)
        reader.read(html)
        reader.finish()
        return sorted(reader.found, key=lambda f: (f[1], f[2]))

    def add(self, html: str, out: Found) -> None:
        """Add one row per card, or per element without cards, in document order.

        A card has the texts and links of its elements by role.  An element has its own, the
        newest header at or before it, the text of the element before it, and
        whether its text is the first of its kind on the page.
        """
        found = self.matches(html)
        if self.card is not None:
            cards: dict[int, tuple[list[int], dict[str, list]]] = {}
            for card, pos, role, text, href, _, _ in found:
                places, fields = cards.setdefault(card, ([pos], {}))
                places[0] = min(places[0], pos)
                fields.setdefault(role, []).append((text, href))
            for (pos,), fields in cards.values():
                out.card(pos, fields)
            return
        header, before, seen = None, None, set()
        for _, pos, role, text, href, classes, lead in found:
            if self.header_below is not None and role == "header" and 0 < len(text) < self.header_below:
                header = text
            out.element(pos, role, text, href, classes, lead, header, before, text not in seen)
            before = text
            seen.add(text)


class _Selectors:
    """The compiled selectors, remembering the places they have judged: pages of one
    board repeat the same few paths over and over."""

    REMEMBERED = 50_000

    def __init__(self, outline: Outline):
        self.card = selector_pattern(outline.card) if outline.card else None
        self.picks = [
            (role, selector_pattern(p.selector), re.compile(p.href) if p.href else None)
            for role, p in outline.picks.items()
        ]
        used = [p.selector for p in outline.picks.values()] + [outline.card or ""]
        # Places among siblings make every path unique, so they are noted only if asked for.
        self.numbered = any(":nth-child" in selector for selector in used)
        self.root = _Place("", "", "", False, [])
        self.known = 0

    def place(self, parent: _Place, tag: str, name: str, classes: str, nth: int) -> _Place:
        """The place of a child element; ``nth`` counts only if a selector asks for it."""
        key = (tag, name, classes, nth) if self.numbered else (tag, name, classes)
        known = parent.below.get(key)
        if known is None:
            segment = tag + ("#" + _NAME.sub("_", name.strip()) if name else "")
            segment += "".join("." + _NAME.sub("_", c) for c in classes.split()) + (f":{nth}" if self.numbered else ":")
            path = f"{parent.path}/{segment}" if parent.path else segment
            is_card = self.card is not None and self.card.search(path) is not None
            known = _Place(path, tag, classes, is_card, [(role, link) for role, selector, link in self.picks if selector.search(path)])
            if self.room():
                parent.below[key] = known
        return known

    def room(self) -> bool:
        """Whether one more may be remembered; what does not fit is judged each time it occurs."""
        self.known += 1
        return self.known <= self.REMEMBERED

    def start(self) -> _Place:
        """The root, for a new page; a full memory is begun anew."""
        if self.known > self.REMEMBERED:
            self.root, self.known = _Place("", "", "", False, []), 0
        return self.root


class _Reader(HTMLParser):
    def __init__(self, selectors: _Selectors, lead: str | None):
        super().__init__(convert_charrefs=True)
        self.selectors, self.lead_tag = selectors, lead
        self.open = [_Element(selectors.start(), 0, 0, [], 0, None, None)]
        self.text: list[str] = []
        self.found: list[tuple] = []
        self.cards = self.seen = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def _end(self) -> None:
        done = self.open.pop()
        if done.roles or done.tag == self.lead_tag:
            text = " ".join("".join(self.text[done.text_from :]).split())
            for role in done.roles:
                self.found.append((done.card, done.pos, role, text, done.href, done.place.classes, done.lead))
        else:
            text = ""
        if self.lead_tag:
            self.open[-1].last_child = (done.tag, text)

    def finish(self) -> None:
        while len(self.open) > 1:
            self._end()

    def read(self, html: str) -> None:
        """Read a whole page.  Plain tags and texts, most of any page, are cut by one pattern, which is
        more than twice as fast; everything else goes to the standard parser, with the same outcome."""
        pos = self._text(html, 0)
        numbered = self.selectors.numbered
        while pos < len(html):
            plain = _TAG.match(html, pos)
            if plain is None:
                pos = self._text(html, self._slowly(html, pos))
                continue
            tag, attributes, ended, text = plain.groups()
            if ended:
                self.handle_endtag(ended.lower())
            else:
                lower = tag.lower()
                if lower in _RAW:
                    pos = self._text(html, self._slowly(html, pos))
                    continue
                if lower in _ENDS:
                    self._make_room(lower)
                parent = self.open[-1].place
                place = parent.plain.get((tag, attributes))
                if place is not None:
                    self._begin(place, None)
                else:
                    given = _ATTRIBUTE.findall(attributes) if attributes else []
                    if given and "&" in attributes:
                        given = [(k, unescape(v)) for k, v in given]
                    begun = self._begin_new(lower, [(k.lower(), v) for k, v in given])
                    if not numbered and begun is not None and begun.href is None and self.selectors.room():
                        parent.plain[(tag, attributes)] = begun.place
            if text:
                self.handle_data(unescape(text) if "&" in text else text)
            pos = plain.end()
        self.close()

    def _text(self, html: str, pos: int) -> int:
        """Take the text before the next tag; the place of that tag."""
        end = html.find("<", pos)
        end = len(html) if end < 0 else end
        if end > pos:
            self.handle_data(unescape(html[pos:end]))
        return end

    def _slowly(self, html: str, pos: int) -> int:
        """What begins at ``pos`` by the standard parser; the place after it, the page's end if it is not over at the next ">"."""
        end = html.find(">", pos) + 1
        if end:
            self.feed(html[pos:end])
            if not self.rawdata and self.cdata_elem is None:
                return end
        self.feed(html[end or pos :])
        return len(html)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS:
            self._make_room(tag)
        self._begin_new(tag, attrs)

    def _make_room(self, tag: str) -> None:
        """End the open elements that the opening tag ends."""
        ended, bounds = _ENDS[tag]
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in ended:
                while len(self.open) > depth:
                    self._end()
                if self.open[-1].tag not in ended:
                    break
            elif self.open[depth].tag in bounds:
                break

    def _begin_new(self, tag: str, attrs: list) -> _Element | None:
        if tag == "br":
            self.text.append(" ")
        if tag in _VOID:
            return None
        given = {k: v or "" for k, v in attrs} if attrs else {}
        parent = self.open[-1]
        place = self.selectors.place(parent.place, tag, given.get("id", ""), given.get("class", ""), parent.children + 1)
        return self._begin(place, given.get("href"))

    def _begin(self, place: _Place, href: str | None) -> _Element:
        parent = self.open[-1]
        parent.children += 1
        self.seen += 1
        card = parent.card
        if place.is_card:
            self.cards += 1
            card = self.cards
        roles = []
        if place.wanted and (card or self.selectors.card is None):
            roles = [role for role, link in place.wanted if link is None or (href is not None and link.search(href))]
        lead = parent.lead
        if self.lead_tag and place.tag == "div" and parent.last_child[0] == self.lead_tag:
            lead = parent.last_child[1]
        begun = _Element(place, len(self.text), card, roles, self.seen, href, lead)
        self.open.append(begun)
        return begun

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                while len(self.open) > depth:
                    self._end()
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag not in _HIDDEN:
            self.text.append(data)
