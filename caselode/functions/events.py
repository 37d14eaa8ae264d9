"""A page as a table of markup events, with its structure worked out once.

Each row is an opened tag, a closed tag or a stretch of text. One pass pairs
tags, finds every row's innermost open element, says whether it is shown and
counts the visible characters before it. All operators on markup are
selections on these rows.

A closing tag closes the innermost open element of its name, and with it what
was left open inside; one that closes nothing is ignored. What isn't shown ends
with its own tag only. Elements without an end tag never contain anything.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

#: Elements without an end tag, and elements whose content isn't shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style iframe object embed svg math template noscript".split())

#: Elements whose text is a page's name.
HEADINGS = ("title", "h1", "h2")

OPEN, CLOSE, TEXT = "open", "close", "text"


@dataclass(slots=True)
class Event:
    kind: str
    #: the tag, or the text
    name: str
    attrs: list = field(default_factory=list)
    raw: str = ""
    start: int = 0
    #: row of the innermost element around this one, and of the tag that ends or began this one
    parent: int | None = None
    partner: int | None = None
    shown: bool = True
    #: whether a table is around this one, and the innermost title or heading around it
    in_table: bool = False
    heading: str | None = None
    #: visible characters before, white space left out
    before: int = 0

    @property
    def end(self) -> int:
        return self.start + len(self.raw)

    @property
    def named(self) -> dict:
        return dict(self.attrs)


class _Reader(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[Event] = []
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()

    def _add(self, kind: str, name: str, attrs: list, raw: str) -> None:
        line, column = self.getpos()
        self.rows.append(Event(kind, name, attrs, raw, self.line_starts[line - 1] + column))

    def handle_starttag(self, tag, attrs):
        self._add(OPEN, tag, attrs, self.get_starttag_text() or "")

    def handle_endtag(self, tag):
        self._add(CLOSE, tag, [], "")

    def handle_data(self, data):
        self._add(TEXT, data, [], "")


class Page:
    """The events of a page; hides: elements whose content isn't shown."""

    def __init__(self, html: str, hides=UNSEEN):
        self.html, self.rows = html, _Reader(html).rows
        around: list[int] = []  # rows of the open elements
        walls: list[int] = []  # places in it of those whose content isn't shown
        opened: Counter[str] = Counter()  # names of the open elements
        count = 0
        for i, e in enumerate(self.rows):
            if e.kind == CLOSE and opened[e.name]:
                scope = walls[-1] if walls else 0
                place = next((k for k in range(len(around) - 1, scope - 1, -1) if self.rows[around[k]].name == e.name), None)
                if place is not None:
                    e.partner = around[place]
                    self.rows[e.partner].partner = i
                    opened.subtract(self.rows[k].name for k in around[place:])
                    del around[place:]
                    while walls and walls[-1] >= place:
                        walls.pop()
            e.parent = around[-1] if around else None
            if around:
                above = self.rows[e.parent]
                e.shown = above.shown and above.name not in hides
                e.in_table = above.in_table or above.name == "table"
                e.heading = above.name if above.name in HEADINGS else above.heading
            e.before = count
            if e.kind == TEXT and e.shown:
                count += len("".join(e.name.split()))
            if e.kind == OPEN and e.name not in VOID:
                if e.name in hides:
                    walls.append(len(around))
                around.append(i)
                opened[e.name] += 1

    def opened(self, *names: str) -> list[int]:
        """Rows that open an element of these names."""
        return [i for i, e in enumerate(self.rows) if e.kind == OPEN and e.name in names]

    def around(self, i: int) -> Iterator[Event]:
        """The elements around a row, the innermost first."""
        at = self.rows[i].parent
        while at is not None:
            yield self.rows[at]
            at = self.rows[at].parent

    def inside(self, i: int) -> range:
        """Rows from an opened tag to the next tag of its name, or the end: links do not nest."""
        name = self.rows[i].name
        stop = next((k for k in range(i + 1, len(self.rows)) if self.rows[k].kind != TEXT and self.rows[k].name == name), len(self.rows))
        return range(i + 1, stop)

    def said(self, rows) -> str:
        """The shown text of rows."""
        return "".join(self.rows[k].name for k in rows if self.rows[k].kind == TEXT and self.rows[k].shown)

    def words(self, rows) -> str:
        """The shown text of rows with white space as single blanks."""
        return " ".join(self.said(rows).split())


def attribute_spans(tag: str) -> list[tuple[str, int | None, int | None]]:
    """(lower-case name, start, end) of each attribute's value in a tag as written; no span without a value.

    The tag is read as a scanner would: name, equals sign, quoted or bare value.
    """
    out, at, n = [], 1, len(tag)
    while at < n and not tag[at].isspace() and tag[at] not in "/>":
        at += 1
    while at < n:
        if tag[at].isspace() or tag[at] in "/>":
            at += 1
            continue
        begin = at
        while at < n and not tag[at].isspace() and tag[at] not in "=/>":
            at += 1
        name, look = tag[begin:at].lower(), at
        while look < n and tag[look].isspace():
            look += 1
        if look >= n or tag[look] != "=":
            out.append((name, None, None))
            at = max(at, begin + 1)
            continue
        at = look + 1
        while at < n and tag[at].isspace():
            at += 1
        quote = tag[at] if at < n and tag[at] in "\"'" else ""
        begin = at + len(quote)
        at = begin
        while at < n and (tag[at] != quote if quote else not (tag[at].isspace() or tag[at] == ">")):
            at += 1
        out.append((name, begin, at))
        at += len(quote)
    return out
