"""What every line of a Markdown text is, found in one pass with a stack of containers.

The rules are those of CommonMark for blocks: a line first continues the open quotes and
list items, then may open new blocks, and else goes on with an open paragraph, also without
the marks of its containers. Only blocks outside all containers are reported: a heading, a
fence or a rule inside a list item or a quote is part of that list or quote.

Raw HTML is text by default. With *html* its blocks (comments, tags that stand alone or
belong to the page's structure) are blocks of kind `other`, and nothing inside opens a section.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

ATX = re.compile(r"#{1,6}(?:[ \t]|$)")
FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
UNDERLINE = re.compile(r"(?:=+|-+)[ \t]*$")
MARKER = re.compile(r"(?:([-+*])|(\d{1,9})([.)]))(?=[ \t]|$)")
# A link definition on one line is no text.
DEFINITION = re.compile(
    r"\[(?=[^\]]*\S)(?:[^\[\]\\]|\\.){1,999}\]:[ \t]*(?:<[^<>]*>|[^\s<]\S*)"
    r"(?:[ \t]+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*$"
)
# Names of elements that make an HTML block of their own.
HTML_NAMES = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|"
    "fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|"
    "main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|"
    "title|tr|track|ul"
)
_VALUE = r"(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?"
#: (start, end or None for a blank line, may stand inside a paragraph)
HTML = (
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I), True),
    (re.compile(r"<!--"), re.compile(r"-->"), True),
    (re.compile(r"<\?"), re.compile(r"\?>"), True),
    (re.compile(r"<![A-Za-z]"), re.compile(r">"), True),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(rf"</?(?:{HTML_NAMES})(?:\s|/?>|$)", re.I), None, True),
    (re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*{_VALUE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None, False),
)


@dataclass
class Line:
    text: str
    kind: str | None = None
    #: Number of the block in its section, from 1, and of the item in its list.
    block_no: int | None = None
    item_no: int | None = None
    is_fence: bool = False
    fence_no: int | None = None
    heading_level: int | None = None
    #: The text of an underlined heading, on its underline.
    heading_text: str | None = None
    in_heading: bool = False


@dataclass
class Box:
    """An open quote, or an open list item with the width its lines are indented by."""

    width: int | None = None
    mark: str = ">"
    empty: bool = False


def _spaced(text: str, column: int) -> str:
    """*text*, which starts at *column*, with its leading tabs as spaces."""
    if "\t" not in text or text[:1] not in " \t":
        return text
    width = 0
    for place, char in enumerate(text):
        if char not in " \t":
            return " " * width + text[place:]
        width += 1 if char == " " else 4 - (column + width) % 4
    return " " * width


def _indent(text: str) -> int:
    return len(text) - len(text.lstrip(" "))


class Reader:
    """The state between two lines of one document."""

    def __init__(self, html: bool = False):
        self.html = html
        self.lines: list[Line] = []
        self.boxes: list[Box] = []
        #: The open block inside the innermost container.
        self.leaf: str | None = None
        self.fence = ("", 0)
        self.html_end: re.Pattern | None = None
        self.kind: str | None = None
        self.list_mark: str | None = None
        self.block_no = self.item_no = self.fence_no = 0
        #: Places of the lines of an open paragraph outside containers.
        self.paragraph: list[int] = []

    # --- reporting: what stands outside all containers -----------------------------
    def _begin(self, kind: str) -> None:
        self.kind, self.list_mark = kind, None
        self.block_no += 1

    def _report(self, line: Line, **more) -> None:
        """The line belongs to the current block."""
        if self.kind:
            line.kind, line.block_no = self.kind, self.block_no
            if self.kind == "list":
                line.item_no = self.item_no
        for name, value in more.items():
            setattr(line, name, value)

    def _section(self, line: Line, level: int, title: str | None) -> None:
        line.kind, line.block_no = None, None
        line.heading_level, line.heading_text, line.in_heading = level, title, True
        self.kind = self.list_mark = None
        self.block_no = 0

    # --- one line ------------------------------------------------------------------
    def read(self, raw: str) -> None:
        line = Line(raw)
        self.lines.append(line)
        if not self.boxes and self.leaf in (None, "paragraph") and raw[:1].isalpha():
            self._text(line, bool(self.leaf))
            return
        text, column, depth = self._continued(raw)
        matched = depth == len(self.boxes)
        if matched and self.leaf == "fence":
            return self._in_fence(line, text)
        if matched and self.leaf == "html" and (self.html_end or text.strip()):
            return self._in_html(line, text)
        if not text.strip(" "):
            return self._blank(line, depth, matched)
        self._open(line, text, column, depth, matched)

    def _continued(self, raw: str) -> tuple[str, int, int]:
        """(rest of the line, its column, number of containers it goes on with)."""
        text, column = _spaced(raw, 0), 0
        for depth, box in enumerate(self.boxes):
            indent = _indent(text)
            blank = indent == len(text)
            if box.width is None:
                if indent > 3 or text[indent : indent + 1] != ">":
                    return text, column, depth
                column += indent + 1
                text = _spaced(text[indent + 1 :], column)
                if text[:1] == " ":
                    text, column = text[1:], column + 1
            elif blank:
                if box.empty:
                    return text, column, depth
            elif indent >= box.width:
                text, column = text[box.width :], column + box.width
                box.empty = False
            else:
                return text, column, depth
        return text, column, len(self.boxes)

    def _in_fence(self, line: Line, text: str) -> None:
        char, size = self.fence
        bare = text.strip(" \t")
        closes = _indent(text) <= 3 and len(bare) >= size and bare == char * len(bare)
        outside = not self.boxes
        self._report(line, is_fence=closes and outside, fence_no=self.fence_no if outside else None)
        if closes:
            self.leaf = None
            if outside:
                self.kind = None

    def _in_html(self, line: Line, text: str) -> None:
        self._report(line)
        if self.html_end and self.html_end.search(text):
            self._ended()

    def _ended(self) -> None:
        self.leaf = None
        if not self.boxes:
            self.kind = None

    def _blank(self, line: Line, depth: int, matched: bool) -> None:
        if not matched:
            del self.boxes[depth:]
            self.leaf = None
        if self.leaf in ("paragraph", "html"):
            self.leaf = None
        if self.boxes or self.leaf == "code" or self.list_mark:
            self._report(line)  # inside, or behind: the end of a block is trimmed
        else:
            self.kind = None

    def _text(self, line: Line, goes_on: bool) -> None:
        """A line of a paragraph outside containers."""
        if not goes_on:
            self.leaf = "paragraph"
            self.paragraph = []
            self._begin("paragraph")
        self.paragraph.append(len(self.lines) - 1)
        self._report(line)

    def _close(self, depth: int) -> None:
        del self.boxes[depth:]
        self.leaf = None

    def _open(self, line: Line, text: str, column: int, depth: int, matched: bool) -> None:
        """A line that is not blank: what it opens, or goes on with."""
        paragraph = self.leaf == "paragraph"
        was_code = self.leaf == "code" and matched
        here = paragraph and matched
        while True:
            indent = _indent(text)
            rest = text[indent:]
            if not rest:
                self.leaf = None  # an item without text so far
                return self._report(line)
            if indent >= 4:
                if paragraph:
                    break
                self._close(depth)
                self.leaf = "code"
                if not self.boxes and not was_code:
                    self._begin("code")
                return self._report(line)
            if rest[0] == ">":
                self._close(depth)
                column += indent + 1
                text = _spaced(rest[1:], column)
                if text[:1] == " ":
                    text, column = text[1:], column + 1
                if not self.boxes:
                    self._begin("quote")
                self.boxes.append(Box())
                depth, paragraph, here, was_code = len(self.boxes), False, False, False
                continue
            if ATX.match(rest):
                self._close(depth)
                if self.boxes:
                    return self._report(line)
                return self._section(line, len(rest) - len(rest.lstrip("#")), None)
            if found := FENCE.match(rest):
                self._close(depth)
                run = found[1] or found[2]
                self.leaf, self.fence = "fence", (run[0], len(run))
                if not self.boxes:
                    self._begin("code")
                    self.fence_no += 1
                    return self._report(line, is_fence=True, fence_no=self.fence_no)
                return self._report(line)
            if self.html and rest[0] == "<" and (end := self._html_start(rest, paragraph)) is not False:
                self._close(depth)
                if not self.boxes:
                    self._begin("other")
                self._report(line)
                self.leaf, self.html_end = "html", end
                if end and end.search(rest):
                    self._ended()
                return None
            if here and UNDERLINE.match(rest):
                self.leaf = None
                if self.boxes:
                    return self._report(line)
                return self._underlined(line, 1 if rest[0] == "=" else 2)
            if RULE.match(rest):
                self._close(depth)
                if not self.boxes:
                    self._begin("other")
                    self._report(line)
                    self.kind = None
                    return None
                return self._report(line)
            found = MARKER.match(rest)
            if not found or (here and (not rest[found.end() :].strip(" \t") or found[2] not in (None, "1"))):
                if not paragraph and DEFINITION.match(rest):
                    self._close(depth)
                    if self.boxes:
                        return self._report(line)
                    self.kind = self.list_mark = None
                    return None
                break
            self._close(depth)
            text, column = self._item(rest, indent, column, found)
            depth, paragraph, here, was_code = len(self.boxes), False, False, False
        if paragraph:  # goes on, also without the marks of its containers
            return self._report(line) if self.boxes else self._text(line, True)
        self._close(depth)
        self.leaf = "paragraph"
        return self._report(line) if self.boxes else self._text(line, False)

    def _item(self, rest: str, indent: int, column: int, found: re.Match) -> tuple[str, int]:
        """Open a list item; returns what is left of the line and its column."""
        mark, size = found[1] or found[3], found.end()
        after = _spaced(rest[size:], column + indent + size)
        spaces = _indent(after)
        empty = spaces == len(after)
        width = size + (1 if empty or spaces > 4 else spaces)
        if not self.boxes:
            if self.list_mark != mark:
                self._begin("list")
                self.list_mark, self.item_no = mark, 0
            self.item_no += 1
        self.boxes.append(Box(indent + width, mark, empty))
        return after[width - size :], column + indent + width

    def _html_start(self, rest: str, paragraph: bool) -> re.Pattern | None | bool:
        """The end of the HTML block that starts here (None: a blank line); False if none does."""
        for start, end, inside in HTML:
            if (inside or not paragraph) and start.match(rest):
                return end
        return False

    def _underlined(self, line: Line, level: int) -> None:
        lines = [self.lines[place] for place in self.paragraph]
        for own in lines:
            own.kind, own.block_no, own.in_heading = None, None, True
        self._section(line, level, "\n".join(own.text for own in lines).strip())


def read_lines(content: str, html: bool = False) -> list[Line]:
    """The lines of *content*; blocks whose text is white space are none."""
    reader = Reader(html)
    for raw in content.split("\n"):
        reader.read(raw)
    return reader.lines
