"""The block structure of Markdown that chunking needs: headings, code, tables, lists, prose and the rest.

Lines go one by one through a stack of open containers, quotes and list items, to the leaf within: a
paragraph, code, a table or markup. What stands on the page's own level is told as blocks; containers
hold blocks of their own, whose lines, a paragraph's lazy ones included, belong to them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_FENCE = re.compile(r" {0,3}(`{3,}(?!.*`)|~{3,})")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3}(?:([-+*])|(\d{1,9})([.)])))(?= |$)( *)")
_DELIMITERS = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")

#: Tags that open a block of markup wherever they stand, up to a blank line.
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option "
    "p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
#: How markup begins, and what ends it; up to a blank line where nothing is named.
_MARKUP = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")), (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(">")), (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(BLOCK_TAGS)})(?:\s|/?>|$)", re.I), None),
)
#: Any other tag that is alone on its line; it can't end a paragraph.
_LONE_TAG = re.compile(r""" {0,3}(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)\s*$""")


@dataclass
class Block:
    kind: str  # heading, code, table, list, prose or other
    text: str
    level: int = 0
    items: list[str] = field(default_factory=list)


@dataclass
class _Container:
    """A quote, or a list item whose blocks are indented by ``content``."""

    content: int | None = None
    family: str = ""
    empty: bool = False  # nothing stands in it yet: a blank line ends it


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _cells(line: str) -> int:
    return len(re.split(r"(?<!\\)\|", line.strip().strip("|")))


class _Parser:
    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.wide = [line.expandtabs(4) for line in self.lines]
        self.out: list[Block] = []
        self.stack: list[_Container] = []
        self.leaf = ""  # paragraph, table, code, fence or markup: what the next line may go on with
        self.end: re.Pattern | None = None  # what ends a fence or markup
        self.kind, self.begin, self.items = "", 0, []  # the block of the page's own level that is open

    def blocks(self) -> list[Block]:
        for n, line in enumerate(self.wide):
            self._line(n, line)
        self._finish(len(self.lines))
        return self.out

    # -- blocks of the page's own level

    def _finish(self, n: int) -> None:
        body = "\n".join(self.lines[self.begin : n]).strip("\n")
        if self.kind and body.strip():
            items = ["\n".join(self.lines[a:b]).rstrip() for a, b in zip(self.items, [*self.items[1:], n])]
            self.out.append(Block(self.kind, body, items=items))
        self.kind, self.items = "", []

    def _open(self, n: int, kind: str) -> None:
        self._finish(n)
        self.kind, self.begin = kind, n

    def _heading(self, n: int, text: str, level: int) -> None:
        self._finish(n)
        self.out.append(Block("heading", text, level))

    # -- lines

    def _within(self, line: str) -> tuple[int, str]:
        """How many of the open containers a line is in, and what it has in the innermost of them."""
        for depth, c in enumerate(self.stack):
            if c.content is None:
                mark = _QUOTE.match(line)
                if not mark:
                    return depth, line
                line = line[mark.end() :]
            elif line.strip():
                if _indent(line) < c.content:
                    return depth, line
                line = line[c.content :]
            elif c.empty:
                return depth, line
        return len(self.stack), line

    def _goes_on(self, rest: str) -> bool:
        """Whether a line in all open containers goes on with a leaf that takes lines as they are."""
        if self.leaf == "fence" or self.leaf == "markup" and self.end:
            if self.end.match(rest) if self.leaf == "fence" else self.end.search(rest):
                self.leaf = ""
            return True
        if self.leaf == "markup":
            if not rest.strip():
                self.leaf = ""
            return bool(rest.strip())
        return self.leaf == "code" and (not rest.strip() or _indent(rest) >= 4)

    def _containers(self, rest: str, ends_paragraph: bool) -> tuple[list[_Container], str]:
        """Containers that a line opens, and what it has in them."""
        made: list[_Container] = []
        while _indent(rest) < 4 and not _RULE.match(rest):
            quote, item = _QUOTE.match(rest), _ITEM.match(rest)
            if quote:
                made.append(_Container())
                rest = rest[quote.end() :]
            elif item and not (ends_paragraph and not made and (not rest[item.end() :].strip() or item[3] not in (None, "1"))):
                after = rest[item.end() :]
                # Five spaces or more are one, and code behind it; an empty first line counts as one, too.
                content = len(item[1]) + (len(item[5]) if after.strip() and len(item[5]) < 5 else 1)
                made.append(_Container(content, item[2] or item[4], not after.strip()))
                rest = rest[content:] if after.strip() else ""
            else:
                break
        return made, rest

    def _line(self, n: int, line: str) -> None:
        if self.leaf == "table" and n == self.begin + 1:
            return  # the line of delimiters
        depth, rest = self._within(line)
        whole = depth == len(self.stack)
        if whole and self.leaf and self._goes_on(rest):
            return
        if not rest.strip():
            if not whole or self.leaf != "code":
                self.leaf = ""
            del self.stack[depth:]
            if not self.stack and not self.leaf and self.kind != "list":
                self._finish(n)
            return
        in_paragraph = self.leaf == "paragraph"
        under = _SETEXT.match(rest) if in_paragraph and whole else None
        if under:
            self.leaf = ""
            if not self.stack:
                text = " ".join(x.strip() for x in self.lines[self.begin : n])
                self.kind = ""
                self.out.append(Block("heading", text, 1 if under[1][0] == "=" else 2))
            return
        made, rest = self._containers(rest, in_paragraph and whole)
        continues = in_paragraph and not made
        leaf, kind, end = self._leaf(n, rest, continues, bool(self.stack[:depth] or made))
        if leaf == "paragraph" and not made and (in_paragraph or self.leaf == "table" and whole):
            return  # the paragraph goes on, also outside of its containers
        if not depth:
            first = made[0] if made else None
            if first and first.family and self.kind == "list" and self.family == first.family:
                self.items.append(n)
            elif first:
                self._open(n, "list" if first.family else "other")
                self.family, self.items = first.family, [n] if first.family else []
            elif kind == "heading":
                atx = _ATX.match(rest)
                self._heading(n, (atx[2] or "").strip(), len(atx[1]))
            else:
                self._open(n, kind)
        del self.stack[depth:]
        for c in self.stack:
            c.empty = False
        self.stack += made
        self.leaf, self.end = leaf, end

    def _leaf(self, n: int, rest: str, in_paragraph: bool, inside: bool) -> tuple[str, str, re.Pattern | None]:
        """(leaf, kind of block, what ends it) that a line begins; a paragraph if it is nothing else."""
        if not rest.strip():
            return "", "", None
        if _indent(rest) >= 4:
            return ("paragraph", "prose", None) if in_paragraph else ("code", "code", None)
        fence = _FENCE.match(rest)
        if fence:
            mark = fence[1].strip()
            return "fence", "code", re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
        if _ATX.match(rest):
            return "", "heading", None
        if _RULE.match(rest):
            return "", "other", None
        for begins, ends in _MARKUP:
            found = begins.match(rest)
            if found:
                return ("", "other", None) if ends and ends.search(rest, found.end()) else ("markup", "other", ends)
        if not in_paragraph and _LONE_TAG.match(rest):
            return "markup", "other", None
        if not inside and self._is_table(n):
            return "table", "table", None
        return "paragraph", "prose", None

    def _is_table(self, n: int) -> bool:
        return n + 1 < len(self.wide) and "|" in self.wide[n] and bool(_DELIMITERS.match(self.wide[n + 1])) and _cells(self.wide[n]) == _cells(self.wide[n + 1])


def parse(text: str) -> list[Block]:
    return _Parser(text).blocks()
