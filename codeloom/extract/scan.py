"""A tolerant scanner: strings and comments blanked out, brackets matched, positions kept. It never raises on broken code."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterable

_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DQ = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)'
_SQ = r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
_TICK = r"`(?:\\.|[^`\\])*(?:`|\Z)"
RULES = {
    "rust": re.compile(rf'(?P<c>{_C})|(?P<s>b?r(#*)".*?(?:"\3|\Z)|b?"(?:\\.|[^"\\])*(?:"|\Z)|b?\'(?:\\[^\n]{{1,9}}?|[^\'\\\n])\')', re.S),
    "go": re.compile(rf"(?P<c>{_C})|(?P<s>{_DQ}|`[^`]*(?:`|\Z)|{_SQ})", re.S),
    "java": re.compile(rf'(?P<c>{_C})|(?P<s>""".*?(?:"""|\Z)|{_DQ}|{_SQ})', re.S),
    "javascript": re.compile(rf"(?P<c>{_C})|(?P<s>{_DQ}|{_SQ}|{_TICK})", re.S),
    "python": re.compile(r"""(?P<c>\#[^\n]*)|(?P<s>(?i:[rbuf]{0,2})(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)))""", re.S),
}
RULES["typescript"] = RULES["javascript"]

OPEN, CLOSE = "([{", ")]}"


class Cover:
    """Whether some span (start, end) covers a position: start <= position < end. Spans may overlap in any way."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        ordered = sorted(spans)
        self.starts = [a for a, _ in ordered]
        self.reach = list(itertools.accumulate((b for _, b in ordered), max))

    def __contains__(self, at: int) -> bool:
        i = bisect.bisect_right(self.starts, at)
        return i > 0 and self.reach[i - 1] > at


class Innermost:
    """The span (start, end, value) with the greatest start that covers a position; of several with this start the longest.

    Positions are asked in ascending order, so all of them take one pass over the spans.
    """

    def __init__(self, spans: Iterable[tuple]):
        self.spans = sorted(spans, key=lambda x: x[:2])
        self.next, self.open = 0, []

    def at(self, at: int) -> tuple | None:
        while self.next < len(self.spans) and self.spans[self.next][0] <= at:
            self.open.append(self.spans[self.next])
            self.next += 1
        while self.open and self.open[-1][1] <= at:
            self.open.pop()
        return self.open[-1] if self.open else None


class Source:
    """A file's text with its blanked copy (``code``), comments, strings, lines and matching brackets."""

    def __init__(self, text: str, language: str):
        self.text = text
        self.comments: list[tuple[int, int]] = []
        self.strings: list[tuple[int, int]] = []
        out, at = [], 0
        for m in RULES[language].finditer(text):
            if m.end() == m.start():
                continue
            out.append(text[at : m.start()])
            body = m.group()
            if m.lastgroup == "c" or m.group("c") is not None:
                self.comments.append(m.span())
                out.append(re.sub(r"[^\n]", " ", body))
            else:
                self.strings.append(m.span())
                out.append('"' + re.sub(r"[^\n]", "_", body[1:-1]) + '"' if len(body) > 1 else '"')
            at = m.end()
        out.append(text[at:])
        self.code = "".join(out)
        self.newlines = [i for i, c in enumerate(text) if c == "\n"]
        self.comment_ends = [b for _, b in self.comments]
        self.close: dict[int, int] = {}
        stack: list[int] = []
        waiting = dict.fromkeys(OPEN, 0)
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c = m.group()
            if c in OPEN:
                stack.append(m.start())
                waiting[c] += 1
            else:
                # An unmatched bracket closes the nearest opener of its kind, or nothing.
                kind = OPEN[CLOSE.index(c)]
                while waiting[kind]:
                    opener = stack.pop()
                    waiting[self.code[opener]] -= 1
                    if self.code[opener] == kind:
                        self.close[opener] = m.start()
                        break

    def line(self, pos: int) -> int:
        return bisect.bisect_left(self.newlines, pos) + 1

    def line_start(self, pos: int) -> int:
        i = bisect.bisect_left(self.newlines, pos)
        return self.newlines[i - 1] + 1 if i else 0

    def end_of(self, opener: int) -> int:
        """Just behind the bracket that closes ``opener``; the end of the text if none does."""
        return self.close.get(opener, len(self.code) - 1) + 1

    def find(self, chars: str, at: int) -> int:
        """First of ``chars`` at or behind ``at``, skipping round and square brackets; -1 if there is none."""
        while at < len(self.code):
            c = self.code[at]
            if c in chars:
                return at
            if c in "([":
                at = self.end_of(at)
                continue
            at += 1
        return -1

    def comments_above(self, pos: int, accept, skip: str | None = None) -> list[str]:
        """Texts of accepted comments directly above the line of ``pos``, first one first; ``skip`` matches lines between."""
        at, found = self.line_start(pos), []
        while at > 0:
            prev = self.line_start(at - 1)
            text = self.text[prev : at - 1].strip()
            end = at - 1
            ending = self.comments[bisect.bisect_right(self.comment_ends, prev) : bisect.bisect_right(self.comment_ends, end + 1)]
            hit = next((c for c in reversed(ending) if self.line_start(c[1] - 1) <= prev and self.text[c[1] : end].strip() == ""), None)
            if hit and self.text[self.line_start(hit[0]) : hit[0]].strip() == "":
                body = self.text[hit[0] : hit[1]]
                if not accept(body):
                    break
                found.append(body)
                at = self.line_start(hit[0])
            elif skip and re.match(skip, text):
                at = prev
            else:
                break
        return found[::-1]


def split_top(text: str, separator: str = ",", angles: bool = True) -> list[str]:
    """Parts between top-level separators."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{" or angles and c == "<":
            depth += 1
        elif c in ")]}" or angles and c == ">" and text[i - 1 : i] not in ("-", "="):
            depth = max(0, depth - 1)
        elif c == separator and depth == 0:
            out.append(text[at:i])
            at = i + 1
    out.append(text[at:])
    return [x.strip() for x in out if x.strip()]
