"""The edit commands one after another on one document: what the relational editor is held against."""

from __future__ import annotations

import re

from quire.functions import markdown as M
from quire.functions import text as T
from quire.operators.edits import LONGEST, RANKS, SLIDE


class Editor:
    """Applies ordered commands to one document; line numbers stay valid until the inserts at the end."""

    def __init__(self, lines: list[str], outline: list[str] | None):
        self.lines = M.normalize(lines)
        self.entries = M.outline_entries(outline or [])
        self.titles = {e[2] for e in self.entries}
        self.mask = M.fenced(self.lines)
        self.present = {M.title_norm(h.text) for h in M.headings(self.lines)}
        self.pages = [(i, m[1].lower()) for i, x in enumerate(self.lines) if (m := M.PAGE.match(x))]
        self.inserts: list[tuple[int, int, str]] = []
        self.stats = dict.fromkeys((*RANKS, "rejected"), 0)

    def heading(self, i: int) -> M.Heading | None:
        """The heading whose title stands in a line: the line and the one before decide, as no edit makes or breaks a fence."""
        if not 0 <= i < len(self.lines) or self.mask[i] or not (own := M.ATX.match(self.lines[i])):
            return None
        meta = M.META.match(self.lines[i - 1]) if i and not self.mask[i - 1] else None
        if meta and len(own[1]) <= T.NATIVE_LEVELS:
            return M.Heading(int(meta[1]), own[2], i - 1, i)
        return M.Heading(len(own[1]), own[2], i, i)

    def beside(self, h: M.Heading, step: int) -> M.Heading | None:
        """The heading before (step -1) or after (1) with blank lines only in between."""
        i = (h.start if step < 0 else h.line) + step
        while 0 <= i < len(self.lines) and not self.lines[i].strip():
            i += step
        return self.heading(i) or (self.heading(i + 1) if step > 0 and 0 <= i < len(self.lines) and M.META.match(self.lines[i]) else None)

    def write(self, h: M.Heading, level: int, text: str) -> None:
        """In place: a level comment goes to the line before only where the heading has one, else raw hashes stand in."""
        if h.start < h.line and level > T.NATIVE_LEVELS:
            self.lines[h.start], self.lines[h.line] = M.serialize(level, text)
        else:
            if h.start < h.line:
                self.lines[h.start] = ""
            self.lines[h.line] = "#" * level + " " + text

    def clear(self, h: M.Heading) -> None:
        for i in range(h.start, h.line + 1):
            self.lines[i] = ""

    def swap(self, *old: str, new: str | None = None) -> None:
        self.present -= {M.title_norm(x) for x in old}
        self.present |= {M.title_norm(new)} if new else set()

    def apply(self, action: str, line: int, level: int | None, text: str | None) -> None:
        ok = action == "insert" or (line <= len(self.lines) and not self.mask[line - 1])
        done = ok and getattr(self, action)(line, level, text)
        if done is not None:
            self.stats[action if done else "rejected"] += 1

    def retitle(self, line, level, text):
        h = self.heading(line - 1)
        if not h or M.title_norm(text) not in self.titles:
            return False
        self.write(h, h.level, text)
        self.swap(h.text, new=text)
        return True

    def relevel(self, line, level, text):
        h = self.heading(line - 1)
        if not h:
            return False
        if h.level == level:
            return None
        self.write(h, level, h.text)
        return True

    def merge(self, line, level, text):
        h = self.heading(line - 1)
        if not h:
            return False
        if into := self.beside(h, -1):
            title = f"{into.text} {h.text}"
        elif into := self.beside(h, 1):
            title = f"{h.text} {into.text}"
        else:
            return False
        self.write(into, into.level, title)
        self.clear(h)
        self.swap(into.text, h.text, new=title)
        return True

    def demote(self, line, level, text):
        h = self.heading(line - 1)
        if not h:
            return False
        self.clear(h)
        self.lines[h.line] = f"**{h.text}**"
        self.swap(h.text)
        return True

    def promote(self, line, level, text):
        i = line - 1
        t = self.lines[i].strip()
        closed = not t or M.PAGE.match(t) or re.match(r"\[\^[^\]]+\]:|[>|]|([*+-]|\d+[.)])\s|```|~~~", t)
        title = re.sub(r"^\*\*(.+?)\*\*$", r"\1", t).strip()
        if closed or self.heading(i) or not title or len(title) > LONGEST or (self.entries and M.title_norm(title) not in self.titles):
            return False
        self.lines[i] = "#" * level + " " + title
        self.swap(new=title)
        return True

    def insert(self, line, level, text):
        norm = M.title_norm(text)
        entry = next((e for e in self.entries if e[2] == norm), None)
        if not entry or norm in self.present or line > len(self.lines):
            return False
        spot = None
        first = min(line, len(self.lines) - 1)
        for i in range(first, min(len(self.lines), first + SLIDE)):
            if not self.lines[i].strip() or M.ATX.match(self.lines[i]):
                spot = i if not self.lines[i].strip() else max(i - 1, 0)
                break
        if spot is None:
            return False
        start = next((i for i, p in self.pages if p == entry[3]), None) if entry[3] else None
        if start is not None and not start <= spot < next((i for i, _ in self.pages if i > start), len(self.lines)):
            return False
        self.inserts.append((spot, level, entry[1]))
        self.present.add(norm)
        return True

    def result(self) -> list[str]:
        for spot, level, text in sorted(self.inserts, key=lambda x: -x[0]):
            new = [*M.serialize(level, text), ""]
            self.lines[spot + 1 : spot + 1] = new if not self.lines[spot].strip() else ["", *new]
        return M.normalize(self.lines)


def ordered(commands: list[tuple]) -> list[tuple]:
    """(action, line, level, text) commands in the order they are applied: the last of a target counts."""
    placed = sorted(commands, key=lambda c: RANKS[c[0]])
    key = lambda c: ("insert", M.title_norm(c[3])) if c[0] == "insert" else (c[0], c[1])
    last = {key(c): i for i, c in enumerate(placed)}
    return [c for i, c in enumerate(placed) if last[key(c)] == i]


def edited(lines: list[str], commands: list[tuple], outline: list[str] | None) -> tuple[str, dict[str, int]]:
    e = Editor(lines, outline)
    if e.entries or M.headings(e.lines):
        for c in ordered(commands):
            e.apply(*c)
    return "\n".join(e.result()), e.stats
