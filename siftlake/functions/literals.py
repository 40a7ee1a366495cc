"""What a line must hold for a pattern to match it: literals taken out of the pattern's parse tree.

Looking for a few fixed strings in a line costs a fraction of a search by pattern, and rules seldom fire. needs() gives
clauses; a line that a pattern matches holds at least one literal of every clause. So a filter by clauses drops no match.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from re import _constants as op
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Literals of a clause, and clauses of a pattern, at most; a longer clause would cost more than the pattern.
WIDE, DEEP = 12, 3
#: Letters that a pattern without regard to case takes for another one, beside what lower() does.
ALIKE = ("ſı", "si")


def _weight(clause: tuple[str, ...]) -> tuple[int, int]:
    return min(map(len, clause)), -len(clause)


def _clauses(tree) -> list[tuple[str, ...]]:
    out, run = [], ""

    def end():
        nonlocal run
        if run:
            out.append((run,))
        run = ""

    for kind, arg in tree:
        if kind is op.LITERAL:
            run += chr(arg)
            continue
        end()
        if kind is op.SUBPATTERN:
            out += _clauses(arg[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and arg[0] > 0:
            out += _clauses(arg[2])
        elif kind is op.ATOMIC_GROUP:
            out += _clauses(arg)
        elif kind is op.IN:
            codes = []
            for k, v in arg:
                codes += [v] if k is op.LITERAL else range(v[0], v[1] + 1) if k is op.RANGE and v[1] - v[0] < WIDE else [None] * WIDE
            if codes and len(codes) <= WIDE and None not in codes:
                out.append(tuple(map(chr, codes)))
        elif kind is op.BRANCH:
            best = [max(c, key=_weight) if (c := _clauses(b)) else None for b in arg[1]]
            union = tuple(dict.fromkeys(x for b in best if b for x in b))
            if None not in best and len(union) <= WIDE:
                out.append(union)
    end()
    return out


@lru_cache(1024)
def needs(pattern: str) -> tuple[bool, tuple[tuple[str, ...], ...]]:
    """Whether case counts, and the clauses, the longest literals first. A pattern with flags for a part of it only has none."""
    tree = _parser.parse(pattern)
    folded = bool(tree.state.flags & re.I)
    if re.search(r"\(\?[a-zA-Z]*-?[a-zA-Z]*i[a-zA-Z]*:", pattern):
        return True, ()
    clauses = [tuple(x.lower() for x in c) if folded else c for c in _clauses(tree)]
    return not folded, tuple(sorted(dict.fromkeys(clauses), key=_weight, reverse=True)[:DEEP])


def fold(col: Column) -> Column:
    """Text in which literals of a pattern without regard to case are looked for."""
    return F.translate(F.lower(col), *ALIKE)


def may_match(col: Column, folded: Column, pattern: str) -> Column:
    """False only where the pattern has no match; folded: fold(col)."""
    cased, clauses = needs(pattern)
    out = F.lit(True)
    for clause in clauses:
        any_ = F.lit(False)
        for literal in clause:
            any_ = any_ | F.contains(col if cased else folded, F.lit(literal))
        out = out & any_
    return out


def plain_fold(text: str) -> str:
    """The text in lower case, as long as before, with the letters that a pattern without regard to case takes alike."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[0] for c in text)
    return low.translate(str.maketrans(*ALIKE)) if not low.isascii() else low


class Finder:
    """An automaton over one clause of every pattern: the longest. Which lines of a text may match which patterns."""

    def __init__(self, patterns: tuple[str, ...]):
        import ahocorasick

        owners: dict[str, list[int]] = {}
        self.always = []
        for k, p in enumerate(patterns):
            clauses = needs(p)[1]
            if not clauses or not all(x.isascii() for x in clauses[0]):
                self.always.append(k)
                continue
            for literal in clauses[0]:
                owners.setdefault(literal.lower(), []).append(k)
        self.automaton = ahocorasick.Automaton()
        for literal, who in owners.items():
            self.automaton.add_word(literal, who)
        self.some = bool(owners)
        if self.some:
            self.automaton.make_automaton()

    def lines(self, text: str, lines: list[str], breaks: list[int]):
        """(number of line from 0, patterns) of lines that hold a literal; breaks: where each line begins in the text."""
        found: dict[int, set[int]] = {}
        if self.some:
            for end, who in self.automaton.iter(plain_fold(text)):
                found.setdefault(bisect_right(breaks, end) - 1, set()).update(who)
        for k in range(len(lines)) if self.always else sorted(found):
            if k < len(lines):
                yield k, sorted({*found.get(k, ()), *self.always})


def candidates(texts: DataFrame, patterns: tuple[str, ...], split, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """texts(text, kept columns) -> kept columns, line_no, line, may: the lines that hold a literal of some pattern, and
    the numbers of those patterns. A text passes one automaton whatever the number of patterns, and only its candidate
    lines leave the task. split: (lines of a text, where each begins). Null texts have no lines."""
    fields = [texts.schema[k] for k in keep]

    def work(batches):
        finder = Finder(patterns)
        for batch in batches:
            at, numbers, kept, may, size = [], [], [], [], 0
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                if not text:
                    continue
                lines, begins = split(text)
                for k, who in finder.lines(text, lines, begins):
                    at.append(i)
                    numbers.append(k + 1)
                    kept.append(lines[k])
                    may.append(who)
                    size += len(lines[k])
                if size > 1 << 22:
                    yield rows(batch, at, numbers, kept, may)
                    at, numbers, kept, may, size = [], [], [], [], 0
            yield rows(batch, at, numbers, kept, may)

    def rows(batch, at, numbers, kept, may):
        cols = [batch.column(k).take(pa.array(at, pa.int64())) for k in keep]
        return pa.RecordBatch.from_arrays([*cols, pa.array(numbers, pa.int32()), pa.array(kept, pa.string()), pa.array(may, pa.list_(pa.int32()))], [*keep, "line_no", "line", "may"])

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "line_no int, line string, may array<int>"])
    return texts.select(*keep, "text").mapInArrow(work, shape)


def matches(col: Column, folded: Column, pattern: str) -> Column:
    """rlike, with the pattern tried only on texts that hold its literals."""
    return may_match(col, folded, pattern) & F.rlike(col, F.lit(f"(?U){pattern}"))
