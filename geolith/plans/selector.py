"""Selectors: type letters, then clauses that all must hold.

    na[shop]              nodes and areas with a shop
    w[highway=primary]    ways whose highway is primary
    *[name:en=Bavaria]    anything; no letters mean the same

Letters: n nodes, w ways that are not areas, a areas, r relations that are not areas.  As extensions, ``!=`` and a
comma list of values are accepted: ``[k!=v]``, ``[k=v,w]``, and ``[!k]`` for absence.  A selector of several parts
separated by ``;`` is their union.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from geolith.functions import tags as T

KINDS = "nwar"
CLAUSE = re.compile(r"\[\s*(!?)\s*(\"[^\"]*\"|[\w:@.-]+)\s*(?:(!?=)\s*((?:\"[^\"]*\"|[^\]\",]+)(?:\s*,\s*(?:\"[^\"]*\"|[^\]\",]+))*))?\s*\]")
VALUE = re.compile(r"\"([^\"]*)\"|([^,]+)")


class SelectorError(ValueError):
    """The selector can't be read; says where."""


@dataclass(frozen=True)
class Clause:
    key: str
    values: tuple[str, ...] | None = None
    negated: bool = False

    def column(self, tags: str) -> Column:
        if self.values is None:
            out = T.has(tags, self.key)
        else:
            out = F.coalesce(T.value(tags, self.key).isin(list(self.values)), F.lit(False))
        return ~out if self.negated else out


@dataclass(frozen=True)
class Selector:
    kinds: frozenset[str]
    clauses: tuple[Clause, ...]

    def column(self, kind: str = "kind", tags: str = "tags") -> Column:
        out = F.lit(True) if self.kinds == frozenset(KINDS) else F.col(kind).isin(sorted(self.kinds))
        for c in self.clauses:
            out = out & c.column(tags)
        return out

    def bits(self, category_of: dict[str, int]) -> int:
        """The categories that a match must have: files without them can be skipped."""
        out = 0
        for c in self.clauses:
            if not c.negated and c.key in category_of and not (c.values and "no" in c.values):
                out |= 1 << category_of[c.key] - 1
        return out


def parse(text: str) -> list[Selector]:
    """The parts of a union."""
    out, at = [], 0
    while True:
        found = re.compile(r"\s*(\*|[nwar]*)\s*").match(text, at)
        letters, at = found[1], found.end()
        if len(set(letters)) < len(letters):
            raise SelectorError(f"a type letter stands twice: {letters}")
        clauses = []
        while at < len(text) and text[at] == "[":
            m = CLAUSE.match(text, at)
            if not m:
                raise SelectorError(f"no clause at {at}: {text[at:]}")
            if m[1] and m[3]:
                raise SelectorError(f"a clause for absence has no value: {m[0]}")
            values = tuple(a or b.strip() for a, b in VALUE.findall(m[4])) if m[4] else None
            clauses.append(Clause(m[2].strip('"'), values, bool(m[1]) or m[3] == "!="))
            at = m.end()
            while at < len(text) and text[at].isspace():
                at += 1
        if not letters and not clauses:
            raise SelectorError(f"nothing selected at {at} of: {text!r}")
        out.append(Selector(frozenset(KINDS if letters in ("", "*") else letters), tuple(clauses)))
        if at == len(text):
            return out
        if text[at] != ";":
            raise SelectorError(f"not understood at {at}: {text[at:]}")
        at += 1


def predicate(text: str, category_of: dict[str, int] | None = None) -> Column:
    """The column of a selector; with categories, key bits prune first."""
    out = None
    for s in parse(text):
        part = s.column()
        if category_of and (bits := s.bits(category_of)):
            part = (F.col("key_bits").bitwiseAND(F.lit(bits)) == bits) & part
        out = part if out is None else out | part
    return out


def pruning(text: str, category_of: dict[str, int] | None = None) -> tuple[str | None, list[int] | None]:
    """(kinds, key bits) of what a selector can match: any of the kinds, all bits of any of the numbers; None: all."""
    parts = parse(text)
    kinds = "".join(k for k in KINDS if any(k in s.kinds for s in parts))
    bits = [s.bits(category_of or {}) for s in parts]
    return None if kinds == KINDS else kinds, None if not all(bits) else bits
