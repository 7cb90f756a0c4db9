"""Text: cleaning, escaping, numbers and option values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(c: Column) -> Column:
    """Trimmed; every white-space character as one space."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s", " ")


def csv_cell(c: Column) -> Column:
    """Quoted only if it holds a quote, a comma or a space; quotes doubled."""
    text = cleaned(c)
    return F.when(text.rlike('[", ]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def xml_escaped(c: Column) -> Column:
    for sign, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(sign), F.lit(to))
    return c


def html_escaped(c: Column) -> Column:
    for sign, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(to))
    return c


def json_text(c: Column) -> Column:
    """A JSON string with its quotes."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def number(c: Column) -> Column:
    """Without a point if whole."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def split_values(c: Column) -> Column:
    """Parts between semicolons, trimmed; empty parts at the end do not count."""
    parts = F.split(F.regexp_replace(c, r";+$", ""), ";")
    return F.transform(parts, lambda x: F.trim(x))


def narrow_number(c: Column) -> Column:
    """The value of canonical decimal text with up to three places, else null: it prints as the same text."""
    ok = c.rlike(r"^(0|-?[1-9][0-9]{0,11}|-?(0|[1-9][0-9]{0,11})\.[0-9]{0,2}[0-9])$") & ~c.rlike(r"^-0(\.0+)?$")
    return F.when(ok, c.try_cast("decimal(18,3)"))


def parse_share(text: str) -> tuple[float, bool]:
    """``5%`` -> (0.05, True); ``20`` -> (20.0, False)."""
    return (float(text[:-1]) / 100, True) if text.endswith("%") else (float(text), False)


def parse_boolean(text: str | None) -> bool:
    if text is None or text.lower() in ("yes", "true", "on"):
        return True
    if text.lower() in ("no", "false", "off"):
        return False
    raise ValueError(f"not a boolean: {text}")


def parse_size(text: str) -> int:
    """A number with an optional unit k, m, g, t or p, each 1024 of the one before."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", text.lower())
    if not found:
        raise ValueError(f"not a number: {text}")
    return int(found[1]) * 1024 ** " kmgtp".index(found[2] or " ")


def in_range(value: float, low: float, high: float, name: str = "value") -> float:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


def parse_choice(text: str, choices: list[str] | tuple[str, ...]) -> str:
    """One of some names, whatever the case."""
    found = {c.lower(): c for c in choices}
    if text.lower() not in found:
        raise ValueError(f"{text} should be one of {', '.join(choices)}")
    return found[text.lower()]
