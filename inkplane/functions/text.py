"""Characters, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hiragana, katakana and common ideographs, both ends included.
SCRIPT_RANGES = ((0x3041, 0x3096), (0x30A1, 0x30F6), (0x4E00, 0x9FFF))


def is_japanese(codepoint: Column) -> Column:
    made = F.lit(False)
    for low, high in SCRIPT_RANGES:
        made = made | codepoint.between(low, high)
    return made


def codepoint(char: Column) -> Column:
    return F.ascii(char)


def char(cp: Column) -> Column:
    """The character of a code point; ``chr`` would fold it to a byte."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def page_name(idx: Column) -> Column:
    return F.format_string("page_%06d", idx)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def swap_suffix(name: Column, old: str, new: str) -> Column:
    """Every occurrence, as a plain replacement does."""
    return F.replace(name, F.lit(old), F.lit(new))


def tokens(line: Column) -> Column:
    """Parts between white space, without empty ones at the ends."""
    return F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")
