"""Names, phrases and extensions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def plural(value: int, word: str) -> str:
    return f"{value} {word}" if value == 1 else f"{value} {word}s"


def plural_phrase(value: Column, word: str) -> Column:
    return F.concat(value.cast("string"), F.lit(" " + word), F.when(value == 1, "").otherwise("s"))


def normalise_extensions(extensions: Iterable[str]) -> tuple[str, ...]:
    """Lower-case, dot-led, without repeats, in the order of first occurrence."""
    dotted = (("" if e.startswith(".") else ".") + e for e in extensions)
    return tuple(dict.fromkeys(e.lower() for e in dotted))


def split_extensions(flag: str) -> tuple[str, ...]:
    """A comma-separated flag; blanks are dropped."""
    return normalise_extensions(e.strip() for e in flag.split(",") if e.strip())


def suffix(path: Column) -> Column:
    """Lower-cased last extension of a path's name; empty for names such as ``.jpg`` or ``x.``."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def index_dtype(n: Column) -> Column:
    """Narrowest unsigned type for indices of n items."""
    return F.when(n <= 65536, "uint16").otherwise("uint32")
