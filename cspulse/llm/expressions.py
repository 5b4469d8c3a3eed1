"""Small helpers over Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that each row computes once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores until no column has it, upper and lower case alike."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def others(columns: Iterable[str], made: Iterable[str]) -> list[str]:
    """The columns that new ones named ``made`` do not replace, upper and lower case alike."""
    gone = {name.lower() for name in made}
    return [c for c in columns if c.lower() not in gone]
