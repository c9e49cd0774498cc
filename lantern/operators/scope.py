"""Restricting sections to a part of the documentation by their source path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the documentation's folders.
ROOT = "Глава 4. Программный интерфейс"
INTERFACE, OVERRIDE, MAIN_GROUP = "Интерфейс", "Переопределение", "Основные процедуры и функции"
KINDS = {"development": INTERFACE, "override": OVERRIDE}
MODES = ("all", *KINDS)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def like(path: Column, pattern: str) -> Column:
    """LIKE that ignores the case of ASCII letters alone; backslashes are ordinary characters."""
    folded = pattern.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\")
    return F.translate(path, _UPPER, _LOWER).like(folded)


def patterns(mode: str = "all", subsystem: str | None = None, group: str | None = None) -> tuple[list[str], list[str], list[str]]:
    """LIKE patterns: all of the first, one of the second (if any), none of the third."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if group and not subsystem:
        raise ValueError("a group needs a subsystem")
    every, some, none = [], [], []
    if mode in KINDS:
        every.append(f"{ROOT}/%/{KINDS[mode]}/%")
    if subsystem:
        every.append(f"{ROOT}/{subsystem}/%")
    if group:
        kinds = [KINDS[mode]] if mode in KINDS else [INTERFACE, OVERRIDE]
        if group == MAIN_GROUP:  # its pages lie directly in the folder of the kind
            some = [f"{ROOT}/{subsystem}/{k}/%" for k in kinds]
            none = [f"{ROOT}/{subsystem}/{k}/%/%" for k in kinds]
        else:
            every.append(f"{ROOT}/{subsystem}/{KINDS.get(mode, '%')}/{group}/%")
    return every, some, none


def condition(path: Column, mode: str = "all", subsystem: str | None = None, group: str | None = None) -> Column | None:
    """The scope as a condition on a source path; None if it takes everything."""
    every, some, none = patterns(mode, subsystem, group)
    slashed = F.translate(path, "\\", "/")
    out = None
    if every or some:
        # no ASCII letters in the root, so this plain prefix is the same and reaches the file scan
        out = path.startswith(f"{ROOT}/") | path.contains("\\")
    for p in every:
        out = out & like(slashed, p)
    if some:
        one = like(slashed, some[0])
        for p in some[1:]:
            one = one | like(slashed, p)
        out = out & one
    for p in none:
        out = out & ~like(slashed, p)
    return out


def scoped(sections: DataFrame, mode: str = "all", subsystem: str | None = None, group: str | None = None, path: str = "source_path") -> DataFrame:
    found = condition(F.col(path), mode, subsystem, group)
    return sections if found is None else sections.filter(found)
