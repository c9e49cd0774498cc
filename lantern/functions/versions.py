"""Release numbers: parsing, families, and finding them in project files, as columns."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: what a version looks like, and one in quotes; the encodings of project files.
PATTERN = r"^\d+(?:[._]\d+)+$"
QUOTED = r'"(\d+(?:\.\d+){1,})"'
ENCODINGS = ("utf-8-sig", "utf-16", "cp1251")


def full(raw: Column) -> Column:
    """The normalised version, null if ``raw`` isn't one."""
    parts = F.transform(F.split(F.trim(raw), "[._]"), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.when(F.trim(raw).rlike(PATTERN), F.array_join(parts, "."))


def release(raw: str) -> Row:
    """``full`` and ``family`` of one version that a caller names, by the same columns; an error if it isn't one."""
    version = full(F.lit(raw.strip()))
    found = SparkSession.active().range(1).select(version.alias("full"), family(version).alias("family")).first()
    if found["full"] is None:
        raise ValueError(f"not a version of at least two numbers: {raw!r}")
    return found


def family(version: Column) -> Column:
    return F.substring_index(version, ".", 2)


def order_key(version: Column) -> Column:
    """Numbers to sort versions by: 3.1.11.9 comes before 3.1.11.115."""
    return F.transform(F.split(version, r"\."), lambda p: p.cast("int"))


def quoted_before(content: Column, marker: str) -> Column:
    """The last quoted version before the first place of ``marker``; null if there is none."""
    head = F.when(F.contains(content, F.lit(marker)), F.substring_index(content, marker, 1))
    return full(F.try_element_at(F.regexp_extract_all(head, F.lit(QUOTED), F.lit(1)), F.lit(-1)))


_SUPPORT = "/*[local-name()='DistributionSupport']"
_PARENT = f"{_SUPPORT}//*[local-name()='parentConfigurationInfos']"


def _xml(content: Column) -> Column:
    return F.when(content.rlike(r"^\s*<"), F.regexp_replace(content, r"^\s*<\?xml[^>]*\?>", ""))


def from_support_xml(content: Column) -> Column:
    """The release named by the first configuration of a support description; null if it isn't one."""
    return full(F.nullif(F.xpath_string(_xml(content), F.lit(f"{_PARENT}[1]/@configRelease")), F.lit("")))


def support_failure(content: Column) -> Column:
    """Why a support description names no release: it isn't one, has no configuration, or a configuration without release; null if it does."""
    xml = _xml(content)
    has = lambda path: F.coalesce(F.xpath_boolean(xml, F.lit(path)), F.lit(False))
    failures = F.when(~has(_SUPPORT), F.lit("not a support description")).when(~has(_PARENT), F.lit("no configuration in the support description"))
    return failures.when(F.coalesce(from_support_xml(content), F.lit("")) == "", F.lit("a configuration without a release"))


def _fitting(content: bytes, encoding: str) -> str | None:
    try:
        return content.decode(encoding)
    except UnicodeDecodeError:
        return None


def decoded(content: bytes) -> str:
    """Text by the first encoding that fits."""
    text = next(filter(lambda t: t is not None, map(partial(_fitting, content), ENCODINGS)), None)
    if text is None:
        raise ValueError("none of the encodings fits")
    return text
