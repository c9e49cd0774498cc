"""Column functions on text: cleaning, names, tokens, flags and result fields."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the documentation format.
STOP_WORDS = ("другие", "других", "если", "записи", "запись", "наличие", "нужно", "отменить", "показать", "при", "проверить", "проверять", "реализовать", "сделать", "справочник", "справочника", "список", "чтобы")
IGNORED_PURPOSE_LINES = ("Оглавление", "Синтаксис", "Параметры", "Возвращаемое значение", "Описание", "Пример")
PURPOSE_PREFIXES = ("Функция ", "Процедура ", "См. ", "Источник:")
RECOMMENDS = r"(?iuU)\bрекоменду(?:ется|емый|емая|емые|овано)\b"
WARNS = r"(?iuU)\b(?:не\s+рекомендуется|устарел(?:а|о|и)?|не\s+следует|запрещается)\b"
INSTRUCTION = "Given a documentation search query, retrieve the passages that answer it"

#: What str.strip() and str.splitlines() take for white space and for the end of a line.
_SPACE = r"[\s\x1c-\x1f\x85 ]"
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def clean_lines(text: Column) -> Column:
    """Every line with single spaces and stripped, without empty lines."""
    lines = F.transform(F.split(text, _LINES), lambda line: strip(F.regexp_replace(line, r"[ \t\r\f\x0b]+", " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def squash(text: Column) -> Column:
    """All white space runs become one space."""
    return F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def slug(text: Column) -> Column:
    """A name for a file system: forbidden characters become spaces."""
    name = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?* ]', " "), r"\s+", " ")
    name = F.regexp_replace(name, r"^[ .]+|[ .]+$", "")
    return F.when(name == "", F.lit("index")).otherwise(name)


def bounded_name(text: Column, limit: int = 100) -> Column:
    name = F.regexp_replace(F.substring(slug(text), 1, limit), r"[ .]+$", "")
    return F.when(name == "", F.lit("index")).otherwise(name)


def excerpt(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def location(breadcrumb: Column) -> Column:
    return F.array_join(breadcrumb, " > ")


def embedding_text(product: str, version: Column, breadcrumb: Column, source_path: Column, text: Column) -> Column:
    source = F.when(F.coalesce(source_path, F.lit("")) != "", F.concat(F.lit("\nSource: "), source_path)).otherwise("")
    return F.concat(F.lit(f"{product} "), version, F.lit("\nSection: "), location(breadcrumb), source, F.lit("\n\n"), text)


#: A query as a model of instructions takes it.
INSTRUCTED = "Instruct: {}\nQuery: {}"


def query_text(query: Column, instruction: str = INSTRUCTION) -> Column:
    return F.concat(F.lit(INSTRUCTED.format(instruction, "")), query)


def search_tokens(query: Column) -> Column:
    """Runs of letters, digits, underscores and dots: each is a phrase of the query."""
    return F.regexp_extract_all(query, F.lit(r"([\p{L}\p{N}_.]+)"), F.lit(1))


def latin_folding() -> tuple[str, str]:
    """Latin letters with marks and what they are indexed as, by their canonical decomposition."""
    kept = set("ǠǡǢǣǮǯǼǽǾǿ")
    pairs = {"ſ": "s", "ẛ": "s"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0x212A, 0x212B):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and c not in kept and c not in pairs and "LATIN" in unicodedata.name(c, ""):
            pairs[c] = base[0]
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = latin_folding()


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def index_tokens(text: Column) -> Column:
    """The full-text index's tokens: runs of letters and numbers, folded."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def discovery_tokens(text: Column) -> Column:
    """The set of words of over two characters."""
    words = F.regexp_extract_all(text, F.lit("([0-9A-Za-zА-Яа-яЁё]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 2), F.lower))


def without_stop_words(tokens: Column) -> Column:
    return F.array_except(tokens, F.array(*map(F.lit, STOP_WORDS)))


def recommends(text: Column) -> Column:
    return text.rlike(RECOMMENDS)


def warns(text: Column) -> Column:
    return text.rlike(WARNS)


def purpose(lines: Column, method: Column, limit: int = 500) -> Column:
    """The first meaningful line about a method, or the method's name."""

    def meaningful(line: Column) -> Column:
        opening = reduce(lambda a, b: a | b, (line.startswith(p) for p in PURPOSE_PREFIXES))
        call = line.endswith("()") | (line.contains("(") & line.endswith(")"))
        return (line != method) & ~line.isin(*IGNORED_PURPOSE_LINES) & ~opening & ~call & (F.length(line) >= 12)

    return F.substring(F.coalesce(F.try_element_at(F.filter(lines, meaningful), F.lit(1)), method), 1, limit)
