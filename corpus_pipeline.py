"""A corpus pipeline: five stages over ``documents``, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, whatever other columns there are and whatever
their names: helper columns take names that the table doesn't have. The packing of the
last stage carries doc_id. ``run`` writes each stage's rows to a table before the next one
reads them, so that nothing is evaluated twice, and deletes it when it is spent.

An empty table gives an empty result in every stage. Texts are never cut but by packing,
however long they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lantern.llm import common, exact_dedup, language, mixing, near_dedup, packing

#: Documents whose language is less certain than this are rejected, as are those of none.
LEAST_CERTAINTY = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is certain enough stay.

    Null and empty texts and those without letters go. Null ids and null languages are
    not learned from; their rows are judged by their text like any other. Repeated rows
    are judged alike. Where no row has a language, nothing can be learned and every document goes.
    """
    columns = docs.columns
    names = common.fresh(docs, "language", "certainty")
    found = language.predict(docs, language.fit(docs), names["language"], names["certainty"])
    return found.filter((found[names["language"]] != language.UNDETERMINED) & (found[names["certainty"]] >= LEAST_CERTAINTY)).select(columns)


def dedup_exactly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays.

    Null texts count as empty: all of them are one group. A null id is smaller than any
    other; of rows equal in id and text one stays, so ties leave one row as well.
    """
    return exact_dedup.deduplicate(docs)


def dedup_nearly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingles of two words, as operator 10 links them, the one with the smallest doc_id stays.

    Null and empty texts link with nothing and stay. A null id is larger than any other;
    rows that share an id are told apart by their texts, and of repeated rows one stays.
    """
    return near_dedup.deduplicate(docs, width=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it, three times at most.

    A null source is a source of its own. Null texts and those without words are never
    taken. Repeated rows are laid out each; rows with equal ids tie by their size.
    """
    return mixing.mixed_documents(docs)


def pack_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens.

    Null and empty texts are one piece, the end id alone. Repeated rows, and rows of null or equal
    ids, are packed each. Texts of over 4096 tokens are cut into pieces.
    """
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", dedup_exactly),
    ("MinHash near-dedup", dedup_nearly),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_best_fit),
]
#: Stages of Python code can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs)
            common.drop(before)
    return docs
