"""A corpus pipeline: language ID, SimHash near-dedup, personal data, mixing, byte-level BPE.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents; each works on all that the one before it kept, and begins with a driver that holds nothing of the stages before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setcast.llm import bpe, langid, mixing, pii, simhash
from setcast.llm.common import collected, left, names, release, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Words that the last stage folds beforehand: fewer than the operator's own, for the driver's memory after four other stages. They bear on speed alone.
COMMON_WORDS = 1 << 17


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told stay, lang becomes the language found; null texts and those without a letter go.

    All other columns stay, whatever their names. Repeated rows are judged alike, texts of any length whole; ties go as langid.Model says;
    an empty table stays empty, and with nothing to learn from every document is undetermined and goes.
    """
    collected(spark)
    found = langid.predictions(docs, langid.learned(docs)).where("found.lang_pred <> 'und'")
    return found.select(*((F.col("found.lang_pred") if c == "lang" else F.col("row")[c]).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id, among several of one id that with the smallest hash of its columns.

    Documents without an id belong to groups like any other, behind those with one; null and wordless texts form a group. An empty table stays empty.
    """
    collected(spark)
    return simhash.survivors(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; no document goes. Null and empty texts stay as they are, overlapping spans are replaced by
    the first's kind, repeated rows alike; texts of any length are searched whole; an empty table stays empty."""
    collected(spark)
    return pii.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, those taken twice in two rows.

    Null and empty texts have nothing to take and go; a null source is one of its own; repeated rows and ids are documents of their own;
    an empty table stays empty. Reruns agree.
    """
    collected(spark)
    return mixing.mixed_texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids, their number, and the digests of ids and decoded bytes.

    Null and empty texts have no ids; texts and words of any length are encoded whole, repeated rows alike; other columns are left out; an empty
    table gives no rows.
    """
    collected(spark)
    tokenizer = bpe.Tokenizer().learn(docs, words=COMMON_WORDS)
    rows = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), tokenizer, digests=True)
    return rows.select("doc_id", "lang", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("mixing to target weights", mixture),
    ("byte-level BPE", tokens),
]

#: The stages' rows are beyond SQL: fitted models, XXH64 fingerprints and ranked merges. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again, but for the last. Once a stage's rows are written, its
    working tables and its docs are deleted; tables of other results are left alone. What the result reads stays: the caller may delete it by
    setcast.llm.common.release(). A stage that is called by itself deletes nothing that its result reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = left() - names(docs)
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
        release(spark, left() - before, reading=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
