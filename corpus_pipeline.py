"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the stage before kept; its result
is written as Parquet to the shared folder and read again as the next one's docs. All stages but the last return
the columns of documents. No stage fails on nulls, empty texts, repeated rows or an empty table; texts are read whole,
however long; columns beyond those of documents are carried along under their own names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import op2_decontaminate, op4_rules, op5_secrets, op6_bpe, op9_jaccard
from foliant.llm.common import discard, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule and that the calibrated classifier keeps.

    A null or empty text has no words and goes. A probability of exactly the threshold is kept. Repeated rows are
    judged alike; an empty label table keeps all that fail no rule.
    """
    return op4_rules.clean(docs, op4_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id.

    A similarity of exactly the threshold is a copy. Of rows that share that doc_id and group one stays, by a hash of
    the text; repeated rows stay once; rows without words are in no group and stay.
    """
    return op9_jaccard.deduplicate(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; documents of which more than half is benchmark go, exactly half stays.

    Null and empty texts, and all texts if the benchmark is empty, stay as they are; repeated rows are treated alike.
    """
    return op2_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by a mark; overlapping secrets get one. Null and empty texts stay as they are."""
    return op5_secrets.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and the text that the ids decode to. Null counts as empty: no ids.

    Columns of documents that are called ids, decoded or n_tokens get the ending _before.
    """
    import public_tokenizers

    path = public_tokenizers.path(op6_bpe.VOCABULARY)
    own = {c: f"{c}_before" for c in docs.columns if c.lower() in ("ids", "decoded", "n_tokens")}
    docs = docs.withColumnsRenamed(own)
    df = op6_bpe.tokenized(docs, path)
    return df.select(*(F.col("decoded").alias("text") if c == "text" else c for c in docs.columns), F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secrets),
    ("BPE encoding and decoding", encoded),
]

#: The trained classifier of the first stage cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        discard(before)
    return docs
