"""A training corpus from the documents table: rejects, near copies, personal data, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``; all but the last return the columns of ``documents``. Every stage works on all rows that its
predecessor kept. An empty table passes all stages as an empty one. Texts are read whole, however long; columns other
than ``doc_id``, ``text`` and ``source`` pass through whatever they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartlake.llm.bpe import encode
from chartlake.llm.common import stored
from chartlake.llm.mixing import mix_sources
from chartlake.llm.near_dedup import keep_one_of_each
from chartlake.llm.pii import redact
from chartlake.llm.quality import keep_good
from chartlake.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject.

    A null text counts as an empty one; both have a score like any text, and so do repeated rows, one by one. Null ids are
    never among the labelled rows that the rules are learnt from. A score equal to the threshold is not rejected."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id.

    Documents without words (null, empty, white space) all stay. A null id comes after all others; of rows alike in id and
    words one stays, also where they differ elsewhere."""
    return keep_one_of_each(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks.

    Null and empty texts stay as they are; repeated rows are treated alike; of overlapping spans the first one, the longer
    of two that start together, gives the mark."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it was drawn (0, 1 or 2 times).

    A null source is one source, the last; a null or empty text has no words, so it is kept by the certain whole copies of
    its source only. Rows alike in id and text are drawn together."""
    mixed = mix_sources(docs).filter("_mix.copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_mix.copies").cast("int")))).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with hashes of ids and decoded text.

    A null or empty text has no tokens and the hashes of the empty string; each copy of a document is a row."""
    return encode(docs, keep=("doc_id", "source"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("bpe", bpe)]

#: The stages use hashes, learnt rules and a vocabulary that DuckDB SQL does not express; see tests/llm for brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
