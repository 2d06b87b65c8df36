"""A corpus pipeline of five operators: quality, line dedup, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
it kept; its result is written as Parquet and read again as the next one's docs.

Edge cases, in every stage: an empty table gives an empty table; columns that
documents doesn't have are left out; texts of any length are taken whole; a row
without id is judged by its text as any other, and stays unless the classifier rejects
it or a copy with an id is kept. A null or empty text is scored from its statistics
(rejected, as a rule); if kept, it has no lines and no personal data, has no near
duplicate but a row of the same id, and is packed as its end id. Rows that repeat an
id and a text count as near duplicates, one of which stays; rows that share an id with
different texts all stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import jaccard_join, line_dedup, packing, pii, quality_classifier
from parlance.llm.common import cut, held, prepare, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars by the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    prepare(spark)
    return quality_classifier.keep(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; a document of nothing else goes with them."""
    prepare(spark)
    reduced = line_dedup.dedup(docs.select(*COLUMNS))
    return _documents(reduced.where(F.col("doomed").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest id stays.

    Rows are numbered first, so that those without an id or with a repeated one
    take part as others do: a row without id stays unless a row with one, or an
    earlier numbered row without, is similar to it; of similar rows with one id
    one stays, as of wordless ones.
    """
    prepare(spark)
    rows = cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    groups = jaccard_join.groups(rows.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    groups = groups.join(rows.select("row", "doc_id"), "row").withColumn("wordless", F.expr("n_shingles = 0 AND doc_id IS NOT NULL"))
    groups = groups.groupBy("wordless", F.expr("CASE WHEN wordless THEN doc_id ELSE component_id END"))
    first = groups.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("first.row")
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    prepare(spark)
    return _documents(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("pii", personal_data), ("packing", packed)]

#: Trained scores, alignments and packing plans have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        # a stage's tables go when its result is written, and that when the next one is
        with held(*done) as stay:
            docs = cut(stage(spark, docs, sf_dir))
            stay.append(docs)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
