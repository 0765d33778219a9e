"""A cleaning pipeline over `documents`: language ID, line dedup, n-gram Jaccard join, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, the last one their tokens. Between stages
the documents are written as Parquet and read again, in a folder under spark.checkpoint.dir; a stage's table goes once the next
one is written, the last when the driver's process ends. Empty tables, repeated rows and null values pass every stage; other
columns than those of documents are left out.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwell.llm import shared

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars that of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) or that cost too many bits a byte under every learned language; every other row stays, whatever its doc_id."""
    from seqwell.llm.langid import fit, identify

    return identify(docs, fit(docs)).where("accepted").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that are boilerplate of their source; every row stays."""
    from seqwell.llm.line_dedup import site_line_dedup

    return _measured(site_line_dedup(docs))


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with _row, a string that tells its rows apart whenever they are read: file and place in it. Rows that are not read from files are written first."""
    try:
        return docs.select(*COLUMNS, F.concat_ws(":", "_metadata.file_path", "_metadata.row_index").alias("_row"))
    except AnalysisException:
        return _keyed(shared.written(docs.select(*COLUMNS)))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest doc_id, null last; of several the first by a hash of what they hold, then by row.

    Every row is a document of its own, also with a null or repeated doc_id."""
    from seqwell.llm.ngram_join import components

    rows = _keyed(docs)
    group = components(rows, key="_row").select(F.col("doc_id").alias("_row"), "component_id")
    rank = F.struct(F.isnull("doc_id"), "doc_id", F.xxhash64("text", "lang", "source"), "_row")
    first = rows.select("_row", rank.alias("_rank")).join(group, "_row").groupBy("component_id").agg(F.min("_rank").alias("_first"))
    return rows.join(first.select("_first._row"), "_row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages, and drops documents that are mostly such passages; a null text stays null."""
    from seqwell.llm.decontaminate import decontaminated

    return _measured(decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("NOT over_limit"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it; a null text is the empty one."""
    from seqwell.llm.bpe import default_ranks, encode

    out = encode(docs.select("doc_id", "lang", "source", "text"), default_ranks(), decoded=True)
    same = F.sha2("decoded", 256) == F.sha2(F.coalesce("text", F.lit("")), 256)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", bpe),
]

#: Language models, connected components and BPE are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared.until_exit(spark, f"{shared.folder(spark)}/pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            shared.removed(spark, f"{folder}/{k - 1}")
    return docs
