"""The corpus pipeline: quality, language, near-duplicates, benchmark passages, tokens.

``run`` applies the stages to ``documents``; each stage's result is written as Parquet to the shared
folder of ``spark.checkpoint.dir`` and read again as the next one's documents.  Every stage takes rows as
they are: nulls in any column, repeated ids and rows, further columns, an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetable.llm import byte_bpe, decontaminate, language_id, near_dedup, quality
from kinetable.llm.graph import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS = 5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the quality threshold learned from all labels.

    Null and empty texts are scored like any other; repeated rows stay or go together; without labels of both
    kinds all stay but where all labels are bad.
    """
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.flag(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters; ``lang`` becomes the language found, where none was given.

    Where no document has a ``lang`` to learn from, it stays null.  Null and empty texts go; repeated rows
    stay or go together.
    """
    samples = language_id.learn(docs)
    found = language_id.flag(docs.select(*COLUMNS), samples or [("", "")])  # one language without a text: all that has letters
    name = F.col("lang_pred") if samples else F.lit(None).cast("string")
    return found.where("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", name)).select(*COLUMNS)


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that shares 80 % of its five-word shingles.

    Rows that repeat an id or have none are documents of their own: of their copies, too, one row stays.  Null and
    wordless texts are copies of nothing and stay; an empty table gives none.
    """
    return near_dedup.deduplicated(docs.select(*COLUMNS), width=SHINGLE_WORDS)


def decontaminate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; each row goes by its own text, whatever its id.

    Null and wordless texts hold no passage and stay; without items all stay; an empty table gives none.
    """
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, and digests of the ids and of the bytes they decode to; a null text has no ids.

    Rows that repeat an id or all columns are rows of the result each; an empty table gives none.
    """
    import public_tokenizers

    done = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids"
    )


STAGES = [
    ("quality classifier", quality_filter),
    ("language ID", language_filter),
    ("MinHash near-dedup", near_dedup_filter),
    ("benchmark decontamination", decontaminate_filter),
    ("byte-level BPE", tokenize),
]

#: Learned models and token merges have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; a stage's files go once the next one's are written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs
