"""The registered query of each operator: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import oracle_sql as chat_sql
from .decontaminate import SQL as DECONTAMINATE_SQL
from .kd_cluster import oracle_sql as cluster_sql
from .near_dedup import SQL as NEAR_DEDUP_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_chats

    return format_chats(_table(spark, sf_dir, "conversations"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import round_trip

    done = round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def _held_out(modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    done = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "contaminated", F.size("item_ids").cast("long").alias("n_items"), F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = score(docs, docs.where(~_held_out(10, 0)))
    return done.select("doc_id", _held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import learn, score

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~_held_out(3, 1)))
    return score(docs, model).select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, score

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(~_held_out(3, 1)))
    return score(docs, model).select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op8_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import pack

    done = pack(_table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("%dx%d:%s", "width", "height", "thumbnail_hash").alias("feature"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, learn

    docs = _table(spark, sf_dir, "documents")
    samples = learn(docs.where(~_held_out(5, 0)))
    return identify(docs, samples).select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import periodic_runs

    return periodic_runs(_table(spark, sf_dir, "documents"), loop=True)


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_cluster import clusters

    return clusters(_table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_chat_format": op1_chat_format, "op4_decontaminate": op4_decontaminate, "op7_html_extract": op7_html_extract, "op5_language_model": op5_language_model, "op6_quality": op6_quality, "op9_toxicity": op9_toxicity, "op8_media_jpeg": op8_media_jpeg, "op10_language_id": op10_language_id, "op2_byte_bpe": op2_byte_bpe, "op3_near_dedup": op3_near_dedup, "op11_periodic_runs": op11_periodic_runs, "op12_simhash_dedup": op12_simhash_dedup, "op13_centroid_clusters": op13_centroid_clusters}
ORACLE_SQL: dict[str, str] = {"op1_chat_format": chat_sql(), "op3_near_dedup": NEAR_DEDUP_SQL, "op4_decontaminate": DECONTAMINATE_SQL, "op13_centroid_clusters": cluster_sql()}
