"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import language_id, quality, spelling, toxicity, vector_codes
from .bpe import bpe_digests
from .common import fold, shared_dir
from .multi_index import search, usable
from .ogg import media_query
from .order_minhash import near_duplicates
from .packing import pack
from .token_counts import count_tokens
from .token_files import token_file_query
from .tokens import tokenizer_path
from .url_filters import QUERY_RULES, QUERY_SQL, SEEDS, counted, judge, path_of, reputation, seeded

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_query(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs.where(~fold())))
    return found.select("doc_id", fold().alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").where(~fold())))
    return found.select("doc_id", fold().alias("held_out"), "score", "predicted")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("vec_id % 100 = 0"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels of the document that a page carries (the number in its path), bad if toxic or of low
    quality; and a bad one for each page whose host's name holds a term of ``SEEDS``."""
    number = F.regexp_extract(path_of(F.col("url")), "^/[a-z]+/([0-9]+)", 1)
    pages = table(spark, sf_dir, "pages").withColumn("carried", F.nullif(number, F.lit("")))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("carried"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    counts = counted(pages, labels, "carried", seeded(F.col("host"), SEEDS))
    return judge(pages, reputation(counts), QUERY_RULES).drop("bound")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its cache is a new folder, so that a run counts every distinct text and its figures hold for a first run."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), shared_dir(spark, "count-cache"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_query(table(spark, sf_dir, "documents"))


def op13_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_query(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_files": op1_token_files,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_order_minhash": op3_order_minhash,
        "op4_quality_rules": op4_quality_rules,
        "op5_language_id": op5_language_id,
        "op6_toxicity": op6_toxicity,
        "op7_multi_index": op7_multi_index,
        "op8_url_filters": op8_url_filters,
        "op9_bpe": op9_bpe,
        "op10_token_counts": op10_token_counts,
        "op11_vector_codes": op11_vector_codes,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_ogg_media": op13_ogg_media,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filters": QUERY_SQL, "op11_vector_codes": vector_codes.oracle(vector_codes.CodeConfig(), 64), "op12_spelling_variants": spelling.oracle()}
