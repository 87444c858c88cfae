"""Token counts through a digest cache.

A count is stored under the digest of the content as the tokenizer normalises it and the digest of the
tokenizer's own file. Documents join the stored counts by digest; only distinct contents that miss are
encoded, and their counts are appended. The piece model's normaliser leaves texts as they are (it only puts a
space mark in front), so the digest is over the text itself.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from listenlake.llm import _text as T, _vocab as V
from listenlake.runtime import materialize, scratch_path, ship_package

_CACHE = "digest string, version string, n_tokens long"


def _count(path: str):
    def run(batches):
        for b in T.pieces(batches, limit=V.BATCH_BYTES):
            texts = b.column(1)
            n = V.piece_counts(texts, path) if path.endswith(".model") else V.byte_bpe_ids(texts, path)[1]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of each row's whole text.

    ``tokenizer`` is a .json file of byte-level BPE for the tokenizers library or a .model file for sentencepiece.
    ``cache`` is the folder of the cache table; without one a new, empty cache is made in the shared folder.
    Null text counts as empty: no bytes, no tokens. Repeated rows are counted each; null ids stay null; other
    columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship_package(spark)
    version = hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()
    cache = cache or scratch_path(spark, "token-count-cache")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    try:
        stored = spark.read.schema(_CACHE).parquet(cache).where(F.col("version") == version).select("digest")
    except AnalysisException:  # no cache yet
        missing = rows.select("digest", "text")
    else:
        missing = rows.select("digest", "text").join(stored, "digest", "left_anti")
    fresh = missing.dropDuplicates(["digest"]).mapInArrow(_count(tokenizer), "digest string, n_tokens long")
    fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(_CACHE).parquet(cache).where(F.col("version") == version).select("digest", "n_tokens")
    counts = materialize(counts.dropDuplicates(["digest"]), "token-counts")  # written, so that a hot digest's rows can be split in the join
    return rows.drop("text").join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
