"""Token counts through a digest cache (operator 3).

A count is a function of the content and the tokenizer's version. The distinct digests of the content join the counts stored
for that version; only those that are missing are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import file_digest, json_encoder
from .common import broadcast_if_small, cut, fresh_dir, map_text, small, split_join

CACHE = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file, the library's release and the options that change counts."""
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    return file_digest(path, lib.__name__, lib.__version__, "no added tokens; special strings as the library's default")


def _counter(path: str):
    """Function from texts to token counts."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    enc = json_encoder(path)
    return lambda texts: [len(b) // 4 for b in enc.encode(texts)]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def read_cache(spark: SparkSession, cache_dir: str, version: str) -> DataFrame:
    """(digest, n_tokens) stored for one tokenizer version, whose folder alone is read."""
    if not _exists(spark, f"{cache_dir}/{version}"):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(f"{cache_dir}/{version}/*")


def count_tokens(docs: DataFrame, path: str, cache_dir: str | None = None, keep: list[str] | None = None, limit: int = 1024, text: str = "text") -> DataFrame:
    """``keep`` columns (default: all but the text) with n_bytes, n_tokens, over_limit (n_tokens > limit) and cached.

    cached: the count was stored before this call. Normalisation only maps null to the empty text: anything else would change
    counts. Columns to keep that have a computed name are replaced. Rows that are repeated come back as often; an empty
    table gives no rows. ``cache_dir`` None: a fresh cache in the shared folder.

    Scale: digests are counted and joined to the cache without texts; of the cache only the wanted digests go on. The texts of
    missing digests are moved once, after their copies have collapsed on the map side (where few are missing, only
    those texts). Counts are written to the cache by the time this returns. A digest of many rows is split in
    the last join. Two runs that append the same digest store it twice; it counts once.
    """
    spark = docs.sparkSession
    version = tokenizer_version(path)
    cache_dir = cache_dir or fresh_dir(spark, "token-counts")
    made = {"n_bytes", "n_tokens", "over_limit", "cached"}
    keep = [c for c in (keep or [c for c in docs.columns if c != text]) if c not in made]
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))

    wanted = cut(docs.select(digest.alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("rows")))
    stored = read_cache(spark, cache_dir, version).join(wanted.select("digest"), "digest", "left_semi")
    hits = cut(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    missing = cut(wanted.join(hits, "digest", "left_anti").select("digest"))

    def make():
        count = _counter(path)
        return lambda texts: [count(texts)]

    counts = hits.select("digest", "n_tokens", F.lit(True).alias("cached"))
    if not small(missing, 0):
        texts = docs.select(digest.alias("digest"), content.alias("text"))
        few = small(missing, 100_000)
        texts = texts.join(broadcast_if_small(missing), "digest", "left_semi") if few else texts
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        texts = texts if few else texts.join(missing, "digest", "left_semi")
        run = f"{cache_dir}/{version}/run={uuid.uuid4().hex}"
        map_text(texts, make, [T.StructField("n_tokens", T.LongType())], ["digest"]).select("digest", "n_tokens").write.parquet(run)
        counts = counts.unionByName(spark.read.schema(CACHE).parquet(run).select("digest", "n_tokens", F.lit(False).alias("cached")))
    counts = counts.join(wanted, "digest").withColumnRenamed("digest", "__digest")
    total = wanted.agg(F.sum("rows")).first()[0] or 0
    sized = docs.select(*keep, digest.alias("__digest"), F.octet_length(content).cast("long").alias("n_bytes"))
    sized = split_join(sized, counts, ["__digest"], "rows", total, [*keep, "n_bytes"] if keep else ["n_bytes"])
    return sized.select(*keep, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached")
