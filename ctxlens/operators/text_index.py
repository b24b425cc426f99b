"""A persisted inverted index: postings by bucket of the term, with lengths and document frequencies, searched by BM25 and added to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

#: Postings of one bucket and version are dealt over so many files by document, so that a term of every document isn't one task's.
SPREAD = 8
#: Up to so many wanted (query, term) rows are broadcast to the postings.
WANTED = 100_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


class TextIndex:
    """Under ``folder``, by version: ``postings`` (bucket, term, doc_id, tf, n), ``terms`` (bucket, term, df), ``totals`` (docs, length)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, doc_id: str, text: Column, version: int = 0) -> None:
        """Indexes documents as one version; adding a version again replaces it. Null texts have no terms but count as documents. Ids must be new."""
        src = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.coalesce(text, F.lit(""))).alias("t"))
        counted = src.select("doc_id", F.size("t").cast("long").alias("n"), F.explode("t").alias("term")).groupBy("doc_id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
        counted = counted.withColumn("bucket", self._bucket(F.col("term")))
        at = f"version={version}"
        dealt = counted.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/postings/{at}")
        stored = self.spark.read.parquet(f"{self.folder}/postings/{at}")
        stored.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/terms/{at}")
        # counts add up to the length, so texts are read and split once
        length = stored.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("length"))
        docs.agg(F.count(F.lit(1)).alias("docs")).crossJoin(length).write.mode("overwrite").parquet(f"{self.folder}/totals/{at}")

    def _of(self, name: str, buckets: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}").where(F.col("bucket").isin(buckets))

    def search(self, queries: DataFrame, limit: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query_id, doc_id, score) of documents that hold a term of a query, from (query_id, text); the first ``limit`` with their rank, ties to the
        smaller id. Only the wanted terms' buckets are read. A term counts once in a query; scores are to twelve digits.
        """
        wanted = settle(queries.select("query_id", F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term")).withColumn("bucket", self._bucket(F.col("term"))))
        buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # self.buckets at most
        few = wanted.limit(WANTED + 1).count() <= WANTED
        near = F.broadcast if few else (lambda df: df)
        total = self.spark.read.parquet(f"{self.folder}/totals").agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).first()
        docs, mean = total.docs or 0, (total.length or 0) / (total.docs or 1) or 1.0
        df = self._of("terms", buckets).join(near(wanted.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.log1p((F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = wanted.select("query_id", "term").join(df, "term").select("query_id", "term", idf.alias("idf"))
        hits = self._of("postings", buckets).select("term", "doc_id", "tf", "n").join(near(asked), "term")
        tf = F.col("tf")
        part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.lit(float(mean))))
        scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 12).alias("score"))
        if limit is None:
            return scored
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id"))), 1, limit)
        # two levels, so that a common term's documents don't meet in one task
        part_of = scored.groupBy("query_id", F.pmod(F.xxhash64("doc_id"), F.lit(256)).alias("slot")).agg(best.alias("b")).select("query_id", F.inline("b"))
        out = part_of.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "doc_id"))), 1, limit).alias("b"))
        return out.select("query_id", F.posexplode("b").alias("i", "r")).select("query_id", F.col("r.doc_id").alias("doc_id"), (-F.col("r.s")).alias("score"), (F.col("i") + 1).alias("rank"))
