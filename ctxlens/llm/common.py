"""Shared pieces of the corpus operators: words, shared folders, lineage cuts, splittable joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: The same six separators, for ``translate``.
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none (tests), a folder in the warehouse is used and also
    becomes Spark's checkpoint folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/ctxlens/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int) -> bool:
    """Whether a (materialised) table has at most ``rows`` rows; reads no more than needed."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast after counting; a larger table stays an ordinary, splittable join side."""
    return F.broadcast(df) if small(df, rows) else df


#: A key that holds more than one in so many rows of a join's side is met by broadcast, so at most so many keys are.
HOT_KEYS = 200


def split_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int, salt: list[str]) -> DataFrame:
    """``left`` left-joined to ``right`` (one row per key; ``weight``: how many rows of the left have it), without ``weight``.

    Keys that hold more than 1 / HOT_KEYS of the left's ``total`` rows are broadcast, HOT_KEYS of them at most. Their rows pass
    the ordinary join under keys of their own (of the columns ``salt``), so that no task gets them all. Keys must not be null.
    """
    values = [c for c in right.columns if c not in (*on, weight)]
    hot = right.where(F.col(weight) * HOT_KEYS > total).select(*[F.col(k).alias(f"__hot_{k}") for k in on], F.struct(F.lit(1).alias("__one"), *values).alias("__hot"))
    met = left.join(F.broadcast(hot), [F.col(k) == F.col(f"__hot_{k}") for k in on], "left").drop(*[f"__hot_{k}" for k in on])
    met = met.withColumn("__own", F.when(F.col("__hot").isNotNull(), F.xxhash64(*salt).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    rest = right.select(*on, F.struct(F.lit(1).alias("__one"), *values).alias("__cold"), F.lit(0).cast("long").alias("__own"))
    met = met.join(rest, [*on, "__own"], "left")
    return met.select(*left.columns, *[F.coalesce(F.col(f"__hot.{c}"), F.col(f"__cold.{c}")).alias(c) for c in values])


def map_text(df: DataFrame, make, fields: list, keep: list[str], text: str = "text", step: int = 256) -> DataFrame:
    """Rows of ``df`` with columns computed from whole texts in Arrow batches.

    ``make()`` runs once per task and gives a function from a list of texts (null as "") to a list
    of Python or Arrow columns, one for each of ``fields``. ``keep`` columns pass through; one that
    has a computed column's name is replaced by it.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    made = {f.name for f in fields}
    kept = [c for c in keep if c not in made]
    src = df.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType([src.schema[c] for c in kept] + list(fields))
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = schema.names

    def run(batches):
        f = make()
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                out = f(part.column(len(kept)).to_pylist())
                cols = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + cols, names)

    return src.mapInArrow(run, schema)
