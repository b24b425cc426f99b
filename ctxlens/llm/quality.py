"""Quality rules with adaptive thresholds (operator 9). DataFrame functions only.

Metrics are integers. Their distribution in each (language, source) is kept as a mergeable quantile
sketch: counts of log-linear buckets (a power of two in 16 steps, so any quantile is within 1/16 of
the true value). Buckets of two parts of the data merge by adding counts, which is what the
aggregation does on each side of its shuffle, so no group meets in one task. A group's sketch is merged with its
language's, scaled down to the weight of a few documents, so that a small group leans on the language and a
large one on itself, by one rule for all sizes. A group's cutoff is an outlier fence over the quantiles of that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, cut

SYMBOLS = "[#*$%&|<>]"
CAPITALS = "[A-Z]"
#: Metrics with adaptive cutoffs, and the least spread of each: what counts as one step where the quartiles are equal.
#: symbol_rate and upper_rate: symbols and ASCII capitals in 1000 characters of words;
#: word_len: mean word length in hundredths of a character; dup_line_rate: in 1000 lines.
STEPS = {"symbol_rate": 5, "upper_rate": 2, "word_len": 5, "dup_line_rate": 40}
#: What every text is taken to hold besides its own, so that short ones need more evidence: characters, words of five, lines.
PRIOR_CHARS, PRIOR_WORDS, PRIOR_LINES = 100, 10, 4


@dataclass(frozen=True)
class Rules:
    """min_words and max_repeat_percent are the base rule. A cutoff is hi + spread * max(hi - lo, step of the metric).

    lo, hi: percentages of the quantiles; prior: weight, in documents, of the language's sketch in that of a group.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    lo: int = 25
    hi: int = 75
    spread: int = 6
    prior: int = 50


def _barrier(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns that are computed once per row, however often lambdas refer to them.

    The optimizer would inline a plain projection into a lambda and compute it for every element;
    it doesn't merge projections across a generator.
    """
    one = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select("*", F.inline(one))


def light_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds __words, n_words, word_chars, n_symbols, n_upper, n_lines (with a word), n_dup_lines; null text: none."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = _barrier(docs, __words=F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), __lines=F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    df = _barrier(
        df,
        n_words=F.size("__words").cast("long"),
        word_chars=F.length(F.array_join("__words", "")).cast("long"),
        n_symbols=F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
        n_upper=F.regexp_count(t, F.lit(CAPITALS)).cast("long"),
        n_lines=F.size("__lines").cast("long"),
        n_dup_lines=(F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    )
    return df.drop("__lines")


def repeat_words(df: DataFrame, width: int = 5) -> DataFrame:
    """Replaces __words by n_repeat_words: words in ``width``-word windows found twice or more in the text.

    Window starts are sorted by (hash of the window, start); equal neighbours are repeats; the union
    of the flagged windows is the sum of their steps. Texts whose windows all differ stop early.
    """
    df = _barrier(df, __word=F.transform("__words", lambda x: F.xxhash64(x)))
    n = F.size("__word") - (width - 1)
    at = lambda i, k: F.get(F.col("__word"), i + k)
    starts = F.when(n > 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    df = _barrier(df, __hash=F.transform(starts, lambda i: F.xxhash64(*[at(i, k) for k in range(width)])))
    repeats = F.size("__hash") > F.size(F.array_distinct("__hash"))
    pairs = F.array_sort(F.transform("__hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = _barrier(df, __pairs=F.when(repeats, pairs))
    near = F.zip_with("__pairs", F.slice("__pairs", F.lit(2), F.greatest(F.size("__pairs") - 1, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = _barrier(df, __starts=F.when(F.col("__pairs").isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.filter(near, lambda x: x.isNotNull()))))))
    steps = F.zip_with("__starts", F.slice("__starts", F.lit(2), F.greatest(F.size("__starts") - 1, F.lit(0))), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("__starts").isNotNull(), total), F.lit(0)).cast("long")).drop("__words", "__word", "__hash", "__pairs", "__starts")


def _rates() -> dict[str, Column]:
    return {
        "symbol_rate": F.expr(f"n_symbols * 1000 DIV (word_chars + {PRIOR_CHARS})"),
        "upper_rate": F.expr(f"n_upper * 1000 DIV (word_chars + {PRIOR_CHARS})"),
        "word_len": F.expr(f"(word_chars + {5 * PRIOR_WORDS}) * 100 DIV (n_words + {PRIOR_WORDS})"),
        "dup_line_rate": F.expr(f"n_dup_lines * 1000 DIV (n_lines + {PRIOR_LINES})"),
    }


def _top(value: Column) -> Column:
    """Upper end of a value's bucket: the value itself below 16, else rounded up within its 1/16 step."""
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift) + 1, shift) - 1


def sketch(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Bucket counts for each key and metric: (keys, metric, bucket, n). Two sketches merge by summing n."""
    long = metrics.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _top(F.col(m)).alias("bucket")) for m in names])).alias("m"))
    return long.select(*keys, "m.*").groupBy(*keys, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sk: DataFrame, keys: list[str], percents: dict[str, int]) -> DataFrame:
    """Quantiles of merged sketches: the first bucket whose running count reaches that share of the total."""
    w = Window.partitionBy(*keys, "metric")
    run = sk.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    pick = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket"))).alias(name) for name, q in percents.items()]
    return run.groupBy(*keys, "metric").agg(*pick)


def leaning(fine: DataFrame, lang: str, source: str, prior: int) -> DataFrame:
    """Sketches of (language, source) merged with their language's at the weight of ``prior`` documents.

    Counts are whole numbers: the group's times the language's total, plus ``prior`` times the language's.
    """
    long = F.col("n").cast("decimal(20,0)")
    coarse = fine.groupBy(lang, "metric", "bucket").agg(F.sum("n").alias("__of_lang"))
    coarse = coarse.withColumn("__total", F.sum("__of_lang").over(Window.partitionBy(lang, "metric")))
    groups = fine.select(lang, source).distinct()
    wide = groups.select(F.col(lang).alias("__lang"), source).join(coarse, F.col("__lang").eqNullSafe(F.col(lang))).drop("__lang")
    own = fine.select(F.col(lang).alias("__l"), F.col(source).alias("__s"), F.col("metric").alias("__m"), F.col("bucket").alias("__b"), long.alias("__n"))
    same = F.col(lang).eqNullSafe(F.col("__l")) & F.col(source).eqNullSafe(F.col("__s")) & (F.col("metric") == F.col("__m")) & (F.col("bucket") == F.col("__b"))
    n = F.coalesce("__n", F.lit(0).cast("decimal(20,0)")) * F.col("__total") + F.lit(prior) * F.col("__of_lang")
    return wide.join(own, same, "left").select(lang, source, "metric", "bucket", n.cast("decimal(38,0)").alias("n"))


def thresholds(metrics: DataFrame, rules: Rules, keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Cutoff of each metric for each (language, source), wide: cut_<metric>.

    The tables here have one row per group, metric and bucket of the language.
    """
    lang, source = keys
    fine = cut(sketch(metrics, [lang, source], list(STEPS)))
    own = quantiles(leaning(fine, lang, source, rules.prior), [lang, source], {"lo": rules.lo, "hi": rules.hi})
    fence = lambda step: (F.col("hi") + rules.spread * F.greatest(F.col("hi") - F.col("lo"), F.lit(step).cast("long"))).cast("long")
    return own.groupBy(lang, source).agg(*[F.max(F.when(F.col("metric") == m, fence(step))).alias(f"cut_{m}") for m, step in STEPS.items()])


def measure(docs: DataFrame, text: str = "text", repeats: bool = True) -> DataFrame:
    """``docs`` with all metrics and rates; columns of ``docs`` that have a computed name are replaced."""
    docs = docs.drop(*[c for c in MADE if c in docs.columns])
    df = light_metrics(docs, text)
    df = repeat_words(df) if repeats else df.drop("__words")
    return df.select("*", *[c.alias(n) for n, c in _rates().items()])


MADE = ["n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *STEPS, *[f"cut_{m}" for m in STEPS]]


def verdicts(measured: DataFrame, cuts: DataFrame, rules: Rules = Rules(), keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``measured`` with base_failed and kept, joined to the cutoffs of its (language, source)."""
    cuts = cuts.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], *[f"cut_{m}" for m in STEPS])
    joined = measured.join(broadcast_if_small(cuts), F.col(keys[0]).eqNullSafe(F.col("__0")) & F.col(keys[1]).eqNullSafe(F.col("__1")), "left")
    base = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    fine = F.lit(True)
    for m in STEPS:
        fine = fine & (F.col(m) <= F.col(f"cut_{m}"))
    return joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & fine).drop("__0", "__1")


def kept_rows(docs: DataFrame, rules: Rules = Rules(), text: str = "text", keys: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, every column as it was, whatever its name."""
    apart = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("of_row"), F.col(keys[0]).alias("of_lang"), F.col(keys[1]).alias("of_source"), F.col(text).alias("of_text"))
    return judge(apart, rules, "of_text", ("of_lang", "of_source")).where("kept").select("of_row.*")


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text", keys: tuple[str, str] = ("lang", "source"), columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or only ``columns`` of it) with the metrics, cutoffs, base_failed and kept.

    Without the text among ``columns`` every text is measured once and the metrics are kept in the shared
    folder; with it, a first pass takes the light metrics for the sketches and a second one measures
    and filters, so that texts are neither shuffled nor written.

    Nulls: a null text has no words (base_failed); null language or source is a group of its own.
    Columns of ``docs`` that have a computed name are replaced. Ties and repeated rows are judged alike.
    """
    columns = [c for c in (columns or docs.columns) if c not in MADE]
    if text in columns:
        light = measure(docs.select(*keys, text), text, repeats=False)
        measured = measure(docs.select(*columns), text)
    else:
        own = list(dict.fromkeys([*columns, *keys, text]))
        light = measured = cut(measure(docs.select(*own), text).drop(text))
    return verdicts(measured, cut(thresholds(light, rules, keys)), rules, keys)
