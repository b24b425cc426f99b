"""From timed words and speaker spans to utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"


def time_words(utterances: DataFrame) -> DataFrame:
    """Words with character-proportional times: (conversation_id, utterance_id, position, text, start_ms, end_ms).

    A word starts at its share of the characters before it, rounded halves up; computed in whole numbers.
    """
    words = F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0))
    u = utterances.withColumn("__words", words)
    total = F.aggregate("__words", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    # the total comes before the explosion: next to it, it would be summed anew for every word
    u = u.select("conversation_id", "utterance_id", F.col("start_ms").alias("a"), F.col("end_ms").alias("b"), total.alias("total"), "__words")
    u = u.select("conversation_id", "utterance_id", "a", "b", "total", F.posexplode("__words").alias("position", "text"))
    w = Window.partitionBy("conversation_id", "utterance_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("upto", F.sum(F.length("text")).over(w))
    at = lambda n: F.expr(f"a + (2 * (b - a) * {n} + total) DIV (2 * total)")
    return u.select("conversation_id", "utterance_id", "position", "text", at("(upto - length(text))").alias("start_ms"), at("upto").alias("end_ms"))


def label_words(words: DataFrame, segments: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """Words with the speaker of the first segment (by start) that holds their midpoint, else "unknown".

    A range join made an equi-join: the segments that touch a time bucket are one sorted list, and a word looks into that
    of its midpoint, so a word is shuffled once and stays one row. Times are doubled so that midpoints are whole numbers.
    """
    w = words.withColumn("__mid", F.col("start_ms") + F.col("end_ms")).withColumn("__b", F.floor(F.col("__mid") / (2 * bucket_ms)))
    s = segments.where("end_ms > start_ms AND speaker IS NOT NULL").select(F.col("conversation_id").alias("__c"), F.struct(F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1"), "speaker").alias("s"))
    s = s.withColumn("__at", F.explode(F.sequence(F.floor(F.col("s.s0") / bucket_ms), F.floor((F.col("s.s1") - 1) / bucket_ms))))
    s = s.groupBy("__c", "__at").agg(F.array_sort(F.collect_list("s")).alias("__spans"))
    met = w.join(s, (F.col("conversation_id") == F.col("__c")) & (F.col("__b") == F.col("__at")), "left")
    hits = F.filter("__spans", lambda x: (F.col("__mid") >= 2 * x["s0"]) & (F.col("__mid") < 2 * x["s1"]))
    return met.select(*words.columns, F.coalesce(F.get(hits, F.lit(0))["speaker"], F.lit(UNKNOWN)).alias("speaker"))


def resolve_alias(rows: DataFrame, aliases: DataFrame, column: str = "speaker") -> DataFrame:
    """Provider label to cluster by aliases(conversation_id, label, cluster_id); a label without one stands for itself."""
    a = aliases.select(F.col("conversation_id").alias("__c"), F.col("label").alias("__l"), F.col("cluster_id").alias("__id"))
    return rows.join(a, (rows["conversation_id"] == F.col("__c")) & (rows[column] == F.col("__l")), "left").withColumn(column, F.coalesce("__id", column)).drop("__c", "__l", "__id")


def assemble(words: DataFrame) -> DataFrame:
    """Utterances: maximal runs of consecutive words of one speaker, in the order of start times."""
    order = ["start_ms", "utterance_id", "position"]
    w = Window.partitionBy("conversation_id").orderBy(*order)
    change = F.when(F.lag("speaker").over(w).eqNullSafe(F.col("speaker")), 0).otherwise(1)
    runs = words.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(*order, "text"))), lambda x: x["text"])
    return runs.groupBy("conversation_id", "run", "speaker").agg(F.array_join(texts, " ").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def finalized(utterances: DataFrame, cutoff_ms) -> DataFrame:
    """Utterances that end by the cutoff (the clock minus a holdback)."""
    return utterances.where(F.col("end_ms") <= cutoff_ms)


def speech_per_speaker(segments: DataFrame) -> DataFrame:
    return segments.groupBy("conversation_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))


def speakers_over(segments: DataFrame, floor_ms: int, ranked: bool = False) -> DataFrame:
    """Speakers with at least so much speech; ``ranked``: most first within a conversation."""
    over = speech_per_speaker(segments).where(F.col("speech_ms") >= floor_ms)
    return over.orderBy("conversation_id", F.col("speech_ms").desc(), "speaker") if ranked else over


def unassigned_turns(segments: DataFrame, aliases: DataFrame) -> DataFrame:
    """First segment of each label without an alias, by start."""
    a = aliases.select(F.col("conversation_id").alias("__c"), F.col("label").alias("__l"))
    free = segments.join(a, (segments["conversation_id"] == F.col("__c")) & (segments["speaker"] == F.col("__l")), "left_anti")
    w = Window.partitionBy("conversation_id", "speaker").orderBy("start_ms", "end_ms")
    return free.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def lookback(utterances: DataFrame, turns: int = 8) -> DataFrame:
    """Each utterance with the texts of the last ``turns`` through itself."""
    w = Window.partitionBy("conversation_id").orderBy("start_ms", "utterance_id").rowsBetween(1 - turns, 0)
    return utterances.withColumn("window_texts", F.collect_list("text").over(w))


def every_nth(utterances: DataFrame, n: int = 25) -> DataFrame:
    """Utterances at which a pass over the whole conversation is due: each n-th final one."""
    w = Window.partitionBy("conversation_id").orderBy("start_ms", "utterance_id")
    return utterances.where("is_final").withColumn("number", F.row_number().over(w)).where(F.col("number") % n == 0)


def header_runs(utterances: DataFrame) -> DataFrame:
    """header: whether a speaker heading stands before the line (first, unknown person, or another person); run: its number."""
    w = Window.partitionBy("conversation_id").orderBy("start_ms", "utterance_id")
    person, previous = F.col("person_id"), F.lag("person_id").over(w)
    header = (F.row_number().over(w) == 1) | person.isNull() | ~previous.eqNullSafe(person)
    marked = utterances.withColumn("header", header)
    return marked.withColumn("run", F.sum(F.col("header").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def clamp_turns(turns: DataFrame) -> DataFrame:
    """Turns that don't start before an earlier one has ended, at least 1 ms long; in the order of ``turn``."""
    w = Window.partitionBy("conversation_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest("start_ms", F.coalesce(F.max("end_ms").over(w), F.col("start_ms")))
    return turns.withColumn("start_ms", start).withColumn("end_ms", F.greatest("end_ms", F.col("start_ms") + 1))


def revise_words(words: DataFrame) -> DataFrame:
    """Words that stand after all revisions (column ``rev``): a turn's last revision replaces it whole; an untagged word its start time's."""
    last = F.max("rev").over(Window.partitionBy("conversation_id", "turn"))
    newest = F.row_number().over(Window.partitionBy("conversation_id", "start_ms").orderBy(F.col("rev").desc(), F.col("position").desc()))
    tagged = words.where(F.col("turn").isNotNull()).withColumn("last", last).where("rev = last").drop("last")
    return tagged.unionByName(words.where(F.col("turn").isNull()).withColumn("n", newest).where("n = 1").drop("n"))


def subtract_overlaps(segments: DataFrame, bucket_ms: int = 10_000) -> DataFrame:
    """Segments (in the order of ``seq``) after each one has carved its span out of the earlier ones.

    What remains of a segment is where it is the last of those that cover a point: between neighbouring end points of the conversation the largest
    covering seq wins, and neighbouring pieces of one segment are joined. Pieces meet segments by an equi-join on time buckets,
    so a conversation's length is spread over tasks. Segments that end where they start leave nothing and carve nothing.
    """
    real = segments.where("end_ms > start_ms").select("conversation_id", "seq", "speaker", "start_ms", "end_ms")
    points = real.select("conversation_id", F.explode(F.array("start_ms", "end_ms")).alias("p")).distinct()
    pieces = points.withColumn("q", F.lead("p").over(Window.partitionBy("conversation_id").orderBy("p"))).where("q IS NOT NULL").withColumn("bucket", F.floor(F.col("p") / bucket_ms))
    spread = real.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor((F.col("end_ms") - 1) / bucket_ms))))
    met = pieces.join(spread, ["conversation_id", "bucket"]).where("p >= start_ms AND p < end_ms")
    won = met.groupBy("conversation_id", "p", "q").agg(F.max(F.struct("seq", "speaker")).alias("s")).select("conversation_id", "p", "q", "s.*")
    mine = Window.partitionBy("conversation_id", "seq", "speaker").orderBy("p")
    runs = won.withColumn("new", F.coalesce((F.lag("q").over(mine) != F.col("p")).cast("long"), F.lit(0))).withColumn("run", F.sum("new").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("conversation_id", "seq", "speaker", "run").agg(F.min("p").alias("start_ms"), F.max("q").alias("end_ms")).drop("run")
