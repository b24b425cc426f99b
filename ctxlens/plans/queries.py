"""Registered queries: every operator over the benchmark tables, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, numeric, text
from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..operators import changes, cluster, facts, identity, retrieval, scoring, segments, session as sessions, views, voice_activity
from ..engine import Memory
from ..session import fresh_folder, settle
from ..sources import audio, sinks
from ..sources.log_table import LogTable
from ..sources.tables import Bench, event_script, inject, lookup, read_table, read_transcript, released
from ..streaming import chains, live, reducer, streams
from .oracle import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "2024-01-15 12:00:00"


def query(sql: str | None = None, *needs: str):
    """Registers a plan over the benchmark tables; whole-number columns come out as long."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(Bench(spark, sf_dir))
            return df.select(*[F.col(c.name).cast("long").alias(c.name) if isinstance(c.dataType, T.IntegerType) else F.col(c.name) for c in df.schema])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = with_views(sql, *needs)
        return f

    return wrap


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def placed(df: DataFrame) -> DataFrame:
    """A sorted table with each row's place from 1 on, numbered within the sort's ranges and over their sizes, so that the order can be checked."""
    rows = settle(df.withColumn("__id", F.monotonically_increasing_id())).withColumns({"__part": F.shiftright("__id", 33), "__i": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return rows.join(F.broadcast(sizes), "__part").withColumn("place", F.col("__before") + F.col("__i") + 1).drop("__id", "__part", "__i", "__before")


def in_parts(b: Bench, name: str, parts: list[DataFrame], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream has put out over parts that come one after the other, each as one batch of any number of files; a restart lies between."""
    base = fresh_folder(b.spark, name)
    for i, rows in enumerate(parts):
        rows.write.parquet(f"{base}/in/{i}")
        stream = streams.replay(b.spark, f"{base}/in/*", rows.schema, files_per_trigger=(1 << 31) - 1)
        streams.append_to(make(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return b.spark.read.parquet(f"{base}/out")


# facts


@query("SELECT fact_id, person_id, attribute, claim, valid_from, superseded_by FROM facts", "facts")
def supersession(b):
    return b.facts().select("fact_id", "person_id", "attribute", "claim", "valid_from", "superseded_by")


@query("""SELECT person_id, slot, fact_id, claim, valid_from FROM (SELECT *, row_number() OVER (PARTITION BY person_id, slot ORDER BY valid_from DESC, fact_id DESC) AS n
    FROM (SELECT *, attribute AS slot FROM facts WHERE superseded_by IS NULL)) WHERE n = 1""", "facts")
def current_facts(b):
    return facts.current(b.facts()).select("person_id", "slot", "fact_id", "claim", "valid_from")


@query("SELECT fact_id, superseded_by, superseded_at FROM facts WHERE superseded_by IS NOT NULL", "facts")
def superseded_facts(b):
    return facts.superseded(b.facts()).select("fact_id", "superseded_by", "superseded_at")


@query("SELECT fact_id, claim, valid_from FROM facts WHERE person_id = 8 AND attribute = 'error'", "facts")
def fact_history(b):
    return facts.history(b.facts(), 8, "error").select("fact_id", "claim", "valid_from")


@query("SELECT fact_id, claim, valid_from FROM facts WHERE person_id = 8 AND attribute = 'click' AND superseded_by IS NULL", "facts")
def resolve_fact_state(b):
    return facts.resolve(b.facts(), 8, "click").select("fact_id", "claim", "valid_from")


@query("SELECT n.fact_id AS new_id, n.claim AS new_claim, o.fact_id AS old_id, o.claim AS old_claim FROM facts o JOIN facts n ON o.superseded_by = n.fact_id", "facts")
def fact_lineage(b):
    return facts.lineage(b.facts()).select("new_id", "new_claim", "old_id", "old_claim")


@query("""SELECT fact_id, first_value(fact_id) OVER w AS root_id, row_number() OVER w - 1 AS depth FROM facts
    WINDOW w AS (PARTITION BY person_id, attribute ORDER BY valid_from, fact_id)""", "facts")
def fact_chain_recursive(b):
    return facts.chains(b.facts())


@query("""SELECT claim, source_utterance_id, min(fact_id) AS fact_id FROM candidates WHERE fact_id % 2 = 1
    AND (source_utterance_id, claim) NOT IN (SELECT source_utterance_id, claim FROM candidates WHERE fact_id % 2 = 0) GROUP BY claim, source_utterance_id""", "candidates")
def idempotent_insert(b):
    c = b.candidates()
    fresh = sinks.insert_once(c.where("fact_id % 2 = 0"), c.where("fact_id % 2 = 1"), ["source_utterance_id", "claim"], [F.col("fact_id")])
    return fresh.select("claim", "source_utterance_id", "fact_id")


@query("""SELECT (SELECT count(*) FROM utterances WHERE conversation_id = 7) AS utterances,
    (SELECT count(*) FROM facts WHERE source_utterance_id IN (SELECT utterance_id FROM utterances WHERE conversation_id = 7)) AS facts,
    (SELECT count(*) FROM promises WHERE promise_id % 1000 IN (SELECT utterance_id FROM utterances WHERE conversation_id = 7)) AS promises""", "facts", "utterances", "promises")
def cascade_delete(b):
    p = b.promises().withColumn("source_utterance_id", F.col("promise_id") % 1000)
    return sinks.cascade_delete(F.lit(7), b.utterances(), b.facts(), p)[1]


@query("SELECT fact_id, superseded_by FROM facts WHERE source_utterance_id NOT IN (SELECT utterance_id FROM utterances WHERE conversation_id = 7)", "facts", "utterances")
def cascade_delete_keeps(b):
    p = b.promises().withColumn("source_utterance_id", F.col("promise_id") % 1000)
    return sinks.cascade_delete(F.lit(7), b.utterances(), b.facts(), p)[0]["facts"].select("fact_id", "superseded_by")


@query("""SELECT conversation_id, utterance_id, text, created FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY rev DESC) AS n, min(rev) OVER (PARTITION BY utterance_id) AS created FROM (
    SELECT conversation_id, utterance_id, text, 0::BIGINT AS rev FROM utterances UNION ALL SELECT conversation_id, utterance_id, text || ' (revised)', 1 FROM utterances WHERE utterance_id % 3 = 0
    UNION ALL SELECT conversation_id, utterance_id + 5000000, text, 2 FROM utterances WHERE utterance_id % 4 = 0)) WHERE n = 1""", "utterances")
def upsert_latest(b):
    u = b.utterances().select("conversation_id", "utterance_id", "text")
    rev = lambda df, n: df.withColumns({"rev": F.lit(n), "created": F.lit(n)})
    incoming = rev(u.where("utterance_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" (revised)"))), 1).unionByName(rev(u.where("utterance_id % 4 = 0").withColumn("utterance_id", F.col("utterance_id") + 5_000_000), 2))
    return sinks.upsert(rev(u, 0), incoming, ["utterance_id"], "rev", "created").drop("rev")


@query("""SELECT utterance_id, text, rev, created FROM (SELECT utterance_id, text, rev, row_number() OVER (PARTITION BY utterance_id ORDER BY batch DESC, rev DESC) AS n, arg_min(rev, [batch, rev]) OVER (PARTITION BY utterance_id) AS created FROM (
    SELECT utterance_id, text, 0::BIGINT AS rev, 0 AS batch FROM utterances WHERE utterance_id % 5 <> 0 UNION ALL SELECT utterance_id, text || ' (revised)', 3, 1 FROM utterances WHERE utterance_id % 3 = 0
    UNION ALL SELECT utterance_id, text || ' (early)', 1, 2 FROM utterances WHERE utterance_id % 4 = 0)) WHERE n = 1""", "utterances")
def upsert_stream(b):
    """Three batches into a log table as a stream, with a compaction after the second and a restart before the third; the last batch wins."""
    base = fresh_folder(b.spark, "upsert-stream")
    u = b.utterances().select("utterance_id", "text")
    mark = lambda df, note, rev: df.select("utterance_id", F.concat("text", F.lit(note)).alias("text"), F.lit(rev).cast("long").alias("rev"), F.lit(rev).cast("long").alias("created"))
    batches = [mark(u.where("utterance_id % 5 <> 0"), "", 0), mark(u.where("utterance_id % 3 = 0"), " (revised)", 3), mark(u.where("utterance_id % 4 = 0"), " (early)", 1)]
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.parquet(f"{base}/in/{i}")
        if i:
            rows = streams.replay(b.spark, f"{base}/in/*", batch.schema)
            streams.upsert_stream(rows, f"{base}/table", ["utterance_id"], "rev", "created", f"{base}/checkpoint", compact_every=2).awaitTermination()
    return LogTable(b.spark, f"{base}/table", batches[0].schema, ["utterance_id"], "rev", "created").read()


@query("SELECT promise_id, CASE WHEN promise_id % 5 = 0 THEN 'cancelled' WHEN promise_id % 5 = 1 THEN 'done' ELSE status END AS status FROM promises", "promises")
def promise_status_changes(b):
    p = b.promises()
    first = p.where("promise_id % 5 IN (0, 1)").select("promise_id", F.lit("done").alias("status"), F.lit(1).alias("seq"))
    then = p.where("promise_id % 5 = 0").select("promise_id", F.lit("cancelled").alias("status"), F.lit(2).alias("seq"))
    return sinks.set_status(p, first.unionByName(then)).select("promise_id", "status")


@query("SELECT 'reminder-' || promise_id AS reminder_id, promise_id, 'pending' AS status, due_at - INTERVAL 1 HOUR AS fire_at FROM promises WHERE status = 'open' AND due_at IS NOT NULL", "promises")
def reminders(b):
    return sinks.append_reminders(b.promises().where("status = 'open' AND due_at IS NOT NULL"), F.col("due_at") - F.expr("INTERVAL 1 HOUR"))


@query()
def reconcile_facts(b):
    """Fold with replace, refine and coexist."""
    relation = F.element_at(F.array(F.lit("replace"), F.lit("refine"), F.lit("coexist")), (F.col("fact_id") % 3 + 1).cast("int"))
    c = b.candidates().select("person_id", "attribute", "fact_id", "claim", "source_utterance_id", F.col("fact_id").alias("position"), F.col("valid_from").cast("timestamp"), F.col("valid_from").cast("timestamp").alias("created_at"), relation.alias("relation"))
    return facts.reconcile(c)


@query("SELECT fact_id, superseded_by FROM facts", "facts")
def set_fact_fold(b):
    """The fold by voice, which equals the window form when every change replaces."""
    c = b.candidates().select("person_id", "attribute", "fact_id", "claim", "source_utterance_id", F.col("fact_id").alias("position"), F.col("valid_from").cast("timestamp"), F.col("valid_from").cast("timestamp").alias("created_at"), F.lit("replace").alias("relation"))
    return facts.reconcile(c, spoken=True).select("fact_id", "superseded_by")


@query("SELECT fact_id, person_id FROM candidates WHERE source_utterance_id = 72 AND person_id IN (SELECT person_id FROM utterances WHERE conversation_id = 7)", "candidates", "utterances")
def model_output_guard(b):
    u = b.utterances().where("conversation_id = 7")
    return facts.guard(b.candidates(), u, u.where("turn = 2").select(F.col("utterance_id").alias("source_utterance_id"))).select("fact_id", "person_id")


@query("""SELECT c.fact_id AS candidate_id, CASE WHEN c.source_utterance_id = f.source_utterance_id THEN true WHEN a.utterance_id IS NULL OR b.utterance_id IS NULL THEN false
    WHEN a.conversation_id = b.conversation_id THEN a.start_ms <= b.start_ms ELSE a.conversation_id <= b.conversation_id END AS stale FROM candidates c JOIN facts f ON f.fact_id = c.fact_id % 5000 AND f.fact_id <> c.fact_id
    LEFT JOIN utterances a ON a.utterance_id = c.source_utterance_id LEFT JOIN utterances b ON b.utterance_id = f.source_utterance_id""", "candidates", "facts", "utterances")
def ordering_guard(b):
    """Candidates against an earlier fact; conversations stand in the order of their ids."""
    u = b.utterances().withColumn("created_at", F.col("conversation_id"))
    c = b.candidates().select(F.col("fact_id").alias("candidate_id"), "source_utterance_id", (F.col("fact_id") % 5000).alias("current_id")).where("candidate_id != current_id")
    return facts.predates(c, b.facts(), u)


# changes


@query("SELECT utterance_id, conversation_id, array_to_string(people, ',') AS people FROM heard", "heard")
def recorded_through(b):
    return changes.recorded_through(b.utterances()).select("utterance_id", "conversation_id", F.array_join(F.transform("people", lambda x: x.cast("string")), ",").alias("people"))


_ROOMS = """SELECT p.*, n.conversation_id, coalesce(n.people, []) AS recorded_with, list_sort(list_filter(coalesce(o.people, []), lambda x: x <> p.person_id AND NOT list_contains(coalesce(n.people, []), x))) AS missed
    FROM pairs p LEFT JOIN heard n ON n.utterance_id = p.after_source LEFT JOIN heard o ON o.utterance_id = p.before_source"""


@query(f"SELECT change_id, array_to_string(missed, ',') AS may_have_missed FROM ({_ROOMS})", "pairs", "heard")
def may_have_missed(b):
    r = changes.rooms(changes.pairs(b.facts()), b.utterances())
    return r.select("change_id", F.array_join(F.transform("may_have_missed", lambda x: x.cast("string")), ",").alias("may_have_missed"))


_WORDS = "list_filter(list_distinct(regexp_split_to_array(lower({0}), '[^a-z0-9]+')), lambda w: length(w) >= 4 AND w NOT IN ('" + "','".join(text.CHANGE_STOP_WORDS) + "'))"
_TOUCHED = f"""SELECT change_id, promise_id FROM (SELECT *, row_number() OVER (PARTITION BY change_id ORDER BY promise_id) AS n FROM (
    SELECT c.change_id, p.promise_id FROM pairs c JOIN op p ON p.person_id = c.person_id
    UNION SELECT c.change_id, p.promise_id FROM pairs c JOIN people x ON x.person_id = c.person_id JOIN (SELECT x.person_id, p.promise_id FROM people x JOIN op p ON contains(lower(p.text), lower(trim(x.name))) WHERE x.person_id IN (SELECT person_id FROM pairs)) p ON p.person_id = c.person_id
    UNION SELECT c.change_id, p.promise_id FROM (SELECT change_id, unnest({_WORDS.format("before_claim || ' ' || after_claim")}) AS w FROM pairs) c
      JOIN (SELECT promise_id, w, row_number() OVER (PARTITION BY w ORDER BY promise_id) AS k FROM (SELECT promise_id, unnest({_WORDS.format("text")}) AS w FROM op)) p ON p.w = c.w AND k <= 3)) WHERE n <= 3"""
_OPEN = ", op AS (SELECT * FROM promises WHERE status = 'open')"


@query(_OPEN + f" SELECT * FROM ({_TOUCHED})", "pairs", "people", "promises")
def affected_promises(b):
    return changes.affected_promises(changes.pairs(settle(b.facts())), b.promises(), b.people()).select("change_id", "promise_id")


_CHANGES = f"""{_OPEN}, touched AS ({_TOUCHED}), rooms AS ({_ROOMS})
    SELECT r.change_id, r.person_id, coalesce(nullif(trim(x.name), ''), 'Unknown speaker') AS person_name, attribute, before_id, before_claim, after_claim, valid_from,
      CASE WHEN r.conversation_id IS NOT NULL THEN after_source END AS source_utterance_id, r.conversation_id, array_to_string(recorded_with, ',') AS recorded_with, array_to_string(missed, ',') AS may_have_missed,
      coalesce((SELECT string_agg(promise_id::VARCHAR, ',' ORDER BY promise_id) FROM touched t WHERE t.change_id = r.change_id), '') AS affected_promises
    FROM rooms r LEFT JOIN people x ON x.person_id = r.person_id"""


def _flat(df: DataFrame) -> DataFrame:
    arrays = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in arrays})


@query(_CHANGES, "pairs", "heard", "people", "promises")
def context_changes(b):
    """The change feed over all changes."""
    return _flat(changes.context_changes(b.facts(), b.utterances(), b.people(), b.promises()))


@query("SELECT change_id, person_id, before_claim, after_claim FROM pairs ORDER BY superseded_at DESC, valid_from DESC, change_id LIMIT 10", "pairs")
def latest_changes(b):
    return changes.context_changes(b.facts(), b.utterances(), b.people(), b.promises(), limit=10).select("change_id", "person_id", "before_claim", "after_claim")


@query(f"SELECT promise_id, array_to_string(list_sort({_WORDS.format('text')}), ',') AS words FROM promises", "promises")
def change_keywords(b):
    return b.promises().select("promise_id", F.array_join(F.array_sort(text.change_words(F.col("text"))), ",").alias("words"))


# retrieval


def _voice_queries(b, n: int = 50):
    return b.voiceprints().where(F.col("voiceprint_id") % n == 0).select(F.col("voiceprint_id").alias("query_id"), F.col("embedding").alias("query"))


@query("SELECT query_id, voiceprint_id, rank, round(cosine, 9) AS cosine, round((1 + cosine) / 2, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, voiceprint_id) AS rank FROM cos) WHERE rank <= 3", "cos")
def knn_voiceprints(b):
    hits = retrieval.knn(b.voiceprints(), _voice_queries(b), 3, "voiceprint_id")
    return hits.select("query_id", "voiceprint_id", "rank", F.round("cosine", 9).alias("cosine"), F.round("score", 9).alias("score"))


@query("""SELECT query_id, voiceprint_id, rank, round(cosine, 9) AS cosine FROM (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, c.voiceprint_id) AS rank FROM cos c JOIN voiceprints q ON q.voiceprint_id = c.query_id WHERE query_id % 100 <> 0 OR c.person_id = q.person_id) WHERE rank <= 3""", "cos")
def voice_index(b):
    """A persisted index, built from two thirds of the prints and added to; every other query asks only for prints of its own person."""
    prints = b.voiceprints()
    index = VectorIndex.build(prints.where("voiceprint_id % 3 <> 0"), fresh_folder(b.spark, "voice-index"), "voiceprint_id", tag="person_id")
    index.add(prints.where("voiceprint_id % 3 = 0"), "voiceprint_id", tag="person_id")
    asked = prints.where("voiceprint_id % 50 = 0").select(F.col("voiceprint_id").alias("query_id"), F.col("embedding").alias("query"), F.when(F.expr("voiceprint_id % 100 = 0"), F.col("person_id")).alias("only"))
    hits = index.search(asked, 3, tag="only")
    return hits.select(F.col("query_id").cast("long").alias("query_id"), F.col("id").cast("long").alias("voiceprint_id"), "rank", F.round("cosine", 9).alias("cosine"))


@query("SELECT query_id, voiceprint_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, voiceprint_id) AS rank FROM cos WHERE person_id = 3) WHERE rank <= 5", "cos")
def knn_filtered(b):
    """The person filter stands before the ranking."""
    return retrieval.knn(b.voiceprints().where("person_id = 3"), _voice_queries(b), 5, "voiceprint_id").select("query_id", "voiceprint_id", "rank")


@query("SELECT query_id, voiceprint_id, person_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, voiceprint_id) AS rank FROM cos) WHERE rank <= 12 AND person_id % 9 <> 4", "cos")
def orphan_semi_join(b):
    """Prints of people that don't exist are dropped after the ranking."""
    people = b.people().where("person_id % 9 <> 4")
    hits = retrieval.knn(b.voiceprints(), _voice_queries(b), 12, "voiceprint_id").join(b.voiceprints().select("voiceprint_id", "person_id"), "voiceprint_id")
    return identity.with_people(hits, people).select("query_id", "voiceprint_id", "person_id")


_TERMS = ("the", "was", "der")
_BM25 = r""", tok AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
    c AS (SELECT doc_id, len(t) AS n, """ + ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS)) + r""" FROM tok),
    st AS (SELECT count(*) AS docs, avg(n) AS mean, """ + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(3)) + r""" FROM c),
    sc AS (SELECT doc_id, round(""" + " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (docs - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) ELSE 0 END" for i in range(3)) + r""", 6) AS score
    FROM c, st WHERE tf0 + tf1 + tf2 > 0)"""


def _lexical(b):
    return retrieval.bm25(b.raw("documents"), list(_TERMS), "doc_id", F.coalesce("text", F.lit(""))).withColumn("score", F.round("score", 6))


@query(_BM25.lstrip(", ").join(["WITH ", " SELECT doc_id, score FROM sc"]))
def bm25(b):
    return _lexical(b)


@query(_BM25.lstrip(", ").join(["WITH ", """, asked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT 1 AS query_id, * FROM sc UNION ALL
    SELECT 2, doc_id, round(ln(1 + (docs - df1 + 0.5::DOUBLE) / (df1 + 0.5::DOUBLE)) * tf1 * 2.2::DOUBLE / (tf1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)), 6) FROM c, st WHERE tf1 > 0))
    SELECT query_id, doc_id, score, rank FROM asked WHERE rank <= 50"""]))
def lexical_index(b):
    """Two questions to a persisted inverted index that was built in two parts; only the buckets of their terms are read."""
    docs = b.raw("documents")
    index = TextIndex(b.spark, fresh_folder(b.spark, "lexical-index"), buckets=16)
    for part in (0, 1):
        index.add(docs.where(F.pmod("doc_id", F.lit(2)) == part), "doc_id", F.col("text"), version=part)
    asked = b.spark.createDataFrame([(1, " ".join(_TERMS)), (2, f"{_TERMS[1]}?")], "query_id int, text string")
    scored = index.search(asked).withColumn("score", F.round("score", 6))
    return retrieval.ranked(scored, "doc_id", 50, group="query_id").select("query_id", "doc_id", "score", "rank")


_LEGS = ", sem AS (SELECT voiceprint_id AS doc_id, row_number() OVER (ORDER BY cosine DESC, voiceprint_id) AS s FROM cos WHERE query_id = 0), lex AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS l FROM sc)"


@query(_BM25 + _LEGS + """ SELECT doc_id, round(coalesce(1.0::DOUBLE / (60 + s), 0) + coalesce(1.0::DOUBLE / (60 + l), 0), 9) AS score FROM (SELECT * FROM sem WHERE s <= 10) FULL JOIN (SELECT * FROM lex WHERE l <= 10) USING (doc_id)""", "cos")
def rrf_fusion(b):
    q = _voice_queries(b).where("query_id = 0")
    sem = retrieval.knn(b.voiceprints(), q, 10, "voiceprint_id").select(F.col("voiceprint_id").alias("doc_id"), "rank")
    fused = retrieval.reciprocal_rank_fusion(sem, retrieval.ranked(_lexical(b), "doc_id", 10), "doc_id")
    return fused.select("doc_id", F.round("score", 9).alias("score"))


def _legs(b):
    q = _voice_queries(b).where("query_id = 0")
    sem = retrieval.knn(b.voiceprints(), q, 100, "voiceprint_id").select(F.col("voiceprint_id").alias("fact_id"), F.col("cosine").alias("score"))
    alive = b.raw("documents").select(F.col("doc_id").alias("fact_id"), F.when(F.col("doc_id") % 3 == 0, F.lit(1)).alias("superseded_by"))
    return alive, sem, _lexical(b).withColumnRenamed("doc_id", "fact_id")


_FUSED = "SELECT doc_id AS fact_id, round(coalesce(1.0::DOUBLE / (60 + s), 0) + coalesce(1.0::DOUBLE / (60 + l), 0), 9) AS score FROM ({sem}) FULL JOIN ({lex}) USING (doc_id) {where} ORDER BY round(coalesce(1.0::DOUBLE / (60 + s), 0) + coalesce(1.0::DOUBLE / (60 + l), 0), 12) DESC, s NULLS LAST, l NULLS LAST LIMIT 10"


@query(_BM25 + _LEGS + " " + _FUSED.format(sem="SELECT * FROM sem WHERE s <= 10", lex="SELECT * FROM lex WHERE l <= 10", where="WHERE doc_id % 3 <> 0 AND doc_id IN (SELECT doc_id FROM documents)"), "cos")
def rrf_filter_after(b):
    """Superseded rows use up places of the fused legs."""
    return retrieval.search_facts(*_legs(b), mode="fused").select("fact_id", F.round("score", 9).alias("score"))


@query(_BM25 + _LEGS + " " + _FUSED.format(sem="SELECT doc_id, row_number() OVER (ORDER BY s) AS s FROM (SELECT * FROM sem WHERE s <= 10) WHERE doc_id % 3 <> 0 AND doc_id IN (SELECT doc_id FROM documents)", lex="SELECT doc_id, row_number() OVER (ORDER BY l) AS l FROM lex WHERE doc_id % 3 <> 0 QUALIFY row_number() OVER (ORDER BY l) <= 10", where=""), "cos")
def rrf_manual(b):
    """The lexical leg is filtered before its limit, the semantic one after."""
    return retrieval.search_facts(*_legs(b), mode="manual").select("fact_id", F.round("score", 9).alias("score"))


_ASK = "urgent purchase, for Customer#000000077 the thre"
_PATTERN = "(?i)urgent|purchase,|Customer#000000077|thre"


@query(f"""SELECT * FROM (SELECT 'promise' AS kind, promise_id AS id, person_id, text, 0.5::DOUBLE AS score FROM promises WHERE status = 'open' AND regexp_matches(text, '{_PATTERN}') ORDER BY promise_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'utterance', utterance_id, person_id, text, 0.25::DOUBLE FROM utterances WHERE regexp_matches(text, '{_PATTERN}') ORDER BY utterance_id LIMIT 5)""", "promises", "utterances")
def lexical_or_regex(b):
    return retrieval.search_text(_ASK, b.promises(), b.utterances())


def _memory(b):
    f = b.facts()
    hits = f.where("superseded_by IS NULL").select("fact_id", F.round(F.col("weight") / 1000, 6).alias("score")).orderBy(F.col("score").desc(), "fact_id").limit(10)
    return retrieval.search_memory(hits, f, retrieval.search_text(_ASK, b.promises(), b.utterances()))


_MEMORY = f"""SELECT *, row_number() OVER (ORDER BY CASE kind WHEN 'fact' THEN 1 WHEN 'promise' THEN 2 ELSE 3 END, score DESC, id) AS place FROM (
    SELECT * FROM (SELECT 'fact' AS kind, fact_id AS id, person_id, claim AS text, round(weight / 1000, 6) AS score FROM facts WHERE superseded_by IS NULL ORDER BY round(weight / 1000, 6) DESC, fact_id LIMIT 10) UNION ALL {{}})""".format(
    f"""SELECT * FROM (SELECT 'promise' AS kind, promise_id AS id, person_id, text, 0.5::DOUBLE AS score FROM promises WHERE status = 'open' AND regexp_matches(text, '{_PATTERN}') ORDER BY promise_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'utterance', utterance_id, person_id, text, 0.25::DOUBLE FROM utterances WHERE regexp_matches(text, '{_PATTERN}') ORDER BY utterance_id LIMIT 5)"""
)


@query(_MEMORY, "facts", "promises", "utterances")
def search_memory(b):
    return _memory(b)


@query(f"SELECT id, kind FROM ({_MEMORY}) WHERE kind <> 'utterance'", "facts", "promises", "utterances")
def prefer_resolved_state(b):
    return retrieval.prefer_facts(_memory(b).withColumn("query_id", F.lit(1))).select("id", "kind")


@query(f"SELECT 1::BIGINT AS query_id, string_agg('[' || n || '] (' || kind || ') ' || text, chr(10) ORDER BY n) AS evidence FROM (SELECT *, row_number() OVER (ORDER BY place) AS n FROM ({_MEMORY}) WHERE kind <> 'utterance')", "facts", "promises", "utterances")
def evidence_lines(b):
    return retrieval.evidence(retrieval.prefer_facts(_memory(b).withColumn("query_id", F.lit(1))))


@query(f"SELECT id, kind, place FROM ({_MEMORY}) WHERE place % 2 = 1", "facts", "promises", "utterances")
def cited_results(b):
    m = _memory(b).withColumn("query_id", F.lit(1))
    return retrieval.cited(m, m.where("place % 2 = 1")).select("id", "kind", "place")


_SHARE = "(" + " + ".join(f"contains(lower({{0}}), '{t}')::INT" for t in ("purchase", "value", "urgent", "thre")) + ") / 4.0::DOUBLE"


@query(f"""SELECT kind, id, person_id, text, score FROM (
    SELECT 1 AS rank, 'fact' AS kind, fact_id AS id, person_id, claim AS text, {_SHARE.format("claim || ' ' || attribute")} AS score FROM facts WHERE superseded_by IS NULL
    UNION ALL SELECT 2, 'promise', promise_id, person_id, text, {_SHARE.format("text")} FROM promises UNION ALL SELECT 3, 'utterance', utterance_id, person_id, text, {_SHARE.format("text")} * 0.5 FROM utterances)
    WHERE score > 0 ORDER BY score DESC, rank, id LIMIT 5""", "facts", "promises", "utterances")
def local_ask(b):
    return retrieval.local_search("What's the purchase value urgent, thre?", b.facts(), b.promises(), b.utterances())


@query("""SELECT kind, id, text, score FROM (SELECT 'fact' AS kind, fact_id AS id, claim AS text, 1.0::DOUBLE AS score, valid_from AS since FROM facts WHERE superseded_by IS NULL AND person_id = 17
    UNION ALL SELECT 'promise', promise_id, text, 0.9::DOUBLE, NULL FROM promises WHERE status = 'open' AND person_id = 17) ORDER BY score DESC, since DESC NULLS LAST, id LIMIT 6""", "facts", "promises")
def subject_ask(b):
    people = b.people().withColumn("name", F.when(F.col("person_id") == 17, "Maya Oliver").otherwise(F.col("name")))
    return retrieval.subject_search("Who's Maya?", people, b.facts(), b.promises())


@query("""SELECT kind, id, text, score FROM (SELECT 'fact' AS kind, fact_id AS id, p.name || ': ' || claim AS text, (contains(attribute || ' ' || claim, 'signup')::INT + contains(attribute || ' ' || claim, 'urgent')::INT) / 2.0::DOUBLE AS score
    FROM facts f JOIN people p ON p.person_id = f.person_id WHERE superseded_by IS NULL UNION ALL SELECT 'promise', promise_id, text, (contains(text, 'signup')::INT + contains(text, 'urgent')::INT) / 2.0::DOUBLE FROM promises)
    WHERE score > 0 ORDER BY score DESC, kind, id LIMIT 5""", "facts", "people", "promises")
def fixture_ask(b):
    return retrieval.fixture_search("of signup urgent", b.facts(), b.people(), b.promises())


@query("""SELECT DISTINCT p.person_id FROM people p LEFT JOIN facts f ON f.person_id = p.person_id AND f.superseded_by IS NULL
    WHERE contains(lower(p.name || ' ' || p.relationship), 'value 42') OR contains(lower(f.claim), 'value 42')""", "people", "facts")
def people_search(b):
    return views.search_people(b.people(), b.facts(), " Value 42").select("person_id")


# identity


@query("""SELECT query_id, CASE WHEN best IS NULL THEN 'new' WHEN best - coalesce(second, -1e300) < 0.05 THEN 'uncertain' ELSE 'match' END AS kind,
    CASE WHEN best - coalesce(second, -1e300) < 0.05 THEN 'ambiguous' END AS reason FROM (
      SELECT q.query_id, max(score) FILTER (place = 1) AS best, max(score) FILTER (place = 2) AS second FROM (SELECT DISTINCT query_id FROM every_cos) q LEFT JOIN (
        SELECT query_id, person_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, person_id) AS place FROM (SELECT query_id, person_id, max(cosine) AS score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, voiceprint_id) AS rank FROM every_cos WHERE query_id <> voiceprint_id) WHERE rank <= 12 AND cosine >= 0.3 GROUP BY query_id, person_id)) r ON r.query_id = q.query_id GROUP BY q.query_id)""", "every_cos")
def decide_speaker(b):
    """Every print is asked for, against all others."""
    hits = retrieval.neighbours(b.voiceprints(), 12, "voiceprint_id", least=0.3)
    hits = hits.join(b.voiceprints().select("voiceprint_id", "person_id"), "voiceprint_id")
    r = identity.best_per_person(hits).groupBy("query_id").agg(F.max(F.when(F.col("place") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    nan = F.lit(float("nan"))
    d = scoring.decide(F.coalesce("best", nan), F.coalesce("second", nan), 0.3, 0.3, 0.05)
    return b.voiceprints().select(F.col("voiceprint_id").alias("query_id")).join(r, "query_id", "left").select("query_id", d["kind"].alias("kind"), d["reason"].alias("reason"))


@query("""SELECT q.voiceprint_id AS query_id, CASE WHEN duration_ms < 3000 THEN 'pending' WHEN r.person_id IS NULL THEN 'new' ELSE 'match' END AS kind, CASE WHEN duration_ms >= 3000 THEN r.person_id END AS person_id
    FROM voiceprints q LEFT JOIN (SELECT query_id, person_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, person_id) AS place FROM (SELECT query_id, person_id, max(cosine) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, voiceprint_id) AS rank FROM cos WHERE voiceprint_id % 50 <> 0)
      WHERE rank <= 3 AND cosine >= 0.3 AND person_id % 9 <> 4 AND person_id IN (SELECT person_id FROM people) GROUP BY query_id, person_id)) r ON r.query_id = q.voiceprint_id AND r.place = 1 WHERE q.voiceprint_id % 50 = 0""", "cos", "people")
def attribute_speakers(b):
    """The stated query set is new speech, all other prints are known; some people are not."""
    clusters = b.voiceprints().where("voiceprint_id % 50 = 0").select(F.col("voiceprint_id").alias("query_id"), F.col("embedding").alias("query"), F.col("duration_ms").alias("speech_ms"))
    return identity.attribute(clusters, b.voiceprints().where("voiceprint_id % 50 <> 0"), b.people().where("person_id % 9 <> 4"), threshold=0.3).select("query_id", "kind", "person_id")


@query("SELECT query_id, c >= 0.6 AS is_owner, round(c, 9) AS confidence FROM (SELECT query_id, max(cosine) FILTER (person_id = 0) AS c FROM cos GROUP BY query_id)", "cos")
def owner_gate(b):
    return identity.owner_gate(_voice_queries(b), b.voiceprints(), b.people()).withColumn("confidence", F.round("confidence", 9))


_MERGES = "SELECT person_id // 3 AS merge_id, person_id FROM people UNION ALL SELECT -1, -5 UNION ALL SELECT -1, 149"
_MAP = f""", m AS ({_MERGES}), g AS (SELECT merge_id, min((p.created_ms, p.person_id)) AS f FROM m LEFT JOIN people p ON p.person_id = m.person_id GROUP BY merge_id HAVING count(*) >= 2 AND count(*) = count(p.person_id)),
    map AS (SELECT m.person_id AS old_id, f[2] AS new_id FROM m JOIN g ON m.merge_id = g.merge_id WHERE m.person_id <> f[2])"""


def _merge(b, strict: bool = True):
    """Everybody in threes, and one request with a person who doesn't exist."""
    p = b.people()
    asked = p.select(F.expr("person_id DIV 3").alias("merge_id"), "person_id")
    odd = b.spark.createDataFrame([(-1, -5), (-1, 149)], "merge_id long, person_id long")
    return p, identity.merge_mapping(asked.unionByName(odd), p, strict)


@query(_MAP + " SELECT fact_id, coalesce(new_id, person_id) AS person_id FROM facts LEFT JOIN map ON old_id = person_id", "people", "facts")
def merge_people(b):
    p, m = _merge(b)
    return identity.merge_people(p, {"facts": b.facts()}, m)[1]["facts"].select("fact_id", "person_id")


@query(_MAP + " SELECT person_id, name FROM people WHERE person_id NOT IN (SELECT old_id FROM map)", "people")
def merged_people_left(b):
    p, m = _merge(b)
    return identity.merge_people(p, {}, m)[0].select("person_id", "name")


@query("SELECT u.person_id, conversation_id, string_agg(utterance_id::VARCHAR, ',' ORDER BY utterance_id) AS utterance_ids FROM utterances u WHERE person_id IN (SELECT person_id FROM people) GROUP BY ALL", "utterances", "people")
def relabel_events(b):
    return _flat(identity.relabel_events(b.utterances(), b.people()))


@query("SELECT DISTINCT u.conversation_id, u.person_id, p.name FROM utterances u JOIN people p ON p.person_id = u.person_id", "utterances", "people")
def conversation_participants(b):
    return views.participants(b.utterances(), b.people())


# scoring


@query("""SELECT block, round(avg(score), 9) AS mean, round(greatest(coalesce(stddev_samp(score), 1e-6), 1e-6), 9) AS std FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY score DESC) AS n FROM trials) WHERE n <= 20 GROUP BY block""", "trials")
def cohort_stats(b):
    return scoring.cohort_stats(b.trials(), "block", 20).select("block", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


_TRIALS = """, tr AS (SELECT a.voiceprint_id AS t, e.voiceprint_id AS e, a.person_id = e.person_id AS genuine, round(list_dot_product(a.embedding, e.embedding) / (sqrt(list_dot_product(a.embedding, a.embedding)) * sqrt(list_dot_product(e.embedding, e.embedding))), 12) AS score
    FROM voiceprints a JOIN voiceprints e ON a.voiceprint_id <> e.voiceprint_id AND a.voiceprint_id % 50 = 0),
    ts AS (SELECT t, avg(score) AS m, greatest(stddev_samp(score), 1e-6) AS s FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC) AS n FROM tr WHERE NOT genuine) WHERE n <= 8 GROUP BY t),
    es AS (SELECT e, avg(score) AS m, greatest(stddev_samp(score), 1e-6) AS s FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY score DESC) AS n FROM tr WHERE NOT genuine) WHERE n <= 8 GROUP BY e)"""


@query(_TRIALS + " SELECT tr.t AS test_id, tr.e AS enrolled_id, round(((score - ts.m) / ts.s + (score - es.m) / es.s) / 2, 6) AS normalized FROM tr JOIN ts ON ts.t = tr.t JOIN es ON es.e = tr.e", "voiceprints")
def as_norm(b):
    """The stated query set against all prints."""
    p = b.voiceprints()
    return scoring.normalized_in_blocks(p.where("voiceprint_id % 50 = 0"), p).select("test_id", "enrolled_id", F.round("normalized", 6).alias("normalized"))


@query("SELECT block, round(coalesce(avg((score >= 0.5)::INT) FILTER (NOT genuine), 0), 9) AS false_accept, round(coalesce(avg((score < 0.5)::INT) FILTER (genuine), 0), 9) AS false_reject FROM trials GROUP BY block", "trials")
def error_rates(b):
    return scoring.error_rates(b.trials(), 0.5, "block").select("block", F.round("false_accept", 9).alias("false_accept"), F.round("false_reject", 9).alias("false_reject"))


@query("""SELECT round(eer, 9) AS eer, threshold FROM (SELECT t AS threshold, (fa + fr) / 2 AS eer, abs(fa - fr) AS gap FROM (
    SELECT c.score AS t, avg((x.score >= c.score)::INT) FILTER (NOT x.genuine) AS fa, avg((x.score < c.score)::INT) FILTER (x.genuine) AS fr FROM (SELECT DISTINCT score FROM trials) c, trials x GROUP BY c.score)) ORDER BY round(gap, 12), threshold LIMIT 1""", "trials")
def equal_error_rate(b):
    return scoring.equal_error_rate(b.trials()).select(F.round("eer", 9).alias("eer"), "threshold")


@query("SELECT block, round(e, 9) AS error FROM (SELECT block, round(coalesce(avg((score >= 0.5)::INT) FILTER (NOT genuine), 0) + coalesce(avg((score < 0.5)::INT) FILTER (genuine), 0), 12) AS e FROM trials GROUP BY block) ORDER BY e DESC, block LIMIT 1", "trials")
def worst_block(b):
    return scoring.worst_block(b.trials(), 0.5).select("block", F.round("error", 9).alias("error"))


@query("SELECT trial_id, round(1 / (1 + exp(-(score * 3.5 - 1.25))), 9) AS probability FROM trials", "trials")
def calibrated_probability(b):
    return b.trials().select("trial_id", F.round(numeric.calibrated(F.col("score"), 3.5, -1.25), 9).alias("probability"))


@query("""RECURSIVE , c AS (SELECT score AS x, genuine::INT AS y, count(*)::DOUBLE AS n FROM trials GROUP BY ALL), t AS (SELECT sum(n) AS total, sum(x * n) / sum(n) AS mean FROM c),
    p AS (SELECT any_value(total) AS total, any_value(mean) AS mean, sqrt(sum(n * (x - mean) * (x - mean)) / any_value(total)) AS spread FROM c, t),
    l AS (SELECT list({'z': (x - mean) / spread, 'y': y, 'n': n} ORDER BY x, y) AS items FROM c, p),
    r AS (SELECT 0 AS i, 0::DOUBLE AS slope, 0::DOUBLE AS intercept UNION ALL
      SELECT i + 1, slope + 0.1::DOUBLE * list_sum(list_transform(items, lambda e: e.n * (e.y - 1 / (1 + exp(-(slope * e.z + intercept)))) * e.z)) / total, intercept + 0.1::DOUBLE * list_sum(list_transform(items, lambda e: e.n * (e.y - 1 / (1 + exp(-(slope * e.z + intercept)))))) / total
      FROM r, l, p WHERE i < 2000)
    SELECT round(slope / spread, 6) AS slope, round(intercept - slope * mean / spread, 6) AS intercept FROM r, p WHERE i = 2000""", "trials")
def calibration_fit(b):
    slope, intercept = scoring.fit_calibration(b.trials())
    return b.spark.createDataFrame([(round(slope, 6), round(intercept, 6))], "slope double, intercept double")


@query("""SELECT bucket, n, r AS "right", floor(r * 100 / n + 0.5)::BIGINT AS percent FROM (SELECT coalesce(bucket, 'all') AS bucket, count(*) AS n, count(*) FILTER (ok) AS r FROM (
    SELECT CASE WHEN end_ms - start_ms < 1000 THEN 'under 1 s' WHEN end_ms - start_ms < 3000 THEN '1 to 3 s' ELSE '3 s and more' END AS bucket, utterance_id % 3 <> 0 AS ok FROM utterances) GROUP BY ROLLUP (bucket))""", "utterances")
def duration_bucket_rollup(b):
    return scoring.duration_report(b.utterances().withColumn("right", F.col("utterance_id") % 3 != 0))


@query("""SELECT CASE WHEN duration_ms < 3000 THEN 'short' ELSE 'long' END AS duration_bucket, count(*) FILTER (duration_ms < 3000) AS "pending", count(*) FILTER (duration_ms >= 3000 AND cosine >= 0.3 AND found = person_id) AS "right",
    count(*) FILTER (duration_ms >= 3000 AND cosine >= 0.3 AND found <> person_id) AS "wrong", count(*) FILTER (duration_ms >= 3000 AND cosine < 0.3) AS "new" FROM (SELECT q.person_id, q.duration_ms, c.person_id AS found, cosine FROM voiceprints q
      JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, voiceprint_id) AS rank FROM cos WHERE voiceprint_id % 50 <> 0) c ON c.query_id = q.voiceprint_id AND rank = 1) GROUP BY ALL""", "cos")
def baseline_verdicts(b):
    turns = b.voiceprints().where("voiceprint_id % 50 = 0").select(F.col("voiceprint_id").alias("query_id"), F.col("embedding").alias("query"), "person_id", "duration_ms")
    v = identity.baseline_verdicts(turns, b.voiceprints().where("voiceprint_id % 50 <> 0"), threshold=0.3).withColumn("duration_bucket", F.when(F.col("duration_ms") < 3000, "short").otherwise("long"))
    return v.groupBy("duration_bucket").pivot("verdict", ["pending", "right", "wrong", "new"]).count().fillna(0)


# segments


@query("SELECT utterance_id, position, text, start_ms, end_ms FROM words", "words")
def word_timing(b):
    return b.words().select("utterance_id", "position", "text", "start_ms", "end_ms")


@query("SELECT utterance_id, position, speaker FROM labelled", "labelled")
def midpoint_join(b):
    return segments.label_words(b.words(), b.segments()).select("utterance_id", "position", "speaker")


_UTT = """, r AS (SELECT *, sum(c) OVER (PARTITION BY conversation_id ORDER BY start_ms, utterance_id, position) AS run FROM (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY conversation_id ORDER BY start_ms, utterance_id, position) IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS c FROM labelled)),
    utt AS (SELECT conversation_id, run::BIGINT AS run, speaker, string_agg(text, ' ' ORDER BY start_ms, utterance_id, position) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r GROUP BY conversation_id, run, speaker)"""


def _assembled(b):
    return segments.assemble(segments.label_words(b.words(), b.segments()))


@query(_UTT + " SELECT * FROM utt", "labelled")
def utterance_islands(b):
    return _assembled(b)


@query(_UTT + " SELECT conversation_id, run, speaker FROM utt WHERE end_ms <= 20000 - 300", "labelled")
def final_cutoff(b):
    return segments.finalized(_assembled(b), 20_000 - 300).select("conversation_id", "run", "speaker")


@query("SELECT conversation_id, CASE WHEN speaker = 'user' THEN 'cluster-0' ELSE speaker END AS speaker, sum(end_ms - start_ms)::BIGINT AS speech_ms FROM segments GROUP BY ALL", "segments")
def speech_per_speaker(b):
    s = b.segments()
    alias = s.where("speaker = 'user'").select("conversation_id", F.col("speaker").alias("label"), F.lit("cluster-0").alias("cluster_id")).distinct()
    return segments.speech_per_speaker(segments.resolve_alias(s, alias))


@query("SELECT conversation_id, speaker, sum(end_ms - start_ms)::BIGINT AS speech_ms FROM segments GROUP BY ALL HAVING sum(end_ms - start_ms) >= 60000", "segments")
def speakers_over_floor(b):
    return segments.speakers_over(b.segments(), 60_000)


@query("SELECT conversation_id, speaker, min(start_ms) AS start_ms FROM segments WHERE speaker <> 'user' GROUP BY ALL", "segments")
def unassigned_turns(b):
    s = b.segments()
    return segments.unassigned_turns(s, s.where("speaker = 'user'").select("conversation_id", F.col("speaker").alias("label")).distinct()).select("conversation_id", "speaker", "start_ms")


@query("SELECT utterance_id, md5(array_to_string(list(text) OVER (PARTITION BY conversation_id ORDER BY start_ms, utterance_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), '|')) AS texts FROM utterances", "utterances")
def lookback_window(b):
    return segments.lookback(b.utterances()).select("utterance_id", F.md5(F.array_join("window_texts", "|")).alias("texts"))


@query("SELECT conversation_id, utterance_id FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY start_ms, utterance_id) AS n FROM utterances WHERE is_final) WHERE n % 3 = 0", "utterances")
def every_nth(b):
    return segments.every_nth(b.utterances(), 3).select("conversation_id", "utterance_id")


@query("""SELECT utterance_id, header, (sum(header::INT) OVER (PARTITION BY conversation_id ORDER BY start_ms, utterance_id))::BIGINT AS run FROM (SELECT *, row_number() OVER w = 1 OR person_id IS NULL OR lag(person_id) OVER w IS DISTINCT FROM person_id AS header
    FROM utterances WINDOW w AS (PARTITION BY conversation_id ORDER BY start_ms, utterance_id))""", "utterances")
def header_runs(b):
    return segments.header_runs(b.utterances()).select("utterance_id", "header", "run")


@query("""SELECT utterance_id, s AS start_ms, greatest(e, s + 1) AS end_ms FROM (SELECT utterance_id, e, greatest(a, coalesce(max(e) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS s
    FROM (SELECT *, start_ms - 500 AS a, end_ms - (turn % 2) * 4000 AS e FROM utterances))""", "utterances")
def turn_clamp(b):
    u = b.utterances().select("conversation_id", "utterance_id", "turn", (F.col("start_ms") - 500).alias("start_ms"), (F.col("end_ms") - (F.col("turn") % 2) * 4000).alias("end_ms"))
    return segments.clamp_turns(u).select("utterance_id", "start_ms", "end_ms")


@query("""SELECT position, "turn", start_ms, rev, conversation_id FROM (SELECT *, CASE WHEN utterance_id % 2 = 0 THEN utterance_id::VARCHAR END AS "turn" FROM words JOIN (SELECT unnest(range(3)) AS rev) ON rev <= utterance_id % 3)
    QUALIFY CASE WHEN "turn" IS NOT NULL THEN rev = max(rev) OVER (PARTITION BY conversation_id, "turn") ELSE row_number() OVER (PARTITION BY conversation_id, "turn" IS NULL, start_ms ORDER BY rev DESC, position DESC) = 1 END""", "words")
def turn_revision(b):
    w = b.words().withColumn("turn", F.when(F.col("utterance_id") % 2 == 0, F.col("utterance_id").cast("string")))
    revised = w.withColumn("rev", F.explode(F.sequence(F.lit(0).cast("long"), F.col("utterance_id") % 3)))
    return segments.revise_words(revised).select("position", "turn", "start_ms", "rev", "conversation_id")


@query(""", sg AS (SELECT conversation_id, start_ms % 7919 * 100000 + start_ms % 100000 AS seq, speaker, greatest(0, start_ms - 700) AS a, end_ms AS b FROM segments),
    pt AS (SELECT conversation_id, seq, unnest(list_distinct(ps)) AS p FROM (SELECT s.conversation_id, s.seq, list(l.a) FILTER (l.a BETWEEN s.a AND s.b) || list(l.b) FILTER (l.b BETWEEN s.a AND s.b) AS ps
      FROM sg s JOIN sg l ON l.conversation_id = s.conversation_id AND l.seq >= s.seq GROUP BY s.conversation_id, s.seq)),
    iv AS (SELECT *, lead(p) OVER (PARTITION BY conversation_id, seq ORDER BY p) AS q FROM pt)
    SELECT i.conversation_id, i.seq, s.speaker, p AS start_ms, q AS end_ms FROM iv i JOIN sg s ON s.conversation_id = i.conversation_id AND s.seq = i.seq
    WHERE q IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sg l WHERE l.conversation_id = i.conversation_id AND l.seq > i.seq AND l.a <= i.p AND l.b >= i.q)""", "segments")
def interval_subtract(b):
    s = b.segments().withColumn("seq", F.col("start_ms") % 7919 * 100_000 + F.col("start_ms") % 100_000)
    return segments.subtract_overlaps(s.withColumn("start_ms", F.greatest(F.lit(0), F.col("start_ms") - 700)))


@query("SELECT utterance_id FROM utterances WHERE end_ms <= 30000", "utterances")
def released_turns(b):
    return released(b.utterances(), 30_000).select("utterance_id")


def _turns(b):
    """Embeddings as turns of conversations, fifty each."""
    v, i = b.voiceprints(), F.col("voiceprint_id")
    return v.select(F.expr("voiceprint_id DIV 50").alias("conversation_id"), F.concat(F.lit("turn-"), i.cast("string")).alias("label"), (i * 900).alias("start_ms"), (i * 900 + F.pmod(i * 37, F.lit(2500))).alias("end_ms"), F.when(i % 7 != 0, F.col("embedding")).alias("embedding"))


@query()
def online_clusters(b):
    return cluster.cluster_turns(_turns(b))


@query("""SELECT person_id, round(list_sum(list_transform(range(1, len(c) + 1), lambda i: i * c[i])), 5) AS total, speech_ms FROM (SELECT person_id, list(m ORDER BY i) AS c, max(ms)::BIGINT AS speech_ms FROM (
    SELECT person_id, i, sum(x * d) / sum(d) AS m, sum(d) AS ms FROM (SELECT person_id, duration_ms AS d, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM voiceprints) GROUP BY person_id, i) GROUP BY person_id)""", "voiceprints")
def weighted_centroids(b):
    t = b.voiceprints().select("person_id", F.lit(0).alias("start_ms"), F.col("duration_ms").alias("end_ms"), "embedding")
    c = cluster.weighted_centroids(t, "person_id")
    return c.select("person_id", F.round(F.aggregate(F.transform("centroid", lambda x, i: (i + 1) * x), F.lit(0.0), lambda s, x: s + x), 5).alias("total"), "speech_ms")


@query("""SELECT conversation_id, label, gap_ms, cluster_id FROM (SELECT t.*, p.cluster_id, greatest(0, t.start_ms - p.p1, p.p0 - t.end_ms)::BIGINT AS gap_ms, row_number() OVER (PARTITION BY t.conversation_id, t.label ORDER BY greatest(0, t.start_ms - p.p1, p.p0 - t.end_ms), p.cluster_id) AS n
    FROM (SELECT conversation_id, utterance_id AS label, start_ms, end_ms FROM utterances WHERE turn % 2 = 0) t JOIN (SELECT conversation_id, utterance_id AS cluster_id, start_ms + 900 AS p0, end_ms - 900 AS p1 FROM utterances WHERE turn % 2 = 1 AND end_ms - start_ms > 1800) p
      ON t.conversation_id = p.conversation_id AND greatest(0, t.start_ms - p.p1, p.p0 - t.end_ms) <= 1200) WHERE n = 1""", "utterances")
def nearest_in_time(b):
    u = b.utterances()
    placed = u.where("turn % 2 = 1 AND end_ms - start_ms > 1800").select("conversation_id", F.col("utterance_id").alias("cluster_id"), (F.col("start_ms") + 900).alias("start_ms"), (F.col("end_ms") - 900).alias("end_ms"))
    return cluster.nearest_in_time(u.where("turn % 2 = 0").select("conversation_id", F.col("utterance_id").alias("label"), "start_ms", "end_ms"), placed)


@query()
def session_utterances(b):
    """Words, spans and embeddings of conversations through the whole session plan."""
    t = _turns(b)
    spans = t.select("conversation_id", F.col("label").alias("speaker"), "start_ms", "end_ms")
    words = t.select("conversation_id", F.regexp_extract("label", "[0-9]+", 0).cast("long").alias("utterance_id"), F.lit(0).alias("position"), F.col("label").alias("text"), (F.col("start_ms") + 10).alias("start_ms"), (F.col("start_ms") + 90).alias("end_ms"))
    return sessions.session_utterances(words, spans, t, clock_ms=400_000)


@query()
def session_decisions(b):
    t = _turns(b)
    return sessions.session_decisions(t.select("conversation_id", F.col("label").alias("speaker"), "start_ms", "end_ms"), t, b.voiceprints(), b.people(), threshold=0.5, margin=0.01)


@query()
def partial_turns(b):
    """Deltas of a streaming transcriber, four events per item."""
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("started", "delta", "stopped", "completed"))), (i % 4 + 1).cast("int"))
    return sessions.partial_turns(b.raw("events").select((F.floor(i / 400)).alias("conversation_id"), i.alias("seq"), kind.alias("type"), F.floor(i / 4).cast("string").alias("item_id"), (i * 250).alias("at_ms"), F.col("event_type").alias("text")))


@query("""RECURSIVE , w AS (SELECT event_id // 1600 AS stream_id, event_id % 1600 AS n, (event_id % 1600) * 20 AS a, (event_id % 1600) * 20 + 20 AS b, event_id // 100 % 16 IN (2, 5) OR value / 100 < 0.01 AS silent FROM events),
    r AS (SELECT stream_id, -1::BIGINT AS n, false AS was, 0::BIGINT AS st, 0::BIGINT AS en, 0::BIGINT AS speech, 0::BIGINT AS quiet, false AS over FROM (SELECT DISTINCT stream_id FROM w)
      UNION ALL SELECT stream_id, n, is_open AND NOT over, st, en, speech, quiet, over FROM (
        SELECT *, is_open AND ((quiet >= 250 AND speech >= 1000) OR b - st >= 15000) AS over FROM (
          SELECT stream_id, n, b, is_open, st, CASE WHEN is_open AND NOT silent THEN b ELSE en END AS en, CASE WHEN is_open AND NOT silent THEN speech + 20 ELSE speech END AS speech, CASE WHEN NOT is_open THEN quiet WHEN silent THEN quiet + 20 ELSE 0 END AS quiet FROM (
            SELECT w.*, r.was OR NOT silent AS is_open, CASE WHEN r.was THEN r.st ELSE w.a END AS st, CASE WHEN r.was THEN r.en ELSE 0 END AS en, CASE WHEN r.was THEN r.speech ELSE 0 END AS speech, CASE WHEN r.was THEN r.quiet ELSE 0 END AS quiet
            FROM r JOIN w ON w.stream_id = r.stream_id AND w.n = r.n + 1)))),
    done AS (SELECT stream_id, st, en FROM (SELECT *, n = max(n) OVER (PARTITION BY stream_id) AS last FROM r) WHERE (over OR (last AND was)) AND speech >= 400)
    SELECT stream_id, 'turn-' || (row_number() OVER (PARTITION BY stream_id ORDER BY st) - 1) AS turn, st AS start_ms, en AS end_ms FROM done""".replace("RECURSIVE ,", "WITH RECURSIVE"))
def energy_vad(b):
    """Streams of 1600 windows; some stretches are silent, others longer than a turn may be."""
    at = "event_id % 1600 * 20D"
    w = b.raw("events").select(F.expr("event_id DIV 1600").alias("stream_id"), F.expr(at).alias("start_ms"), F.expr(f"{at} + 20D").alias("end_ms"), F.when(F.expr("event_id DIV 100 % 16 IN (2, 5)"), 0.0).otherwise(F.col("value") / 100).alias("rms"))
    return voice_activity.voice_turns(w)


# views


@query("SELECT person_id, name, row_number() OVER (ORDER BY name, person_id) AS place FROM people", "people")
def people_by_name(b):
    return placed(views.people_by_name(b.people()).select("person_id", "name"))


@query("""SELECT person_id, section, row_number() OVER (PARTITION BY section ORDER BY name, person_id) AS place FROM (SELECT person_id, name, CASE WHEN trim(name) = '' OR regexp_matches(trim(name), '(?i)^(unknown|unnamed|speaker\\b)') THEN 'Waiting for a name' ELSE upper(left(trim(name), 1)) END AS section
    FROM (SELECT person_id, CASE person_id % 4 WHEN 0 THEN name WHEN 1 THEN 'Speaker 7' WHEN 2 THEN '  ' ELSE lower(relationship) END AS name FROM people))""".replace("\\\\", "\\"), "people")
def people_sections(b):
    k = F.col("person_id") % 4
    named = b.people().withColumn("name", F.when(k == 0, F.col("name")).when(k == 1, "Speaker 7").when(k == 2, "  ").otherwise(F.lower("relationship")))
    return views.people_sections(named.select("person_id", "name")).select("person_id", "section", "place")


@query("""SELECT promise_id, list, row_number() OVER (PARTITION BY list ORDER BY due_at NULLS LAST, promise_id) AS place FROM (SELECT *, CASE WHEN status <> 'open' THEN 'closed' WHEN person_id = 0 THEN 'owing' ELSE 'owed' END AS list FROM promises)""", "promises")
def loops_owed(b):
    return views.loops(b.promises().select("promise_id", "person_id", "status", "due_at")).select("promise_id", "list", "place")


@query("SELECT promise_id, due_at, row_number() OVER (ORDER BY due_at NULLS FIRST, created_at, promise_id) AS place FROM promises WHERE status = 'open'", "promises")
def promises_sorted(b):
    return placed(views.promises_by_due(b.promises(), "open").select("promise_id", "due_at"))


@query("SELECT conversation_id, count(*) AS utterances FROM utterances GROUP BY conversation_id", "utterances")
def home_counts(b):
    return views.conversation_counts(b.utterances())


@query("SELECT count(*) FILTER (status = 'open') AS open_promises, count(DISTINCT person_id) AS people FROM promises", "promises")
def open_promise_count(b):
    return b.promises().agg(F.count_if(F.col("status") == "open").alias("open_promises"), F.countDistinct("person_id").alias("people"))


@query("SELECT DISTINCT conversation_id FROM utterances", "utterances")
def non_empty_conversations(b):
    u = b.utterances()
    every = u.select("conversation_id").distinct().unionByName(b.spark.range(10_000_000, 10_000_003).toDF("conversation_id"))
    return views.non_empty(every, u)


@query("SELECT person_id, string_agg(claim, ' ' ORDER BY valid_from, fact_id) AS claims FROM facts WHERE superseded_by IS NULL GROUP BY person_id", "facts")
def claims_of_people(b):
    return views.claims_of_people(b.facts())


@query("""SELECT conversation_id, count(*) AS lines, string_agg(line, chr(10) ORDER BY n) AS transcript FROM (SELECT *, sum(length(line)) OVER (PARTITION BY conversation_id ORDER BY n) AS used FROM (
    SELECT conversation_id, coalesce(nullif(p.name, ''), 'Someone') || ': ' || trim(text) AS line, row_number() OVER (PARTITION BY conversation_id ORDER BY start_ms, utterance_id) AS n FROM utterances u LEFT JOIN people p ON p.person_id = u.person_id WHERE trim(text) <> ''))
    WHERE n <= 60 AND used <= 2000 GROUP BY conversation_id""", "utterances", "people")
def transcript_budget(b):
    return views.title_transcript(b.utterances(), b.people(), chars=2000)


@query(r"""SELECT utterance_id FROM (SELECT *, lag(t) OVER (PARTITION BY conversation_id ORDER BY start_ms, utterance_id) AS p, row_number() OVER (PARTITION BY conversation_id ORDER BY start_ms, utterance_id) AS n FROM (
    SELECT *, CASE WHEN turn % 3 = 1 THEN 'same' WHEN turn % 3 = 2 THEN ' same ' ELSE text END AS raw, trim(raw) AS t FROM utterances) WHERE length(regexp_replace(raw, '[^\p{L}\p{N}]', '', 'g')) > 1) WHERE p IS DISTINCT FROM t""", "utterances")
def noise_and_dup_filter(b):
    k = F.col("turn") % 3
    return views.readable_lines(b.utterances().withColumn("text", F.when(k == 1, "same").when(k == 2, " same ").otherwise(F.col("text")))).select("utterance_id")


@query("SELECT fact_id, s.utterance_id AS source FROM facts f LEFT JOIN (SELECT person_id, max((end_ms, utterance_id))[2] AS utterance_id FROM utterances WHERE is_final AND person_id IS NOT NULL GROUP BY person_id) s ON s.person_id = f.person_id", "facts", "utterances")
def inferred_sources(b):
    return views.inferred_sources(b.facts(), b.utterances())


@query("SELECT promise_id FROM promises WHERE status = 'open' AND due_at > TIMESTAMP '1998-01-15 12:00:01' AND promise_id % 10 <> 0", "promises")
def due_notifications(b):
    p = b.promises()
    return views.due_notifications(p, F.lit("1998-01-15 12:00:00").cast("timestamp_ntz"), p.where("promise_id % 10 = 0")).select("promise_id")


@query("SELECT person_id, name FROM people WHERE person_id = 42", "people")
def point_lookup(b):
    return lookup(b.people(), "person_id", 42).select("person_id", "name")


# scalars


_NORMAL = r"trim(regexp_replace(regexp_replace(lower(strip_accents(lower({0}))), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_NORMAL.format('text')}) AS normalized FROM documents")
def normalize_claim(b):
    return b.raw("documents").select("doc_id", F.md5(text.normalize_claim(F.col("text"))).alias("normalized"))


@query("SELECT promise_id, CASE promise_id % 4 WHEN 0 THEN text WHEN 1 THEN 'remind me: ' || text END AS command FROM promises", "promises")
def wake_command(b):
    k = F.col("promise_id") % 4
    said = F.when(k == 0, F.concat(F.lit("Well, HEY,  Robin! — "), F.col("text"))).when(k == 1, F.concat(F.lit("Hey Robin—remind me: "), F.col("text"))).when(k == 2, F.concat(F.lit("they robinate "), F.col("text"))).otherwise("hey robin ...")
    return b.promises().select("promise_id", text.wake_command(said, "hey robin").alias("command"))


@query("SELECT promise_id, CASE promise_id % 3 WHEN 0 THEN left(text, 80) WHEN 1 THEN text END AS title FROM promises", "promises")
def title_clean(b):
    k = F.col("promise_id") % 3
    return b.promises().select("promise_id", text.clean_title(F.when(k == 0, F.concat(F.lit(' "'), F.col("text"), F.lit('".'))).when(k == 1, F.concat(F.col("text"), F.lit("..."))).otherwise("Untitled Conversation")).alias("title"))


@query("""SELECT event_id, CASE WHEN m <= 0 THEN 'Due now' WHEN m < 60 THEN 'In ' || m || ' min' ELSE CASE d WHEN 0 THEN 'Today' WHEN 1 THEN 'Tomorrow' ELSE CASE WHEN d < 7 THEN 'In ' || d || ' days' ELSE 'Jan ' || day(ts) END END || ', '
    || CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END || ':' || lpad(minute(ts)::VARCHAR, 2, '0') || CASE WHEN hour(ts) >= 12 THEN ' pm' ELSE ' am' END END AS due
    FROM (SELECT event_id, ts, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 60000000.0 + 0.5)::BIGINT AS m, date_diff('day', DATE '2024-01-15', ts::DATE) AS d FROM events)""")
def format_due(b):
    return b.raw("events").select("event_id", dates.format_due(F.col("ts"), now()).alias("due"))


@query("SELECT event_id, CASE WHEN date_trunc('day', ts) + INTERVAL 21 HOUR <= ts THEN date_trunc('day', ts) + INTERVAL 45 HOUR ELSE date_trunc('day', ts) + INTERVAL 21 HOUR END AS tonight, strftime(ts, '%Y-%m-%d') AS today FROM events")
def resolve_tonight(b):
    return b.raw("events").select("event_id", dates.resolve_tonight(F.col("ts")).cast("timestamp_ntz").alias("tonight"), dates.today_iso(F.col("ts")).alias("today"))


@query("SELECT person_id, upper(left(name, 1)) AS initials, CASE WHEN person_id % 2 = 0 THEN name ELSE 'Unknown speaker ' || person_id END AS shown, coalesce(nullif(CASE WHEN person_id % 2 = 0 THEN name ELSE '' END, ''), 'Unknown speaker ' || right(person_id::VARCHAR, 4)) AS label FROM people", "people")
def names_and_labels(b):
    p = b.people()
    blank = F.when(F.col("person_id") % 2 == 0, F.col("name")).otherwise("")
    return p.select("person_id", text.initials(F.col("name")).alias("initials"), text.display_name(blank, F.col("person_id")).alias("shown"), text.speaker_label(blank, F.col("person_id")).alias("label"))


_SAID = ("actually", "nowhere", "no longer", "unchanged", "NOW, it")
_CUED = "list_extract(['" + "', '".join(_SAID) + "'], (utterance_id % 5 + 1)::INT) || ' ' || text"


@query(rf"SELECT utterance_id, regexp_matches({_CUED}, '(?i)\b(?:{'|'.join(text.CHANGE_CUES)})\b') AS cue, upper(left(speaker, 1)) || substr(speaker, 2) || ' rate' AS label FROM utterances", "utterances")
def change_cues(b):
    said = F.concat(F.element_at(F.array(*map(F.lit, _SAID)), (F.col("utterance_id") % 5 + 1).cast("int")), F.lit(" "), F.col("text"))
    return b.utterances().select("utterance_id", text.has_change_cue(said).alias("cue"), text.attribute_label(F.concat("speaker", F.lit("__rate "))).alias("label"))


_HASH = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(name, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_CELLS = " || ".join(f"((g >> {(i // 5 * 3 + min(i % 5, 4 - i % 5)) % 29}) & 1)::VARCHAR" for i in range(25))


@query(f"SELECT person_id, h AS hash, {text.HUES}[h % {len(text.HUES)} + 1]::BIGINT AS hue, {_CELLS} AS cells FROM (SELECT *, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS g FROM (SELECT person_id, {_HASH} AS h FROM people))", "people")
def identicons(b):
    return b.people().select("person_id", text.fnv1a(F.col("name")).alias("hash"), text.identicon_hue(F.col("name")).alias("hue"), F.array_join(F.transform(text.identicon_cells(F.col("name")), lambda x: x.cast("int").cast("string")), "").alias("cells"))


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e) / len(e)), 9) AS rms, round(list_dot_product(e, e) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(e, e))), 9) AS self, len(e) // 2 AS half, round(list_sum(list_transform(range(1, len(e) // 2 + 1), lambda i: i * e[2 * i - 1])), 6) AS resampled FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def sample_arithmetic(b):
    e = F.col("embedding").cast("array<double>")
    lower = numeric.resample(e, 16_000, 8_000)
    total = F.aggregate(F.transform(lower, lambda x, i: (i + 1) * x), F.lit(0.0), lambda s, x: s + x)
    return b.raw("embeddings").select("vec_id", F.round(numeric.rms(e), 9).alias("rms"), F.round(numeric.cosine(e, numeric.normalize(e)), 9).alias("self"), F.size(lower).alias("half"), F.round(total, 6).alias("resampled"))


@query("SELECT event_id, CASE WHEN k IS NULL THEN NULL ELSE k END AS k FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT END AS k FROM events)")
def safe_arguments(b):
    broken = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{oops "), F.col("props"))).otherwise(F.col("props"))
    return b.raw("events").select("event_id", text.safe_args(broken, "k long")["k"].alias("k"))


# writes, sources and rows as callers see them


@query("SELECT person_id::VARCHAR AS _id, name, relationship, is_owner FROM people", "people")
def collection_scan(b):
    """People written as a collection and read under its declared schema; a missing optional field reads as null."""
    base = fresh_folder(b.spark, "collections")
    at = F.timestamp_millis("created_ms")
    p = b.people().select(F.col("person_id").cast("string").alias("_id"), F.lit("owner").alias("owner_id"), "name", at.alias("created_at"), at.alias("updated_at"), "relationship", "is_owner")
    sinks.write_snapshot(p, f"{base}/people")
    return read_table(b.spark, base, "people").select("_id", "name", "relationship", "is_owner")


@query("SELECT conversation_id::VARCHAR AS conversation_id, utterance_id::VARCHAR AS utterance_id, person_id::VARCHAR AS person_id, speaker, md5(text) AS text, start_ms, end_ms FROM utterances", "utterances")
def transcript_read(b):
    """Conversations written as transcripts, one JSON document a line, and read back."""
    turn = F.struct(F.col("utterance_id").cast("string").alias("utterance_id"), F.col("person_id").cast("string").alias("person_id"), "speaker", "text", "start_ms", "end_ms")
    path = fresh_folder(b.spark, "transcripts")
    b.utterances().groupBy(F.col("conversation_id").cast("string").alias("conversation_id")).agg(F.collect_list(turn).alias("utterances")).write.json(path)
    return read_transcript(b.spark, path, lines=True).withColumn("text", F.md5("text"))


@query("SELECT utterance_id, person_id, text FROM (SELECT utterance_id, person_id, text FROM utterances UNION ALL VALUES (-1::BIGINT, 7::BIGINT, 'hello'), (-2, NULL, ''))", "utterances")
def injected_rows(b):
    return inject(b.utterances().select("utterance_id", "person_id", "text"), [(-1, 7, "hello"), (-2, None, "")])


@query("""SELECT (n * 3 + i)::BIGINT AS seq, type, ((t + n * 1000) // 2)::BIGINT AS at_ms FROM (VALUES (0, 'utterance', 0), (1, 'fact', 400), (2, 'promise', 900)) v(i, type, t), (SELECT unnest(range(3)) AS n)""")
def scripted_events(b):
    """A script of three events at double speed, three times, with a pause."""
    script = [{"type": "utterance", "at_ms": 0}, {"type": "promise", "at_ms": 900}, {"type": "fact", "at_ms": 400}]
    return event_script(b.spark, script, speed=2, loops=3, pause_ms=100).select("seq", "type", "at_ms")


@query(f"""SELECT * FROM (SELECT 'promise' AS kind, promise_id AS id, person_id, text, 0.5::DOUBLE AS score FROM promises WHERE status = 'open' AND person_id = 7 AND regexp_matches(text, '{_PATTERN}') ORDER BY promise_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'utterance', utterance_id, person_id, text, 0.25::DOUBLE FROM utterances WHERE person_id = 7 AND regexp_matches(text, '{_PATTERN}') ORDER BY utterance_id LIMIT 5)""", "promises", "utterances")
def person_scope(b):
    """A search of one person's rows; without a person it is lexical_or_regex."""
    return retrieval.search_text(_ASK, b.promises(), b.utterances(), person=7)


@query("SELECT utterance_id, turn % 2 = 0 AND coalesce(person_id = 0, false) AND utterance_id % 11 <> 3 AND utterance_id % 10 >= 6 AS allowed FROM utterances", "utterances")
def wake_gate(b):
    """A command, the owner's, in a voice known well enough; what is missing fails."""
    command = F.when(F.col("turn") % 2 == 0, F.col("text"))
    confidence = F.when(F.col("utterance_id") % 11 != 3, (F.col("utterance_id") % 10) / 10)
    return b.utterances().select("utterance_id", identity.wake_allowed(command, F.col("person_id"), F.lit(0), confidence).alias("allowed"))


@query("SELECT voiceprint_id, person_id, duration_ms::BIGINT AS duration_ms FROM voiceprints", "voiceprints")
def public_rows(b):
    return views.public_row(b.voiceprints())


@query("SELECT DISTINCT conversation_id FROM utterances WHERE person_id = 7", "utterances")
def conversations_of_person(b):
    talks = b.utterances().groupBy("conversation_id").agg(F.collect_set("person_id").alias("participant_ids"))
    return views.conversations_of(talks, F.lit(7).cast("long")).select("conversation_id")


@query("SELECT fact_id, person_id, valid_from, row_number() OVER (ORDER BY valid_from DESC, fact_id DESC) AS place FROM facts WHERE superseded_by IS NULL", "facts")
def recent_facts(b):
    return placed(facts.recent(b.facts()).select("fact_id", "person_id", "valid_from"))


@query("SELECT *, row_number() OVER (ORDER BY started_at DESC, conversation_id) AS place FROM (SELECT conversation_id, max(end_ms)::BIGINT AS started_at FROM utterances GROUP BY conversation_id)", "utterances")
def conversations_by_start(b):
    talks = b.utterances().groupBy("conversation_id").agg(F.max("end_ms").alias("started_at"))
    return placed(_api(b).list_conversations(talks))


@query("SELECT utterance_id, start_ms, text, row_number() OVER (ORDER BY start_ms, utterance_id) AS place FROM utterances WHERE conversation_id = 7", "utterances")
def conversation_lines(b):
    return placed(_api(b).list_utterances(7).select("utterance_id", "start_ms", "text"))


def _api(b) -> Memory:
    return Memory(b.people(), b.facts(), b.promises(), b.utterances())


@query("SELECT person_id, name, row_number() OVER (ORDER BY lower(name), person_id) AS place FROM (SELECT person_id, CASE person_id % 3 WHEN 0 THEN name WHEN 1 THEN lower(name) ELSE upper(name) END AS name FROM people)", "people")
def people_by_locale(b):
    """Names that differ in case stand together, unlike in the order of bytes."""
    k = F.col("person_id") % 3
    named = b.people().withColumn("name", F.when(k == 0, F.col("name")).when(k == 1, F.lower("name")).otherwise(F.upper("name")))
    return placed(views.people_by_name(named, locale=True).select("person_id", "name"))


@query(f""", m AS ({_MERGES}), pe AS (SELECT person_id, created_ms, CASE WHEN person_id % 4 = 1 THEN name ELSE '  ' END AS name FROM people), g AS (
    SELECT merge_id, min((p.created_ms, p.person_id)) AS f FROM m JOIN pe p ON p.person_id = m.person_id GROUP BY merge_id HAVING count(*) >= 2),
    map AS (SELECT m.person_id AS old_id, f[2] AS new_id FROM m JOIN g ON m.merge_id = g.merge_id JOIN pe ON pe.person_id = m.person_id WHERE m.person_id <> f[2]),
    nm AS (SELECT new_id, arg_min(name, (created_ms, person_id)) AS inherited FROM map JOIN pe ON person_id = old_id WHERE trim(name) <> '' GROUP BY new_id)
    SELECT person_id, coalesce(nullif(trim(name), ''), inherited, name) AS name FROM pe LEFT JOIN nm ON new_id = person_id WHERE person_id NOT IN (SELECT old_id FROM map)""", "people")
def merge_people_inherit(b):
    """Missing people are ignored, and a survivor without a name takes the first one of those merged."""
    p, m = _merge(b, strict=False)
    p = p.withColumn("name", F.when(F.col("person_id") % 4 == 1, F.col("name")).otherwise("  "))
    return identity.merge_people(p, {}, m, inherit_name=True)[0].select("person_id", "name")


_CONFIDENCE = """, k AS (SELECT conversation_id, utterance_id, start_ms, CASE WHEN turn % 3 = 0 THEN (utterance_id % 10) / 10.0::DOUBLE END AS c FROM utterances)"""


@query(_CONFIDENCE + " SELECT utterance_id, coalesce(c, 0) AS confidence, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY start_ms, utterance_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k", "utterances")
def owner_confidence(b):
    """The owner's confidence by utterance, and as it was known before each one."""
    u = b.utterances()
    gate = u.where("turn % 3 = 0").select(F.col("utterance_id").alias("query_id"), ((F.col("utterance_id") % 10) / 10).alias("confidence"))
    before = identity.owner_confidence(u, gate, lagged=True).select("utterance_id", F.col("confidence").alias("before"))
    return identity.owner_confidence(u, gate).select("utterance_id", "confidence").join(before, "utterance_id")


@query("SELECT utterance_id, md5(text || CASE WHEN utterance_id % 4 = 0 THEN '!' ELSE '' END) AS text FROM utterances", "utterances")
def replayed_poll(b):
    """Rows that are polled again and again, some revised, are one row for each id."""
    u = b.utterances().select("utterance_id", "text", F.lit(1).alias("poll"))
    again = u.where("utterance_id % 4 = 0").withColumns({"text": F.concat("text", F.lit("!")), "poll": F.lit(2)})
    rows = u.unionByName(u.withColumn("poll", F.lit(0))).unionByName(again)
    return sinks.latest(rows, ["utterance_id"], [F.col("poll")]).select("utterance_id", F.md5("text").alias("text"))


@query(f"SELECT doc_id, contains({_NORMAL.format('text')}, 'the data') AS found FROM documents")
def phrase_contained(b):
    return b.raw("documents").select("doc_id", text.contains_phrase(F.col("text"), F.lit(" The,  DÁTA!")).alias("found"))


_SLOTS = ("move_date", "food_preference", "work", "recent_trip", "job", "birthday")


@query("SELECT event_id, (['move', 'preference', 'job', 'travel', 'job', 'birthday'])[event_id % 6 + 1] AS slot, (['move,move_date', 'food_preference,preference', 'job,work', 'recent_trip,travel', 'job,work', 'birthday'])[event_id % 6 + 1] AS names FROM events")
def attribute_slots(b):
    name = F.element_at(F.array(*map(F.lit, _SLOTS)), (F.col("event_id") % 6 + 1).cast("int"))
    names = F.element_at(F.array(*[F.lit(",".join(sorted(text.attribute_aliases(a)))) for a in _SLOTS]), (F.col("event_id") % 6 + 1).cast("int"))
    return b.raw("events").select("event_id", text.canonical_attribute(name).alias("slot"), names.alias("names"))


@query("""SELECT fact_id, 'That changed: ' || claim || '.' || CASE fact_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' I found 1 related open loop worth reviewing.' ELSE ' I found 2 related open loops worth reviewing.' END AS reply FROM candidates""", "candidates")
def live_replies(b):
    return b.candidates().select("fact_id", text.live_reply(F.concat(F.lit(" "), "claim", F.lit("!?.")), F.col("fact_id") % 3).alias("reply"))


@query(f"SELECT fact_id, 'spoken-' || attribute || '-' || coalesce(superseded_by::VARCHAR, 'initial') AS spoken, 'note-' || left({_NORMAL.format('claim')}, 60) AS note FROM facts", "facts")
def source_keys(b):
    return b.facts().select("fact_id", text.spoken_key(F.col("attribute"), F.col("superseded_by")).alias("spoken"), text.note_key(F.col("claim")).alias("note"))


@query("SELECT trial_id, round(greatest(-1, least(1, 2 * (score * 1.2::DOUBLE) - 1)), 9) AS cosine, floor(trial_id * 37 / 16000.0::DOUBLE * 1000 + 0.5)::BIGINT AS ms FROM trials", "trials")
def score_and_clock_arithmetic(b):
    """Cosines back from index scores (some out of range), and milliseconds of sample counts."""
    return b.trials().select("trial_id", F.round(numeric.raw_cosine(F.col("score") * 1.2), 9).alias("cosine"), numeric.ms_of_samples(F.col("trial_id") * 37).alias("ms"))


_CODES = "list_transform(list_transform(embedding::DOUBLE[], lambda x: greatest(-1, least(1, 3 * x))), lambda x: floor(CASE WHEN x < 0 THEN x * 32768 ELSE x * 32767 END + 0.5)::INT)"


@query(f"SELECT vec_id, array_to_string({_CODES}, ',') AS codes, round(list_sum(list_transform({_CODES}, lambda x: x / 32768.0::DOUBLE)), 9) AS total, array_to_string(({_CODES})[1 + vec_id % 50:ceil((vec_id % 70 + 0.5) / 1000 * 1000)::BIGINT], ',') AS cut FROM embeddings")
def sample_codes(b):
    """Samples as 16-bit numbers (some clipped), back as fractions, and a time span of them at 1000 a second."""
    i = F.col("vec_id")
    e = b.raw("embeddings").select("vec_id", numeric.float_to_int16(F.transform(F.col("embedding").cast("array<double>"), lambda x: 3 * x)).alias("codes"))
    text_of = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    total = F.aggregate(numeric.int16_to_float(F.col("codes")), F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", text_of("codes").alias("codes"), F.round(total, 9).alias("total"), text_of(numeric.slice_pcm(F.col("codes"), i % 50 + 0.5, i % 70 + 0.5, 1000)).alias("cut"))


@query("SELECT doc_id, coalesce(strlen(text) > 0 AND strlen(text) % 4 = 0, false) AS whole FROM documents")
def whole_pcm(b):
    return b.raw("documents").select("doc_id", audio.valid_pcm(F.col("text").cast("binary")).alias("whole"))


@query("""SELECT event_id, 'data: {"event_id":' || event_id || ',"type":"' || event_type || '"}' || chr(10) || chr(10) AS line FROM events""")
def sse_lines(b):
    return b.raw("events").select("event_id", text.sse_line(F.struct("event_id", F.col("event_type").alias("type"))).alias("line"))


@query("SELECT conversation_id, string_agg(utterance_id::VARCHAR, ',' ORDER BY utterance_id) AS ids, md5(arg_min(text, utterance_id)) AS first_text FROM utterances GROUP BY conversation_id", "utterances")
def keyed_rows(b):
    m = views.keyed(b.utterances().select("conversation_id", "utterance_id", "text"), "conversation_id", "utterance_id")
    keys = F.array_sort(F.map_keys("by_id"))
    return m.select("conversation_id", F.array_join(F.transform(keys, lambda x: x.cast("string")), ",").alias("ids"), F.md5(F.element_at("by_id", F.element_at(keys, 1))["text"]).alias("first_text"))


@query("SELECT promise_id FROM promises WHERE promise_id % 3 = 0 AND status <> 'open'", "promises")
def cancelled_notifications(b):
    p = b.promises()
    return views.cancelled_notifications(p.where("promise_id % 3 = 0").select("promise_id"), p).select("promise_id")


@query("""SELECT promise_id AS draft_id, x.name AS to_name, f.claim AS "to", promise_id % 2 = 0 AND f.claim IS NOT NULL AS sent FROM promises p LEFT JOIN people x ON x.person_id = p.person_id
    LEFT JOIN (SELECT person_id, claim, row_number() OVER (PARTITION BY person_id ORDER BY valid_from DESC, fact_id DESC) AS n FROM facts WHERE attribute = 'click' AND superseded_by IS NULL) f ON f.person_id = p.person_id AND n = 1""", "promises", "people", "facts")
def email_drafts(b):
    """A draft for every promise; every other one is sent, if there is an address."""
    asked = b.promises().select(F.col("promise_id").alias("draft_id"), "person_id", F.lit("s").alias("subject"), F.col("text").alias("body"), "created_at")
    drafts = sinks.create_drafts(asked, b.people(), b.facts(), "click")
    wanted = asked.where("draft_id % 2 = 0")
    return sinks.send_drafts(drafts, wanted.unionByName(wanted), now()).select("draft_id", "to_name", "to", F.col("sent_at").isNotNull().alias("sent"))


@query(f"""SELECT 1::BIGINT AS query_id, 'said' AS text, string_agg(kind || ':' || id, ',' ORDER BY place) AS citations FROM ({_MEMORY}) WHERE place % 2 = 1
    UNION ALL SELECT 2, '{retrieval.NO_EVIDENCE}', ''""", "facts", "promises", "utterances")
def answers(b):
    """A question with evidence, half of which is cited, and one without."""
    m = _memory(b).withColumn("query_id", F.lit(1).cast("long"))
    asked = b.spark.range(1, 3).toDF("query_id")
    said = asked.select("query_id", F.lit("said").alias("text")).join(m.where("place % 2 = 1").groupBy("query_id").agg(F.collect_list(F.concat_ws(":", "kind", "id")).alias("used")), "query_id", "left")
    return _flat(retrieval.answers(asked, m.where("place % 2 = 1 OR id NOT IN (-1)"), said))


_MINTING = """RECURSIVE , q AS (SELECT voiceprint_id AS query_id, duration_ms AS speech, voiceprint_id // 400 AS session, row_number() OVER (PARTITION BY voiceprint_id // 400 ORDER BY voiceprint_id) AS n FROM voiceprints WHERE voiceprint_id % 50 = 0),
    known AS (SELECT query_id, list({'far': -cosine, 'minted': 0, 'rank': rank, 'person': CASE WHEN person_id IN (SELECT person_id FROM people WHERE person_id % 9 <> 4) THEN person_id::VARCHAR END} ORDER BY rank) AS known FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, voiceprint_id) AS rank FROM cos WHERE voiceprint_id % 50 <> 0) WHERE rank <= 3 GROUP BY query_id),
    met AS (SELECT query_id, list({'m': voiceprint_id, 'c': cosine}) AS met FROM cos WHERE voiceprint_id % 50 = 0 GROUP BY query_id),
    r AS (SELECT session, 0::BIGINT AS n, []::BIGINT[] AS minted, NULL::BIGINT AS query_id, NULL::VARCHAR AS kind, NULL::VARCHAR AS person_id FROM (SELECT DISTINCT session FROM q)
      UNION ALL
      SELECT session, n, CASE WHEN kind = 'new' THEN list_append(minted, query_id) ELSE minted END, query_id, kind, CASE kind WHEN 'new' THEN 'person-' || query_id WHEN 'match' THEN fits[1].person END FROM (
        SELECT *, CASE WHEN speech < 3000 THEN 'pending' WHEN len(fits) = 0 THEN 'new' ELSE 'match' END AS kind FROM (
          SELECT r.session, q.n, r.minted, q.query_id, q.speech, list_filter(list_sort(list_concat(k.known, list_transform(list_filter(m.met, lambda x: list_contains(r.minted, x.m)),
            lambda x: {'far': -x.c, 'minted': 1, 'rank': list_position(r.minted, x.m)::BIGINT, 'person': 'person-' || x.m})))[1:3], lambda x: x.far <= -0.3 AND x.person IS NOT NULL) AS fits
          FROM r JOIN q ON q.session = r.session AND q.n = r.n + 1 JOIN known k ON k.query_id = q.query_id JOIN met m ON m.query_id = q.query_id)))
    SELECT query_id, kind, person_id FROM r WHERE query_id IS NOT NULL"""


def _speech(b):
    """The stated query set as speech of sessions, in order, one for each 400 prints."""
    i = F.col("voiceprint_id")
    return b.voiceprints().where("voiceprint_id % 50 = 0").select(F.expr("voiceprint_id DIV 400").alias("session"), i.alias("seq"), i.alias("query_id"), F.col("embedding").alias("query"), F.col("duration_ms").alias("speech_ms"))


@query(_MINTING, "cos", "people")
def attribute_minting(b):
    """New voices become people that the session's later ones can match."""
    return identity.attribute_minting(_speech(b), b.voiceprints().where("voiceprint_id % 50 <> 0"), b.people().where("person_id % 9 <> 4"), "session", threshold=0.3)


@query(_MINTING + " AND kind <> 'pending'", "cos", "people")
def live_attribution(b):
    """The same by the stream: speech arrives in four parts, is met with the index, and decided on in keyed state; restarts lie between."""
    index = VectorIndex.build(b.voiceprints().where("voiceprint_id % 50 <> 0"), fresh_folder(b.spark, "live-attribution"), "voiceprint_id", tag="person_id")
    speech = _speech(b).select(F.col("session").alias("conversation_id"), F.col("query_id").alias("cluster_id"), "seq", F.timestamp_seconds(F.col("seq") % 400 + 86_400).alias("at"), "speech_ms", "query", F.lit(False).alias("ending"))
    people = b.people().where("person_id % 9 <> 4")
    parts = [speech.where(F.expr("seq DIV 50 % 8 DIV 2") == part) for part in range(4)]
    return in_parts(b, "live-speech", parts, lambda s: live.attribute_live(s, index, people, threshold=0.3)).select(F.col("cluster_id").cast("long").alias("query_id"), "kind", "person_id")


# streams


@query("""SELECT conversation_id, (pos // 100)::BIGINT AS frame, 100::BIGINT AS n, round(sum(x), 4) AS total FROM (SELECT conversation_id, x, row_number() OVER (PARTITION BY conversation_id ORDER BY vec_id, i) - 1 AS pos FROM (
    SELECT vec_id // 50 AS conversation_id, vec_id, unnest(e) AS x, unnest(range(len(e))) AS i FROM (SELECT vec_id, embedding[1:vec_id % 64 + 1]::DOUBLE[] AS e FROM embeddings))) GROUP BY ALL HAVING count(*) = 100""")
def frame_packetizer(b):
    chunks = b.raw("embeddings").select(F.expr("vec_id DIV 50").alias("conversation_id"), F.col("vec_id").alias("seq"), F.slice("embedding", 1, (F.col("vec_id") % 64 + 1).cast("int")).alias("samples"))
    out = audio.packetize(chunks, size=100)
    total = F.aggregate(F.col("samples").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return out.select("conversation_id", "frame", F.size("samples").alias("n"), F.round(total, 4).alias("total"))


def _events(b):
    """Utterances, facts and promises as events on the bus, in a fixed order of arrival."""
    u = b.utterances().select((F.col("utterance_id") * 3).alias("seq"), F.lit("utterance").alias("type"), F.col("conversation_id").cast("string").alias("conversation_id"), F.col("utterance_id").cast("string").alias("utterance_id"),
                              F.col("person_id").cast("string").alias("person_id"), "text", "start_ms", "end_ms", "is_final")
    again = u.where("seq % 2 = 0").withColumns({"seq": F.col("seq") + 1, "text": F.concat("text", F.lit("!")), "person_id": F.lit(None).cast("string")})
    missing = {"voiceprint_id": F.lit(None).cast("string"), "utterance_ids": F.lit(None).cast("array<string>")}
    return u.unionByName(again).withColumns(missing)


@query("SELECT utterance_id::VARCHAR AS utterance_id, person_id::VARCHAR AS person_id, md5(CASE WHEN (utterance_id * 3) % 2 = 0 THEN text || '!' ELSE text END) AS text FROM utterances", "utterances")
def event_reducer(b):
    return reducer.utterance_state(_events(b)).select("utterance_id", "person_id", F.md5("text").alias("text"))


def _ts_events(b):
    return b.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling(b):
    return streams.tumbling(_ts_events(b)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') - INTERVAL 12 HOUR]) AS window_start FROM events) GROUP BY ALL""")
def sliding(b):
    return streams.sliding(_ts_events(b)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, s""")
def session(b):
    s = streams.sessions(_ts_events(b))
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("""SELECT conversation_id, turn::BIGINT AS seq, row_number() OVER w AS number, CASE WHEN length(text) % 7 <> 0 THEN (sum(CASE WHEN length(text) % 7 <> 0 THEN length(text) ELSE 0 END) OVER w)::VARCHAR END AS result, length(text) % 7 = 0 AS failed
    FROM utterances WINDOW w AS (PARTITION BY conversation_id ORDER BY turn)""", "utterances")
def serial_chain(b):
    """Every conversation's turns as a chain of work that fails on some of them, as a stream in two parts."""
    turns = b.utterances().select("conversation_id", F.col("turn").cast("long").alias("seq"), "text")

    def work(memory, said):
        if len(said) % 7 == 0:
            raise ValueError(said)
        total = str(int(memory or 0) + len(said))
        return total, total

    out = in_parts(b, "serial-chain", [turns.where("seq < 3"), turns.where("seq >= 3")], lambda s: chains.chained(s, work))
    return out.select(F.col("conversation_id").cast("long").alias("conversation_id"), "seq", "number", "result", F.col("error").isNotNull().alias("failed"))


@query("""SELECT owner_id, min(event_id) AS first_seq, max(event_id) AS last_seq, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY owner_id ORDER BY ts, event_id) AS batch FROM (
    SELECT user_id AS owner_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events)) GROUP BY owner_id, batch""")
def debounced_batches(b):
    """Each user's events in batches that a pause of six hours ends; a last event of somebody else makes the last pauses known."""
    events = b.raw("events").select(F.col("user_id").alias("owner_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("at"))
    last = events.agg((F.max("at") + F.expr("INTERVAL 2 DAYS")).alias("at")).select(F.lit(-1).cast("long").alias("owner_id"), F.lit(0).cast("long").alias("seq"), F.lit("end").alias("text"), "at")
    return in_parts(b, "debounced", [events, last], lambda s: chains.debounced(s, 6 * 3_600_000)).where("owner_id <> '-1'").select(F.col("owner_id").cast("long").alias("owner_id"), "first_seq", "last_seq", "n")


@query("""SELECT vec_id, 16000::BIGINT AS sample_rate, len(c)::BIGINT AS n, list_sum(list_transform(range(1, len(c) + 1), lambda i: i * c[i]))::BIGINT AS codes FROM (
    SELECT vec_id, list_transform(embedding, lambda x: floor(CASE WHEN greatest(-1, least(1, 9 * x::DOUBLE)) < 0 THEN greatest(-1, 9 * x::DOUBLE) * 32768 ELSE least(1, 9 * x::DOUBLE) * 32767 END + 0.5)::BIGINT) AS c FROM embeddings)""")
def wav_round_trip(b):
    """Clips, some of them too loud, written as WAV bytes and parsed again; the codes by their places."""
    clips = b.raw("embeddings").select("vec_id", F.transform("embedding", lambda x: 9 * x.cast("double")).alias("samples"))

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            got = [audio.parse_wav(w) for w in batch.column(1).to_pylist()]
            cols = [[rate for rate, _ in got], [len(x) for _, x in got], [int((x.astype("f8") * 32768).astype("i8") @ range(1, len(x) + 1)) for _, x in got]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols]], ["vec_id", "sample_rate", "n", "codes"])

    return audio.wav_files(clips).select("vec_id", "wav").mapInArrow(parse, "vec_id long, sample_rate long, n long, codes long")


@query("""SELECT conversation_id, count(*) AS frames, count(*) FILTER (bad) AS bad_sizes, round(count(*) / 10.0, 3)::DOUBLE AS audio_seconds, round(max(peak), 6) AS peak, round(sqrt(sum(energy) / sum(n)), 6) AS rms,
    CASE WHEN count(*) FILTER (bad) > 0 THEN 'bad frame sizes' WHEN max(peak) > 0.0005 THEN 'ok' ELSE 'silent' END AS verdict FROM (
    SELECT vec_id // 50 AS conversation_id, vec_id % 199 = 7 AS bad, CASE WHEN vec_id // 50 % 3 = 2 THEN 0 ELSE list_max(list_transform(e, lambda x: abs(x))) END AS peak,
      k * CASE WHEN vec_id // 50 % 3 = 2 THEN 0 ELSE list_sum(list_transform(e, lambda x: x * x)) END AS energy, k * len(e) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN vec_id % 199 = 7 THEN 24 ELSE 25 END AS k FROM embeddings)) GROUP BY conversation_id""")
def uplink_report(b):
    """Messages of 64 samples, repeated to a frame; some are a piece short, a third of the conversations is silent."""
    quiet, short = F.expr("vec_id DIV 50 % 3 = 2"), F.col("vec_id") % 199 == 7

    def packed(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            raw = [np.tile(np.array(x, "<f4"), k).tobytes() for x, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["conversation_id", "raw"])

    said = b.raw("embeddings").select(F.expr("vec_id DIV 50").alias("conversation_id"), F.when(quiet, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("x"), F.when(short, 24).otherwise(25).alias("k"))
    r = audio.uplink_report(said.mapInArrow(packed, "conversation_id long, raw binary"))
    return r.select("conversation_id", "frames", "bad_sizes", F.round("audio_seconds", 3).alias("audio_seconds"), F.round("peak", 6).alias("peak"), F.round("rms", 6).alias("rms"), "verdict")


@query("""SELECT 'print' AS kind, voiceprint_id::VARCHAR AS id, CASE WHEN voiceprint_id % 20 = 0 THEN 100000 + voiceprint_id ELSE person_id END AS person_id, NULL AS name FROM voiceprints WHERE voiceprint_id % 5 <> 1
    UNION ALL SELECT 'person', person_id::VARCHAR, person_id, name FROM people UNION ALL SELECT 'person', (100000 + voiceprint_id)::VARCHAR, 100000 + voiceprint_id, CASE WHEN voiceprint_id % 40 = 0 THEN 'Guest ' || voiceprint_id ELSE 'Unknown' END FROM voiceprints WHERE voiceprint_id % 20 = 0""", "voiceprints", "people")
def enroll_voices(b):
    """A fifth of the prints is enrolled, a quarter of these without a person, which makes one."""
    v = b.voiceprints().select("voiceprint_id", "person_id", "embedding", F.col("voiceprint_id").alias("real"))
    fresh = v.where("voiceprint_id % 5 = 0").withColumn("name", F.when(F.col("voiceprint_id") % 40 == 0, F.concat(F.lit("Guest "), F.col("voiceprint_id").cast("string"))))
    fresh = fresh.withColumns({"person_id": F.when(F.col("voiceprint_id") % 20 != 0, F.col("person_id")), "voiceprint_id": F.when(F.col("voiceprint_id") % 20 == 0, F.col("voiceprint_id") + 100_000).otherwise(F.col("voiceprint_id"))})
    prints, people = identity.enroll(v.where("voiceprint_id % 5 > 1"), b.people(), fresh, 64)
    return prints.select(F.lit("print").alias("kind"), F.col("real").cast("string").alias("id"), "person_id", F.lit(None).cast("string").alias("name")).unionByName(people.select(F.lit("person").alias("kind"), F.col("person_id").cast("string").alias("id"), "person_id", "name"))


@query(_BM25 + _LEGS + " " + _FUSED.format(sem="SELECT doc_id, row_number() OVER (ORDER BY s) AS s FROM (SELECT * FROM sem WHERE s <= 10) WHERE doc_id % 3 <> 0 AND doc_id IN (SELECT doc_id FROM documents)", lex="SELECT NULL::BIGINT AS doc_id, NULL::BIGINT AS l WHERE false", where=""), "cos")
def rrf_fallback(b):
    """The lexical leg plans, and fails when it runs: what is left is the semantic leg of the manual path."""
    alive, sem, lex = _legs(b)
    failing = lex.withColumn("score", F.when(F.col("score") > -1, F.raise_error("index is gone").cast("double")))
    return retrieval.search_or_fall_back(alive, sem, lambda: failing).select("fact_id", F.round("score", 9).alias("score"))


@query("SELECT conversation_id, seq, speaker FROM (SELECT conversation_id, turn::BIGINT AS seq, speaker, lag(speaker) OVER (PARTITION BY conversation_id ORDER BY turn) AS before FROM utterances) WHERE before IS DISTINCT FROM speaker", "utterances")
def changed_drafts(b):
    """What differs from the last emission of its key, as a stream in two parts."""
    rows = b.utterances().select("conversation_id", F.col("turn").cast("long").alias("seq"), "speaker")
    return in_parts(b, "changed", [rows.where("seq < 2"), rows.where("seq >= 2")], lambda s: streams.changed_only(s, "conversation_id", "speaker"))


@query("SELECT DISTINCT conversation_id, speaker AS cluster_id FROM utterances", "utterances")
def pending_once(b):
    """Announcements of speakers, each once over two parts of a stream."""
    rows = b.utterances().select("conversation_id", F.col("speaker").alias("cluster_id"), F.col("turn").cast("long").alias("seq"))
    return in_parts(b, "pending", [rows.where("seq < 2"), rows.where("seq >= 2")], streams.announce_once).select("conversation_id", "cluster_id")


@query("""RECURSIVE , sp AS (SELECT conversation_id::VARCHAR || ':' || speaker AS cluster_id, turn::BIGINT AS seq, (sum(end_ms - start_ms) OVER (PARTITION BY conversation_id, speaker ORDER BY turn))::BIGINT AS speech_ms, turn = max(turn) OVER (PARTITION BY conversation_id, speaker) AS ending, row_number() OVER (PARTITION BY conversation_id, speaker ORDER BY turn) AS n FROM utterances),
    r AS (SELECT cluster_id, 0::BIGINT AS n, 0::BIGINT AS done, 0::BIGINT AS upto, false AS over, false AS tried, false AS final FROM (SELECT DISTINCT cluster_id FROM sp)
      UNION ALL SELECT cluster_id, n, CASE WHEN tried THEN done + 1 ELSE done END, CASE WHEN tried THEN speech_ms ELSE upto END, over OR (tried AND fin), tried, fin FROM (
        SELECT r.cluster_id, sp.n, r.done, r.upto, r.over, sp.speech_ms, sp.ending OR r.done >= 3 AS fin, NOT r.over AND sp.speech_ms >= 3000 AND (sp.ending OR r.done >= 3 OR sp.speech_ms - r.upto >= 3000) AS tried
        FROM r JOIN sp ON sp.cluster_id = r.cluster_id AND sp.n = r.n + 1))
    SELECT cluster_id, done AS attempt, upto AS speech_ms, final FROM r WHERE tried""", "utterances")
def retry_attempts(b):
    """When voices that stay ambiguous are tried, by the speech so far, as a stream in two parts."""
    w = Window.partitionBy("conversation_id", "speaker")
    spoken = F.sum(F.col("end_ms") - F.col("start_ms")).over(w.orderBy("turn")).cast("long")
    rows = b.utterances().select(F.concat_ws(":", "conversation_id", "speaker").alias("cluster_id"), F.col("turn").cast("long").alias("seq"), spoken.alias("speech_ms"), (F.col("turn") == F.max("turn").over(w)).alias("ending"))
    return in_parts(b, "retries", [rows.where("seq < 3"), rows.where("seq >= 3")], streams.retry_gate)


_OWNERS = """RECURSIVE , ev AS (SELECT user_id::VARCHAR AS owner_id, event_id AS seq, event_type IN ('click', 'view', 'signup') AS said, (event_id % 3)::VARCHAR AS person_id, event_id * 700 AS at_ms FROM events),
    cand AS (SELECT owner_id, seq, at_ms, person_id, (SELECT max_by(struct_pack(seq := c.seq, at_ms := c.at_ms), c.seq) FROM ev c WHERE c.said AND c.owner_id = f.owner_id AND c.person_id = f.person_id AND c.seq < f.seq) AS cue FROM ev f WHERE NOT said),
    fit AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY seq) AS n FROM (SELECT owner_id, seq, at_ms, person_id, cue.seq AS cue FROM cand WHERE cue IS NOT NULL AND at_ms - cue.at_ms <= 30000)),
    r AS (SELECT owner_id, 0::BIGINT AS n, -1000000000::BIGINT AS last, []::BIGINT[] AS used, NULL::BIGINT AS seq, false AS told FROM (SELECT DISTINCT owner_id FROM fit)
      UNION ALL SELECT owner_id, n, CASE WHEN told THEN at_ms ELSE last END, CASE WHEN told THEN list_append(used, cue) ELSE used END, seq, told FROM (
        SELECT f.owner_id, f.n, f.at_ms, f.cue, f.seq, r.last, r.used, f.at_ms - r.last >= 10000 AND NOT list_contains(r.used, f.cue) AS told FROM r JOIN fit f ON f.owner_id = r.owner_id AND f.n = r.n + 1))
    SELECT r.owner_id, r.seq::VARCHAR AS fact_id, person_id, at_ms FROM r JOIN fit f ON f.owner_id = r.owner_id AND f.seq = r.seq WHERE told"""


@query(_OWNERS.replace("RECURSIVE ,", "WITH RECURSIVE"))
def live_context(b):
    """Users are owners; each of their events is a cue or a fact about one of three people."""
    e = b.raw("events")
    said = F.col("event_type").isin("click", "view", "signup")
    rows = e.select(
        F.col("user_id").cast("string").alias("owner_id"), F.col("event_id").alias("seq"), F.when(said, "utterance").otherwise("fact").alias("type"), (F.col("event_id") % 3).cast("string").alias("person_id"),
        F.when(said, "actually, now").alias("text"), F.lit(True).alias("is_final"), F.lit("move").alias("attribute"), F.col("event_id").cast("string").alias("fact_id"), F.lit("x").alias("superseded_fact_id"), (F.col("event_id") * 700).alias("at_ms"),
    )
    return streams.live_context(rows)
