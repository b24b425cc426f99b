"""Structured Streaming forms of the stateful rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import ACTIONABLE, has_change_cue


def replay(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def finalize(words: DataFrame, delay: str = "300 milliseconds", width: str = "1 second") -> DataFrame:
    """Counts and ends of words per conversation and window, emitted once the watermark (the holdback) has passed."""
    return words.withWatermark("ts", delay).groupBy("conversation_id", F.window("ts", width)).agg(F.count(F.lit(1)).alias("words"), F.max("ts").alias("last"))


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    return _windowed(events, F.window("ts", width), late)


def sliding(events: DataFrame, width: str = "1 day", step: str = "12 hours", late: str | None = None) -> DataFrame:
    return _windowed(events, F.window("ts", width, step), late)


def _windowed(events: DataFrame, window, late: str | None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    out = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def changed_only(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows (key, seq, value) whose value differs from the last one emitted for the key: drafts are not repeated."""
    kind = rows.schema[key].dataType.simpleString()

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(batches).sort_values("seq").itertuples(index=False):
            if getattr(r, value) != last:
                last = getattr(r, value)
                out.append((k[0], r.seq, last))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "seq", value])

    return rows.select(key, "seq", value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, seq long, {value} string", f"{value} string", "append", GroupStateTimeout.NoTimeout)


def pcm_clock(messages: DataFrame, frame_bytes: int = 6400, frame_ms: int = 100) -> DataFrame:
    """conversation_id, seq, position_ms of the frames of a stream (conversation_id, seq, raw): only whole frames move the clock."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState):
        n = state.get[0] if state.exists else 0
        ok = pd.concat(batches).sort_values("seq")
        ok = ok[ok["size"] == frame_bytes]
        state.update((n + len(ok),))
        yield pd.DataFrame({"conversation_id": k[0], "seq": ok["seq"], "position_ms": [(n + i) * frame_ms for i in range(len(ok))]}).astype({"position_ms": "int64"})

    kind = messages.schema["conversation_id"].dataType.simpleString()
    sized = messages.select("conversation_id", "seq", F.octet_length("raw").alias("size"))
    return sized.groupBy("conversation_id").applyInPandasWithState(step, f"conversation_id {kind}, seq long, position_ms long", "n long", "append", GroupStateTimeout.NoTimeout)


def announce_once(pending: DataFrame) -> DataFrame:
    """One announcement per cluster."""
    return pending.dropDuplicates(["conversation_id", "cluster_id"])


def every_nth_final(utterances: DataFrame, n: int = 25) -> DataFrame:
    """conversation_id, number: a slow pass is due at each n-th final utterance of a conversation."""

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState):
        before = state.get[0] if state.exists else 0
        after = before + sum(int(b["is_final"].sum()) for b in batches)
        state.update((after,))
        yield pd.DataFrame({"conversation_id": k[0], "number": [i for i in range(before + 1, after + 1) if i % n == 0]}).astype({"number": "int64"})

    return utterances.groupBy("conversation_id").applyInPandasWithState(step, "conversation_id long, number long", "seen long", "append", GroupStateTimeout.NoTimeout)


def retry_gate(speech: DataFrame, floor_ms: int = 3000, tries: int = 3) -> DataFrame:
    """cluster_id, attempt, speech_ms, final: when a voice that stays ambiguous is tried, from (cluster_id, seq, speech_ms, ending).

    An attempt needs the floor of speech, and as much new speech since the last one. After ``tries`` ambiguous attempts, or
    when the session ends, one more is final and needs no new speech; nothing follows it.
    """

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState):
        done, at, over = state.get if state.exists else (0, 0, False)
        out = []
        for r in pd.concat(batches).sort_values("seq").itertuples():
            final = bool(r.ending) or done >= tries
            if over or r.speech_ms < floor_ms or (not final and r.speech_ms - at < floor_ms):
                continue
            done, at, over = done + 1, int(r.speech_ms), final
            out.append((k[0], done, at, final))
        state.update((done, at, over))
        yield pd.DataFrame(out, columns=["cluster_id", "attempt", "speech_ms", "final"]).astype({"attempt": "int64", "speech_ms": "int64", "final": "bool"})

    rows = speech.select("cluster_id", "seq", "speech_ms", F.coalesce("ending", F.lit(False)).alias("ending"))
    return rows.groupBy("cluster_id").applyInPandasWithState(step, "cluster_id string, attempt long, speech_ms long, final boolean", "done long, at long, over boolean", "append", GroupStateTimeout.NoTimeout)


def interventions(events: pd.DataFrame, state: tuple, window_ms: int = 30_000, cooldown_ms: int = 10_000, remembered: int = 500) -> tuple[list[tuple], tuple]:
    """Facts (fact_id, person_id, at_ms) to announce among events in order, and the new state.

    A superseding fact of an actionable attribute is announced if its person has given a change cue within the window, no other
    announcement was made within the cooldown, and it hasn't been announced. A cue is used up once.
    """
    cues, seen, last = dict(state[0]), list(state[1]), state[2]
    out = []
    for e in events.sort_values("seq").to_dict("records"):
        if e["type"] == "utterance":
            if e["is_final"] and e["person_id"] is not None and e["cue"]:
                cues[e["person_id"]] = e["at_ms"]
            continue
        if e["type"] != "fact" or e["superseded_fact_id"] is None or e["attribute"] not in ACTIONABLE or e["fact_id"] in seen:
            continue
        cue = cues.get(e["person_id"])
        if cue is None or e["at_ms"] - cue > window_ms or (last is not None and e["at_ms"] - last < cooldown_ms):
            continue
        seen = [*seen, e["fact_id"]][-remembered:]
        cues.pop(e["person_id"])
        last = e["at_ms"]
        out.append((e["fact_id"], e["person_id"], e["at_ms"]))
    return out, (cues, seen, last)


def announced(cued: DataFrame, key: str, window_ms: int = 30_000, cooldown_ms: int = 10_000) -> DataFrame:
    """The batch form of ``live_context`` in two levels, over events with ``cue``.

    First each fact meets the last cue of its (owner, person) before it: a running value, so a busy owner is spread over the people. What is
    within the window is a candidate, few rows; over these an owner's cooldown is scanned in order.
    """
    cue = F.when((F.col("type") == "utterance") & F.coalesce("is_final", F.lit(False)) & F.col("cue"), F.struct(F.col("seq").alias("cue_seq"), F.col("at_ms").alias("cue_at")))
    so_far = Window.partitionBy(key, "person_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    facts = cued.where("person_id IS NOT NULL").withColumn("last_cue", F.last(cue, ignorenulls=True).over(so_far))
    facts = facts.where((F.col("type") == "fact") & F.col("superseded_fact_id").isNotNull() & F.col("attribute").isin(*ACTIONABLE))
    near = facts.where(F.col("at_ms") - F.col("last_cue.cue_at") <= window_ms).select(F.col(key).cast("string").alias(key), "seq", "fact_id", "person_id", "at_ms", F.col("last_cue.cue_seq").alias("cue_seq"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        used, seen, last, keep = set(), set(), None, []
        for r in pdf.sort_values("seq").itertuples():
            told = (last is None or r.at_ms - last >= cooldown_ms) and r.cue_seq not in used and r.fact_id not in seen
            if told:
                used.add(r.cue_seq)
                seen.add(r.fact_id)
                last = r.at_ms
                keep.append((getattr(r, key), r.fact_id, r.person_id, r.at_ms))
        return pd.DataFrame(keep, columns=[key, "fact_id", "person_id", "at_ms"]).astype({"at_ms": "int64"})

    return near.groupBy(key).applyInPandas(scan, f"{key} string, fact_id string, person_id string, at_ms long")


def live_context(events: DataFrame, key: str = "owner_id") -> DataFrame:
    """Announcements per owner, in batch or as a stream: events with seq, type, person_id, text, is_final, attribute, fact_id, superseded_fact_id, at_ms."""
    import json

    cued = events.withColumn("cue", F.coalesce(has_change_cue(F.col("text")), F.lit(False)))
    out = f"{key} string, fact_id string, person_id string, at_ms long"

    def rows(k, pdf, state):
        pdf = pdf.astype(object).where(pdf.notna(), None)
        found, state = interventions(pdf, state)
        return pd.DataFrame([(k, *f) for f in found], columns=[key, "fact_id", "person_id", "at_ms"]).astype({"at_ms": "int64"}), state

    if not events.isStreaming:
        return announced(cued, key)

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState):
        old = json.loads(state.get[0]) if state.exists else [{}, [], None]
        found, new = rows(k[0], pd.concat(batches), old)
        state.update((json.dumps(new),))
        yield found

    return cued.groupBy(key).applyInPandasWithState(step, out, "state string", "append", GroupStateTimeout.NoTimeout)


def upsert_stream(rows: DataFrame, target: str, key: list[str], seq: str, created: str, checkpoint: str, compact_every: int = 50):
    """Starts a query that appends each micro-batch to the log table under ``target``; a batch that comes again changes nothing.

    The log is folded into a new base every ``compact_every`` batches; between, a batch's cost follows the batch. Read it with ``LogTable.read``.
    """
    from ..sources.log_table import LogTable

    schema = rows.schema

    def write(batch: DataFrame, epoch: int) -> None:
        table = LogTable(batch.sparkSession, target, schema, key, seq, created)
        table.append(batch, epoch)
        if (epoch + 1) % compact_every == 0:
            table.compact()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def emit(rows: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Starts a query into an in-memory table, for tests and the event sink."""
    return rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(rows: DataFrame, folder: str, checkpoint: str):
    """Starts a query that appends what has come to Parquet files, each batch once."""
    return rows.writeStream.format("parquet").option("path", folder).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
