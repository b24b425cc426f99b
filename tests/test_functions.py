import datetime as dt
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from ctxlens.functions import dates, numeric, text


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_normalize_claim(spark):
    rows = ["Moves on September 1.", "  Café — Ñandú!! ", "Ｆｕｌｌ width", "", None, "ﬁne №5"]
    got = [r.x for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").orderBy("i").select(text.normalize_claim(F.col("s")).alias("x")).collect()]

    def want(s):
        if s is None:
            return None
        s = "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not "̀" <= c <= "ͯ")
        return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in s).split())

    assert got == [want(r) for r in rows]


def test_contains_phrase_and_aliases(spark):
    assert one(spark, text.contains_phrase(F.lit("Well, HEY Robin!"), F.lit("hey, robin")))[0]
    assert text.attribute_aliases("work") == ["job", "work"] and text.attribute_aliases("pet") == ["pet"]
    assert one(spark, text.canonical_attribute(F.lit("move_date")), text.canonical_attribute(F.lit("pet")))[:] == ("move", "pet")


@pytest.mark.parametrize(
    ("said", "command"),
    [
        ("Hey Robin, remind me", "remind me"), ("so hey robin — what now?", "what now?"), ("Hey Robin—remind me", "remind me"), ("hey robin", None), ("they robin go", None),
        ("hey robinnn go", None), ("HEY, ROBIN! Go. Hey Robin stop", "Go. Hey Robin stop"), ("nothing", None),
    ],
)
def test_wake_command(spark, said, command):
    assert one(spark, text.wake_command(F.lit(said), "hey robin"))[0] == command


def test_names_and_titles(spark):
    assert one(spark, text.initials(F.lit("  ada king lovelace ")), text.initials(F.lit("ada")), text.initials(F.lit(" ")))[:] == ("AL", "A", "")
    assert one(spark, text.display_name(F.lit("Speaker 3"), 2), text.display_name(F.lit("Speakerine")), text.display_name(F.lit(None).cast("string")))[:] == ("Unknown speaker 2", "Speakerine", "Unknown speaker")
    assert one(spark, text.speaker_label(F.lit(" "), F.lit("person-abcd")), text.speaker_label(F.lit(None).cast("string"), F.lit(None).cast("string")))[:] == ("Unknown speaker abcd", "Unknown speaker")
    assert one(spark, text.clean_title(F.lit(' "Plans for May." ')), text.clean_title(F.lit("Untitled conversation")), text.clean_title(F.lit("x" * 99)))[:] == ("Plans for May", None, "x" * 80)
    assert one(spark, text.attribute_label(F.lit("move_date")), text.humanize(F.lit("food_preference")))[:] == ("Move date", "food preference")
    assert one(spark, text.live_reply(F.lit("Moves on the 15th!"), F.lit(1)), text.live_reply(F.lit("x"), F.lit(0)))[:] == ("That changed: Moves on the 15th. I found 1 related open loop worth reviewing.", "That changed: x.")
    assert one(spark, text.spoken_key(F.lit("move"), F.lit(None).cast("string")), text.note_key(F.lit("Hi, there!")))[:] == ("spoken-move-initial", "note-hi there")


def test_terms(spark):
    assert one(spark, text.change_words(F.lit("Moving from Oslo in September, then Rome; oslo")))[0] == ["oslo", "then", "rome"]
    assert one(spark, text.query_terms(F.lit("What's Maya’s new job?")))[0] == ["maya", "new", "job"]
    assert text.any_term_pattern("a bb ccc") is None and text.any_term_pattern("what (now)?") == r"(?iu)what|\(now\)\?"
    assert one(spark, text.has_change_cue(F.lit("It has Changed")), text.has_change_cue(F.lit("knowing")), text.has_change_cue(F.lit("no longer")))[:] == (True, False, True)
    assert one(spark, text.is_noise(F.lit("a.")), text.is_noise(F.lit("ok")))[:] == (True, False)


def test_hash_and_identicon(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 % (1 << 32)
        return h

    words = ["", "a", "vp-123", "Zoë"]
    for w in words:
        assert one(spark, text.fnv1a(F.lit(w)))[0] == fnv(w)
    cells = one(spark, text.identicon_cells(F.lit("vp-123")))[0]
    assert len(cells) == 25 and all(cells[5 * r + c] == cells[5 * r + 4 - c] for r in range(5) for c in range(5))
    assert one(spark, text.identicon_hue(F.lit("")), text.identicon_hue(F.lit("unknown")))[0] in text.HUES


def test_safe_args(spark):
    assert one(spark, text.safe_args(F.lit('{"k": 3}'), "k long")["k"], text.safe_args(F.lit("{bad"), "k long")["k"])[:] == (3, None)


def test_dates(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    now = t("2024-01-15 12:00:00")
    days = {"2024-01-15 01:00:00": "Today", "2024-01-14 23:00:00": "Yesterday", "2024-01-16 00:00:00": "Tomorrow", "2024-01-10 00:00:00": "5 days ago", "2024-01-21 00:00:00": "In 6 days", "2024-03-02 00:00:00": "Mar 2"}
    for d, want in days.items():
        assert one(spark, dates.format_day(t(d), now))[0] == want
    assert one(spark, dates.format_time(t("2024-01-15 00:05:00")), dates.format_time(t("2024-01-15 13:30:00")))[:] == ("12:05 am", "1:30 pm")
    none = F.lit(None).cast("timestamp")
    assert one(spark, dates.format_due(none, now), dates.format_due(t("2024-01-15 11:00:00"), now), dates.format_due(t("2024-01-15 12:20:00"), now), dates.format_due(t("2024-01-16 09:00:00"), now))[:] == ("No date yet", "Due now", "In 20 min", "Tomorrow, 9:00 am")
    assert one(spark, dates.format_duration(now, t("2024-01-15 12:00:10")), dates.format_duration(now, none))[:] == ("1 min", "")
    assert one(spark, dates.resolve_tonight(t("2024-01-15 20:00:00")), dates.resolve_tonight(t("2024-01-15 21:00:00")))[:] == (dt.datetime(2024, 1, 15, 21), dt.datetime(2024, 1, 16, 21))


def test_numbers(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, numeric.cosine(arr(0, 0), arr(1, 2)), numeric.cosine(arr(1, 0), arr(1, 0)))[:] == (0.0, 1.0)
    assert one(spark, numeric.raw_cosine(F.lit(0.9)), numeric.raw_cosine(F.lit(1.5)))[:] == (0.8, 1.0)
    assert one(spark, numeric.js_round(F.lit(-0.5)), numeric.js_round(F.lit(2.5)))[:] == (0, 3)
    assert one(spark, numeric.resample(arr(0, 1, 2, 3), 16000, 8000))[0] == [0.0, 2.0]
    assert one(spark, numeric.resample(arr(0, 1), 8000, 16000))[0] == [0.0, 0.5, 1.0, 1.0]
    assert one(spark, numeric.float_to_int16(arr(-2, -1, 0.5, 1)), numeric.int16_to_float(F.array(F.lit(-32768))))[:] == ([-32768, -32768, 16384, 32767], [-1.0])
    assert one(spark, numeric.ms_of_samples(F.lit(1600)), numeric.rms(arr(3, 4)))[:] == (100, pytest.approx(12.5**0.5))
    assert one(spark, numeric.slice_pcm(arr(*range(32)), F.lit(1), F.lit(9)))[0] == [float(x) for x in range(16, 32)]
    assert [numeric.config_number(x, 0.6) for x in (None, " ", "nan", "x", "0.7")] == [0.6, 0.6, 0.6, 0.6, 0.7]
    random.seed(0)


def test_identicon_hashes_once(spark):
    plan = spark.createDataFrame([("a",)], "s string").select(text.identicon_cells(F.col("s")))._jdf.queryExecution().analyzed().toString()
    assert plan.splitlines()[0].count("2166136261") <= 2  # of the offset basis, some fifty when each cell hashes


def test_normalize_claim_is_the_fold_of_every_character(spark):
    import re

    rows = [f"A{chr(p)}b" for p in range(1, 0x20000) if not 0xD800 <= p < 0xE000] + ["ΟΔΟΣ Ünḯcó֑dé ﬁn…½", "", None]
    norm = lambda s: None if s is None else re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub(r"[^a-z0-9 \t\n\x0b\f\r]", " ", text._fold(s))).strip(" ")
    got = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string").select("i", text.normalize_claim(F.col("s")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: norm(s) for i, s in enumerate(rows)}


def test_plain_texts_are_not_folded_in_python(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.pandas_udf(lambda s: (seen.add(int(s.notna().sum())), s)[1], "string")
    kept, text.fold_accents = text.fold_accents, count
    try:
        spark.createDataFrame([("plain",), ("déjà vu",), (None,)], "s string").select(text.normalize_claim(F.col("s"))).collect()
    finally:
        text.fold_accents = kept
    assert seen.value == 1
