"""Text functions as Columns (no Python per row, but for accent folding of non-ASCII text)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that never count as change keywords (fixed values).
CHANGE_STOP_WORDS = ["about", "after", "again", "before", "from", "into", "moving", "that", "their", "there", "they", "this", "with", "your", "september"]
#: Words that never count as terms of a question (fixed values).
QUERY_STOP_WORDS = (
    "who whos what whats when where why how is are was were the a an and or of for about tell me do does did "
    "i know my his her their they she he it to with again"
).split()
#: Attribute names that mean the same slot (fixed values).
ATTRIBUTE_ALIASES = {"move_date": "move", "food_preference": "preference", "work": "job", "recent_trip": "travel"}
#: Cues of an explicit change (fixed values).
CHANGE_CUES = ["actually", "instead", "changed?", "pushed", "moved", "rescheduled", "no longer", "not anymore", "now", "rather than", "correction"]
#: Attributes whose change may interrupt a conversation (fixed values).
ACTIONABLE = ["location", "move", "move_date", "job", "employer", "project", "travel"]


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not "̀" <= c <= "ͯ")


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """Lower case, compatibility decomposition, combining marks removed."""
    return s.map(_fold, na_action="ignore")


def normalize_claim(c: Column, ascii_only: bool = False) -> Column:
    """Lower case without accents; anything but a-z, 0-9 and white space becomes a space; runs of it become one.

    Only texts that aren't of ASCII alone go to Python, as there is no built-in function for them; ``ascii_only`` skips the fold.
    """
    if ascii_only:
        folded = F.lower(c)
    else:
        foreign = F.octet_length(c) > F.char_length(c)
        folded = F.when(foreign, fold_accents(F.when(foreign, c))).otherwise(F.lower(c))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^a-z0-9\s]", " "), r"\s+", " "))


def contains_phrase(c: Column, phrase: Column, ascii_only: bool = False) -> Column:
    return F.contains(normalize_claim(c, ascii_only), normalize_claim(phrase, ascii_only))


def canonical_attribute(c: Column) -> Column:
    out = c
    for alias, name in ATTRIBUTE_ALIASES.items():
        out = F.when(c == alias, name).otherwise(out)
    return out


def attribute_aliases(attribute: str) -> list[str]:
    """All names of an attribute's slot."""
    name = ATTRIBUTE_ALIASES.get(attribute, attribute)
    return [name] + [a for a, n in ATTRIBUTE_ALIASES.items() if n == name]


def change_words(c: Column) -> Column:
    """Distinct keywords of a text: lower-case runs of a-z and 0-9 of four or more characters, no stop words."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)
    return F.array_except(words, F.array(*map(F.lit, CHANGE_STOP_WORDS)))


def query_terms(c: Column) -> Column:
    """Terms of a question: lower case, no possessive, more than one character, no stop words; repeats stay."""
    plain = F.regexp_replace(F.lower(c), r"['’]s\b", "")
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(QUERY_STOP_WORDS))


def term_share(haystack: Column, terms: Column) -> Column:
    """Share of the terms that a text contains; 0 without terms."""
    text = F.lower(haystack)
    hits = F.size(F.filter(terms, lambda t: F.contains(text, t)))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


def any_term_pattern(query: str) -> str | None:
    """Case-insensitive pattern of a query's terms of more than three characters; None without any."""
    terms = [t for t in query.split() if len(t) > 3]
    return "(?iu)" + "|".join("".join("\\" + c if c in r".*+?^${}()|[]\\" else c for c in t) for t in terms) if terms else None


def has_change_cue(c: Column) -> Column:
    return c.rlike(r"(?i)\b(?:" + "|".join(CHANGE_CUES) + r")\b")


def is_noise(c: Column) -> Column:
    """At most one letter or digit."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) <= 1


def is_unnamed(name: Column) -> Column:
    t = F.trim(name)
    return F.coalesce((t == "") | t.rlike(r"(?i)^(unknown|unnamed|speaker\b)"), F.lit(True))


def display_name(name: Column, number: Column | int = 0) -> Column:
    number = F.lit(number) if isinstance(number, int) else number
    return F.when(~is_unnamed(name), name).when(number > 0, F.concat(F.lit("Unknown speaker "), number.cast("string"))).otherwise("Unknown speaker")


def speaker_label(name: Column, person_id: Column) -> Column:
    """Name, else the last four characters of the id, else nothing to tell speakers apart by."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("Unknown speaker "), F.right(person_id.cast("string"), F.lit(4))), F.lit("Unknown speaker"))


def wake_command(text: Column, phrase: str) -> Column:
    """What follows the first occurrence of the phrase's words, adjacent and in either case, in the original text.

    Leading punctuation is dropped; null if the phrase or a command is missing. ``phrase``: the words, blank-separated, which
    are those of the caller's assistant.
    """
    words = [re.escape(w) for w in phrase.split()]
    pattern = r"(?iu)(?:^|[^\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(words) + r"(?![\p{L}\p{N}])[^\p{L}\p{N}]*(.*)$"
    return F.nullif(F.trim(F.regexp_extract(F.regexp_replace(text, r"[\r\n]+", " "), pattern, 1)), F.lit(""))


def clean_title(c: Column) -> Column:
    """Without outer quotes and final periods, 80 characters; null if empty or the default title."""
    t = F.left(F.regexp_replace(F.trim(c), r"""^["']|["'.]+$""", ""), F.lit(80))
    return F.when((t != "") & (F.lower(t) != "untitled conversation"), t)


def live_reply(claim: Column, loops: Column) -> Column:
    clean = F.regexp_replace(F.trim(claim), r"[.!?]+$", "")
    noun = F.when(loops == 1, "loop").otherwise("loops")
    more = F.when(loops > 0, F.concat(F.lit(" I found "), loops.cast("string"), F.lit(" related open "), noun, F.lit(" worth reviewing."))).otherwise("")
    return F.concat(F.lit("That changed: "), clean, F.lit("."), more)


def humanize(attribute: Column) -> Column:
    return F.replace(attribute, F.lit("_"), F.lit(" "))


def attribute_label(attribute: Column) -> Column:
    t = F.trim(F.regexp_replace(attribute, "[_-]+", " "))
    return F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 1 << 30))


def initials(name: Column) -> Column:
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda p: p != "")
    first, last = F.left(F.try_element_at(parts, F.lit(1)), F.lit(1)), F.left(F.try_element_at(parts, F.lit(-1)), F.lit(1))
    return F.when(F.size(parts) == 0, "").when(F.size(parts) == 1, F.upper(first)).otherwise(F.upper(F.concat(first, last)))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the code points of a text (UTF-16 units agree with them outside surrogate pairs)."""
    points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    # the multiplication by 16777619 = 2**24 + 403, modulo 2**32, stays within 63 bits
    step = lambda h, x: F.pmod(h.bitwiseXOR(x) * 403 + F.pmod(h.bitwiseXOR(x), F.lit(256)) * (1 << 24), F.lit(1 << 32))
    return F.aggregate(points, F.lit(2166136261).cast("long"), step)


#: Hues of identicons (fixed values).
HUES = [18, 32, 44, 96, 152, 196, 258, 330]


def identicon_hue(seed: Column) -> Column:
    h = fnv1a(F.when(seed == "", "unknown").otherwise(seed))
    return F.element_at(F.array(*map(F.lit, HUES)), (F.pmod(h, F.lit(len(HUES))) + 1).cast("int"))


def identicon_cells(seed: Column) -> Column:
    """25 booleans, five rows of five, mirrored; bits are read with a signed shift."""
    h = fnv1a(F.when(seed == "", "unknown").otherwise(seed))
    signed = F.transform(F.array(h), lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x))  # the hash is computed once for all cells
    cell = lambda x, i: F.call_function("shiftright", x, F.lit((i // 5 * 3 + min(i % 5, 4 - i % 5)) % 29)).bitwiseAND(F.lit(1)) == 1
    return F.element_at(F.transform(signed, lambda x: F.array(*[cell(x, i) for i in range(25)])), 1)


def spoken_key(attribute: Column, previous: Column) -> Column:
    """Source key of a fact that was set by voice: each transition is a row of its own."""
    return F.concat_ws("-", F.lit("spoken"), attribute, F.coalesce(previous.cast("string"), F.lit("initial")))


def note_key(text: Column) -> Column:
    return F.concat(F.lit("note-"), F.left(normalize_claim(text), F.lit(60)))


def safe_args(json: Column, schema: str) -> Column:
    """Arguments of a tool call; broken JSON gives a struct of nulls."""
    return F.from_json(json, schema, {"mode": "PERMISSIVE"})


def sse_line(row: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(row), F.lit("\n\n"))
