"""Sentences, their spans, and text normalisation (T1-T6 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a cut is one white space character after . or ?, unless an abbreviation such as z.B. or Dr. ends there.
SENTENCE_END = r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s"
MIN_SENTENCE = 10  # code points; shorter sentences make no node
# Marks that normalisation sets apart, and marks that it drops.
PADDED = r"['\".()!?\-\\/,]"
DROPPED = r"[;:|\n]"


def split_sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END, -1)


def spans(text: Column, fix_offsets: bool = False) -> Column:
    """Array of (s, e, text) of the sentences that are long enough.

    Skipped sentences don't move the offsets of those after them, so these are only right up to the first skipped one;
    ``fix_offsets`` gives the true ones.
    """
    empty = F.expr("cast(array() as array<struct<s:bigint,e:bigint,text:string>>)")

    def add(acc, t):
        n = F.length(t).cast("long")
        span = F.struct(acc["at"].alias("s"), (acc["at"] + n).alias("e"), t.alias("text"))
        kept = n >= MIN_SENTENCE
        step = F.when(kept | F.lit(fix_offsets), acc["at"] + n + 1).otherwise(acc["at"])
        return F.struct(step.alias("at"), F.when(kept, F.concat(acc["all"], F.array(span))).otherwise(acc["all"]).alias("all"))

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("all"))
    return F.aggregate(split_sentences(text), start, add)["all"]


def split_text(text: Column, s: Column, e: Column) -> Column:
    return F.substring(text, (s + 1).cast("int"), (e - s).cast("int"))


def ui_split_text(text: Column, s: Column, e: Column) -> Column:
    """What the browser shows: its second argument is a length, so it reads on past the sentence."""
    return F.substring(text, (s + 1).cast("int"), e.cast("int"))


def normalize(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"({PADDED})", " $1 "), DROPPED, " ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def token_window(text: Column, length: int = 125) -> Column:
    """The last ``length`` tokens, with empty ones after them where there are fewer."""
    found = tokens(text)
    last = F.slice(found, F.greatest(F.size(found) - length + 1, F.lit(1)), F.lit(length))
    return F.concat(last, F.array_repeat(F.lit(""), F.lit(length) - F.size(last)))


def preprocess(text: Column, lower: bool = True, stop_words: list[str] | None = None, letters_only: bool = False) -> Column:
    """Tokens of a text (T9): words and single marks; without stop words, and without what isn't all letters, on request."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"), F.lit(0))
    if letters_only:
        tokens = F.filter(tokens, lambda t: t.rlike(r"^[\p{L}\p{M}]+$"))
    if stop_words:
        tokens = F.filter(tokens, lambda t: ~F.lower(t).isin(*[w.lower() for w in stop_words]))
    return F.transform(tokens, F.lower) if lower else tokens
