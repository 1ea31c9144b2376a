"""Quality rules: a table of thresholds compiled into one projection over length, symbol, stop-word and line ratios."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emendata.llm.common import WORD, let, words

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec ce dans de des du en est et la le les ou par pas pour que qui sur un une "
    "als auf das dem den der des die ein eine es ist im mit nicht sich und von zu "
    "al como con del el ella es esta ha las lo los más no para por se su sus un y"
).split()


class Rule(NamedTuple):
    """A document passes if low <= measure / per <= high; a bound of None is open. per 0 passes."""

    name: str
    measure: str
    per: str | None
    low: float | None
    high: float | None


#: The production table.
RULES = (
    Rule("length", "n_words", None, 10, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("shouting", "n_upper", "word_chars", None, 0.5),
)


def symbol_count(text: Column, symbols: str = SYMBOLS) -> Column:
    left = text
    for c in symbols:
        left = F.replace(left, F.lit(c), F.lit(""))
    return F.length(text) - F.length(left)


def repeated_window_words(tokens: Column, n: int = 5) -> Column:
    """How many words lie in windows of ``n`` words that occur twice or more, the first occurrence included."""

    def covered(found: Column) -> Column:
        # found: (window, place) in order of window; a window is repeated if a neighbour equals it.
        def place(i: Column) -> Column:
            own = F.get(found, i)
            before, after = F.get(found, i - 1), F.get(found, i + 1)
            same = own["h"].eqNullSafe(before["h"]) | own["h"].eqNullSafe(after["h"])
            return F.when(same, own["i"])

        places = F.sort_array(F.array_compact(F.transform(F.sequence(F.lit(0), F.size(found) - 1), place)))
        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        step = lambda s, i: F.struct((s["total"] + i + n - F.greatest(i, s["end"])).alias("total"), (i + n).alias("end"))
        return F.aggregate(places, start, step, lambda s: s["total"])

    def windows(w: Column) -> Column:
        one = lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(n)]).alias("h"), i.alias("i"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - n), one))

    return let(tokens, lambda w: F.when(F.size(w) >= n, let(windows(w), covered)).otherwise(0)).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The measures of a text by name, all longs; a null text measures as the empty one."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    found = {
        "n_words": F.size(words(body)),
        "word_chars": F.length(F.translate(body, " \t\n\x0b\f\r", "")),
        "n_symbols": symbol_count(body),
        "n_lines": F.size(lines),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_window_words(words(body)),
        "n_stop_words": F.regexp_count(body, F.lit(r"(?i)(?<![^\x20\x09-\x0D])(?:" + "|".join(dict.fromkeys(STOP_WORDS)) + r")(?![^\x20\x09-\x0D.,;:!?])")),
        "n_upper": F.length(F.regexp_replace(body, "[^A-ZÀ-ÖØ-Þ]+", "")),
    }
    return {k: v.cast("long") for k, v in found.items()}


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The conjunction of all rules over the measures as columns."""
    out = F.lit(True)
    for r in rules:
        value = F.col(r.measure)
        if r.low is not None:
            out = out & (value >= (F.lit(r.low) if r.per is None else F.lit(r.low) * F.col(r.per)))
        if r.high is not None:
            out = out & (value <= (F.lit(r.high) if r.per is None else F.lit(r.high) * F.col(r.per)))
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the measures, base_failed and kept; columns of those names are replaced.

    One projection, no shuffle, no user function. base_failed: fewer than 10 words, or over a fifth of them in
    repeated five-word windows. kept is false then, else the verdict of the table. Null and empty texts have no
    words and fail. Rows that repeat are judged each; an empty table gives an empty table.
    """
    named = measures(F.col(f"`{text}`"))
    made = {*named, "base_failed", "kept"}
    out = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made], *[v.alias(k) for k, v in named.items()]
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
