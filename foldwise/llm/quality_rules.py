"""Quality rules: one table of thresholds compiled into one projection of built-in expressions.

The measures are computed from the whole text in the scan's own stage: no shuffle, no user
function.  Repeats of eight-word windows are first looked for on 64-bit hashes; only a text
with two equal hashes takes the exact comparison, so the count never depends on a hash.

Defined results: a null or empty text has no words and fails the length rule; repeated rows
are judged alike; an empty table gives an empty table; other columns of the input, whatever
their names, play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.text import SPACE, let, whole, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this "
    "to was were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne ou par pas plus pour que qui sa se ses "
    "son sont sur un une "
    "aber als am auch auf aus bei das dem den der die ein eine einen er es für im ist mit nach nicht noch nur oder "
    "sich sie sind so über um und von vor war wie zu zum zur "
    "al como con del el ella entre era esta este las lo los más muy no para pero porque sin sobre su sus también y ya"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= numerator / denominator <= high``; without a denominator the number itself counts."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", low=20),
    Rule("repetition", "n_repeat_words", "n_words", high=0.30),
    Rule("word_length", "word_chars", "n_words", low=2.0, high=20.0),
    Rule("symbols", "n_symbols", "n_words", high=0.20),
    Rule("exclamations", "n_exclamations", "n_words", high=0.30),
    Rule("stop_words", "n_stop_words", "n_words", low=0.05),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.60),
)


def _starts(v: Column) -> Column:
    return F.sequence(F.lit(1), F.size(v) - (WINDOW - 1))


def _hashes(v: Column) -> Column:
    """A hash of every window of eight words, from pairs, then pairs of pairs, then pairs of those."""

    def paired(h: Column, k: int) -> Column:
        n = F.size(h) - k
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))

    return let(F.transform(v, lambda x: F.xxhash64(x)), lambda a: let(paired(a, 1), lambda b: let(paired(b, 2), lambda c: paired(c, 4))))


def _covered(v: Column) -> Column:
    """Words in windows that occur twice, by sorting the windows and comparing neighbours."""
    windows = F.transform(_starts(v), lambda i: F.struct(F.array_join(F.slice(v, i, WINDOW), " ").alias("w"), i.alias("i")))
    no = F.array(F.lit(False))

    def repeated(s: Column) -> Column:
        n = F.size(s)
        same = F.zip_with(F.slice(s, F.lit(1), n - 1), F.slice(s, F.lit(2), n - 1), lambda a, b: a["w"] == b["w"])
        flags = let(same, lambda e: F.zip_with(F.concat(no, e), F.concat(e, no), lambda a, b: a | b))
        return F.sort_array(F.filter(F.zip_with(s, flags, lambda x, f: F.when(f, x["i"])), lambda i: i.isNotNull()))

    return F.aggregate(
        let(F.sort_array(windows), repeated),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )


def repeat_words(w: Column) -> Column:
    """Number of words in eight-word windows that the text holds twice or more."""
    unique = let(_hashes(w), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).when(unique, F.lit(0)).otherwise(_covered(w))


def measures(text: str = "text") -> Column:
    """Struct of all counts the rules use, computed from the whole text."""
    t = whole(text)

    def per_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    def per_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    of_words, of_lines = let(words(F.col(text)), per_words), let(lines, per_lines)
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda m: F.struct(
            m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"),
            F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"), m["l"]["n_dup_lines"].alias("n_dup_lines"),
            m["w"]["n_repeat_words"].alias("n_repeat_words"), m["w"]["n_stop_words"].alias("n_stop_words"),
            m["l"]["n_lines"].alias("n_lines"), (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        ),
    )


def verdict(m: Column, rules=RULES) -> Column:
    """Name of the first rule that fails, null if all hold.  Ratios are compared as products: no division by zero."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        top, bottom = m[r.numerator], m[r.denominator] if r.denominator else F.lit(1)
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (top < bottom * r.low)
        if r.high is not None:
            bad = bad | (top > bottom * r.high)
        out = F.when(bad, F.lit(r.name)).otherwise(out)
    return out


def judge(docs: DataFrame, text: str = "text", rules=RULES, into: str = "quality") -> DataFrame:
    """All input columns and one struct ``into``: the measures, ``failed_rule`` and ``kept``."""
    m = measures(text)
    judged = let(m, lambda v: let(verdict(v, rules), lambda f: F.struct(v.alias("measures"), f.alias("failed_rule"), f.isNull().alias("kept"))))
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != into], judged.alias(into))


def keep(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The documents that pass every rule, with their columns as they were."""
    return judge(docs, text, rules, "_fw_quality").filter("_fw_quality.kept").select(*[F.col(f"`{c}`") for c in docs.columns])
