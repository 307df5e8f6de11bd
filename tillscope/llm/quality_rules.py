"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a built-in expression, so the rules run inside the scan's stage:
no shuffle, no user function, memory bounded by one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.llm.words import WORD

#: symbols that prose rarely holds
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was what with"
    " das den der des die ein eine für im in ist mit nicht sich und von zu"
    " al como con de del el en es la las lo los no para por que se su un una y"
    " au aux avec ce dans de des du en est et la le les pour qui sur un une"
)


@dataclass(frozen=True)
class Rule:
    """Keep a document when ``least <= measure <= most``; None leaves a side open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None

    def holds(self) -> Column:
        value = F.expr(self.measure)
        held = F.lit(True)
        if self.least is not None:
            held = held & (value >= F.lit(float(self.least)))
        if self.most is not None:
            held = held & (value <= F.lit(float(self.most)))
        return held


# The measures are SQL over the counts below, so a rule is a row that anyone can edit.
RULES = (
    Rule("words", "n_words", least=50),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", most=0.5),
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", least=2, most=15),
    Rule("symbols_per_word", "n_symbols / greatest(n_words, 1)", most=0.1),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", least=0.02),
    Rule("duplicate_lines", "n_dup_lines / greatest(n_lines, 1)", most=0.5),
    Rule("capital_letters", "n_capitals / greatest(word_chars, 1)", most=0.5),
)
#: rules every caller gets, whatever table is passed
BASE_RULES = ("words", "repeated_words")
#: more repeated windows than this are found by a sort, fewer by a scan; same result
_SCANNED = 64
#: internal columns never meet the caller's
_P = "__rule_"


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that rules may use.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a
    word), n_dup_lines (such lines equal to an earlier one), n_repeat_words (words in
    3-word windows found twice or more in the text), n_stop_words and
    n_capitals (A-Z). A null text counts as an empty one: all are 0. A caller's
    column of one of these names is replaced; other columns pass through.
    Windows are compared by 64-bit hash.
    """
    name = _P
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    step = docs.withColumn(f"{name}t", body)
    t = F.col(f"{name}t")
    step = step.withColumns(
        {
            f"{name}w": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
            f"{name}l": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)),
            "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("bigint"),
            "n_capitals": (
                F.length(t) - F.length(F.regexp_replace(t, F.lit("[A-Z]+"), F.lit("")))
            ).cast("bigint"),
        }
    ).drop(f"{name}t")
    w, lines = F.col(f"{name}w"), F.col(f"{name}l")
    stops = sorted(set(STOP_WORDS.split()))
    step = step.withColumns(
        {
            "n_words": F.size(w).cast("bigint"),
            "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
            "n_lines": F.size(lines).cast("bigint"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
            "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("bigint"),
            f"{name}h": F.transform(
                F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
            ),
        }
    ).drop(f"{name}w", f"{name}l")
    return _with_repeats(step).drop(*(name + x for x in "hsdqp"))


def _with_repeats(step: DataFrame) -> DataFrame:
    """Count words under repeated windows: hashes sorted, equal neighbours, their places."""
    h, s, d, q, p = (F.col(_P + x) for x in "hsdqp")
    step = step.withColumn(_P + "s", F.sort_array(h))
    step = step.withColumn(
        _P + "d", F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))
    )
    step = step.withColumn(
        _P + "q",
        F.when(
            F.size(d) > _SCANNED,
            F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    scanned = F.filter(
        F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda x: x.isNotNull()
    )
    twin = F.filter(
        q,
        lambda x, i: ((i > 0) & (x["h"] == F.get(q, i - 1)["h"]))
        | F.coalesce(x["h"] == F.get(q, i + 1)["h"], F.lit(False)),
    )
    step = step.withColumn(
        _P + "p",
        F.when(F.size(d) == 0, F.array().cast("array<int>"))
        .when(F.size(d) <= _SCANNED, scanned)
        .otherwise(F.sort_array(F.transform(twin, lambda x: x["i"]))),
    )
    # a window adds three words, fewer where the one before reaches into it
    covered = F.transform(
        p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1)))
    )
    return step.withColumn(
        "n_repeat_words",
        F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x),
    )


def quality_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text"
) -> DataFrame:
    """``docs`` with its counts, ``base_failed`` and ``kept``.

    ``base_failed`` holds for fewer than 50 words, or more than half of the words
    under repeated windows; ``kept`` is true when no rule fails. Null and empty texts
    fail. Repeated rows are judged alike, an empty table gives an empty one, and a
    clashing column is replaced by the count of that name.
    """
    counted = measured(docs, text)
    table = {rule.name: rule for rule in (*RULES, *rules)}
    base = F.lit(True)
    for name in BASE_RULES:
        base = base & table[name].holds()
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.holds()
    judged = counted.withColumns({"base_failed": ~base, f"{_P}k": base & verdict})
    # without this step a filter on ``kept`` is pushed below the counts, where each use of a
    # count would count the text again
    others = [c for c in judged.columns if c not in ("kept", f"{_P}k")]
    return judged.select(
        *(F.col(f"`{c}`") for c in others), F.explode(F.array(f"{_P}k")).alias("kept")
    )
