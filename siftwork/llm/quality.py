"""Quality rules: a threshold table compiled into one projection.

``measures`` are plain column expressions; ``compile_rules`` turns a table of
``(name, measure, comparison, threshold)`` rows into the columns ``kept`` and ``failed``.
Everything is one narrow projection over the scan: no shuffle, no user function.

Defined results: a null text counts as empty (no words; it fails the length rule);
blank lines are not lines with a word, so they never count as duplicates; a text of
fewer than three words has no three-word window. Input columns stay; a computed column
replaces an input column of its name.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.common import WORD_GAP, let, table, word_count


class Rule(NamedTuple):
    """A document passes if ``measure`` ``keep`` ``threshold`` holds (keep: one of >= <= > <)."""

    name: str
    measure: str
    keep: str
    threshold: float


#: Function words of English, French, German and Spanish, the languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for with was a "
    "le la les de des du et un une est que "
    "der die das und ist von zu ein eine nicht mit "
    "el los las y en una por con para es"
).split()

#: The production table. Ratios are bounds for running prose; each leaves clean text a wide margin. Of the texts that the
#: other rules keep at sf0.01 and sf0.1, the least share of stop words is 0.096. A long text is judged by ratios alone.
RULES = (
    Rule("few_words", "n_words", ">=", 50),
    Rule("repeated_words", "repeat_ratio", "<=", 0.5),
    Rule("short_words", "mean_word_chars", ">=", 2),
    Rule("long_words", "mean_word_chars", "<=", 20),
    Rule("symbols", "symbol_ratio", "<=", 0.2),
    Rule("repeated_lines", "dup_line_ratio", "<=", 0.5),
    Rule("bullets", "bullet_line_ratio", "<=", 0.9),
    Rule("cut_lines", "cut_line_ratio", "<=", 0.3),
    Rule("few_stop_words", "stop_ratio", ">=", 0.02),
)

#: Lines of a list, and lines that end in an ellipsis.
BULLET = r"\A[\x20\x09-\x0D]*[-*\u2022\u2023\u25E6\u00B7]"
CUT = r"(?:\.\.\.|\u2026)[\x20\x09-\x0D]*\z"

_COMPARE = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
}


def covered_by_repeats(found: Column) -> Column:
    """Number of words in three-word windows that the text holds twice or more; ``found`` is the array of words.

    Windows are compared by 64-bit hashes within one text. Where a window recurs, the
    windows are sorted by hash, those with an equal neighbour keep their positions, and the
    length of the union of the covered stretches is summed; n log n in the words of the text.
    """

    def of(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

        def starts(by_hash: Column) -> Column:
            same = lambda x, j: x["h"] == F.get(by_hash, j)["h"]
            return F.sort_array(F.transform(F.filter(by_hash, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False))), lambda x: x["i"]))

        def union(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)

        def count(h: Column) -> Column:
            pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, starts), union))

        return let(hashes, count)

    return let(found, of).cast("long")


LINE_COUNTS = ("n_lines", "n_dup_lines", "n_bullet_lines", "n_cut_lines")


def measures(text: Column) -> dict[str, Column]:
    """Counts of a text, each as long; ``lines`` is a struct of ``LINE_COUNTS``."""
    gaps = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(gaps, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    like = lambda x, rule: F.size(F.filter(x, lambda line: line.rlike(rule)))
    duplicates = lambda x: F.size(x) - F.size(F.array_distinct(x))
    of_lines = let(lines, lambda x: F.struct(*(n.cast("long").alias(c) for c, n in zip(LINE_COUNTS, (F.size(x), duplicates(x), like(x, BULLET), like(x, CUT)), strict=True))))
    stop = r"(?i)(?<![^\x20\x09-\x0D])(?:" + "|".join(STOP_WORDS) + r")(?![^\x20\x09-\x0D.,;:!?])"
    return {
        "n_words": word_count(text),
        "word_chars": F.length(F.regexp_replace(gaps, WORD_GAP, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(gaps, r"[^#*$%&|<>]+", "")).cast("long"),
        "lines": of_lines,
        "n_repeat_words": covered_by_repeats(F.filter(F.split(gaps, WORD_GAP, -1), lambda w: w != "")),
        "n_stop_words": F.regexp_count(gaps, F.lit(stop)).cast("long"),
    }


#: Derived measures over the counts, for the rules.
RATIOS = {
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
    "cut_line_ratio": ("n_cut_lines", "n_lines"),
    "stop_ratio": ("n_stop_words", "n_words"),
}


def compile_rules(rules: tuple[Rule, ...], measure: dict[str, Column]) -> tuple[Column, Column]:
    """Columns ``kept`` (every rule holds) and ``failed`` (names of the rules that don't, in table order)."""
    failed = F.array_compact(F.array(*(F.when(~_COMPARE[r.keep](measure[r.measure], F.lit(r.threshold)), F.lit(r.name)) for r in rules)))
    kept = F.lit(True)
    for r in rules:
        kept = kept & _COMPARE[r.keep](measure[r.measure], F.lit(r.threshold))
    return kept, failed


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``kept`` and ``failed``."""
    own = "quality_"
    while any(c.startswith(own) for c in docs.columns):
        own = "_" + own
    found = measures(F.col(f"`{text}`"))
    counted = docs.withColumns({own + k: v for k, v in found.items()})
    of = {k: F.col(own + k) for k in found if k != "lines"} | {k: F.col(own + "lines")[k] for k in LINE_COUNTS}
    of |= {k: F.coalesce(F.try_divide(of[a].cast("double"), of[b].cast("double")), F.lit(0.0)) for k, (a, b) in RATIOS.items()}
    kept, failed = compile_rules(rules, of)
    base_failed = (of["n_words"] < 50) | (100 * of["n_repeat_words"] > 50 * of["n_words"])
    out = counted.withColumns({k: of[k] for k in COUNTS} | {"base_failed": base_failed, "kept": kept & ~base_failed, "failed": failed})
    return out.drop(*(own + k for k in found))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs).select("doc_id", *COUNTS, "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    prefixed = score(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")))
    return prefixed.where("kept").select("__row.*")
