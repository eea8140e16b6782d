"""Quality rules as one projection: a threshold table compiled into Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
#: Very common words of the languages that the default rules serve.
STOP_WORDS = (
    "the of and to in is that it was for on are with as be at by this have from or an not but he his they which you "
    "le la les de des du un une et est en que qui dans pour par sur au aux pas avec ce il elle ne se plus "
    "der die das und ist von mit den dem ein eine im zu auf für nicht sich des auch als an wird sie es "
    "el los las y del al con una por para no su lo como más pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule if numerator / denominator (0 if that is 0) leaves [low, high]."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Measures are the columns that `measures` makes.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.4),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", None, 0.4),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and one struct `m` of counts for each row of docs, without Python or shuffle.

    A NULL, empty or blank text has zero for every count. Only `keep` and `text` are read, so other
    columns of docs cannot clash. Repeated rows are measured each for itself."""
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(BLANKS))
    step = docs.select(
        *keep,
        t.alias("t"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
    )
    step = step.select(*keep, "t", "w", "l", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    window = F.transform(
        F.sequence(F.lit(0), F.size("h") - 3),
        lambda i: F.struct(F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)).alias("h"), i.alias("p")),
    )
    step = step.select(*keep, "t", "w", "l", F.when(F.size("h") >= 4, F.sort_array(window)).alias("s"))
    same = F.filter("s", lambda x, i: (x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]))
    step = step.select(*keep, "t", "w", "l", F.sort_array(F.transform(same, lambda x: x["p"])).alias("p"))
    gaps = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: F.least(F.lit(3), b - a))
    covered = F.when(F.size("p") > 0, F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).otherwise(0)
    long = lambda c: c.cast("long")
    return step.select(
        *keep,
        F.struct(
            long(F.size("w")).alias("n_words"),
            long(F.length(F.array_join("w", ""))).alias("word_chars"),
            long(F.regexp_count("t", F.lit(SYMBOLS))).alias("n_symbols"),
            long(F.size("l")).alias("n_lines"),
            long(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
            long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
            long(F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS)))).alias("n_stop_words"),
            long(F.size(F.filter("l", lambda x: F.ltrim(x).rlike("^[-•*]")))).alias("n_bullet_lines"),
            long(F.size(F.filter("l", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$")))).alias("n_ellipsis_lines"),
        ).alias("m"),
    )


def verdicts(rules: tuple[Rule, ...] = RULES, m: str = "m") -> tuple[Column, Column]:
    """(base_failed, names of broken rules) as columns over the struct of `measures`."""
    c = lambda name: F.col(f"{m}.{name}")
    base = (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))
    broken = []
    for r in rules:
        ratio = F.when(c(r.denominator) > 0, c(r.numerator) / c(r.denominator)).otherwise(F.lit(0.0))
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (ratio < r.low)
        if r.high is not None:
            bad = bad | (ratio > r.high)
        broken.append(F.when(bad, F.lit(r.name)))
    return base, F.array_compact(F.array(*broken))


def quality(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs: key, counts, base_failed, broken_rules, kept. See `measures`;
    an empty table gives an empty result, blank texts fail the base rule."""
    base, broken = verdicts(rules)
    return measures(docs, text, (key,)).select(key, "m.*", base.alias("base_failed"), broken.alias("broken_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)
    )


def filter_quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, all their columns, whose text passes. The row travels in a struct, so a
    column of any name is safe."""
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("body"))
    base, broken = verdicts(rules)
    # A plain filter would be pushed below the measures and copy their expressions into itself.
    passed = F.explode_outer(F.when(~base & (F.size(broken) == 0), F.array("row"))).alias("kept")
    return measures(boxed, "body", ("row",)).select(passed).where("kept IS NOT NULL").select("kept.*")
