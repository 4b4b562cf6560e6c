"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Words are runs of `[^\\x20\\x09-\\x0D]`. Results for odd input: a null or blank text has no words, all
counts 0, and fails the base; a repeated row is judged each time; other columns pass through untouched.
A window of five words is known by its 64-bit hash within its own text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenplex.llm.common import ROW, carried

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
BULLETS = ("-", "*", "•")
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Frequent function words of the languages that the rules know.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not are this from "
    "de la le les des et un une du en que est pour dans qui sur par au "
    "der die das und den von zu mit sich ein eine auf nicht dem als "
    "el los las del y una se con por para su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A ratio must lie within [low, high]; a missing bound doesn't bind."""

    name: str
    low: float | None = None
    high: float | None = None


#: Production thresholds.
RULES = (
    Rule("mean_word_chars", 1.5, 14.0),
    Rule("symbol_ratio", None, 0.2),
    Rule("stop_word_ratio", 0.04, None),
    Rule("dup_line_ratio", None, 0.4),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.5),
    Rule("shout_ratio", None, 0.5),
)


def _gram(words: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input row as a struct, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios."""
    body = F.coalesce(F.col(f"{ROW}.{text}"), F.lit(""))
    has_word = lambda line: F.length(F.translate(line, SPACE, "")) > 0
    one = (
        carried(docs)
        .select(
            ROW,
            F.array_remove(F.split(body, "[\\x20\\x09-\\x0D]+"), "").alias("words"),
            F.length(F.translate(body, SPACE, "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.filter(F.split(body, "\n"), has_word).alias("lines"),
            F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            F.regexp_count(body, F.lit(r"\p{Ll}")).cast("long").alias("n_lower"),
        )
    )
    two = one.select(
        ROW, "word_chars", "n_symbols", "words", "n_upper", "n_lower",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin(*BULLETS))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.when(
            F.size("words") > WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: _gram(F.col("words"), i)),
        ).otherwise(F.array().cast("array<bigint>")).alias("grams"),
    )
    # Only texts that repeat a window at all pay for ordering their windows.
    three = two.select(
        ROW, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines", "n_upper", "n_lower",
        F.when(
            F.size(F.array_distinct("grams")) < F.size("grams"),
            F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("ordered"),
    )
    near = lambda i: F.get(F.col("ordered"), i).getField("h")
    again = F.filter("ordered", lambda g, i: F.coalesce((near(i + 1) == g.getField("h")), F.lit(False)) | F.coalesce((near(i - 1) == g.getField("h")), F.lit(False)))
    four = three.withColumn("at", F.sort_array(F.transform(again, lambda g: g.getField("i")))).drop("ordered")
    reach = F.transform("at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), i + 1) - p, F.lit(WINDOW))))
    words, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines"))
    measures = F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0).cast("long")).alias("n_repeat_words"),
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbol_ratio"),
        (F.col("n_stop_words") / words).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / lines).alias("dup_line_ratio"),
        (F.col("n_bullet_lines") / lines).alias("bullet_line_ratio"),
        (F.col("n_ellipsis_lines") / lines).alias("ellipsis_line_ratio"),
        (F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))).alias("shout_ratio"),
    )
    # A filter on a measure stays above this generator; pushed below, it would measure each text several times.
    return four.select(ROW, F.explode(F.array(measures)).alias("m")).select(ROW, "m.*")


def verdict(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """base_failed, and the names of the rules that a row of measure() breaks."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.name) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.name) > r.high)
        broken.append(F.when(bad, F.lit(r.name)))
    return base, F.array_compact(F.array(*broken))


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measure() with base_failed, broken_rules and kept."""
    base, broken = verdict(rules)
    return measure(docs, text).withColumn("base_failed", base).withColumn("broken_rules", broken).withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input rows that no rule rejects, with their own columns."""
    return apply_rules(docs, text, rules).where("kept").select(f"{ROW}.*")
