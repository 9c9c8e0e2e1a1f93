"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

WINDOW = 8

#: Function words of English, German, French and Spanish (fixed values)
STOP_WORDS = """the of and to in is that for with was on are it be by this from at an
der die das und ist von den mit zu ein eine dem nicht auf für als auch
la le les des et un une est que qui dans pour par sur pas au
el los las y en del por con para se al su""".split()

#: (measure, words from which it applies, least, most): a text is kept if every measure that applies is in range
RULES = (
    ("symbols_per_word", 1, None, 0.2),
    ("mean_word_chars", 10, 2.5, 10.0),
    ("stop_word_share", 50, 0.02, 0.85),
    ("upper_share", 20, None, 0.5),
    ("shout_share", 10, None, 0.5),
    ("same_next_share", 10, None, 0.2),
    ("distinct_share", 50, 0.1, None),
    ("dup_line_share", 30, None, 0.5),
)


def measures(text: Column) -> dict[str, Column]:
    """Counts of one text: base columns and what the rules' measures are made of.

    Every value is an expression over `words`, `lines` and `text`, which measured() lays out first.
    """
    words, lines = F.col("words"), F.col("lines")
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))
    return {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "runs": F.when(n >= WINDOW, runs).otherwise(F.array().cast("array<bigint>")),
        "n_stop": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")),
        "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}]+", "")),
        "n_shouts": F.length(F.regexp_replace(text, r"[^!]+", "")),
        "n_distinct": F.size(F.array_distinct("hashes")),
        "n_same_next": F.size(F.filter(F.arrays_zip(F.col("hashes").alias("a"), F.slice(F.col("hashes"), F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b")), lambda z: z["a"] == z["b"])),
    }


#: Words of the windows that occur twice or more, from the windows' hashes in `runs`: equal neighbours of the sorted (hash, place)
#: pairs give the repeated places; each covers up to the next place or a whole window
REPEATED = f"""CASE WHEN size(array_distinct(runs)) = size(runs) THEN 0L ELSE
  aggregate(
    transform(array(array_sort(array_distinct(flatten(
      transform(array(array_sort(transform(runs, (h, i) -> named_struct('h', h, 'i', i)))),
                s -> flatten(zip_with(s, slice(s, 2, greatest(size(s) - 1, 0)), (a, b) -> CASE WHEN a.h = b.h THEN array(a.i, b.i) ELSE CAST(array() AS array<int>) END))))))),
      p -> aggregate(zip_with(p, slice(p, 2, greatest(size(p) - 1, 0)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (t, x) -> t + x)),
    0L, (t, x) -> t + x) END"""


def measured(docs: DataFrame) -> DataFrame:
    """docs with the counts of measures(), n_repeat_words, and one column for each measure of RULES."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    laid = docs.withColumn("__text", text).withColumn("words", F.regexp_extract_all("__text", F.lit(f"({WORD})"), F.lit(1)))
    laid = laid.withColumn("lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD))).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    counted = laid.select(*docs.columns, *(c.alias(k) for k, c in measures(F.col("__text")).items()))
    counted = counted.withColumn("n_repeat_words", F.expr(REPEATED)).drop("runs")
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.withColumns({
        "symbols_per_word": F.col("n_symbols") / n,
        "mean_word_chars": F.col("word_chars") / n,
        "stop_word_share": F.col("n_stop") / n,
        "upper_share": F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)),
        "shout_share": F.col("n_shouts") / n,
        "same_next_share": F.col("n_same_next") / n,
        "distinct_share": F.col("n_distinct") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    })


def verdict(rules=RULES) -> Column:
    """The rules as one condition."""
    out = F.lit(True)
    for name, applies, least, most in rules:
        ok = F.lit(True)
        if least is not None:
            ok = ok & (F.col(name) >= least)
        if most is not None:
            ok = ok & (F.col(name) <= most)
        out = out & ((F.col("n_words") < applies) | ok)
    return out


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the base counts, base_failed and kept, for every row of docs (doc_id, text).

    A null or empty text has no words and fails the base rules. Repeated rows are judged alike. No row is dropped, and
    no row depends on another.
    """
    rows = measured(docs.select("doc_id", "text"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = rows.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
