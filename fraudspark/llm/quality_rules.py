"""Quality rules: base counts, and a log-likelihood ratio of hashed n-grams between trusted and raw texts.

Words and pairs of neighbouring words are hashed into `buckets`. Two multinomials over the buckets, one of
the trusted texts and one of all texts, are estimated with add-one smoothing; a text's verdict is the
mean log ratio over its n-grams, held against a fixed threshold. Everything is a DataFrame expression.

Nulls and empty texts have no words; they fail the base rule and are not kept. Repeated rows are judged
one by one and count each. Without trusted texts the ratio is taken as 0 for every bucket. An empty table
gives an empty table. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import GAPS

BUCKETS = 8192
WINDOW = 8
THRESHOLD = -0.05


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAPS), "")


def n_grams(own: Column, buckets: int) -> Column:
    """Buckets of the words, then of the pairs of neighbours."""
    count = F.size(own)
    single = F.transform(own, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = F.when(count > 1, F.zip_with(
        F.slice(own, 1, F.greatest(count - 1, F.lit(1))), F.slice(own, 2, F.greatest(count - 1, F.lit(1))),
        lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(single, pairs)


def repeated_words(own: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur twice or more, the first included."""
    count = F.size(own)
    windows = F.transform(F.sequence(F.lit(1), count - WINDOW + 1), lambda i: F.xxhash64(F.slice(own, i, WINDOW)))
    return F.when(count > WINDOW, windows)


def _let(value: Column, use) -> Column:
    """`use` of `value`, which is computed once: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words covered by the windows that are equal to another one."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = _let(placed, lambda p: F.filter(p, lambda x, k: (
        (k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))))
    starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
    return F.aggregate(
        starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("end")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["end"])).cast("long").alias("n"), s.alias("end")), lambda a: a["n"])


def ratios(docs: DataFrame, trusted: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
           buckets: int = BUCKETS) -> list[float]:
    """Log ratio of each bucket's share in the texts whose ids `trusted` has, and in all texts.

    Counts run over all rows; one row for each bucket reaches the driver.
    """
    marked = trusted.select(F.col(id_column).alias("_id")).filter("_id is not null").distinct().withColumn("_good", F.lit(1))
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_t"))
    # Always by shuffle: ids of labels grow with the corpus.
    grams = rows.join(marked.hint("merge"), "_id", "left").select("_good", F.explode(n_grams(words(F.col("_t")), buckets)).alias("b"))
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("_good").alias("good")).collect()
    raw_n, good_n = {r["b"]: r["raw"] for r in counts}, {r["b"]: r["good"] for r in counts if r["good"]}
    if not good_n:
        return [0.0] * buckets
    raw_total, good_total = sum(raw_n.values()) + buckets, sum(good_n.values()) + buckets
    return [math.log((good_n.get(b, 0) + 1) / good_total) - math.log((raw_n.get(b, 0) + 1) / raw_total) for b in range(buckets)]


def judge(docs: DataFrame, weights: list[float], *, id_column: str = "doc_id", text_column: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr) of every row."""
    table = F.split(F.lit(",".join(f"{w:.6f}" for w in weights)), ",").cast("array<double>")
    text = F.coalesce(F.col("_t"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_t"))
    split = rows.withColumn("_w", words(F.col("_t")))
    counted = split.select(
        "_id", F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"), repeated_words(F.col("_w")).alias("_windows"), n_grams(F.col("_w"), len(weights)).alias("_grams"),
    )
    judged = counted.select(
        "_id", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered(F.col("_windows"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.when(F.size("_grams") > 0, F.aggregate("_grams", F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size("_grams"))
        .otherwise(F.lit(0.0)).alias("llr"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(
        F.col("_id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr",
    )
