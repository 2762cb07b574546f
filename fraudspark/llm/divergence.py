"""Source divergence audit: how the use of terms in each (lang, source) differs from other sources and from the lang.

A CountVectorizer with minDF and the largest possible vocabulary builds the exact sparse vector of every document.
Its vocabulary holds what is frequent enough in all langs together, which no kept term of a lang can miss; vectors are
summed up by (lang, source), entry by entry with partial sums of counts and documents, never as dense vectors,
and each lang keeps the terms with enough documents of its own. A vocabulary reaches the driver as a job's result
before it is broadcast, so it is no larger than spark.driver.maxResultSize; where Spark refuses it, terms
are dealt by hash into twice as many slices, each with a vocabulary of its own, and every term is in exactly one.
A pair of sources is compared on dense cells of at most 64 sources and 8192 terms, block against block.

Null text, lang and source are read as ''. A group without kept terms keeps its row with a total of 0. Repeated rows
count each. A lang without kept terms has pairs of value 0 and no terms. An empty table gives an empty result.
Columns are read by name; others are ignored. Ties of a value are ordered by the item's UTF-8 bytes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.llm.ordering import numbered
from fraudspark.session import cut_lineage

BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 10 ** 9, 50
SOURCE_BLOCK, TERM_BLOCK = 64, 8192


def terms(text: Column) -> Column:
    """Runs of letters and of anything beyond ASCII; only A to Z are lower-cased, which lower() does for a text of ASCII."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def _plain(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    read = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    return docs.select(read(lang, "lang"), read(source, "source"), read(text, "text"))


def group_counts(docs: DataFrame, *, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, at least of all terms in `least_docs` documents of a lang.

    docs(lang, source, text).
    """
    group, named = _group_keys(docs)
    split = docs.select(group.alias("group"), terms(F.col("text")).alias("terms"))
    slices = 1
    while True:
        try:
            counted = reduce(DataFrame.unionByName, [_slice_counts(split, least_docs, slices, part) for part in range(slices)])
            return counted.join(named, "group").select("lang", "source", "term", "n", "docs")
        except Exception as error:
            if "maxResultSize" not in str(error):
                raise
            slices *= 2


def _group_keys(docs: DataFrame) -> tuple[Column, DataFrame]:
    """One number for each (lang, source), which rows are summed up by, and (group, lang, source): a hash with the
    first seed that gives no two groups the same number."""
    groups, seed = cut_lineage(docs.select("lang", "source").distinct(), "groups"), 0
    while True:
        key = F.xxhash64(F.lit(seed), F.col("lang"), F.col("source"))
        found = groups.agg(F.countDistinct(key).alias("keys"), F.count("*").alias("groups")).first()
        if found["keys"] == found["groups"]:
            return key, groups.withColumn("group", key)
        seed += 1


def _slice_counts(split: DataFrame, least_docs: int, slices: int, part: int) -> DataFrame:
    spark = split.sparkSession
    if slices > 1:
        split = split.withColumn("terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(slices)) == part))
    vectorizer = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(least_docs), vocabSize=2 ** 31 - 1)
    try:
        model = vectorizer.fit(split)
    except IllegalArgumentException as error:
        if "vocabulary size" not in str(error):
            raise
        return spark.createDataFrame([], "group long, term string, n long, docs long")  # no term is frequent enough
    entries = F.unwrap_udt("vector")
    sparse = model.transform(split).select("group", F.explode(F.arrays_zip(entries["indices"], entries["values"])).alias("e"))
    sums = sparse.groupBy("group", F.col("e.indices").alias("at")).agg(
        F.sum(F.col("e.values").cast("long")).alias("n"), F.count("*").alias("docs"))
    sums = cut_lineage(sums, "group-sums")
    known = model.vocabulary
    words = pa.table({"at": pa.array(range(len(known)), pa.int32()), "term": pa.array(known, pa.string())})
    return sums.join(spark.createDataFrame(words), "at").select("group", "term", "n", "docs")


def shares(counts: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """`counts` with p = 1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * kinds)), exact; totals(by, total, kinds)."""
    return counts.join(totals, by).withColumn("p", _share(F.col("n")))


def _share(n: Column) -> Column:
    wide = lambda c: c.cast("decimal(20,0)")
    over = wide(n + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)")
    return 1 + F.call_function("div", over, wide(F.col("total")) + wide(F.col("kinds")) * F.lit(SMOOTH).cast("decimal(2,0)"))


def _pair_sums(cells):
    """For Arrow: sums over the terms of a cell of |p - q|, for every source of one block and every one of the other."""
    rows = cells.to_pydict()
    width, a, b = rows["width"][0], rows["a"][0], rows["b"][0]
    blocks = {}
    for block, source_no, base, places, values in zip(rows["block"], rows["source_no"], rows["p0"], rows["places"], rows["values"]):
        line = np.full(width, base, np.int64)
        line[np.asarray(places, np.int64)] = np.asarray(values, np.int64)
        blocks.setdefault(block, []).append((source_no, line))
    left, right = blocks.get(a, []), blocks.get(b, [])
    one = np.array([no for no, _ in left], np.int64)
    found = []
    for no, line in right:
        sums = [int(np.abs(other - line).sum()) for _, other in left]
        found += [(no, x, s) for x, s in zip(one.tolist(), sums) if x != no]
        if a != b:
            found += [(x, no, s) for x, s in zip(one.tolist(), sums)]
    columns = list(zip(*found)) if found else [()] * 3
    lang = pa.array([rows["lang"][0]] * len(found), pa.string())
    return pa.table([lang, *(pa.array(c, pa.int64()) for c in columns)], names=["lang", "x", "y", "value"])


def pairs(lines: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, x, y, value) of every two different sources of a lang by number; value sums |p - q| over all kept terms.

    lines(lang, source_no, term_no, p) has terms that occur, groups(lang, source_no, kinds, p0) every source.
    """
    numbers = groups.groupBy("lang").agg(F.max("source_no").alias("last"))
    placed = groups.join(numbers, "lang").withColumn("block", F.floor(F.col("source_no") / SOURCE_BLOCK))
    # Every source takes part in every slice of terms, also where it has none of them.
    ranges = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("kinds") - 1) / TERM_BLOCK))).alias("part")
    cells = placed.filter("kinds > 0").select("lang", "source_no", "block", "last", "kinds", "p0", ranges)
    held = lines.groupBy("lang", "source_no", F.floor(F.col("term_no") / TERM_BLOCK).alias("part")).agg(
        F.collect_list((F.col("term_no") % TERM_BLOCK).cast("int")).alias("places"), F.collect_list("p").alias("values"))
    none = lambda kind: F.array().cast(kind)
    filled = cells.join(held, ["lang", "source_no", "part"], "left").select(
        "lang", "source_no", "block", "last", "part", "p0", F.least(F.lit(TERM_BLOCK), F.col("kinds") - F.col("part") * TERM_BLOCK).cast("int").alias("width"),
        F.coalesce("places", none("array<int>")).alias("places"), F.coalesce("values", none("array<bigint>")).alias("values"))
    # A block meets itself and every other one of its lang once.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / SOURCE_BLOCK))).alias("other")
    met = filled.select("*", other).select(
        "lang", "part", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
        "source_no", "block", "p0", "width", "places", "values")
    partial = met.groupBy("lang", "part", "a", "b").applyInArrow(_pair_sums, "lang string, x long, y long, value long")
    return partial.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, *, lang_column: str = "lang", source_column: str = "source", text_column: str = "text",
          least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): see `pairs` for part 'pair'.

    Part 'term' has the `top` kept terms of a source whose share exceeds the lang's by the most.
    """
    plain = _plain(docs, lang_column, source_column, text_column)
    known = cut_lineage(group_counts(plain, least_docs=least_docs), "term-counts")
    by_lang = known.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_lang = cut_lineage(by_lang.filter(F.col("docs") >= least_docs).drop("docs"), "by-lang")
    counts = cut_lineage(known.drop("docs").join(by_lang.select("lang", "term"), ["lang", "term"]), "kept-counts")
    in_lang = Window.partitionBy("lang")
    sized = by_lang.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    in_order = numbered(shares(by_lang, sized, ["lang"]), ["lang"], ["term"], label="terms")
    kept = cut_lineage(in_order.select("lang", "term", F.col("_pos").alias("term_no"), F.col("p").alias("q")), "kept-terms")
    groups = plain.select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sized.select("lang", "kinds"), "lang", "left").na.fill(0, ["total", "kinds"])
    groups = groups.withColumn("source_no", (F.row_number().over(in_lang.orderBy("source")) - 1).cast("long"))
    groups = cut_lineage(groups.withColumn("p0", F.when(F.col("kinds") > 0, _share(F.lit(0)))), "groups")
    lines = shares(counts, groups, ["lang", "source"]).join(kept, ["lang", "term"])
    lines = cut_lineage(lines.select("lang", "source", "source_no", "term", "term_no", "p", "q"), "lines")

    named = groups.select("lang", "source_no", "source")
    every = pairs(lines, groups).join(named.withColumnsRenamed({"source_no": "x"}), ["lang", "x"])
    every = every.join(named.withColumnsRenamed({"source_no": "y", "source": "item"}), ["lang", "y"]).select("lang", "source", "item", "value")
    bare = groups.filter("kinds = 0").select("lang", "source")
    without = bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_rows = every.unionByName(without).withColumn("rank", F.row_number().over(ranked))
    term_rows = lines.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term_rows = term_rows.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pair_rows, "pair").unionByName(part(term_rows, "term"))
