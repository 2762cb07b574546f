"""op11 to op13 against plain Python, and op1 on corpora without or with nothing but secrets."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fraudspark.llm import divergence, merkle, mixture, secrets
from fraudspark.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _pos long, hash string, _key string, n int, k string"


def made(seed=3, n=90):
    draw = random.Random(seed)
    words = "the The ÀB über data of x1y 中国 don't".split()
    rows = []
    for i in range(n):
        text = None if i == 4 else "" if i == 5 else " \n\t" if i == 6 else " ".join(draw.choice(words) for _ in range(draw.randint(1, 30)))
        lang = None if i % 11 == 3 else "en" if i % 3 else draw.choice(["", "de", "fr", "ÿ"])
        source = None if i % 13 == 2 else draw.choice(["a", "a", "a", "b", "", "ß"])
        rows.append((i * 7 - 5, text, lang, source, None if i % 17 == 1 else len(text or ""), i, "h", "k", 1, "k"))
    rows[7] = (rows[7][0], "long " * 40_000, *rows[7][2:])
    return rows + [rows[10], rows[10], (None, "no id", "en", "a", 1, 0, "h", "k", 1, "k")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(4).drop("nothing")


# --- 11 Merkle manifest ------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n = row[:5]
    parts = [None if v is None else str(v) for v in (doc_id, source, lang, n, text)]
    return sha("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def manifest_of(rows):
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    first = lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1]))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_of([leaf_of(r, r[1]) for r in sorted(by_lang[x], key=first)]) for x in langs}
    top = levels_of([trees[x][-1][0] for x in langs])
    out = []
    for at, lang in enumerate(langs):
        for pos, r in enumerate(sorted(by_lang[lang], key=first)):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            own, beside = leaf_of(r, lower(r[1]) if hit else r[1]), ""
            for tree, p in ((trees[lang], pos), (top, at)):
                for level in tree[:-1]:
                    run = level[p // 8 * 8:p // 8 * 8 + 8]
                    beside += "".join(run[:p % 8] + run[p % 8 + 1:])
                    own = sha("".join(run[:p % 8] + [own] + run[p % 8 + 1:]))
                    p //= 8
            root = top[-1][0]
            out.append((r[0], leaf_of(r, r[1]), trees[lang][-1][0], root, sha(beside), own, own == root))
    return out


def query_on(spark, name, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    return QUERIES[name](spark, str(tmp_path))


def same(got, want):
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_manifest(spark, table, tmp_path):
    got = query_on(spark, "op11_merkle_manifest", table, tmp_path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    same(got.collect(), manifest_of(made()))


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 512, 513, 4100])
def test_manifest_of_all_shapes(spark, n, tmp_path):
    # Around every power of the fan-out and of a block; 4100 leaves need two rounds of blocks.
    rows = [(i, f"T{i}", "en", "s", i) for i in range(n)]
    frame = spark.range(n).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("T"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    same(query_on(spark, "op11_merkle_manifest", frame, tmp_path).collect(), manifest_of(rows))


def test_manifest_of_many_groups(spark, tmp_path):
    rows = [(i, "t", f"l{i % 70}", None, None) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same(query_on(spark, "op11_merkle_manifest", frame, tmp_path).collect(), manifest_of(rows))


def test_tampering_is_found(spark, table):
    values = [F.col("doc_id"), F.col("text")]
    found = merkle.proofs(table, values, group="lang", order="doc_id", carry=merkle.leaf([F.col("doc_id"), F.lit("other")]))
    fold = lambda c: merkle.fold(F.col(c), F.col("siblings")) == F.col("root")
    row = found.agg(F.count_if(fold("leaf")).alias("own"), F.count_if(fold("carried")).alias("other"), F.count("*").alias("n")).first()
    assert (row.own, row.other) == (row.n, 0)


# --- 12 divergence -----------------------------------------------------------------------------

def audit_of(rows, least, top=50):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))) for r in rows]
    df, counts, groups = Counter(), defaultdict(Counter), sorted({d[:2] for d in docs})
    for lang, source, words in docs:
        df.update((lang, w) for w in set(words))
        counts[lang, source].update(words)
    out = []
    for lang, source in groups:
        kept = sorted((w for x, w in df if x == lang and df[x, w] >= least), key=str.encode)
        share = lambda c: {w: 1 + 10 ** 9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}
        p = share(counts[lang, source])
        pairs = [(sum(abs(p[w] - q) for w, q in share(counts[lang, s]).items()), s) for x, s in groups if x == lang and s != source]
        q = share(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        over = [(p[w] - q[w], w) for w in kept if counts[lang, source][w] and p[w] > q[w]]
        for part, found in (("pair", pairs), ("term", over)):
            ranked = sorted(found, key=lambda f: (-f[0], f[1].encode()))[:top if part == "term" else None]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return out


@pytest.mark.parametrize("least, blocks", [(30, (64, 8192)), (3, (64, 8192)), (2, (2, 3)), (10 ** 6, (64, 8192))])
def test_divergence(spark, table, least, blocks, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCE_BLOCK", blocks[0])
    monkeypatch.setattr(divergence, "TERM_BLOCK", blocks[1])
    got = divergence.audit(table, least_docs=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    same(got.collect(), audit_of(made(), least))


def test_divergence_in_slices(spark, table, monkeypatch):
    """Where Spark refuses to bring a vocabulary to the driver, slices of the terms give the same result."""
    fit, seen = divergence.CountVectorizer.fit, []

    def refuse(self, frame, *rest):
        seen.append(frame)
        if len(seen) < 3:
            raise RuntimeError("Total size of serialized results is bigger than spark.driver.maxResultSize")
        return fit(self, frame, *rest)

    monkeypatch.setattr(divergence.CountVectorizer, "fit", refuse)
    same(divergence.audit(table, least_docs=3).collect(), audit_of(made(), 3))
    assert len(seen) == 2 + 4


def test_divergence_keeps_the_top_terms_only(spark, table):
    same(divergence.audit(table, least_docs=2, top=2).collect(), audit_of(made(), 2, top=2))


# --- 13 mixture --------------------------------------------------------------------------------

def targets_of(sizes):
    """Exact: raise the level until the targets add up, source by source in order of the level that fills it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_weight = Fraction(3, 2) * sum(sizes.values()), sum(weight.values())
    out = {}
    for s in sorted(names, key=lambda s: Fraction(2 * sizes[s], weight[s])):
        out[s] = min(Fraction(2 * sizes[s]), left / open_weight * weight[s])
        left, open_weight = left - out[s], open_weight - weight[s]
    return out


def test_mixture(spark, table):
    got = mixture.mix(table).collect()
    want = [(r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")), r[3]) for r in made()]
    totals = Counter()
    for _, size, source in want:
        totals[source] += size
    goal = targets_of(totals)
    same([(r.doc_id, r["size"], r.source_size) for r in got], [(i, n, totals[s]) for i, n, s in want])
    of = {i: s for i, _, s in want}
    taken, largest = Counter(), Counter()
    for r in got:
        assert abs(r.target - float(goal[of[r.doc_id]])) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 2 * r["size"] and r.taken % max(1, r["size"]) == 0
        taken[of[r.doc_id]] += r.taken
        largest[of[r.doc_id]] = max(largest[of[r.doc_id]], r["size"])
    for s in totals:
        assert abs(taken[s] - goal[s]) <= 2 * largest[s]
    same(mixture.mix(table.repartition(7)).collect(), [tuple(r) for r in got])


def test_mixture_near_targets(spark):
    # One source with a third of all rows, one far below its weight, and many rows of one size.
    rows = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 7919 % 41).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, "small").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source"))
    got = mixture.mix(rows).join(rows.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most"), F.first("source_size").alias("n")).collect()
    assert all(abs(r.taken - r.target) <= 0.01 * r.target + 82 and r.most <= 2 for r in got)
    goal = targets_of({r.source: r.n for r in got})
    assert all(abs(r.target - float(goal[r.source])) < 1e-6 * r.target for r in got)


def test_mixture_without_words(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(map(tuple, mixture.mix(rows).collect())) == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]


# --- empty tables, and op1 with one kind of text -----------------------------------------------

def test_empty_tables(table):
    none = table.filter(F.lit(False))
    assert merkle.proofs(none, [F.col("text")], group="lang", order="doc_id").count() == 0
    assert divergence.audit(none).count() == 0 and mixture.mix(none).count() == 0


@pytest.mark.parametrize("texts", [[], ["plain words only", "and more of them"], ["password = hunter22"] * 3, ["", " \n", None]])
def test_secrets_of_one_kind_of_text(spark, texts):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    field = secrets.train(docs)
    found = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in secrets.scan(docs, field).collect()}
    assert found == {i: secrets.base_spans(t or "") for i, t in enumerate(texts)}
    hidden = {r.doc_id: r.text for r in corpus_pipeline.hide_secrets(spark, docs, "").collect()}
    assert hidden == {i: t and t.replace("hunter22", "[SECRET]") for i, t in enumerate(texts)}
