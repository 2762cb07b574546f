"""Queries opN_<name>: each operator over its whole table, with the digest columns of its result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudspark.llm import (
    bm25_wand, byte_bpe, divergence, hmm_lm, license_match, merkle, mixture, quality_model, quality_rules, secrets, suffix_dedup,
    tensor_minhash, training_order,
)
from fraudspark.llm.common import held_out
from fraudspark.session import prepare, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PREDICTED_FROM = 0.3


def ready(spark: SparkSession) -> SparkSession:
    """Texts may be long, so fewer rows at once go to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return prepare(spark)


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(ready(spark), folder)
        if sql is not None:
            CHECKS[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(spark: SparkSession, path: str | None = None) -> byte_bpe.Vocabulary:
    return byte_bpe.Vocabulary(spark, path or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op1_secret_scan")
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    # A span of the contract is a whole match, as its length rule for group 2 is one for matches.
    order = lambda kind: F.array_position(F.array(*map(F.lit, secrets.KINDS)), kind)
    found = found.withColumn("spans", F.array_sort(F.zip_with("spans", "matched", lambda s, at: F.struct(
        at.alias("start"), order(s["kind"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), of("crf").alias("n_crf"),
    )


@query("op2_byte_bpe")
def byte_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    words = vocabulary(spark)
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, folder, "documents"), words), words)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op3_license_scan")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    written = F.array_join(F.transform("matches", lambda m: F.concat_ws(
        ":", m["license"], m["start"].cast("string"), m["end"].cast("string"), F.format_number(m["coverage"], 3))), ",")
    return license_match.scan(table(spark, folder, "documents")).select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), written.alias("matches"))


@query("op4_quality_score")
def quality_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = held_out("doc_id", 5, 0)
    weights = quality_model.train(docs, table(spark, folder, "labels").filter(~out))
    return quality_model.score(docs, weights).select(
        "doc_id", out.alias("held_out"), "score", (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"))


@query("op5_repeated_bytes")
def repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    kept = suffix_dedup.remove_repeated(table(spark, folder, "documents"))
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_language_model")
def language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = held_out("doc_id", 7, 2)
    return hmm_lm.score(docs, out, hmm_lm.train(docs, out))


@query("op7_near_duplicates", """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), x -> x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), i -> array_to_string(w[i:i + 4], ' ')) END) AS g FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * common.n >= 85 * (s.n + t.n - common.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN sizes USING (doc_id)
""")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return tensor_minhash.near_duplicates(table(spark, folder, "documents"))


@query("op8_training_order")
def training_slots(spark: SparkSession, folder: str) -> DataFrame:
    return training_order.materialise(table(spark, folder, "documents"), scratch_path(spark, "shards"))


@query("op9_quality_rules")
def rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    trusted = table(spark, folder, "labels").filter("quality = 1")
    return quality_rules.judge(docs, quality_rules.ratios(docs, trusted))


@query("op10_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return bm25_wand.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: CRC-32 bit by bit: eight steps for each byte of a decimal number, the byte added before the first.
_CRC_SQL = """xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
         lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)))"""

_FIELDS_SQL = "".join(f" || coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))[4:]


@query("op11_merkle_manifest", f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, sha256({_FIELDS_SQL.format(text="text")}) AS leaf,
         sha256({_FIELDS_SQL.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS other,
         coalesce({_CRC_SQL} % 3 = 0, false) AS tampered FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM docs GROUP BY lang),
leaves AS (SELECT d.*, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY tree) AS n FROM docs d JOIN langs l ON d.lang IS NOT DISTINCT FROM l.lang),
low AS (SELECT tree, 0 AS level, pos, leaf AS h, n FROM leaves UNION ALL
        SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM low WHERE n > 1 GROUP BY tree, level, pos // 8, n),
subroots AS (SELECT tree, h FROM low WHERE n = 1),
high AS (SELECT -1 AS tree, 0 AS level, tree AS pos, h, (SELECT count(*) FROM subroots) AS n FROM subroots UNION ALL
         SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM high WHERE n > 1 GROUP BY tree, level, pos // 8, n),
nodes AS MATERIALIZED (SELECT * FROM low UNION ALL SELECT * FROM high),
steps AS MATERIALIZED (
  SELECT a.tree, a.level, a.pos, a.tree AS next_tree, a.level + 1 AS next_level, a.pos // 8 AS next_pos,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL
  UNION ALL SELECT tree, level, pos, -1, 0, tree, NULL, NULL FROM low WHERE n = 1),
walk AS (
  SELECT tree AS own_tree, pos AS own, tree, 0 AS level, pos, CASE WHEN tampered THEN other ELSE leaf END AS h, '' AS beside FROM leaves UNION ALL
  SELECT own_tree, own, next_tree, next_level, next_pos, CASE WHEN l IS NULL THEN h ELSE sha256(l || h || r) END, beside || coalesce(l || r, '')
  FROM walk JOIN steps USING (tree, level, pos))
SELECT doc_id, leaf, s.h AS subroot, top.h AS root, sha256(w.beside) AS proof_sha256, w.h AS folded_root, w.h = top.h AS verified
FROM leaves JOIN subroots s USING (tree) JOIN (SELECT h, level FROM high WHERE n = 1) top ON true
JOIN walk w ON w.own_tree = leaves.tree AND w.own = leaves.pos AND w.tree = -1 AND w.level = top.level
""")
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    lowered = merkle.leaf(fields(F.translate("text", divergence.UPPER, divergence.LOWER)))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lowered)
    found = merkle.proofs(docs, fields(F.col("text")), group="lang", order="doc_id", carry=tampered)
    folded = found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.written(F.col("siblings")), 256).alias("proof_sha256"),
        merkle.fold(F.coalesce("carried", "leaf"), F.col("siblings")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_source_divergence", """
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS no,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS (SELECT lang, source, no, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT no) >= 30),
tot AS (SELECT lang, sum(n) AS total, count(*) AS kinds FROM kept GROUP BY lang),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * kinds) AS q FROM kept JOIN tot USING (lang)),
grp AS (SELECT DISTINCT lang, source FROM docs),
cnt AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS own FROM cnt GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(own, 0) + 5 * kinds) AS p
      FROM grp g JOIN kept k USING (lang) JOIN tot USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN cnt c USING (lang, source, term)),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
tr AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pr UNION ALL
           SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM tr)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""")
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


@query("op13_source_mix", """
WITH RECURSIVE sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (SELECT key, sum(size)::BIGINT AS s, [5, 2, 1][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS w FROM sized GROUP BY key),
-- The level at which the sources that are full by the one before leave the rest of 150 %; it only rises.
fill AS (SELECT 0 AS turn, 0.0::DOUBLE AS level, -1::BIGINT AS full_before, 0::BIGINT AS full_now UNION ALL
         SELECT turn + 1, CASE WHEN n = full_before OR w = 0 THEN level ELSE (1.5 * whole - held) / w END, n, CASE WHEN n = full_before OR w = 0 THEN -2 ELSE n END
         FROM (SELECT f.turn, f.level, f.full_before, count(*) FILTER (2 * s <= level * sources.w) AS n,
                      coalesce(sum(2 * s) FILTER (2 * s <= level * sources.w), 0)::DOUBLE AS held, sum(s)::DOUBLE AS whole,
                      coalesce(sum(sources.w) FILTER (2 * s > level * sources.w), 0)::DOUBLE AS w
               FROM fill f, sources WHERE f.full_now > -2 GROUP BY ALL)),
goal AS (SELECT key, s, least((2 * s)::DOUBLE, (SELECT arg_max(level, turn) FROM fill) * w) AS target FROM sources),
parts AS (SELECT *, CASE WHEN s > 0 THEN least(floor(target / s * 1099511627776.0), 2199023255552)::HUGEINT ELSE 0::HUGEINT END AS each,
          ('0x' || substr(md5('mix:' || key), 1, 10))::BIGINT AS start FROM goal),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) AS k FROM sized)
SELECT doc_id, size, s AS source_size, target, copies, (copies * size)::BIGINT AS taken
FROM (SELECT doc_id, size, s, target, ((start + each * k) // 1099511627776 - (start + each * (k - 1)) // 1099511627776)::BIGINT AS copies FROM placed JOIN parts USING (key))
""")
def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(table(spark, folder, "documents"))
