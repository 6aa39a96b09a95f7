"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from rasterloom.llm import bpe, common, exact_dedup, gru_lm, jaccard, langid, mixing, quality, secret_scan, suffix_dedup, toxicity

#: Word characters are all but these; A-Z alone are lower-cased.
SQL_WORD = r"[^\x20\x09-\x0D]+"
SQL_UPPER, SQL_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without other_id: of the texts that share a passage, the operator names one that it met."""
    return suffix_dedup.repeated_passages(common.documents(spark, sf_dir)).drop("other_id")


OP3_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{SQL_UPPER}', '{SQL_LOWER}'), '{SQL_WORD}') AS ws FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {suffix_dedup.LEAST_WORDS} + 1)) AS i FROM w WHERE len(ws) >= {suffix_dedup.LEAST_WORDS}),
k AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + {suffix_dedup.LEAST_WORDS}], ' ') AS body FROM g),
s AS (SELECT body FROM k GROUP BY body HAVING min(doc_id) < max(doc_id)),
h AS (SELECT DISTINCT doc_id, i FROM k JOIN s USING (body)),
b AS (SELECT doc_id, i, coalesce(i > lag(i) OVER p + {suffix_dedup.LEAST_WORDS}, true) AS fresh FROM h WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, count_if(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + {suffix_dedup.LEAST_WORDS} AS INTEGER) AS end_word,
  CAST(max(i) + {suffix_dedup.LEAST_WORDS} - min(i) AS INTEGER) AS n_words
FROM n GROUP BY doc_id, run
"""


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(common.documents(spark, sf_dir), width=3, num=90, den=100)


OP4_SQL = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{SQL_UPPER}', '{SQL_LOWER}'), '{SQL_WORD}') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
t AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS shingle FROM g),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 90 * (x.n + y.n - both_have)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(common.documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{SQL_UPPER}', '{SQL_LOWER}') AS body FROM documents),
     g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g ON d.body = g.body
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    found = quality.quality_filter(docs, keep_measures=True)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *names, failed.alias("base_failed"), (~failed & F.col("failed_rule").isNull()).alias("kept"))


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{SQL_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SQL_WORD}')) AS ls FROM d),
pos AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM pos),
many AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM many WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  len(regexp_extract_all(t, '!!')) AS n_bangs, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN cover c ON w.doc_id = c.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols * 10 > n_words OR n_bangs * 5 > n_words
       OR n_upper * 2 > word_chars OR word_chars > n_words * 25 OR n_dup_lines * 2 > n_lines) AS kept
FROM m
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixing_plan(common.documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{SQL_WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM s),
w AS (SELECT source, source_size, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * 2.0::DOUBLE AS stop FROM r),
o AS (SELECT *, stop / weight AS ratio FROM w),
f AS (SELECT *, coalesce(sum(stop) OVER p, 0) AS stops, coalesce(sum(weight) OVER p, 0) AS used,
        (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS total, (SELECT sum(weight) FROM w) AS weights
      FROM o WINDOW p AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - stops) / CAST(weights - used AS DOUBLE) AS level FROM f),
t AS (SELECT source, source_size, least(stop, (SELECT max(level) FROM l WHERE level <= ratio) * weight) AS target FROM l),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t),
c AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.rate,
        CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':0'), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS part
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN part < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c
"""


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(common.documents(spark, sf_dir))
    kinds = F.array(*[F.lit(k) for k, *_ in secret_scan.RULES])
    n_base = len(secret_scan.BASE_RULES)
    spans = F.coalesce("spans", F.array().cast("array<struct<places:int,starts:int,ends:int>>"))
    count = lambda place: F.size(F.filter(spans, lambda s: s["places"] == place)).cast("long")
    joined = lambda chosen: F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.get(kinds, s["places"]), s["starts"].cast("string"), s["ends"].cast("string"))), ",")
    found = found.withColumn("spans", F.arrays_zip("places", "starts", "ends"))
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.filter(spans, lambda s: s["places"] < n_base)).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def _op10_sql() -> str:
    """Starts of matches are the lengths of what stands before: the pieces between matches, and the matches."""
    letters = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)  # noqa: E731  RE2's own folding would go beyond A-Z
    names = "|".join(letters(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = {"assign": rf"(?:{names})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"}
    patterns |= {kind: pattern.replace("'", "''") for kind, pattern, *_ in secret_scan.RULES[1:]}
    found = " UNION ALL ".join(
        f"SELECT row, {k} AS place, '{kind}' AS kind, {least} AS least, {1 if group else 0} AS own, '{patterns[kind]}' AS rule, regexp_extract_all(t, '{patterns[kind]}') AS hits, regexp_extract_all(t, '{patterns[kind]}', {1 if group else 0}) AS parts, string_split_regex(t, '{patterns[kind]}') AS gaps FROM d"
        for k, (kind, _, group, least) in enumerate(secret_scan.RULES)
    )
    span = "kind || ':' || start || ':' || (start + size)"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
u AS (SELECT row, place, kind, least, hits, parts, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
s AS (SELECT row, place, kind, length(hits[i]) AS size,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
      FROM u WHERE length(parts[i]) >= least),
f AS (SELECT row, count_if(place = 0) AS n_assign, count_if(place = 1) AS n_access, count_if(place = 2) AS n_hex,
        string_agg({span}, ',' ORDER BY start, place) FILTER (place < {len(secret_scan.BASE_RULES)}) AS base, string_agg({span}, ',' ORDER BY start, place) AS spans
      FROM s GROUP BY row)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (row)
"""


OP10_SQL = _op10_sql()


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_table(common.documents(spark, sf_dir), common.fold_of("doc_id", 5) == 1)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_table(common.documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    learn = docs.where(common.fold_of("doc_id", 5) != 0)
    model = toxicity.fit(learn, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score_table(docs, model)
    return found.select("doc_id", (common.fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = langid.fit(docs.where(common.fold_of("doc_id", 4) != 2))
    found = langid.language_table(docs, model)
    return found.select("doc_id", (common.fold_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op1_lm_score": op1_lm_score, "op2_bpe": op2_bpe, "op3_suffix": op3_suffix, "op4_jaccard": op4_jaccard, "op5_exact_dedup": op5_exact_dedup, "op6_quality": op6_quality, "op7_toxicity": op7_toxicity, "op8_language": op8_language, "op9_mixing": op9_mixing, "op10_secrets": op10_secrets}
ORACLE_SQL = {"op3_suffix": OP3_SQL, "op4_jaccard": OP4_SQL, "op10_secrets": OP10_SQL, "op5_exact_dedup": OP5_SQL, "op6_quality": OP6_SQL, "op9_mixing": OP9_SQL}
