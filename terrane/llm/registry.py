"""The corpus queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, embedding_forest, licenses, mixing, near_dup, packing, quality, secrets, token_counts, warc

#: Folder of the public tokenizer files; None: that of the installed package.
TOKENIZERS: str | None = None

#: Target weights of the sources; what is left open is for all others.
TARGETS = {"src0": 0.20} | {f"src{k}": 0.04 for k in range(1, 20)}


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 2048)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op3_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("live", "text_key")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, TARGETS, period=100, block=8)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 1024, 2)


def queries() -> dict:
    found = [op1_token_counts, op2_substring_dedup, op3_embedding_near_dup, op4_minhash_near_dup, op5_warc, op6_quality_rules, op7_license_scan, op8_mixing, op9_secret_scan, op10_packing]
    return {f.__name__: f for f in found}


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN f.first_id IS NOT NULL AND d.n >= 100 AND d.page_id > f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.n >= 100 AND d.page_id > f.first_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON d.digest = f.digest
"""


#: The targets in whole slots of a period of 100, and earliest deadline first over them, from the definition.
OP8_SQL = """
WITH RECURSIVE n AS (SELECT list_concat(['(other)', 'src0'], ['src' || k for k in generate_series(1, 19)]) AS cls, list_concat([4, 20], [4 for k in generate_series(1, 19)]) AS per),
e AS (SELECT -1 AS slot, [0 for k in generate_series(1, 21)] AS had, 0 AS k, 0 AS i, 0 AS release, 0 AS deadline FROM n
  UNION ALL SELECT slot + 1, [had[j] + CASE WHEN j = b.k THEN 1 ELSE 0 END for j in generate_series(1, 21)], b.k, b.i, b.release, b.deadline FROM (
    SELECT slot, had, list_min([{'deadline': CAST(ceil((had[j] + 1) * 100 / per[j]) AS INTEGER), 'cls': cls[j], 'k': j, 'i': had[j], 'release': CAST(floor(had[j] * 100 / per[j]) AS INTEGER)}
      for j in generate_series(1, 21) if had[j] < per[j] AND floor(had[j] * 100 / per[j]) <= slot + 1]) AS b FROM e, n WHERE slot < 99)),
plan AS (SELECT n.cls[k] AS cls, n.per[k] AS per, i, slot, release, deadline FROM e, n WHERE slot >= 0),
r AS (SELECT doc_id, source, CASE WHEN list_contains((SELECT cls[2:] FROM n), source) THEN source ELSE '(other)' END AS cls, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
m AS (SELECT doc_id, source, cls, row_number() OVER (PARTITION BY cls ORDER BY k, doc_id NULLS FIRST) - 1 AS rk FROM r),
b AS (SELECT m.*, rk // 8 AS block, p.per FROM m JOIN (SELECT DISTINCT cls, per FROM plan) p USING (cls)),
s AS (SELECT b.doc_id, b.source, b.rk, b.block, (b.block // b.per) * 100 AS base, plan.slot, plan.release, plan.deadline FROM b JOIN plan ON plan.cls = b.cls AND plan.i = b.block % b.per)
SELECT doc_id, source, CAST(block AS BIGINT) AS mix_block, CAST(base + release AS BIGINT) AS mix_release, CAST(base + deadline AS BIGINT) AS mix_deadline,
  CAST(base + slot AS BIGINT) AS mix_slot, CAST((base + slot) * 8 + rk % 8 AS BIGINT) AS mix_position FROM s
"""


OP3_SQL = """
WITH RECURSIVE ok AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.low, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(c.low, v.vec_id)) AS kept
FROM embeddings v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_transform(generate_series(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS sh
  FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.low, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""


def op6_sql() -> str:
    """The contract's patterns and limits stand here as literals; only the shares of words, a table, are the module's."""
    classes = ["[a-z]", "[A-Z]", "[0-9]", "[\\x20\\x09-\\x0D]", "[.,;:!?''\"()-]", "[#*$%&|<>]"]
    without = lambda p: f"length(text) - length(regexp_replace(text, '{p}', '', 'g'))"
    counts = ", ".join(without(p) for p in classes)
    words = ", ".join(f"'{w}'" for w in quality.WORDS)
    nw = len(quality.WORDS) + 1
    shares = ", ".join(f"('{k}', {quality.word_shares(k)}::DOUBLE[])" for k in quality.COMMON)

    def distance(h: str, n: int) -> str:
        p, q = f"({h}[i] / list_sum({h}))", f"r_{h}[i]"
        part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
        return f"CASE WHEN list_sum({h}) > 0 AND r_{h} IS NOT NULL THEN sqrt(greatest(list_sum([{part(p)} + {part(q)} for i in generate_series(1, {n})]) / 2, 0)) END"

    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, [{counts}] AS c0 FROM d),
g AS (SELECT doc_id, unnest(generate_series(1, len(words) - 4)) AS i, words FROM w WHERE len(words) > 5),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i : i + 4]) AS n FROM g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM k WHERE n > 1) GROUP BY 1),
f AS (SELECT w.*, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, {without("[#*$%&|<>]")} AS n_symbols,
  len([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')]) AS n_lines,
  len(list_distinct([x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')])) AS n_own, coalesce(n_repeat_words, 0) AS n_repeat_words,
  list_concat(c0, [greatest(length(text) - list_sum(c0), 0)]) AS cls, [x for x in list_transform(words, lambda x: lower(x)) if x IN ({words})] AS known FROM w LEFT JOIN c USING (doc_id)),
h AS (SELECT *, list_concat([len([x for x in known if x = v]) for v in [{words}]], [n_words - len(known)]) AS com FROM f),
r(lang, r_cls) AS (VALUES ('en', [0.785, 0.025, 0.005, 0.165, 0.020, 0.0, 0.0]::DOUBLE[]), ('de', [0.770, 0.055, 0.005, 0.140, 0.020, 0.0, 0.010]::DOUBLE[]),
  ('fr', [0.755, 0.020, 0.005, 0.165, 0.030, 0.0, 0.025]::DOUBLE[]), ('es', [0.765, 0.020, 0.005, 0.165, 0.020, 0.0, 0.025]::DOUBLE[])),
rw(lang, r_com) AS (VALUES {shares}),
j AS (SELECT h.*, {distance("cls", 7)} AS cd, {distance("com", nw)} AS wd, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM h LEFT JOIN r USING (lang) LEFT JOIN rw USING (lang))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_lines - n_own AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(CASE WHEN n_words >= 300 THEN cd > 0.22 OR wd > 0.26 WHEN n_words >= 120 THEN cd > 0.22 OR wd > 0.30 WHEN n_words >= 60 THEN cd > 0.30 OR wd > 0.42 END, FALSE) AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM j
"""


OP9_KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("provider", "gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|[sr]k_live_[0-9A-Za-z]{24,}|eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}", 0, 0),
]


def op9_sql() -> str:
    """The contract's patterns and limits, written out here: kind, pattern, group of the secret, its least length."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(OP9_KINDS):
        p = pattern.replace("'", "''")
        value = f"regexp_extract(m, '{p}', {group})"
        parts.append(f"""SELECT doc_id, source, '{kind}' AS kind, {rank} AS rank, b + length(p) AS start, b + length(p) + length(m) AS stop, md5({value}) AS digest FROM (
  SELECT doc_id, source, m, p, coalesce(sum(length(m) + length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (
    SELECT doc_id, source, unnest(ms) AS m, unnest(ps[1 : len(ms)]) AS p, unnest(generate_series(1, len(ms))) AS i FROM (
      SELECT doc_id, source, regexp_extract_all(text, '{p}') AS ms, regexp_split_to_array(text, '{p}') AS ps FROM documents WHERE text IS NOT NULL) WHERE len(ms) > 0)) WHERE length({value}) >= {least}""")
    return f"""
WITH s AS ({" UNION ALL ".join(parts)}),
o AS (SELECT digest, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS n_owners, count(DISTINCT (source, doc_id)) AS n_repositories FROM s GROUP BY 1),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3 OR n_owners <= 2 AND n_repositories <= 20), '') AS spans,
  count(*) FILTER (n_owners <= 2 AND n_repositories <= 20) AS n_live, count(*) FILTER (n_owners > 2 OR n_repositories > 20) AS n_examples, max(n_owners) AS most_owners, max(n_repositories) AS most_repositories FROM s JOIN o USING (digest) GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories FROM documents d LEFT JOIN a USING (doc_id)
"""


def op7_sql() -> str:
    """Every window of every width against every template, by sets of three words; windows are two to four times as long."""
    rows, widths = [], set()
    for name, many in sorted(licenses.TEMPLATES.items()):
        for text in many:
            w = re.findall("[a-z0-9]+", text.lower())
            width = next(x for x in (12 << k for k in range(20)) if len(w) <= x // 2 + 1)
            widths.add(width)
            rows.append(f"('{name}', {width}, {w})")
    grams = lambda w: f"list_distinct([{w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2] for i in generate_series(1, len({w}) - 2)])"
    return f"""
WITH t(license, width, words) AS (VALUES {", ".join(rows)}), tt AS (SELECT license, width, {grams("words")} AS sh FROM t),
d AS (SELECT doc_id, [x for x in regexp_split_to_array(lower(text), '[^a-z0-9]+') if x <> ''] AS words FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, width, step * (width // 2) AS first_word, words[step * (width // 2) + 1 : step * (width // 2) + width] AS win FROM (
  SELECT doc_id, words, width, unnest(generate_series(0, len(words) // (width // 2))) AS step FROM d, (SELECT unnest({sorted(widths)}) AS width))),
g AS (SELECT doc_id, width, first_word, {grams("win")} AS have FROM v WHERE len(win) > 2),
m AS (SELECT doc_id, license, first_word, g.width, len(list_intersect(sh, have)) / len(sh) AS share FROM g JOIN tt ON g.width = tt.width AND list_has_any(have, sh))
SELECT doc_id, license, round(max(share), 6) AS containment, min(first_word) AS first_word, count(DISTINCT (width, first_word)) AS n_windows FROM m WHERE share >= 0.8 GROUP BY 1, 2
"""


def oracle_sql() -> dict:
    return {"op6_quality_rules": op6_sql(), "op7_license_scan": op7_sql(), "op9_secret_scan": op9_sql(), "op3_embedding_near_dup": OP3_SQL, "op4_minhash_near_dup": OP4_SQL, "op5_warc": OP5_SQL, "op8_mixing": OP8_SQL}
