"""Queries over the training-data operators, and the same in DuckDB's SQL where that can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.hpylm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import license_report

    return license_report(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import archived_pages

    return archived_pages(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality_net import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.importance import importance_resample

    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.periodic import run_report

    return run_report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hpylm": op1_hpylm,
        "op2_secrets": op2_secrets,
        "op3_toxicity": op3_toxicity,
        "op4_licenses": op4_licenses,
        "op5_packing": op5_packing,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_warc": op7_warc,
        "op8_mixing": op8_mixing,
        "op9_quality": op9_quality,
        "op10_ngram_join": op10_ngram_join,
        "op11_quality_net": op11_quality_net,
        "op12_importance": op12_importance,
        "op13_periodic": op13_periodic,
        "pipeline": pipeline,
    }


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_RULES = (("assign", _ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1))


def _secret_sql() -> str:
    kinds = []
    for rank, (kind, pattern, group, least) in enumerate(_RULES):
        kinds.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, i, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s, length(found[i])::BIGINT AS n, length(parts[i]) >= {least} AS ok "
            f"FROM (SELECT doc_id, found, parts, gaps, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {group}) AS parts, string_split_regex(t, '{pattern}') AS gaps FROM d))"
        )
    all_kinds = " UNION ALL ".join(kinds)
    base = "kind <> 'pem'"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({all_kinds}), k AS (SELECT doc_id, kind, rank, s, kind || ':' || s || ':' || (s + n) AS span FROM f WHERE ok),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'pem') AS n_pem,
string_agg(span, ',' ORDER BY s, rank) FILTER ({base}) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_pem, 0) AS n_pem, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


def _license_sql() -> str:
    """Known texts as VALUES; words stand between double spaces while spellings are changed."""
    from tidemark.llm.licenses import KNOWN, KNOWN_DIGESTS, SPELLINGS

    text = lambda x: "'" + x.replace("'", "''") + "'"

    def plain(c: str) -> str:
        lines = rf"regexp_replace(lower({c}), '(?m)^[^\n]*(?:\bcopyright\s*(?:\(c\)|©|\d)|\(c\)\s*\d|©|all rights reserved)[^\n]*$', ' ', 'g')"
        return rf"trim(regexp_replace({lines}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

    def digest(c: str) -> str:
        out = f"' ' || replace({c}, ' ', '  ') || ' '"
        for a, b in SPELLINGS:
            a, b = (" " + x.replace("-", " ").replace(" ", "  ") + " " for x in (a, b))
            out = f"replace({out}, {text(a)}, {text(b)})"
        return f"sha256(trim(replace({out}, '  ', ' ')))"

    known = ", ".join(f"({i}, {text(a)}, {text(b)})" for i, (a, b) in enumerate(KNOWN))
    digests = ", ".join(f"({len(KNOWN) + i}, {text(a)}, {text(b)})" for i, (a, b, _) in enumerate(KNOWN_DIGESTS))
    return f"""WITH v(no, license, t) AS (VALUES {known}), w AS (SELECT no, license, {plain("t")} AS words FROM v),
x(no, license, digest) AS (SELECT no, license, {digest("words")} FROM w UNION ALL VALUES {digests}), k AS (SELECT digest, arg_min(license, no) AS license FROM x GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, {plain("t")} AS words FROM d), g AS (SELECT doc_id, {digest("words")} AS text_digest FROM p),
l AS (SELECT doc_id, unnest(list_concat(string_split(t, chr(10)), string_split_regex(t, '\\n[\\x20\\t\\r]*\\n'))) AS part FROM d),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM (SELECT doc_id, {plain("part")} AS words FROM l) x JOIN k ON {digest("words")} = k.digest GROUP BY doc_id)
SELECT g.doc_id, text_digest, k.license, coalesce(notices, '') AS notices FROM g LEFT JOIN k ON text_digest = digest LEFT JOIN n ON g.doc_id = n.doc_id"""


EXACT_SQL = r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, keep_id, group_size, n.doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t"""

WARC_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id < keep THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keep THEN keep END AS refers_to FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000"""

MIX_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS number FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][(number - 1) % 3 + 1]::DOUBLE AS weight FROM n),
c AS (SELECT *, source_size::DOUBLE * 3 AS cap, source_size::DOUBLE * 3 / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level FROM c WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, number, source_size, least(cap, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER () * weight, cap)) AS target FROM l),
q AS (SELECT r, d.doc_id, d.size, number, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT r, number, target, e * source_size + start + 128 * p AS position, least(128, size - 128 * p) AS words FROM (SELECT *, unnest(range(0, (size + 127) // 128)) AS p FROM q), (SELECT unnest([0, 1, 2]) AS e)),
o AS (SELECT r, words, sum(words) OVER (ORDER BY (position + words)::DOUBLE / target, number, position ROWS UNBOUNDED PRECEDING) - words AS ahead FROM p),
k AS (SELECT r, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - ahead)))::BIGINT AS taken FROM o GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM q LEFT JOIN k ON q.r = k.r"""


# The words of all texts and their CRC-32 by its definition: eight steps for a table of bytes, then one a byte.
IMPORTANCE_SQL = r"""WITH RECURSIVE z(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM z WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS steps FROM z WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark),
p AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
o AS (SELECT w, sum(n) AS s FROM p GROUP BY w), x AS (SELECT w, count(*) AS t FROM b GROUP BY w),
h AS (SELECT w, hex(encode(w)) AS bytes FROM (SELECT w FROM o UNION SELECT w FROM x)),
k AS (SELECT w, xor(list_reduce(list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT), lambda acc, v: xor(acc >> 8, steps[xor(acc & 255, v) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM h, crc),
g AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM (SELECT w, s, 0 AS t FROM o UNION ALL SELECT w, 0, t FROM x) JOIN k USING (w) GROUP BY bucket),
v AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM g) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM g) + 10000))))::BIGINT AS gain FROM g),
m AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM p JOIN k USING (w) JOIN v USING (bucket) GROUP BY r),
q AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (r)),
n AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM n"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": _secret_sql(), "op4_licenses": _license_sql(), "op6_exact_dedup": EXACT_SQL, "op7_warc": WARC_SQL, "op8_mixing": MIX_SQL, "op12_importance": IMPORTANCE_SQL}
