"""The corpus operators bound to the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, hard_negatives, langid, ngram_join, order_minhash, packing, quality, secrets, token_counts, topk, toxicity, warc
from .common import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules of op7 are votes over, so that SQL can tell it."""
    counted = quality.counts(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", quality.base_failed().alias("base_failed"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=20, scale=64, query_modulus=20)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after a new heading, a replacement in the middle and a cut of the last ten characters."""
    docs = table(spark, sf_dir, "documents")
    size = F.length(F.coalesce("text", F.lit("")))
    middle = F.floor(size / 2)
    step = lambda a, b, t: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(t).alias("replacement"))
    edits = F.array(step(F.lit(0), F.lit(0), "Note: "), step(middle + 6, middle + 11, " (edited)"), step(size - 1, size + 9, ""))
    return token_counts.count(docs.select("doc_id", "text", edits.alias("edits")), "edits", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector bears a wrong label."""
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives.mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.compare(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "next_id")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_packing": op4_packing,
    "op5_warc": op5_warc,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality_rules": op7_quality_rules,
    "quality_counts": quality_counts,
    "op8_topk_search": op8_topk_search,
    "op9_token_counts": op9_token_counts,
    "op10_ngram_join": op10_ngram_join,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_order_minhash": op13_order_minhash,
}

# RE2 folds more letters than A-Z under (?i), so the classes are written out.
_WORD = {w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api", "key")}
_PATTERNS = {
    "assign": rf"(?:{_WORD['password']}|{_WORD['passwd']}|{_WORD['secret']}|{_WORD['token']}|{_WORD['api']}_?{_WORD['key']})[\"'']?\x20*[:=]\x20*[\"'']?[A-Za-z0-9+/_.=-]+",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{16,}",
    "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "github": "gh[pousr]_[A-Za-z0-9]{36,}",
    "jwt": r"(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "slack": "xox[abprs]-[A-Za-z0-9-]{10,}",
}
_KEPT = {"assign": r"length(regexp_extract(m, '[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12", "access": "length(m) >= 18"}


def _secret_sql() -> str:
    parts = []
    for k, (kind, pattern) in enumerate(_PATTERNS.items()):
        # RE2 can't look behind, so a jwt's match holds the character before it
        before = "CASE WHEN starts_with(m, 'eyJ') THEN 0 ELSE 1 END" if kind == "jwt" else "0"
        parts.append(f"""
        SELECT doc_id, '{kind}' AS kind, {k} AS k, s + {before} AS s, s + length(m) AS e FROM (
          SELECT doc_id, m, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
          FROM (SELECT n, doc_id, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i FROM (
            SELECT n, doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM d))
          WINDOW w AS (PARTITION BY n ORDER BY i ROWS UNBOUNDED PRECEDING))
        WHERE {_KEPT.get(kind, "true")}""")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
    f AS ({" UNION ALL ".join(parts)}),
    g AS (SELECT doc_id,
        count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        coalesce(string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, k) FILTER (WHERE k < 3), '') AS base,
        string_agg(kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY s, k) AS spans
      FROM f GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


_WARC_SQL = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
    SELECT page_id, payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
      CASE WHEN first_id IS NULL OR first_id IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN first_id IS DISTINCT FROM page_id THEN first_id END AS refers_to
    FROM q"""


_TOPK_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 20"""


_WORD_CLASS = r"[^\x20\x09-\x0D]+"

_COUNTS_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '{_WORD_CLASS}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD_CLASS}')) AS l FROM d),
    g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    h AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
    c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h) GROUP BY r),
    n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
      FROM w LEFT JOIN c USING (r))
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n"""


_JOIN_SQL = rf"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD_CLASS}') AS w FROM documents),
    s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM d),
    x AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS x FROM s WHERE doc_id IS NOT NULL),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    reach AS (SELECT DISTINCT doc_id AS a, doc_id AS b FROM s WHERE doc_id IS NOT NULL UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
    c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s LEFT JOIN c ON c.a = s.doc_id"""


_NEGATIVES_SQL = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
      s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5"""


_PHRASES_SQL = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
    n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
    g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, unnest([1, 2, 3, 4]) t(k))),
    f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
    s AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM f, unnest([2, 3]) t(m) WHERE m < k) GROUP BY ALL),
    c AS (SELECT f.lang, f.phrase, j, f.f AS a, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * f.f) // (x.f + y.f) AS BIGINT) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) f
      JOIN f x ON x.lang = f.lang AND x.phrase = array_to_string(f.ws[1 : j], ' ') JOIN f y ON y.lang = f.lang AND y.phrase = array_to_string(f.ws[j + 1 : f.k], ' ')),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
    FROM b JOIN n ON n.lang = b.lang LEFT JOIN s ON s.lang = b.lang AND s.phrase = b.phrase
    WHERE s.longer IS NULL OR 100 * s.longer < 80 * a QUALIFY rank <= 2000"""


ORACLE_SQL = {
    "op11_collocations": _PHRASES_SQL,
    "op12_hard_negatives": _NEGATIVES_SQL,
    "quality_counts": _COUNTS_SQL,
    "op10_ngram_join": _JOIN_SQL,
    "op5_warc": _WARC_SQL,
    "op8_topk_search": _TOPK_SQL,
    "op3_secret_scan": _secret_sql(),
}
