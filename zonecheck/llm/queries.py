"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, ann, bpe, decontaminate, jaccard_join, language_id, license_scan, line_dedup, spelling, suffix_dedup, superkmers, token_count, warc
from .common import table

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_documents(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(table(spark, sf_dir, "documents"), threshold=0.8, width=5).select("doc_id", "class_id", "n_links")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.marked(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", "deleted", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.cut(table(spark, sf_dir, "documents"), length=400)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), containment=0.8, width=5)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.document_links(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = superkmers.cut(table(spark, sf_dir, "documents"), length=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.document_variants(table(spark, sf_dir, "documents"), least=7, every=31, ratio=10)


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS original FROM p)
SELECT page_id, payload_bytes,
 array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + ((CAST('0x' || substr(s, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest,
 CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> original THEN original END AS refers_to
FROM d
"""

# the distinct shingles of five words of each text, or all words of a shorter one
_SHINGLES = """SELECT id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
 FROM (SELECT {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}) t"""

_TEMPLATES = ", ".join(f"({n}, '{label}', {n < len(license_scan.PHRASES)}, '{text}')" for n, (label, text) in enumerate(license_scan.PHRASES + license_scan.TEMPLATES))

OP3_SQL = f"""
WITH t(template, label, exact, wanted) AS (VALUES {_TEMPLATES}), tw AS (SELECT *, string_split(wanted, ' ') AS v FROM t),
 tg AS (SELECT template, label, exact, wanted, len(v) - 1 AS n_grams, j, v[j] AS w0, v[j + 1] AS w1 FROM (SELECT *, unnest(range(1, len(v))) AS j FROM tw) x),
 d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 dg AS (SELECT doc_id, i - 1 AS i, w[i] AS a, w[i + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM d) x),
 hits AS (SELECT doc_id, template, label, exact, wanted, n_grams, i, j, i - j + 1 AS diagonal FROM dg JOIN tg ON a = w0 AND b = w1),
 voted AS (SELECT doc_id, template, label, exact, n_grams, diagonal, count(*) AS votes FROM hits GROUP BY ALL),
 new AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= 2 THEN 0 ELSE 1 END AS new FROM voted WHERE NOT exact),
 runs AS (SELECT doc_id, template, diagonal, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM new),
 merged AS (SELECT h.doc_id, h.label, h.wanted, h.n_grams, count(DISTINCT j) / h.n_grams AS covered, min(i) AS a, max(i) + 1 AS b FROM hits h JOIN runs r ON r.doc_id = h.doc_id AND r.template = h.template AND r.diagonal = h.diagonal GROUP BY h.doc_id, h.template, h.label, h.wanted, h.n_grams, run),
 found AS (SELECT m.*, array_to_string(w[a + 1:b + 1], ' ') AS f FROM merged m JOIN d ON d.doc_id = m.doc_id WHERE covered >= 0.85e0 AND b - a <= n_grams + 4),
 spans AS (SELECT doc_id, label, true AS exact, diagonal AS a, 1e0 AS covered FROM voted WHERE exact AND votes = n_grams UNION ALL
  SELECT doc_id, label, false, a, covered FROM found WHERE levenshtein(f, wanted) <= (1e0 - 0.8e0) * greatest(length(f), length(wanted)))
SELECT d.doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(*) FILTER (exact) AS n_base, min(a) FILTER (exact) AS first_word, max(a) FILTER (exact) AS last_word,
 coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list(label))), ','), '') AS labels, coalesce(max(covered), 0e0) AS score
 FROM d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY 1
"""

OP4_SQL = f"""
WITH RECURSIVE sh AS ({_SHINGLES.format(id="doc_id", table="documents")}), n AS (SELECT id, count(*) AS n FROM sh GROUP BY 1),
 met AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
 links AS (SELECT a, b FROM met JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.8 * (x.n + y.n - k)),
 reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
 classes AS (SELECT a, min(least(a, b)) AS class_id FROM reach GROUP BY 1), degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(g.n_links, 0) AS n_links FROM documents d LEFT JOIN classes c ON c.a = d.doc_id LEFT JOIN degree g ON g.a = d.doc_id
"""

OP7_SQL = f"""
WITH sh AS ({_SHINGLES.format(id="doc_id", table="documents")}), it AS ({_SHINGLES.format(id="item_id", table="benchmark")}), n AS (SELECT id, count(*) AS n_item FROM it GROUP BY 1),
 met AS (SELECT sh.id AS doc_id, it.id AS item_id, count(*) AS n_shared FROM sh JOIN it ON it.s = sh.s GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(n_shared AS INT) AS n_shared, CAST(n_item AS INT) AS n_item, n_shared / n_item AS containment FROM met JOIN n ON n.id = item_id WHERE n_shared >= 0.8 * n_item
"""

# exact search, which the lists give too while there are no more of them than a query reads (4,096 vectors)
OP10_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL),
 u AS (SELECT * FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
 p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score FROM u q JOIN u c ON c.vec_id <> q.vec_id AND len(c.x) = len(q.x) WHERE q.vec_id % 20 = 0),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

# every window as one text, counted; a word goes if a repeated window starts at it or at one of the 34 words before it
OP12_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 33)) AS i FROM d) x),
 rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM win) x WHERE n > 1),
 words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
 cover AS (SELECT words.doc_id, j, word, max(CASE WHEN rep.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY words.doc_id ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN rep ON rep.doc_id = words.doc_id AND rep.i = words.j)
SELECT d.doc_id, any_value(len(w)) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (gone = 0), '')) AS kept_sha256
 FROM d LEFT JOIN cover ON cover.doc_id = d.doc_id GROUP BY 1
"""

# crc32 by its table, near words by the strings that deletions leave
OP13_SQL = """
WITH RECURSIVE t8(i, k, c) AS (SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM t8 WHERE k < 8),
 crc AS (SELECT list(c ORDER BY i) AS t FROM t8 WHERE k = 8),
 runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) x WHERE length(run) >= 7 GROUP BY 1, 2),
 coded AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS x FROM runs),
 h AS (SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM coded, crc),
 w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h) x WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
 del AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS s FROM (SELECT *, unnest(range(1, length(word) + 1)) AS p FROM w) x),
 near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM del a JOIN del b ON a.s = b.s AND a.p = b.p AND a.word <> b.word UNION
  SELECT a.word, b.word, b.n FROM del a JOIN w b ON a.s = b.word UNION SELECT b.word, a.word, a.n FROM del a JOIN w b ON a.s = b.word),
 best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS best, max(other_n) AS best_n FROM near GROUP BY 1),
 forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN best ON best.word = w.word),
 walk(word, last) AS (SELECT word, word FROM forms UNION ALL SELECT walk.word, form FROM walk JOIN forms ON forms.word = walk.last WHERE form IS NOT NULL)
SELECT f.word, form, last AS root, n, n_near, form_n FROM forms f JOIN walk ON walk.word = f.word WHERE NOT EXISTS (SELECT 1 FROM forms g WHERE g.word = last AND g.form IS NOT NULL)
"""

QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_language_id, op3_license_scan, op4_jaccard_join, op5_line_dedup, op6_suffix_dedup, op7_decontaminate, op8_token_counts, op9_warc, op10_ann, op11_token_alignment, op12_substring_dedup, op13_spelling_variants)}

ORACLE_SQL: dict[str, str] = {"op3_license_scan": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op7_decontaminate": OP7_SQL, "op9_warc": OP9_SQL, "op10_ann": OP10_SQL, "op12_substring_dedup": OP12_SQL, "op13_spelling_variants": OP13_SQL}
