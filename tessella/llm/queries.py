"""The corpus operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.llm.fertility import op10_fertility
from tessella.llm.flac import op2_flac
from tessella.llm.language_id import op3_language
from tessella.llm.longest_match import op4_longest_match
from tessella.llm.near_dedup import op5_near_dedup
from tessella.llm.packing import op9_packing
from tessella.llm.source_mix import op6_source_mix
from tessella.llm.suffix_dedup import op8_suffix_dedup
from tessella.llm.toxicity import op7_toxicity
from tessella.llm.warc import op1_transactions

QUERIES = {
    "op1_transactions": op1_transactions,
    "op2_flac": op2_flac,
    "op3_language": op3_language,
    "op4_longest_match": op4_longest_match,
    "op5_near_dedup": op5_near_dedup,
    "op6_source_mix": op6_source_mix,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_packing": op9_packing,
    "op10_fertility": op10_fertility,
    "x_flac_payload": lambda spark, folder: op2_flac(spark, folder).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256"),
    "x_mix_targets": lambda spark, folder: op6_source_mix(spark, folder).select("doc_id", "size", "source_size", F.round("target", 4).alias("target")),
    "x_base_rules": lambda spark, folder: op10_fertility(spark, folder).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
}

#: The x_ queries are those columns of operators without SQL that SQL can recompute: what a decoded stream holds, the level
#: of the water that fills the sources' targets, the base rules.
#: Prefix filtering makes the similarity join exact and quick; the others say what the contract says. The remaining queries
#: have no SQL form: they train models, search optima or read vocabularies. tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_transactions": """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
 CASE WHEN octet_length(encode(html)) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY html) THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN octet_length(encode(html)) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY html) THEN max(page_id) OVER (PARTITION BY html) END AS refers_to FROM pages""",
    "op5_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),
classes AS (SELECT list_sort(s) AS k, min(doc_id) AS rep, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
x AS (SELECT rep, n, unnest(k) AS g FROM classes),
f AS (SELECT g, count(*) AS df FROM x GROUP BY g),
p AS (SELECT rep, n, x.g, row_number() OVER (PARTITION BY rep ORDER BY df, x.g) AS r FROM x JOIN f ON x.g = f.g),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep WHERE a.r <= a.n - ceil(0.8 * a.n) + 1 AND b.r <= b.n - ceil(0.8 * b.n) + 1 AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM cand JOIN classes ca ON ca.rep = a JOIN classes cb ON cb.rep = b WHERE 180 * len(list_intersect(ca.k, cb.k)) >= 80 * (ca.n + cb.n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
comp AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, s.doc_id) AS component_id, s.doc_id = coalesce(c, s.doc_id) AS kept
FROM s LEFT JOIN classes k ON len(s.s) > 0 AND list_sort(s.s) = k.k LEFT JOIN comp ON comp.rep = k.rep""",
    "op8_suffix_dedup": """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, substring(x, 2 * i - 1, 200) AS g FROM (SELECT doc_id, x, unnest(range(1, n - 98)) AS i FROM h WHERE n >= 100) t),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) t WHERE r > 1),
bytes AS (SELECT doc_id, j, substring(x, 2 * j - 1, 2) AS b FROM (SELECT doc_id, x, unnest(range(1, n + 1)) AS j FROM h) t),
marked AS (SELECT b.doc_id, j, b, coalesce(max(i) OVER (PARTITION BY b.doc_id ORDER BY j) >= j - 99, false) AS gone FROM bytes b LEFT JOIN again a ON a.doc_id = b.doc_id AND a.i = b.j),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS opens FROM marked),
found AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(b, '' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM edges GROUP BY doc_id)
SELECT h.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM h LEFT JOIN found f ON f.doc_id = h.doc_id""",
    "x_flac_payload": """
WITH b AS (SELECT doc_id, coalesce(text, '') AS t, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents), p AS (SELECT *, greatest(192, CAST(ceil(n / 192.0) AS BIGINT) * 192) AS size FROM b)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(t || repeat(' ', size - n)) AS payload_sha256 FROM p""",
    "x_mix_targets": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS w FROM d GROUP BY source),
o AS (SELECT *, 2 * source_size / w AS full_at, coalesce(sum(2 * source_size) OVER before, 0) AS spent, sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, 1.5 * sum(source_size) OVER () AS wanted FROM s WINDOW before AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(min_by((wanted - spent) / free, full_at), 0) AS level FROM o WHERE (wanted - spent) / free <= full_at)
SELECT doc_id, size, source_size, round(least(2 * source_size, level * w), 4) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l""",
    "x_base_rules": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w) t),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w) t),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) t WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, n_dup_lines, coalesce(n, 0) AS n_repeat_words,
 len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed FROM w JOIN lines l ON l.doc_id = w.doc_id LEFT JOIN rep r ON r.doc_id = w.doc_id""",
}
