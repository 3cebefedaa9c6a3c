"""DuckDB SQL of the registered queries that SQL can express.

Each is a plain reading of the query's rules over whole tables: windows and
shingles as text, all links by a self-join on shingles, quartiles from sorted
values.  Queries without an entry (a trained model, a packing, a tokenizer)
are compared with brute-force versions in the tests.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP5 = """
WITH rows AS (
    SELECT DISTINCT vec_id::BIGINT AS id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
    SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
           row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.v, c.v) DESC, c.id) AS rank
    FROM rows q JOIN rows c ON q.id % 20 = 0 AND q.id <> c.id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP6 = rf"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '{WORD}') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared_n
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
    WHERE 100 * shared_n >= 85 * (p.n + q.n - shared_n)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, l.component_id = d.doc_id AS kept
FROM documents d JOIN least l USING (doc_id) LEFT JOIN sizes s USING (doc_id)
"""

#: a base-32 character is five bits: twenty bits are five hexadecimal digits and four characters
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {1 + 5 * i}, 5))::INTEGER >> {shift}) % 32 + 1, 1)"
    for i in range(8) for shift in (15, 10, 5, 0))

OP8 = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY p) AS first FROM payloads)
SELECT page_id, octet_length(encode(p))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM firsts
"""

OP10 = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
parts AS (
    SELECT r, doc_id, lang, source, t, regexp_extract_all(t, '{WORD}') AS w,
           list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines
    FROM texts),
windows AS (
    SELECT r, i, array_to_string(w[i:i + 4], ' ') AS five
    FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM parts WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, five) > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY r),
counted AS (
    SELECT p.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines) AS n_lines,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(x.n, 0)::BIGINT AS n_repeat_words
    FROM parts p LEFT JOIN repeated x ON x.r = p.r),
measured AS (
    SELECT r, lang, source, unnest([
        {{'m': 'symbols', 'spread': 10, 'v': CASE WHEN word_chars = 0 THEN 0 ELSE 1000 * n_symbols // word_chars END}},
        {{'m': 'length', 'spread': 6, 'v': CASE WHEN n_words = 0 THEN 0 ELSE 10 * word_chars // n_words END}},
        {{'m': 'lines', 'spread': 30, 'v': CASE WHEN n_lines = 0 THEN 0 ELSE 1000 * n_dup_lines // n_lines END}},
        {{'m': 'repeats', 'spread': 30, 'v': CASE WHEN n_words = 0 THEN 0 ELSE 1000 * n_repeat_words // n_words END}}], recursive := true)
    FROM counted),
-- a value's bucket keeps its six leading bits
bucketed AS (SELECT *, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS b FROM measured),
grouped AS (
    SELECT 1 AS level, lang, source, m, spread, b FROM bucketed
    UNION ALL SELECT 2, lang, NULL, m, spread, b FROM bucketed
    UNION ALL SELECT 3, NULL, NULL, m, spread, b FROM bucketed),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY level, lang, source, m ORDER BY b) AS place,
           count(*) OVER (PARTITION BY level, lang, source, m) AS total
    FROM grouped),
quartiles AS (
    SELECT level, lang, source, m, spread, total, max(b) FILTER (place = (total + 3) // 4) AS q1,
           max(b) FILTER (place = (3 * total + 3) // 4) AS q3
    FROM ranked GROUP BY level, lang, source, m, spread, total),
fences AS (
    SELECT *, q1 - 6 * greatest(q3 - q1, spread) AS low, q3 + 6 * greatest(q3 - q1, spread) AS high FROM quartiles),
outside AS (
    SELECT DISTINCT x.r
    FROM measured x
    JOIN fences o ON o.level = 1 AND o.m = x.m AND o.lang IS NOT DISTINCT FROM x.lang AND o.source IS NOT DISTINCT FROM x.source
    JOIN fences l ON l.level = 2 AND l.m = x.m AND l.lang IS NOT DISTINCT FROM x.lang
    JOIN fences a ON a.level = 3 AND a.m = x.m
    WHERE x.v > CASE WHEN o.total >= 100 THEN o.high WHEN l.total >= 100 THEN l.high ELSE a.high END
       OR x.m = 'length' AND x.v < CASE WHEN o.total >= 100 THEN o.low WHEN l.total >= 100 THEN l.low ELSE a.low END)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND r NOT IN (SELECT r FROM outside) AS kept
FROM counted
"""

def _assigned(n: int) -> str:
    """Every part's nearest entry of the n-th codebooks."""
    return f"""
dist{n} AS MATERIALIZED (
    SELECT a.r, a.p, b.e, sum((a.x - b.x) * (a.x - b.x))::BIGINT AS d FROM parts a JOIN book{n} b ON a.p = b.p AND a.j = b.j GROUP BY ALL),
pick{n} AS MATERIALIZED (SELECT r, p, e, d FROM dist{n} QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY d, e) = 1)"""


def _round(n: int) -> str:
    """The codebooks after an assignment by the n-th: floors of the means, an unused entry stays."""
    return f"""{_assigned(n)},
sums{n} AS (SELECT e, p, j, sum(x)::BIGINT AS s, count(*) AS c FROM pick{n} JOIN parts USING (r, p) GROUP BY ALL),
book{n + 1} AS MATERIALIZED (
    SELECT b.e, b.p, b.j, CASE WHEN s IS NULL THEN b.x ELSE (s - ((s % c) + c) % c) // c END AS x FROM book{n} b LEFT JOIN sums{n} USING (e, p, j))"""


OP12 = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT r, len(v) // 8 AS w, unnest(v) AS x, unnest(range(len(v))) AS i FROM kept),
parts AS MATERIALIZED (SELECT r, i // w AS p, i % w AS j, x FROM flat),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < 16),
book0 AS MATERIALIZED (SELECT e, p, j, x FROM parts JOIN first USING (r)),
{",".join(_round(n) for n in range(6))},
{_assigned(6)},
coded AS (
    SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM pick6 GROUP BY r),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book6)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""

SQL: dict[str, str] = {
    "op5_exact_top_k": OP5,
    "op6_minhash_near_dedup": OP6,
    "op8_warc": OP8,
    "op10_quality_rules": OP10,
    "op12_vector_codes": OP12,
}
