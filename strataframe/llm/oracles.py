"""DuckDB SQL for the queries whose rows SQL can express without the method."""

from __future__ import annotations

from . import mixing
from .mixing import WORD

NEAR_DUPLICATES = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, least(len(w), 1)))) AS k FROM texts),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+4], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS far FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.far),
least_of AS (SELECT doc_id, min(far) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least_of USING (doc_id)
"""

REPEATS = f"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS p FROM texts WHERE len(w) >= 35),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p+34], ' ')) AS h FROM starts),
often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
repeated AS (SELECT doc_id, p, true AS r FROM windows WHERE h IN (SELECT h FROM often)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM texts),
marked AS (
  SELECT doc_id, word, p, coalesce(p - last_value(CASE WHEN r THEN p END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p) < 35, false) AS gone
  FROM words LEFT JOIN repeated USING (doc_id, p)),
counts AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN counts USING (doc_id)
"""

NEAR_VECTORS = """
WITH RECURSIVE fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM fine),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
counts AS (SELECT a, count(*) AS n_links FROM edges GROUP BY a),
reach AS (SELECT vec_id, vec_id AS far FROM embeddings UNION SELECT r.vec_id, e.b FROM reach r JOIN edges e ON e.a = r.far),
least_of AS (SELECT vec_id, min(far) AS component_id FROM reach GROUP BY vec_id)
SELECT d.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, d.vec_id = component_id AS kept
FROM embeddings d LEFT JOIN counts ON a = vec_id JOIN least_of USING (vec_id)
"""

EQUAL_TEXTS = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
ranked AS (
  SELECT doc_id, content, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
    row_number() OVER best = 1 AS kept
  FROM texts WINDOW best AS (PARTITION BY content ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, sha256(content) AS text_sha256 FROM ranked
"""



def _vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """All distances of each round, as SQL; lengths that ``parts`` divides."""
    ctes = [f"""kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (
  SELECT vec_id, part, e[part * (len(e) // {parts}) + 1 : (part + 1) * (len(e) // {parts})] AS piece
  FROM kept, (SELECT unnest(range({parts})) AS part)),
book0 AS (
  SELECT part, entry, piece AS centre FROM cut
  JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}) USING (vec_id))"""]
    for r in range(rounds + 1):
        ctes.append(f"""near{r} AS (
  SELECT vec_id, part, arg_min(entry, distance * {entries} + entry) AS entry, min(distance) AS distance
  FROM (SELECT vec_id, part, entry, list_sum(list_transform(list_zip(piece, centre), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
    FROM cut JOIN book{r} USING (part)) GROUP BY vec_id, part)""")
        if r < rounds:
            ctes.append(f"""moved{r} AS (
  SELECT part, entry, list(centre ORDER BY place) AS centre
  FROM (SELECT part, entry, place, floor(sum(component) / count(*))::BIGINT AS centre
    FROM (SELECT n.part, n.entry, unnest(piece) AS component, generate_subscripts(piece, 1) AS place FROM near{r} n JOIN cut USING (vec_id, part))
    GROUP BY part, entry, place) GROUP BY part, entry),
book{r + 1} AS (SELECT part, entry, coalesce(m.centre, b.centre) AS centre FROM book{r} b LEFT JOIN moved{r} m USING (part, entry))""")
    return "WITH " + ",\n".join(ctes) + f""",
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(array_to_string(centre, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (vec_id), books
"""


VECTOR_CODES = _vector_codes()

ORACLE_SQL = {
    "op12_metric_tree_codes": VECTOR_CODES,
    "op13_salted_exact_duplicates": EQUAL_TEXTS,
    "op6_pivot_near_vectors": NEAR_VECTORS,
    "op4_systematic_mixing": mixing.ORACLE_SQL,
    "op8_minmax_near_duplicates": NEAR_DUPLICATES,
    "op10_difference_cover_repeats": REPEATS,
}
