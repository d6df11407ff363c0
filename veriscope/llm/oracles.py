"""The operators' queries as DuckDB SQL over whole tables, where SQL can express them."""

from __future__ import annotations

from . import sharding

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1() -> str:
    """Placement by the filled table, given as a list of shard numbers."""
    table = sharding.fill(sharding.SHARDS)
    return (
        f"WITH filled AS (SELECT {table} AS t), names AS (SELECT {list(sharding.SHARDS)} AS s), "
        f"keyed AS (SELECT doc_id, source, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {sharding.SLOTS}, 0) AS slot FROM documents) "
        "SELECT doc_id, source, slot, s[t[slot + 1] + 1] AS shard FROM keyed, filled, names"
    )


OP5 = f"""WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
  sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
  classes AS (SELECT s, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
  posted AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM classes),
  pairs AS (SELECT a.rep AS a, b.rep AS b FROM posted a JOIN posted b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
  reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
  roots AS (SELECT a AS rep, least(a, min(b)) AS root FROM reach GROUP BY a)
  SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(r.root, c.rep, d.doc_id) AS component_id, coalesce(r.root, c.rep, d.doc_id) = d.doc_id AS kept
  FROM (SELECT doc_id, list_sort(s) AS s FROM sets) d LEFT JOIN classes c ON c.s = d.s LEFT JOIN roots r ON r.rep = c.rep"""

OP8 = f"""WITH words AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
  windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
  first AS (SELECT x, min(doc_id) AS least FROM windows GROUP BY x),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN first USING (x) WHERE least < doc_id),
  lost AS (SELECT doc_id, list(i) AS lost FROM gone GROUP BY doc_id),
  kept AS (SELECT doc_id, len(w) AS n_words, coalesce(len(lost), 0) AS n_removed, list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(coalesce(lost, []), i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS k
  FROM words LEFT JOIN lost USING (doc_id))
  SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""

OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0 AND len(q.x) = len(c.x))
  SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored) WHERE rank <= 20"""

OP10 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
  f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
  SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
  FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest AND payload_bytes >= 100"""
