"""SQL (DuckDB) for the queries that SQL can express, on the same tables."""

from __future__ import annotations

from punctua.llm.secrets import BASE_RULES, RULES
from punctua.llm.sharding import N_SHARDS

#: A checksum by its definition: the table of the reversed polynomial, then one step a byte.
_CRC = """
WITH RECURSIVE bits AS (
  SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),"""
SHARDING = f"""{_CRC}
docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS skey,
         md5('interleave|' || CASE WHEN doc_id IS NULL THEN '-' ELSE '+' || doc_id END) AS digest
  FROM documents
), sized AS (
  SELECT doc_id, source, skey, digest, octet_length(encode(text)) + 8 AS size,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, octet_length(encode(text))), lambda i: ('0x' || substr(hex(encode(text)), 2 * i::INT + 1, 2))::UBIGINT)),
             lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM docs, crc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY skey ORDER BY digest, size, text_crc32) - 1 AS rank, count(*) OVER (PARTITION BY skey) AS n,
         ('0x' || substr(md5('interleave offset|' || skey), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS shift
  FROM sized
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (rank + shift) / n, skey, digest, size, text_crc32) - 1 AS spot, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (spot * {N_SHARDS} // total)::INT AS shard,
       (spot - ((spot * {N_SHARDS} // total) * total + {N_SHARDS - 1}) // {N_SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, source
FROM placed
"""

_NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < <width> THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - <width> + 2), lambda i: array_to_string(w[i:i + <width> - 1], ' '))) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS shared
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT x, y FROM pairs WHERE 100 * shared >= 80 * (nx + ny - shared)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id<more> FROM sets s JOIN least l ON l.x = s.doc_id
"""
NEAR_DUPLICATES = _NEAR.replace("<width>", "5").replace("<more>", "")
MINHASH = _NEAR.replace("<width>", "4").replace("<more>", ", s.doc_id = l.component_id AS kept")


def secrets_sql() -> str:
    """Spans by splitting, as a union over the rules; a text without a match has none."""
    parts = []
    for i, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
          SELECT id, {i} AS ord, '{rule.kind}' AS kind, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g, string_split_regex(text, '{pattern}') AS p, {rule.least} AS least
          FROM docs WHERE regexp_matches(text, '{pattern}')""")
    union = " UNION ALL ".join(parts)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}')::BIGINT AS n_{r.kind}" for r in BASE_RULES)
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
    found AS ({union}),
    each AS (SELECT id, ord, kind, m, g, p, least, unnest(range(1, len(m) + 1)) AS k FROM found),
    spans AS (
      SELECT id, ord, kind, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS s, length(m[k]) AS n
      FROM each WHERE length(g[k]) >= least
    ), said AS (
      SELECT id, {counts}, string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, ord) AS spans,
             string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, ord) FILTER (ord < {len(BASE_RULES)}) AS base
      FROM spans GROUP BY id
    )
    SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN said USING (id)
    """


TOP_K = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

FILL_IN_MIDDLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l,
         list_transform(range(0, 4), lambda i: ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8 * i::INT + 1, 8))::BIGINT) AS h
  FROM documents
), cut AS (
  SELECT *, len(l) AS n, least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS a, greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM docs
), parts AS (
  SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS p, coalesce(array_to_string(l[a + 1:b], ''), '') AS m, coalesce(array_to_string(l[b + 1:], ''), '') AS s FROM cut
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""

TRIE = _CRC + r"""
t AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), drawn AS (
  SELECT c, s, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, octet_length(encode(c::VARCHAR))), lambda i: ('0x' || substr(hex(encode(c::VARCHAR)), 2 * i::INT + 1, 2))::UBIGINT)),
         lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT % 4 AS h
  FROM t, crc
), rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM drawn a LEFT JOIN t b ON b.c = a.c - a.c % 20
), members AS (
  SELECT c, d, s[1:d] AS k, len(s) = d AS ended, CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w
  FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT k, d, min(c) AS c, count(*) AS n, max(w) AS w, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended) AS ends FROM members GROUP BY k, d
), kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (k, d)),
subtrees AS (
  SELECT k[1:i] AS k, i AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * w) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM full_nodes) GROUP BY 1, 2
)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_nodes n JOIN subtrees s ON s.k = n.k AND s.d = n.d LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]
"""

ORACLE_SQL = {"op1_sharding": SHARDING, "op3_near_duplicates": NEAR_DUPLICATES, "op4_secrets": secrets_sql(), "op8_topk": TOP_K, "op11_fill_in_middle": FILL_IN_MIDDLE, "op12_minhash": MINHASH, "op13_prefix_trie": TRIE}
