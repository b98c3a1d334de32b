"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from . import licenses

OP1 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size,
             max(doc_id) >= (SELECT (min(doc_id) + max(doc_id)) / 2.0 FROM documents) AS from_history
      FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256,
       from_history
FROM d JOIN g USING (body)
"""

OP5 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1),
                                     lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle
      FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
      FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a),
g AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM g LEFT JOIN n USING (doc_id)
"""

# Bigrams of the templates are rows, made by the rule that the operator uses.
OP7 = f"""
WITH t(license, bigram) AS (VALUES {", ".join(
    f"('{name}', '{b}')" for name, notice in licenses.TEMPLATES.items()
    for b in licenses.template_bigrams(notice))}),
n AS (SELECT license, count(*) AS n FROM t GROUP BY license),
u AS (SELECT doc_id, unnest(string_split(regexp_replace(lower(regexp_replace(coalesce(text, ''),
        '[\\n\\r]+|[.!?:;][ \\t]+', chr(10), 'g')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10))) AS unit
      FROM documents),
w AS (SELECT doc_id, row_number() OVER () AS unit_no, string_split(trim(unit), ' ') AS words FROM u),
b AS (SELECT DISTINCT doc_id, unit_no, unnest(list_transform(range(1, len(words)),
        lambda i: words[i] || ' ' || words[i + 1])) AS bigram FROM w WHERE len(words) > 1),
a AS (SELECT doc_id, unit_no, count(*) AS a FROM b GROUP BY ALL),
m AS (SELECT doc_id, unit_no, license, count(*) AS c FROM b JOIN t USING (bigram) GROUP BY ALL),
d AS (SELECT m.doc_id, license, 2.0::DOUBLE * c / (a + n) AS dice
      FROM m JOIN a USING (doc_id, unit_no) JOIN n USING (license))
SELECT doc_id, license, round(max(dice), 6) AS dice, count(*) AS n_units
FROM d WHERE dice >= 0.8 GROUP BY doc_id, license
"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vector
           FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_inner_product(q.vector::DOUBLE[], c.vector::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
      FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP12 = """
WITH l AS (SELECT doc_id, unnest(list_zip(string_split(coalesce(text, ''), chr(10)),
                                          range(len(string_split(coalesce(text, ''), chr(10)))))) AS z
           FROM documents),
k AS (SELECT doc_id, z[1] AS line, z[2] AS position,
             translate(trim(z[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM l),
r AS (SELECT body, max(doc_id) AS stays FROM k WHERE length(body) >= 40
      GROUP BY body HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (stays <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (stays IS NULL OR stays = doc_id),
                       '')) AS kept_sha256
FROM k LEFT JOIN r USING (body) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op5_jaccard_join": OP5, "op7_licenses": OP7, "op10_top_k": OP10,
            "op12_line_dedup": OP12}
