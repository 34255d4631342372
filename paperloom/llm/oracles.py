"""The rows of the operators that SQL can express, in DuckDB's SQL, by brute force."""

from __future__ import annotations

#: Which root each node of `links (a, b)`, given in both directions, has: the least that it reaches.
REACH = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [len(w) || ':' || array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),{REACH}
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, min(r.b)) AS component_id, d.doc_id = least(d.doc_id, min(r.b)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v WHERE list_dot_product(e, e) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND list_dot_product(x.u, y.u) >= 0.9),{REACH}
SELECT e.vec_id, coalesce(any_value(k.n), 0) AS n_links, least(e.vec_id, min(r.b)) AS component_id, e.vec_id = least(e.vec_id, min(r.b)) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = e.vec_id LEFT JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id"""

#: Bytes as two hexadecimal digits each; places in bytes from 0.
REPEATS = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM t)),
twice AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS first FROM w SEMI JOIN twice USING (m)),
span AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT doc_id, i, sum(first::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit) GROUP BY doc_id, k),
spans AS (SELECT doc_id, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi FROM span GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(list_sum(hi) - list_sum(lo), 0)::BIGINT AS n_removed, coalesce(len(lo), 0) AS n_spans,
  sha256(unhex(CASE WHEN lo IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(lo) + 2), lambda k: substr(h, 2 * coalesce(hi[k - 1], 0) + 1, 2 * (coalesce(lo[k], length(h) // 2) - coalesce(hi[k - 1], 0)))), '') END)) AS kept_sha256
FROM t LEFT JOIN spans USING (doc_id)"""




def _clusters(rounds: int = 3) -> str:
    nearest = """SELECT id, any_value(vec_id) AS vec_id, any_value(x) AS x, min({'distance': d, 'cluster': k}) AS m
  FROM (SELECT id, vec_id, x, k, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM v CROSS JOIN c%d) GROUP BY id"""
    moved = """SELECT k, coalesce(new, c) AS c FROM c%d LEFT JOIN
  (SELECT k, list(CAST((s - ((s %% n) + n) %% n) / n AS BIGINT) ORDER BY i) AS new FROM
    (SELECT m.cluster AS k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT m, x, unnest(range(1, 65)) AS i FROM a%d) GROUP BY ALL) GROUP BY k) USING (k)"""
    steps = "".join(f"a{r} AS ({nearest % r}),\nc{r + 1} AS ({moved % (r, r)}),\n" for r in range(rounds))
    return f"""
WITH v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda y: CAST(floor(64 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: isfinite(y))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT sha256('1:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT 16)),
{steps}a{rounds} AS ({nearest % rounds}),
s AS (SELECT m.cluster AS k, sum(m.distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY m.cluster)
SELECT vec_id, m.cluster::INTEGER AS cluster, m.distance AS distance, cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM s) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN s ON s.k = m.cluster JOIN c{rounds} c ON c.k = m.cluster"""


def _word_list(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"list_filter(regexp_split_to_array({low}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


#: Exact windows by joins of whole phrases; proximity from each window's rarest word, the first of them in the window.
LEAKS = rf"""
WITH d AS (SELECT doc_id, {_word_list("text")} AS w FROM documents),
b AS (SELECT item_id, {_word_list("text")} AS w FROM benchmark),
win AS (SELECT row_number() OVER () AS win, * FROM (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS u FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT len(u) AS k FROM win))),
hit AS (SELECT doc_id, i, k, item_id FROM grams JOIN (SELECT item_id, len(u) AS k, array_to_string(u, ' ') AS g FROM win) USING (k, g)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, i + unnest(range(k)) AS pos FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id),
tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
n AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
each AS (SELECT win, item_id, len(u) AS k, unnest(u) AS word, generate_subscripts(u, 1) AS off FROM win),
rarest AS (SELECT win, arg_min(word, (n, off)) AS word, arg_min(off, (n, off)) AS off, count(n) = any_value(k) AS known FROM each LEFT JOIN n USING (word) GROUP BY win),
start AS (SELECT doc_id, win, pos - off AS st FROM rarest JOIN tok USING (word) WHERE known),
near AS (SELECT s.doc_id, e.item_id FROM start s JOIN each e USING (win) JOIN tok t ON t.doc_id = s.doc_id AND t.word = e.word AND t.pos BETWEEN st + e.off - 2 AND st + e.off + 2
  GROUP BY s.doc_id, s.win, s.st, e.item_id HAVING count(DISTINCT e.off) = any_value(e.k)),
beside AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN beside USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash": NEAR, "op5_pivot_index": VECTORS, "op9_suffix_dedup": REPEATS, "op12_centroids": _clusters(), "op13_decontamination": LEAKS}
