"""DuckDB SQL for the registered queries that SQL can express."""

_DECONTAMINATE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), keys AS (SELECT DISTINCT n, k FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, i, n, k FROM dw SEMI JOIN keys USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM found JOIN bw USING (n, k)) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""



def _clustering(clusters: int = 16, rounds: int = 3, dimensions: int = 64) -> str:
    """Vectors component by component; each round's assignment and centroids are tables of their own."""
    parts = [
        f"""k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (SELECT r, unnest(range(1, {dimensions} + 1)) AS d, unnest(x) AS x FROM k),
f AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), x) - 1 AS c, x FROM k),
c0 AS MATERIALIZED (SELECT c, unnest(range(1, {dimensions} + 1)) AS d, unnest(x) AS x FROM f WHERE c < {clusters})"""
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, s * {clusters} + c) AS c, min(s) AS s FROM (SELECT r, c, CAST(sum((v.x - c{n}.x) * (v.x - c{n}.x)) AS BIGINT) AS s FROM v JOIN c{n} USING (d) GROUP BY r, c) GROUP BY r)")
        if n < rounds:
            mean = "CASE WHEN s % n < 0 THEN (s - s % n) // n - 1 ELSE (s - s % n) // n END"
            parts.append(f"m{n} AS (SELECT c, d, {mean} AS x FROM (SELECT c, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM v JOIN a{n} USING (r) GROUP BY c, d))")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c, d, coalesce(m{n}.x, c{n}.x) AS x FROM c{n} LEFT JOIN m{n} USING (c, d))")
    last = f"a{rounds}"
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, s AS distance, CAST(sum(s) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(s) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM {last} JOIN k USING (r) JOIN h USING (c)
"""


_LEAF = " || ".join(f"coalesce(CAST(strlen({x}) AS VARCHAR) || ':' || {x}, '-')" for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST({n} AS VARCHAR)", "text"))
_MERKLE = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t
), leaf AS MATERIALIZED (
  SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, * FROM (
    SELECT doc_id, lang, sha256({_LEAF.format(n="n_chars")}) AS leaf, sha256({_LEAF.format(n="(CAST(n_chars AS HUGEINT) + 1)")}) AS bad,
      xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 0 AS touched
    FROM documents, crc)
), tree AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY r) AS l FROM leaf GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range((len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM tree WHERE len(l) > 1
), sub AS MATERIALIZED (SELECT lang, level AS depth, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r FROM tree WHERE len(l) = 1),
over_ AS (
  SELECT 0 AS level, list(subroot ORDER BY r) AS l FROM sub
  UNION ALL
  SELECT level + 1, list_transform(range((len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], ''))) FROM over_ WHERE len(l) > 1
), steps AS MATERIALIZED (
  SELECT leaf.lang AS lang, leaf.r AS r, level, len(l) AS n, (leaf.r >> level) & 1 AS side, l[CAST(xor(leaf.r >> level, 1) AS BIGINT) + 1] AS sibling
  FROM leaf JOIN tree ON leaf.lang IS NOT DISTINCT FROM tree.lang WHERE len(l) > 1
  UNION ALL
  SELECT leaf.lang, leaf.r, depth + level, len(l), (sub.r >> level) & 1, l[CAST(xor(sub.r >> level, 1) AS BIGINT) + 1]
  FROM leaf JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang, over_ WHERE len(l) > 1
), proof AS MATERIALIZED (SELECT coalesce('1' || lang, '0') AS tree, r, list(side ORDER BY level) AS sides, list(sibling ORDER BY level) AS siblings FROM steps GROUP BY ALL),
fold AS (
  SELECT tree, r, 0 AS k, CASE WHEN touched AND bad IS NOT NULL THEN bad ELSE leaf END AS h FROM (SELECT *, coalesce('1' || lang, '0') AS tree FROM leaf)
  UNION ALL
  SELECT tree, r, k + 1, CASE WHEN siblings[k + 1] IS NULL THEN sha256(h) WHEN sides[k + 1] = 1 THEN sha256(siblings[k + 1] || h) ELSE sha256(h || siblings[k + 1]) END
  FROM fold JOIN proof USING (tree, r) WHERE k < len(sides)
), ends AS (SELECT tree, r, arg_max(h, k) AS folded_root FROM fold GROUP BY tree, r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(siblings, ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, coalesce('1' || lang, '0') AS tree FROM leaf) JOIN ends USING (tree, r) LEFT JOIN proof USING (tree, r)
JOIN (SELECT coalesce('1' || lang, '0') AS tree, subroot FROM sub) USING (tree), (SELECT l[1] AS root FROM over_ WHERE len(l) = 1)
"""

_MIXING = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, coalesce('1' || source, '2') AS source, source IS NULL AS last, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS MATERIALIZED (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY last, source) - 1) % 3 + 1 AS weight FROM d GROUP BY source, last),
total AS (SELECT CAST(sum(source_size) AS BIGINT) AS budget FROM s),
level AS (
  SELECT 0 AS k, CAST(0 AS BIGINT) AS capped, CAST(sum(weight) AS BIGINT) AS weighed FROM s
  UNION ALL
  SELECT k + 1, CAST(coalesce(sum(3 * source_size) FILTER (weight * (budget - capped) >= 3 * source_size * weighed), 0) AS BIGINT),
    CAST(coalesce(sum(weight) FILTER (weight * (budget - capped) < 3 * source_size * weighed), 0) AS BIGINT)
  FROM level, s, total WHERE k < 60 AND weighed > 0 GROUP BY k, capped, weighed
), t AS MATERIALIZED (
  SELECT source, source_size, CASE WHEN weighed = 0 OR weight * (budget - capped) >= 3 * source_size * weighed THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * (budget - capped) AS DOUBLE) / weighed END AS target
  FROM s, total, (SELECT * FROM level ORDER BY k DESC LIMIT 1)
), served AS (
  SELECT row, doc_id, size, source_size, target,
    CAST(sum(size) OVER (PARTITION BY source ORDER BY CAST('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT), doc_id, size, row) AS BIGINT) AS upto
  FROM d JOIN t USING (source)
), copies AS (
  SELECT row, source_size * copy + upto - size AS begun, least(source_size * copy + upto, CAST(floor(target) AS BIGINT)) AS ended, target FROM served, range(3) AS c(copy)
), line AS (
  SELECT row, ended - begun AS words, sum(ended - begun) OVER (ORDER BY ended / target, row, begun) - (ended - begun) AS start FROM copies WHERE ended > begun
), taken AS (SELECT row, CAST(sum(least(words, budget - start)) AS BIGINT) AS taken FROM line, total WHERE start < budget GROUP BY row)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, coalesce(taken, 0) AS taken FROM served LEFT JOIN taken USING (row)
"""

ORACLE_SQL = {
    "op4_substring": _SUBSTRING,
    "op5_decontaminate": _DECONTAMINATE,
    "op11_centroid_clustering": _clustering(),
    "op12_merkle_manifest": _MERKLE,
    "op13_source_mixing": _MIXING,
}
