"""SQL for those registered queries that SQL can express, in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Sequence


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fitting_rule(rules: Sequence[tuple[str, str]], what: int) -> str:
    """CASE over the rules, longest first; ``what`` is 0 for the verdict, 1 for the rule."""
    out = "CASE"
    for r in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = r[1].partition("/")
        fits = f"(host = {_literal(name)} OR ends_with(host, {_literal('.' + name)})) AND starts_with(path, {_literal(slash + rest)})"
        out += f"\n      WHEN {fits} THEN {_literal(r[what])}"
    return out + " END"


def url_filter_sql(
    rules: Sequence[tuple[str, str]],
    depth: int = 16,
    max_children: int = 16,
    least_share: float = 0.05,
    similar_z: float = 1.0,
    reject_at: float = 0.8,
    prior: float = 0.2,
    strength: float = 4.0,
) -> str:
    """page_id, host, path, rule and verdict of ``pages``.

    Templates are made level by level from the root (t0, t1, ...), each URL
    shape knowing its template at every level; purities (p0, p1, ...) follow.
    """
    real = lambda x: f"CAST({x!r} AS DOUBLE)"
    trees, purities = "", ""
    for d in range(1, depth + 2):
        # How often each next segment occurs below a template, and whether it is named or a wildcard there.
        trees += f"""
s{d} AS MATERIALIZED (
  SELECT host, of, seg, 
    COUNT(*) OVER (PARTITION BY host, of) > {max_children} AND n < {real(least_share)} * SUM(n) OVER (PARTITION BY host, of) AS is_rare
  FROM (SELECT host, t[{d}] AS of, segs[{d}] AS seg, SUM(n) AS n FROM t{d - 1} WHERE len(segs) >= {d} GROUP BY ALL)
),
t{d} AS MATERIALIZED (
  SELECT x.host, x.shape, x.n, x.labelled, x.bad, x.segs,
    CASE WHEN len(x.segs) >= {d} THEN list_append(x.t, x.t[{d}] || '/' || CASE WHEN s.is_rare THEN '*' ELSE s.seg END) ELSE x.t END AS t
  FROM t{d - 1} x LEFT JOIN s{d} s ON x.host = s.host AND len(x.segs) >= {d} AND x.t[{d}] = s.of AND x.segs[{d}] = s.seg
),"""
        purities += f"""
n{d} AS MATERIALIZED (
  SELECT host, t[{d}] AS above, t[{d + 1}] AS template, SUM(labelled) AS l, SUM(bad) AS b
  FROM t{depth + 1} WHERE len(t) > {d} GROUP BY ALL
),
o{d} AS (
  SELECT *, LAG(l) OVER w AS l0, LAG(b) OVER w AS b0 FROM n{d} WHERE l > 0
  WINDOW w AS (PARTITION BY host, above ORDER BY b / l, template)
),
c{d} AS (
  SELECT *, CASE WHEN b / l = b0 / l0
      OR abs(b / l - b0 / l0) < {real(similar_z)} * sqrt(((b + b0) / (l + l0)) * (1 - (b + b0) / (l + l0)) * (1.0::DOUBLE / l + 1.0::DOUBLE / l0)) THEN 0 ELSE 1 END AS cut
  FROM o{d}
),
g{d} AS (SELECT host, above, template, l, b, SUM(cut) OVER (PARTITION BY host, above ORDER BY b / l, template) AS branch FROM c{d}),
m{d} AS (SELECT host, above, template, SUM(l) OVER (PARTITION BY host, above, branch) AS l, SUM(b) OVER (PARTITION BY host, above, branch) AS b FROM g{d}),
p{d} AS MATERIALIZED (
  SELECT n.host, n.template, (coalesce(m.b, 0) + {real(strength)} * p.purity) / (coalesce(m.l, 0) + {real(strength)}) AS purity
  FROM n{d} n JOIN p{d - 1} p ON n.host = p.host AND n.above = p.template LEFT JOIN m{d} m ON n.host = m.host AND n.template = m.template
),"""
    every = " UNION ALL ".join(f"SELECT * FROM p{d}" for d in range(depth + 2))
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
judged AS MATERIALIZED (
  SELECT *,
    {_fitting_rule(rules, 1)} AS rule,
    {_fitting_rule(rules, 0)} AS by_rule,
    regexp_replace(regexp_replace(path, '[0-9a-fA-F]*[0-9][0-9a-fA-F]{{7,}}|[0-9a-fA-F]{{7,}}[0-9][0-9a-fA-F]*', '#', 'g'), '[0-9]+', '#', 'g') AS shape
  FROM parts
),
shapes AS (
  SELECT host, shape, CAST(COUNT(*) AS DOUBLE) AS n, CAST(COUNT(by_rule) AS DOUBLE) AS labelled,
    CAST(COUNT(*) FILTER (by_rule = 'block') AS DOUBLE) AS bad, string_split(shape, '/')[2:] AS segs
  FROM judged GROUP BY host, shape
),
t0 AS MATERIALIZED (
  SELECT host, shape, n, labelled, bad, CASE WHEN len(segs) > {depth} THEN list_append(segs[1:{depth}], '**') ELSE segs END AS segs, [''] AS t FROM shapes
),{trees}
p0 AS MATERIALIZED (
  SELECT host, '' AS template, (SUM(bad) + {real(strength)} * {real(prior)}) / (SUM(labelled) + {real(strength)}) AS purity FROM t0 GROUP BY host
),{purities}
purity AS ({every}),
verdicts AS (
  SELECT t.host, t.shape, CASE WHEN purity >= {real(reject_at)} THEN 'block' ELSE 'allow' END AS by_tree
  FROM t{depth + 1} t JOIN purity p ON t.host = p.host AND t.t[-1] = p.template
)
SELECT page_id, host, path, rule, coalesce(by_rule, by_tree) AS verdict FROM judged LEFT JOIN verdicts USING (host, shape)
"""


def vector_links_sql(least: float = 0.93) -> str:
    """vec_id, n_links, component_id and kept of ``embeddings`` by comparing all pairs of a label.

    Whole rows that repeat count once, and keys are taken to be unique apart
    from that. This is quadratic: it is meant for the small tables of a check.
    """
    return f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label,
    CASE WHEN len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
      THEN CAST(embedding AS DOUBLE[]) END AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL
),
fit AS (
  SELECT DISTINCT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors WHERE v IS NOT NULL
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_dot_product(a.v, b.v) / (a.norm * b.norm) >= CAST({least} AS DOUBLE) ELSE FALSE END
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings WHERE vec_id IS NOT NULL
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
),
least AS (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a, COUNT(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n_links, 0) AS n_links, l.component_id, coalesce(e.vec_id = l.component_id, TRUE) AS kept
FROM embeddings e LEFT JOIN least l ON e.vec_id = l.a LEFT JOIN counted c ON e.vec_id = c.a
"""


_WHOLE = "[CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]"
_SOUND = "len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"


def clusters_sql(k: int = 40, rounds: int = 5, d: int = 64, seed: int = 2) -> str:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of ``embeddings``; keys are taken to be unique."""
    steps = ""
    for i in range(rounds + 1):
        steps += f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, arg_min(n, (distance, n)) AS cluster, min(distance) AS distance FROM (
    SELECT vec_id, n, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v, c)]) AS distance FROM kept, c{i}) GROUP BY vec_id
),"""
        if i < rounds:
            steps += f"""
m{i} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM (
    SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
      SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM kept JOIN a{i} USING (vec_id)) GROUP BY cluster, pos) GROUP BY cluster
),
c{i + 1} AS MATERIALIZED (SELECT n, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} m ON m.cluster = n),"""
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, {_WHOLE} AS v FROM embeddings WHERE len(embedding) = {d} AND {_SOUND}),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS n, v AS c FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h LIMIT {k})
),{steps}
facts AS (
  SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia, sha256(any_value(array_to_string(c, ','))) AS centroid_sha256
  FROM a{rounds} JOIN c{rounds} ON n = cluster GROUP BY cluster
)
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, cluster_inertia, CAST((SELECT sum(distance) FROM a{rounds}) AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN facts USING (cluster)
"""


def negatives_sql(positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> str:
    """Anchors, their positives and hard negatives of ``embeddings`` by comparing all anchors with all rows; keys are taken to be unique."""
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_SOUND}
),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, b.v)]) AS BIGINT) AS s
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
),
best AS (
  SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= {positives}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, s AS negative_score
FROM best JOIN scores USING (anchor_id) WHERE NOT same AND {low} * positive_score <= 100 * s AND 100 * s <= {high} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) <= {negatives}
"""


def archive_sql(least_bytes: int = 1000) -> str:
    """The records that ``pages`` become, as read back from the archives."""
    return f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sizes AS (SELECT *, octet_length(encode(html)) AS payload_bytes, CASE WHEN octet_length(encode(html)) >= {least_bytes} THEN html END AS same FROM payloads),
firsts AS (SELECT same, max(page_id) AS last FROM sizes WHERE same IS NOT NULL GROUP BY same)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN last IS NULL OR page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM sizes LEFT JOIN firsts USING (same)
"""
