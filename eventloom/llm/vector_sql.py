"""DuckDB SQL of the clustering and vector code queries, round after round as named steps."""

from __future__ import annotations

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE))"
#: floor(s / n) of whole numbers: // cuts towards zero.
_FLOOR = "CAST((s - ((s % n) + n) % n) // n AS DOUBLE)"


def yinyang_sql(k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3) -> str:
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_WHOLE} AS e FROM embeddings WHERE {_FINITE} AND len(embedding) = {dim})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), e) - 1 AS c, e AS m FROM v ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        distance = "CAST(list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, m) + list_dot_product(m, m) AS BIGINT)"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, e, min(CAST(d AS HUGEINT) * {k} + c) AS best FROM (SELECT v.r, v.vec_id, v.e, c, {distance} AS d FROM v, c{i}) GROUP BY r, vec_id, e)")
        if i < rounds:
            steps.append(
                f"u{i} AS MATERIALIZED (SELECT c, list({_FLOOR} ORDER BY i) AS m FROM (SELECT best % {k} AS c, i, sum(CAST(e[i] AS BIGINT)) AS s, count(*) AS n FROM a{i}, generate_series(1, {dim}) g(i) GROUP BY 1, 2) GROUP BY c)"
            )
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(u{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN u{i} USING (c))")
    last = f"SELECT vec_id, CAST(best % {k} AS INTEGER) AS cluster, CAST(best // {k} AS BIGINT) AS distance FROM a{rounds}"
    digest = "sha256(array_to_string(list_transform(m, lambda x: CAST(x AS BIGINT)), ','))"
    return f"WITH {', '.join(steps)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, {digest} AS centroid_sha256 FROM ({last}) JOIN c{rounds} ON c = cluster"


def vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, width: int = 16) -> str:
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, {_WHOLE} AS e FROM embeddings WHERE {_FINITE})",
        f"x AS MATERIALIZED (SELECT r, p, e[p * {width} + 1 : (p + 1) * {width}] AS e FROM v, generate_series(0, {parts - 1}) g(p))",
        f"f AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY vec_id, e) - 1 AS j FROM v ORDER BY j LIMIT {entries})",
        "b0 AS MATERIALIZED (SELECT p, j, e AS m FROM x JOIN f USING (r))",
    ]
    for i in range(rounds + 1):
        distance = "CAST(list_dot_product(x.e, x.e) - 2 * list_dot_product(x.e, m) + list_dot_product(m, m) AS BIGINT)"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, min(d * {entries} + j) AS best FROM (SELECT x.r, x.p, j, {distance} AS d FROM x JOIN b{i} ON x.p = b{i}.p) GROUP BY r, p)")
        if i < rounds:
            steps.append(
                f"u{i} AS MATERIALIZED (SELECT p, j, list({_FLOOR} ORDER BY i) AS m FROM (SELECT a{i}.p, best % {entries} AS j, i, sum(CAST(x.e[i] AS BIGINT)) AS s, count(*) AS n FROM a{i} JOIN x USING (r, p), generate_series(1, {width}) g(i) GROUP BY 1, 2, 3) GROUP BY p, j)"
            )
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT p, j, coalesce(u{i}.m, b{i}.m) AS m FROM b{i} LEFT JOIN u{i} USING (p, j))")
    coded = f"SELECT r, string_agg(lower(printf('%02x', CAST(best % {entries} AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r"
    digest = f"(SELECT sha256(string_agg(array_to_string(list_transform(m, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, j)) FROM b{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {digest} AS codebooks_sha256 FROM v JOIN ({coded}) USING (r)"
