"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from tallyard.llm.vectorcodes import ENTRIES, PARTS, ROUNDS, SCALE


def _assign(step: int) -> str:
    """Each part's nearest entry of the codebooks after ``step`` rounds: the smallest (distance, index)."""
    return f"""a{step} AS MATERIALIZED (
        SELECT r, p, min(struct_pack(d := d, e := e)) AS m FROM (
            SELECT parts.r, p, e, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x, c)]) AS BIGINT) AS d FROM parts JOIN b{step} USING (p)
        ) GROUP BY r, p)"""


def _mean(step: int) -> str:
    """Codebooks after ``step`` rounds: means of the parts of each entry, rounded down; entries without parts stay."""
    return f"""b{step} AS MATERIALIZED (
        SELECT p, e, coalesce(n.c, o.c) AS c FROM b{step - 1} o LEFT JOIN (
            SELECT p, e, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY j) AS c FROM (
                SELECT p, m.e AS e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS k
                FROM a{step - 1} JOIN parts USING (r, p), unnest(range(1, len(x) + 1)) AS u(j) GROUP BY ALL
            ) GROUP BY p, e
        ) n USING (p, e))"""


VECTOR_CODES = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, unnest(range({PARTS})) AS t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {ENTRIES}),
{", ".join(f"{_assign(i)}, {_mean(i + 1)}" for i in range(ROUNDS))},
{_assign(ROUNDS)},
codes AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (r), digest
"""
