"""DuckDB fragments for the SQL counterparts of queries."""

from __future__ import annotations

from ..operators.cleaning import MEASURES


def label_sql(c: str, fill: str = "'unknown'") -> str:
    """Label form of a column."""
    return f"coalesce(regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '[^\\p{{L}}\\p{{N}}_]+', '_', 'g'), {fill})"


def base_sql(c: str) -> str:
    """Base trail of a trail id, null if it names none."""
    return f"nullif(nullif(split_part({label_sql(c, 'NULL')}, '_sub', 1), 'unknown'), '')"


def measure_sql(c: str) -> str:
    return f"CASE WHEN {c} > 0 AND NOT isnan({c}) AND NOT isinf({c}) THEN {c} END"


SEX_SQL = "CASE WHEN lower(trim(sex)) IN ('f', 'female', '0') THEN 'f' WHEN lower(trim(sex)) IN ('m', 'male', '1') THEN 'm' ELSE 'unknown' END"

#: The clean footprint table.
FP = f"""fp AS (SELECT id, {label_sql('species')} AS species, {label_sql('individual_id')} AS individual_id, {label_sql('trail')} AS trail,
  {SEX_SQL} AS sex, {label_sql('dataorigin')} AS dataorigin, {label_sql('substrate')} AS substrate, fold, {label_sql('"__split__"')} AS split,
  {', '.join(f'{measure_sql(c)} AS {c}' for c in MEASURES)} FROM footprints)"""

#: Clean pair rows.
MP = f"""mp AS (SELECT comparison_id, {base_sql('trail_a_id')} AS a, {base_sql('trail_b_id')} AS b, {label_sql('trail_a_id')} AS trail_a_id, {label_sql('trail_b_id')} AS trail_b_id, pipeline, origin, tag, fold, min_observations, max_observations,
  CASE {label_sql('same_individual')} WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS same,
  {', '.join(f'CASE WHEN dist_{m} >= 0 AND NOT isnan(dist_{m}) THEN dist_{m} END AS {m}' for m in ('euclidean', 'manhattan', 'cosine', 'chebyshev', 'canberra', 'braycurtis'))} FROM master_pairs)"""

#: Vectors as rows of trails: ten individuals with up to six trails each.
EMB = """e AS (SELECT vec_id AS id, 'l' || label AS individual_id, 'l' || label || '_t' || ((vec_id // 10) % 6) AS trail, embedding FROM embeddings),
long AS (SELECT id, individual_id, trail, i, CAST(embedding[i] AS DOUBLE) AS x FROM e, generate_series(1, 64) AS g(i)),
cent AS (SELECT trail, individual_id, i, avg(x) AS m, min(id) AS ord FROM long GROUP BY ALL),
dist AS (SELECT a.trail AS trail_a_id, b.trail AS trail_b_id, a.individual_id = b.individual_id AS same_individual,
  sqrt(sum((a.m - b.m) ** 2)) AS euclidean, sum(abs(a.m - b.m)) AS manhattan, 1 - sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))) AS cosine,
  max(abs(a.m - b.m)) AS chebyshev, sum(abs(a.m - b.m) / (abs(a.m) + abs(b.m))) AS canberra, sum(abs(a.m - b.m)) / sum(abs(a.m + b.m)) AS braycurtis
  FROM cent a JOIN cent b ON a.i = b.i AND a.ord < b.ord GROUP BY ALL)"""
