"""DuckDB's SQL of exact alignment: accumulated costs as a fold over rows, the path as a fold over steps back."""

from __future__ import annotations


def total(values: str) -> str:
    """The sum from left to right."""
    return f"list_reduce(list_prepend(0.0::DOUBLE, {values}), lambda su, sv: su + sv)"


def paths(distance: str, pairs: str = "pairs", name: str = "paths") -> str:
    """Common table expressions that end in one with pair_id, a, b and path, a list of [i, j] from 1. `distance` is the SQL of the distance of x and y."""
    # a cell is its distance and the better of its upper and diagonal neighbours; each adds the least of these and the cell on its left
    row = "list_reduce(list_prepend([]::DOUBLE[], {cells}), lambda le, ce: le || [ce[1] + CASE WHEN len(le) = 0 THEN ce[2] ELSE least(ce[2], le[len(le)]) END])"
    first = row.format(cells="list_transform(cost[1], lambda v, j: [v, CASE WHEN j = 1 THEN 0 ELSE 'infinity'::DOUBLE END])")
    later = row.format(cells="list_transform(ro[1], lambda v, j: [v, CASE WHEN j > 1 THEN least(ac[len(ac)][j], ac[len(ac)][j - 1]) ELSE ac[len(ac)][j] END])")
    i, j, inf = "pa[len(pa)][1]", "pa[len(pa)][2]", "'infinity'::DOUBLE"
    diagonal, up, left = f"CASE WHEN {i} > 1 AND {j} > 1 THEN sums[{i} - 1][{j} - 1] ELSE {inf} END", f"CASE WHEN {i} > 1 THEN sums[{i} - 1][{j}] ELSE {inf} END", f"CASE WHEN {j} > 1 THEN sums[{i}][{j} - 1] ELSE {inf} END"
    # of equal steps back the diagonal first, then up, then left
    step = f"CASE WHEN {diagonal} <= least({up}, {left}) THEN [{i} - 1, {j} - 1] WHEN {up} <= {left} THEN [{i} - 1, {j}] ELSE [{i}, {j} - 1] END"
    return f"""{name}_cost AS MATERIALIZED (SELECT pair_id, a, b, list_transform(a, lambda x: list_transform(b, lambda y: {distance})) AS cost FROM {pairs}),
{name}_sums AS MATERIALIZED (SELECT pair_id, a, b, list_reduce(list_prepend([{first}], list_transform(cost[2:], lambda r: [r])), lambda ac, ro: ac || [{later}]) AS sums FROM {name}_cost),
{name} AS MATERIALIZED (SELECT pair_id, a, b, list_reverse(list_reduce(list_transform(range(len(a) + len(b)), lambda k: [[CAST(len(a) AS BIGINT), CAST(len(b) AS BIGINT)]]), lambda pa, un: CASE WHEN {i} = 1 AND {j} = 1 THEN pa ELSE pa || [{step}] END)) AS path FROM {name}_sums)"""


def steps(name: str = "paths") -> str:
    """pair_id, step, i, j from 0."""
    return f"SELECT pair_id, CAST(k - 1 AS INTEGER) AS step, CAST(path[k][1] - 1 AS INTEGER) AS i, CAST(path[k][2] - 1 AS INTEGER) AS j FROM (SELECT pair_id, path, unnest(range(1, len(path) + 1)) AS k FROM {name})"
