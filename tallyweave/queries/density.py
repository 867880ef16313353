"""Marginal frequencies and distribution errors."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tallyweave.operators import bins, density
from tallyweave.queries.registry import query, round_doubles, table

COLUMNS = ("l_returnflag", "l_linenumber", "l_discount", "l_tax", "l_quantity")
NARROW = COLUMNS[:4]


def populations(spark, folder, columns=NARROW):
    """Lines of the one status and of the other, standing in for a real and a synthetic table."""
    lines = table(spark, folder, "lineitem")
    return tuple(lines.where(F.col("l_linestatus") == s).select(*columns) for s in "OF")


def _cells_sql(columns, orders):
    """One full join per combination, as independent of the grouping sets as can be."""
    parts = []
    for order in orders:
        for combo in combinations(columns, order):
            keys = ", ".join(combo)
            cell = " || '_' || ".join(
                f"coalesce(CAST(coalesce(t.{c}, s.{c}) AS VARCHAR), 'null')" for c in combo
            )
            on = " AND ".join(f"t.{c} IS NOT DISTINCT FROM s.{c}" for c in combo)
            parts.append(
                f"""SELECT CAST({order} AS INTEGER) AS "order", '{"_".join(combo)}' AS combo,
                    {cell} AS cell, coalesce(t.n, 0) AS n_target, coalesce(s.n, 0) AS n_synth
                FROM (SELECT {keys}, count(*) AS n FROM target GROUP BY {keys}) t
                FULL JOIN (SELECT {keys}, count(*) AS n FROM synthetic GROUP BY {keys}) s
                ON {on}"""
            )
    return f"""WITH target AS (SELECT * FROM lineitem WHERE l_linestatus = 'O'),
        synthetic AS (SELECT * FROM lineitem WHERE l_linestatus = 'F'),
        counted AS ({" UNION ALL ".join(parts)}),
        cells AS (SELECT *, n_target / (SELECT count(*) FROM target)::DOUBLE AS p,
                  n_synth / (SELECT count(*) FROM synthetic)::DOUBLE AS q FROM counted)"""


def _errors_sql(columns, orders, tail):
    return f"""{_cells_sql(columns, orders)},
        errors AS (SELECT "order", combo, count(*) AS cells, avg(abs(p - q)) AS mae,
            avg(abs(p - q) / (p + q)) AS mnae, -sum(p * ln(q + 1e-10)) AS cross_entropy
            FROM cells GROUP BY "order", combo)
        {tail}"""


@query("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def freq_1way(spark, folder):
    return density.value_counts(table(spark, folder, "lineitem"), "l_returnflag")


@query(
    """SELECT l_returnflag, l_linenumber, count(*) AS n,
        l_returnflag || '_' || CAST(l_linenumber AS VARCHAR) AS cell
    FROM lineitem GROUP BY l_returnflag, l_linenumber"""
)
def freq_2way(spark, folder):
    columns = ["l_returnflag", "l_linenumber"]
    counted = density.frequencies(table(spark, folder, "lineitem"), columns)
    return counted.withColumn("cell", density.cell_name(columns))


@query(
    _cells_sql(NARROW, (2,))
    + """ SELECT "order", combo, cell, n_target, n_synth, round(p, 9) AS p, round(q, 9) AS q
    FROM cells"""
)
def joint_probs_2(spark, folder):
    return round_doubles(density.joint_probs(*populations(spark, folder), orders=[2]))


@query(
    _cells_sql(COLUMNS, (1, 2, 3))
    + """ SELECT "order", combo, cell, n_target, n_synth, round(p, 9) AS p, round(q, 9) AS q
    FROM cells"""
)
def joint_probs_rolled_up(spark, folder):
    """All orders from a few wide column sets."""
    tables = populations(spark, folder, COLUMNS)
    sizes = density.column_sizes(*tables)
    return round_doubles(density.joint_probs(*tables, orders=[1, 2, 3], sizes=sizes))


@query(
    _cells_sql(NARROW, (2,))
    + " SELECT combo, cell, round(abs(p - q), 9) AS abs_error FROM cells"
)
def abs_error_cells(spark, folder):
    probs = density.joint_probs(*populations(spark, folder), orders=[2])
    return round_doubles(density.absolute_errors(probs).select("combo", "cell", "abs_error"))


def _errors(spark, folder, orders, columns=NARROW):
    return density.evaluate(*populations(spark, folder, columns), orders=orders)


@query(_errors_sql(NARROW, (2,), "SELECT combo, cells, round(mae, 9) AS mae FROM errors"))
def mae_by_combo(spark, folder):
    return round_doubles(_errors(spark, folder, [2]).select("combo", "cells", "mae"))


@query(_errors_sql(NARROW, (2,), "SELECT combo, round(mnae, 9) AS mnae FROM errors"))
def mnae_by_combo(spark, folder):
    return round_doubles(_errors(spark, folder, [2]).select("combo", "mnae"))


@query(
    _errors_sql(
        NARROW, (2,), "SELECT combo, round(cross_entropy, 9) AS cross_entropy FROM errors"
    )
)
def cross_entropy_by_combo(spark, folder):
    return round_doubles(_errors(spark, folder, [2]).select("combo", "cross_entropy"))


@query(
    _errors_sql(
        COLUMNS,
        (1, 2, 3),
        """SELECT "order", count(*) AS combos, round(avg(mae), 9) AS mmae,
            round(avg(mnae), 9) AS mean_mnae,
            round(avg(cross_entropy), 9) AS mean_cross_entropy
        FROM errors GROUP BY "order" """,
    )
)
def mmae_orders(spark, folder):
    return round_doubles(density.mean_errors(_errors(spark, folder, [1, 2, 3], COLUMNS)))


_ERROR_COLUMNS = """"order", combo, cells, round(mae, 9) AS mae, round(mnae, 9) AS mnae,
    round(cross_entropy, 9) AS cross_entropy"""


@query(_errors_sql(NARROW, (1, 2), f"""SELECT {_ERROR_COLUMNS},
    CAST(row_number() OVER (ORDER BY errors.mae, "order", combo) AS INTEGER) AS rank FROM errors"""))
def rank_combos(spark, folder):
    return round_doubles(density.rank_combos(_errors(spark, folder, [1, 2])))


@query(
    _errors_sql(
        NARROW,
        (1, 2),
        f'SELECT {_ERROR_COLUMNS} FROM errors ORDER BY errors.mae DESC, "order", combo LIMIT 3',
    )
)
def worst_combo(spark, folder):
    return round_doubles(density.worst_combos(_errors(spark, folder, [1, 2]), 3))


@query(
    """SELECT coalesce(f.o_orderpriority, o.o_orderpriority) AS o_orderpriority,
        coalesce(f.n, 0) AS n_target, coalesce(o.n, 0) AS n_synth
    FROM (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) f
    FULL JOIN
        (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) o
    ON f.o_orderpriority IS NOT DISTINCT FROM o.o_orderpriority"""
)
def value_counts_outer(spark, folder):
    orders = table(spark, folder, "orders")
    filled = F.col("o_orderstatus") == "F"
    pick = [orders.where(side).drop("o_orderstatus") for side in (filled, ~filled)]
    return density.compare_value_counts(*pick, "o_orderpriority")


@query(
    f"""SELECT count(*) AS distinct_rows, CAST(sum(n) AS BIGINT) AS rows,
        round(count(*) / sum(n)::DOUBLE, 9) AS share
    FROM (SELECT {", ".join(COLUMNS)}, count(*) AS n FROM lineitem GROUP BY ALL)"""
)
def unique_row_share(spark, folder):
    return round_doubles(density.unique_row_share(table(spark, folder, "lineitem").select(*COLUMNS)))


_EDGES = ", ".join(f"s[CAST(floor((len(s) - 1) * {i / 10} + 0.5) AS BIGINT) + 1]" for i in range(11))
_BIN_SQL = """CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice < edges[1] THEN -1
        WHEN o_totalprice > edges[len(edges)] THEN len(edges) - 1
        ELSE least(len(list_filter(edges, lambda e: e <= o_totalprice)), len(edges) - 1) - 1 END"""


@query(
    f"""WITH ranked AS (SELECT list_sort(list(o_totalprice)) AS s FROM orders WHERE o_orderstatus = 'F'),
    edges AS (SELECT list_sort(list_distinct([{_EDGES}])) AS edges FROM ranked),
    cut AS (SELECT o_orderstatus, o_orderpriority, {_BIN_SQL} AS bin FROM orders, edges),
    sizes AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders),
    cells AS (SELECT 'o_totalprice' AS combo, bin AS a, NULL AS b, o_orderstatus AS side FROM cut
        UNION ALL SELECT 'o_orderpriority', NULL, o_orderpriority, o_orderstatus FROM cut
        UNION ALL SELECT 'o_totalprice_o_orderpriority', bin, o_orderpriority, o_orderstatus FROM cut),
    counted AS (SELECT combo, a, b, count(*) FILTER (side = 'F') / any_value(f)::DOUBLE AS p,
        count(*) FILTER (side = 'O') / any_value(o)::DOUBLE AS q FROM cells, sizes WHERE side IN ('F', 'O') GROUP BY combo, a, b)
    SELECT combo, count(*) AS cells, round(avg(abs(p - q)), 9) AS mae FROM counted GROUP BY combo"""
)
def binned_marginals(spark, folder):
    """Prices of orders of the one status against the bins of the other, alone and by priority."""
    orders = table(spark, folder, "orders")
    target, synthetic = (
        orders.where(F.col("o_orderstatus") == s).select("o_totalprice", "o_orderpriority") for s in "FO"
    )
    return round_doubles(bins.evaluate(target, synthetic, [1, 2]).select("combo", "cells", "mae"))
