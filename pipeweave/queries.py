"""One query for each operator of the language over the synthetic tables, with the SQL of the same rows.

Each entry is a program and its SQL. Programs run over whole tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import frame, run

_T = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"



#: name -> (program, SQL)
PROGRAMS: dict[str, tuple[str, str]] = {
    "filter_cmp": (
        'load "lineitem.parquet" | filter l_quantity >= 30 and l_discount < 0.05 | select l_orderkey, l_linenumber, l_quantity',
        "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05",
    ),
    "filter_kleene": (
        'load "events.parquet" | filter not (event_type == "click") or value > 50 | select event_id, event_type, value',
        "SELECT event_id, event_type, value FROM events WHERE NOT (event_type = 'click') OR value > 50",
    ),
    "filter_null_predicate": (
        'load "orders.parquet" | mutate p = if_else(o_totalprice > 100000, o_totalprice, null) | filter p > 0 | select o_orderkey, p',
        "SELECT o_orderkey, o_totalprice AS p FROM orders WHERE o_totalprice > 100000",
    ),
    "select_alias": (
        'load "nation.parquet" | select name = n_name, n_nationkey, region = n_regionkey',
        "SELECT n_name AS name, n_nationkey, n_regionkey AS region FROM nation",
    ),
    "drop_cols": (
        'load "customer.parquet" | drop c_name, c_acctbal',
        "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
    ),
    "rename_cols": (
        'load "supplier.parquet" | rename id = s_suppkey, balance = s_acctbal',
        "SELECT s_suppkey AS id, s_name, s_nationkey, s_acctbal AS balance FROM supplier",
    ),
    "mutate_parallel_swap": (
        'load "part.parquet" | select p_partkey, p_name, p_brand | mutate p_name = p_brand, p_brand = p_name',
        "SELECT p_partkey, p_brand AS p_name, p_name AS p_brand FROM part",
    ),
    "arith_all": (
        'load "lineitem.parquet" | mutate a = l_quantity + 1, b = l_quantity - l_linenumber, c = l_quantity * 2, d = l_quantity / 4, '
        "e = l_quantity % 7, f = -l_quantity | select l_orderkey, l_linenumber, a, b, c, d, e, f",
        "SELECT l_orderkey, l_linenumber, l_quantity + 1.0::DOUBLE AS a, l_quantity - l_linenumber::DOUBLE AS b, l_quantity * 2.0::DOUBLE AS c, "
        "l_quantity / 4.0::DOUBLE AS d, l_quantity % 7.0::DOUBLE AS e, -l_quantity AS f FROM lineitem",
    ),
    "div_zero_ieee": (
        'load "lineitem.parquet" | mutate z = l_linenumber - 1 | mutate shown = to_string(l_quantity / z), back = is_null(null / z) '
        "| filter z == 0 | select l_orderkey, l_linenumber, shown, back",
        "SELECT l_orderkey, l_linenumber, 'inf' AS shown, true AS back FROM lineitem WHERE l_linenumber = 1",
    ),
    "dynamic_col": (
        'load "part.parquet" | mutate which = if_else(p_size > 25, "p_brand", "p_type") | mutate picked = col(which) | select p_partkey, picked',
        "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_type END AS picked FROM part",
    ),
    "concat_nulls": (
        'load "customer.parquet" | mutate label = concat(c_mktsegment, "/", if_else(c_custkey % 2 == 0, c_name, null), "#", c_custkey) | select c_custkey, label',
        "SELECT c_custkey, c_mktsegment || '/' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END || '#' || c_custkey AS label FROM customer",
    ),
    "lower_upper_trim": (
        'load "customer.parquet" | mutate lo = lower(c_mktsegment), up = upper(c_name), tr = trim(concat("  ", c_name, " ")) | select c_custkey, lo, up, tr',
        "SELECT c_custkey, lower(c_mktsegment) AS lo, upper(c_name) AS up, c_name AS tr FROM customer",
    ),
    "contains_starts_with": (
        'load "part.parquet" | mutate has = contains(p_name, "a"), starts = starts_with(p_brand, "Brand#1") | select p_partkey, has, starts',
        "SELECT p_partkey, contains(p_name, 'a') AS has, starts_with(p_brand, 'Brand#1') AS starts FROM part",
    ),
    "replace_literal": (
        'load "part.parquet" | mutate r = replace(p_brand, "#", "-"), w = replace(p_brand, p_brand, p_type) | select p_partkey, r, w',
        "SELECT p_partkey, replace(p_brand, '#', '-') AS r, p_type AS w FROM part",
    ),
    "to_string_number": (
        'load "lineitem.parquet" | mutate q = to_string(l_quantity), big = to_string(l_orderkey * 1000000), half = to_string(l_linenumber / 2) '
        "| select l_orderkey, l_linenumber, q, big, half",
        "SELECT l_orderkey, l_linenumber, l_quantity::BIGINT::VARCHAR AS q, (l_orderkey * 1000000)::BIGINT::VARCHAR AS big, "
        "CASE WHEN l_linenumber % 2 = 0 THEN (l_linenumber // 2)::VARCHAR ELSE (l_linenumber // 2)::VARCHAR || '.5' END AS half FROM lineitem",
    ),
    "to_number_parse": (
        'load "customer.parquet" | mutate n = to_number(concat(" ", c_custkey, ".5 ")), bad = to_number(c_name) | select c_custkey, n, bad',
        "SELECT c_custkey, c_custkey + 0.5::DOUBLE AS n, NULL::DOUBLE AS bad FROM customer",
    ),
    "to_boolean_parse": (
        'load "nation.parquet" | mutate b = to_boolean(if_else(n_regionkey == 0, " true", if_else(n_regionkey == 1, "false", "TRUE"))) | select n_nationkey, b',
        "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN true WHEN 1 THEN false END AS b FROM nation",
    ),
    "abs_round": (
        'load "customer.parquet" | mutate a = abs(c_acctbal), r = round(c_acctbal) | select c_custkey, a, r',
        "SELECT c_custkey, abs(c_acctbal) AS a, CASE WHEN round(c_acctbal) = 0 THEN 0.0::DOUBLE ELSE round(c_acctbal) END AS r FROM customer",
    ),
    "round_digits": (
        'load "lineitem.parquet" | mutate r = round(l_extendedprice * l_discount, 1) | select l_orderkey, l_linenumber, r',
        "SELECT l_orderkey, l_linenumber, CASE WHEN round(l_extendedprice * l_discount * 10) = 0 THEN 0.0::DOUBLE ELSE round(l_extendedprice * l_discount * 10) / 10 END AS r FROM lineitem",
    ),
    "coalesce_first": (
        'load "orders.parquet" | mutate v = coalesce(if_else(o_totalprice > 150000, o_totalprice, null), 0) | select o_orderkey, v',
        "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN o_totalprice ELSE 0.0::DOUBLE END AS v FROM orders",
    ),
    "if_else_null": (
        'load "orders.parquet" | mutate v = if_else(if_else(o_orderkey % 2 == 0, o_totalprice, null) > 100000, "high", "low") | select o_orderkey, v',
        "SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 THEN NULL WHEN o_totalprice > 100000 THEN 'high' ELSE 'low' END AS v FROM orders",
    ),
    "is_null_not_null": (
        'load "orders.parquet" | mutate x = if_else(o_orderkey % 3 == 0, o_orderstatus, null) | mutate a = is_null(x), b = not_null(x), c = x == null | select o_orderkey, a, b, c',
        "SELECT o_orderkey, o_orderkey % 3 <> 0 AS a, o_orderkey % 3 = 0 AS b, o_orderkey % 3 <> 0 AS c FROM orders",
    ),
    "date_parts": (
        'load "orders.parquet" | mutate y = year(o_orderdate), m = month(o_orderdate), d = day(o_orderdate) | select o_orderkey, y, m, d',
        "SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, day(o_orderdate)::DOUBLE AS d FROM orders",
    ),
    "date_normalize": (
        'load "events.parquet" | mutate d = date(ts) | select event_id, d',
        "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d FROM events",
    ),
    "datetime_normalize": (
        'load "events.parquet" | mutate t = datetime(ts), n = datetime(date(ts)) | select event_id, t, n',
        f"SELECT event_id, {_T.format('ts')} AS t, NULL::VARCHAR AS n FROM events",
    ),
    **{
        f"date_floor_{u}": (
            f'load "events.parquet" | mutate t = date_floor(ts, "{u}"), d = date_floor(date(ts), "{u}") | select event_id, t, d',
            f"SELECT event_id, strftime(date_trunc('{u}', ts), '%Y-%m-%dT00:00:00Z') AS t, strftime(date_trunc('{u}', ts), '%Y-%m-%d') AS d FROM events",
        )
        for u in ("day", "week", "month", "year")
    },
    "date_format_month": (
        'load "events.parquet" | mutate m = date_format(ts, "%Y-%m"), c = date_format(ts, "%H:%M:%S %z %% %j") | select event_id, m, c',
        "SELECT event_id, strftime(ts, '%Y-%m') AS m, strftime(ts, '%H:%M:%S +0000 %% %j') AS c FROM events",
    ),
    "date_format_isoweek": (
        'load "events.parquet" | mutate w = date_format(ts, "%G-W%V-%u") | select event_id, w',
        "SELECT event_id, strftime(ts, '%G-W%V-%u') AS w FROM events",
    ),
    "agg_global": (
        'load "lineitem.parquet" | agg n = count(), q = sum(l_quantity), lo = min(l_extendedprice), hi = max(l_extendedprice)',
        "SELECT count(*) AS n, sum(l_quantity) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem",
    ),
    "agg_group_multi": (
        'load "lineitem.parquet" | group_by l_returnflag, l_linestatus, l_linenumber | agg n = count(), q = sum(l_quantity), m = mean(l_quantity)',
        "SELECT l_returnflag, l_linestatus, l_linenumber::VARCHAR AS l_linenumber, count(*) AS n, sum(l_quantity) AS q, avg(l_quantity) AS m FROM lineitem GROUP BY ALL",
    ),
    "agg_count_nonnull": (
        'load "orders.parquet" | mutate x = if_else(o_totalprice > 100000, o_totalprice, null) | group_by o_orderstatus | agg n = count(x), rows = count()',
        "SELECT o_orderstatus, count(*) FILTER (o_totalprice > 100000) AS n, count(*) AS rows FROM orders GROUP BY 1",
    ),
    "agg_count_distinct": (
        'load "orders.parquet" | group_by o_orderpriority | agg c = count_distinct(o_custkey)',
        "SELECT o_orderpriority, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1",
    ),
    "agg_min_max_text": (
        'load "customer.parquet" | group_by c_nationkey | agg a = min(c_name), z = max(c_name)',
        "SELECT c_nationkey::VARCHAR AS c_nationkey, min(c_name) AS a, max(c_name) AS z FROM customer GROUP BY 1",
    ),
    "agg_expr_arg": (
        'load "lineitem.parquet" | group_by l_shipdate | agg q = sum(l_quantity * 2 + 1)',
        f"SELECT {_T.format('l_shipdate')} AS l_shipdate, sum(l_quantity * 2 + 1) AS q FROM lineitem GROUP BY 1",
    ),
    "agg_empty_global": (
        'load "nation.parquet" | filter n_nationkey < 0 | agg n = count(), s = sum(n_nationkey), m = mean(n_nationkey)',
        "SELECT count(*) AS n, sum(n_nationkey)::DOUBLE AS s, avg(n_nationkey) AS m FROM nation WHERE n_nationkey < 0",
    ),
    "agg_text_sum": (
        'load "customer.parquet" | agg s = sum(c_name), n = count(c_name)',
        "SELECT NULL::DOUBLE AS s, count(c_name) AS n FROM customer",
    ),
    "join_inner": (
        'let c = load "customer.parquet" load "orders.parquet" | join c on (o_custkey, c_custkey) | select o_orderkey, c_name, o_totalprice',
        "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
    "join_left": (
        'let o = load "orders.parquet" | filter o_totalprice > 200000 load "customer.parquet" | join o on (c_custkey, o_custkey) kind left | select c_custkey, o_orderkey, o_totalprice',
        "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey",
    ),
    "join_right_keycopy": (
        'let c = load "customer.parquet" | select c_custkey, c_name load "orders.parquet" | filter o_totalprice > 200000 | join c on (o_custkey, c_custkey) kind right | select o_custkey, o_orderkey, c_name',
        "SELECT c_custkey AS o_custkey, o_orderkey, c_name FROM (SELECT * FROM orders WHERE o_totalprice > 200000) RIGHT JOIN customer ON c_custkey = o_custkey",
    ),
    "join_full": (
        'let s = load "supplier.parquet" | filter s_nationkey > 5 | select s_nationkey, s_name load "nation.parquet" | filter n_nationkey < 15 | join s on (n_nationkey, s_nationkey) kind full | select n_nationkey, n_name, s_name',
        "SELECT coalesce(n_nationkey, s_nationkey)::BIGINT AS n_nationkey, n_name, s_name FROM (SELECT * FROM nation WHERE n_nationkey < 15) FULL JOIN (SELECT * FROM supplier WHERE s_nationkey > 5) ON n_nationkey = s_nationkey",
    ),
    "join_semi": (
        'let o = load "orders.parquet" | filter o_orderstatus == "F" load "customer.parquet" | join o on (c_custkey, o_custkey) kind semi | select c_custkey, c_name',
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    ),
    "join_anti": (
        'let o = load "orders.parquet" | filter o_orderstatus == "F" load "customer.parquet" | join o on (c_custkey, o_custkey) kind anti | select c_custkey, c_name',
        "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    ),
    "join_composite": (
        'let l = load "lineitem.parquet" | select l_orderkey, l_linenumber, l_tax load "lineitem.parquet" | filter l_quantity > 45 | join l on l_orderkey, l_linenumber | select l_orderkey, l_linenumber, l_tax_right',
        "SELECT l_orderkey, l_linenumber, b.l_tax AS l_tax_right FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber) WHERE a.l_quantity > 45",
    ),
    "join_pair_keys": (
        'let s = load "supplier.parquet" let n = load "nation.parquet" load "lineitem.parquet" | join s on (l_suppkey, s_suppkey) | join n on (s_nationkey, n_nationkey) | group_by n_name | agg q = sum(l_quantity)',
        "SELECT n_name, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    ),
    "join_suffix": (
        'let b = load "nation.parquet" | select n_nationkey, n_name, n_regionkey load "nation.parquet" | join b on n_regionkey | select n_nationkey, n_name, n_nationkey_right, n_name_right',
        "SELECT a.n_nationkey, a.n_name, b.n_nationkey AS n_nationkey_right, b.n_name AS n_name_right FROM nation a JOIN nation b USING (n_regionkey)",
    ),
    "union_pos": (
        'let s = load "supplier.parquet" | select s_suppkey, s_name load "customer.parquet" | select c_custkey, c_name | union s',
        "SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
    ),
    "union_by_name_pad": (
        'let s = load "supplier.parquet" | select id = s_suppkey, balance = s_acctbal load "customer.parquet" | select id = c_custkey, segment = c_mktsegment | union s by_name true',
        "SELECT c_custkey AS id, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier",
    ),
    "union_distinct": (
        'let b = load "customer.parquet" | select k = c_nationkey load "supplier.parquet" | select k = s_nationkey | union b distinct true',
        "SELECT s_nationkey::BIGINT AS k FROM supplier UNION SELECT c_nationkey FROM customer",
    ),
    "distinct_rows": (
        'load "lineitem.parquet" | select l_returnflag, l_linestatus | distinct',
        "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    ),
    "distinct_keys_first": (
        'load "orders.parquet" | sort o_totalprice desc, o_orderkey | distinct o_custkey | select o_custkey, o_orderkey, o_totalprice',
        "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    ),
    "pivot_longer": (
        'load "lineitem.parquet" | select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax | pivot_longer l_quantity, l_discount, l_tax names_to measure values_to amount',
        "SELECT l_orderkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem "
        "UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem",
    ),
    "complete_fill": (
        'load "orders.parquet" | group_by o_orderpriority, o_custkey | agg n = count() | complete o_orderpriority, o_custkey fill n = 0',
        "WITH o AS (SELECT o_orderpriority, o_custkey::VARCHAR AS o_custkey, count(*) AS n FROM orders GROUP BY ALL) "
        "SELECT p.o_orderpriority, c.o_custkey, coalesce(n, 0)::DOUBLE AS n FROM (SELECT DISTINCT o_orderpriority FROM o) p CROSS JOIN (SELECT DISTINCT o_custkey FROM o) c "
        "LEFT JOIN o ON p.o_orderpriority = o.o_orderpriority AND c.o_custkey = o.o_custkey",
    ),
    "topk_sort_limit": (
        'load "orders.parquet" | sort o_totalprice desc, o_orderkey | limit 100 | select o_orderkey, o_totalprice',
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    ),
    "sort_nulls_variants": (
        'load "orders.parquet" | mutate x = if_else(o_orderkey % 5 == 0, null, o_totalprice) | mutate a = row_number() over (order_by x, o_orderkey), '
        "b = row_number() over (order_by x desc, o_orderkey), c = row_number() over (order_by x asc nulls_first, o_orderkey), "
        "d = row_number() over (order_by x desc nulls_last, o_orderkey) | select o_orderkey, a, b, c, d",
        "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS x FROM orders) SELECT o_orderkey, "
        "row_number() OVER (ORDER BY x NULLS LAST, o_orderkey) AS a, row_number() OVER (ORDER BY x DESC NULLS LAST, o_orderkey) AS b, "
        "row_number() OVER (ORDER BY x NULLS FIRST, o_orderkey) AS c, row_number() OVER (ORDER BY x DESC NULLS FIRST, o_orderkey) AS d FROM o",
    ),
    "binding_start": (
        'let done = load "orders.parquet" | filter o_orderstatus == "F" done | group_by o_orderpriority | agg n = count()',
        "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    ),
    "mixed_if_else": (
        'load "part.parquet" | mutate m = if_else(p_size > 25, p_size, p_brand) | mutate t = to_string(m), n = to_number(m) | select p_partkey, t, n',
        "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE p_brand END AS t, CASE WHEN p_size > 25 THEN p_size::DOUBLE END AS n FROM part",
    ),
    "q_pricing_summary": (
        'load "lineitem.parquet" | filter l_quantity <= 48 | mutate disc = l_extendedprice * (1 - l_discount) | group_by l_returnflag, l_linestatus '
        "| agg sum_qty = sum(l_quantity), orders = count_distinct(l_orderkey), avg_qty = mean(l_quantity), rows = count(), top = max(disc) | sort l_returnflag, l_linestatus",
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(DISTINCT l_orderkey) AS orders, avg(l_quantity) AS avg_qty, count(*) AS rows, "
        "max(l_extendedprice * (1 - l_discount)) AS top FROM lineitem WHERE l_quantity <= 48 GROUP BY 1, 2",
    ),
}

#: Whole numbers, so that sums don't depend on the order in which they are taken.
_EVENTS = 'load "events.parquet" | mutate v = round(value), off = event_id % 3'
_SQL_EVENTS = "(SELECT event_id, user_id, ts, CASE WHEN round(value) = 0 THEN 0.0::DOUBLE ELSE round(value) END AS v, event_id % 3 AS off FROM events)"
_W = "partition_by user_id order_by ts, event_id"
_SQLW = "PARTITION BY user_id ORDER BY ts, event_id"
_RANKED = {
    "row_number": ("row_number()", "row_number()"), "rank": ("rank()", "rank()"), "dense_rank": ("dense_rank()", "dense_rank()"),
    "percent_rank": ("percent_rank()", "percent_rank()"), "cume_dist": ("cume_dist()", "cume_dist()"),
}
for _name, (_f, _sql) in _RANKED.items():
    _order = "l_quantity desc, l_linenumber" if _name == "row_number" else "l_quantity desc"
    PROGRAMS[_name] = (
        f'load "lineitem.parquet" | mutate w = {_f} over (partition_by l_suppkey order_by {_order}{", l_orderkey" if _name == "row_number" else ""}) | select l_orderkey, l_linenumber, w',
        f"SELECT l_orderkey, l_linenumber, {_sql} OVER (PARTITION BY l_suppkey ORDER BY {_order.replace('desc', 'DESC')}{', l_orderkey' if _name == 'row_number' else ''}) AS w FROM lineitem",
    )
_VALUES = {
    "lag_default": ("lag(v, 1, 0)", f"lag(v, 1, 0.0::DOUBLE) OVER ({_SQLW})"),
    "lead": ("lead(v, 2)", f"lead(v, 2) OVER ({_SQLW})"),
    "lag_dynamic": (
        "lag(v, off, -1)",
        f"CASE off WHEN 0 THEN v WHEN 1 THEN lag(v, 1, -1.0::DOUBLE) OVER ({_SQLW}) ELSE lag(v, 2, -1.0::DOUBLE) OVER ({_SQLW}) END",
    ),
}
for _name, (_f, _sql) in _VALUES.items():
    PROGRAMS[_name] = (
        f"{_EVENTS} | mutate w = {_f} over ({_W}) | select event_id, w",
        f"SELECT event_id, {_sql} AS w FROM {_SQL_EVENTS}",
    )
PROGRAMS["first_last_value"] = (
    f"{_EVENTS} | mutate a = first_value(v) over ({_W}), z = last_value(v) over ({_W}), r = last_value(v) over ({_W} frame running) | select event_id, a, z, r",
    f"SELECT event_id, first_value(v) OVER ({_SQLW}) AS a, last_value(v) OVER ({_SQLW} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z, v AS r FROM {_SQL_EVENTS}",
)
_FRAMES = {
    "win_whole": ("", "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"), "win_running": ("frame running", "UNBOUNDED PRECEDING AND CURRENT ROW"),
    "win_remaining": ("frame remaining", "CURRENT ROW AND UNBOUNDED FOLLOWING"), "win_trailing": ("frame trailing 2", "2 PRECEDING AND CURRENT ROW"),
    "win_leading": ("frame leading 2", "CURRENT ROW AND 2 FOLLOWING"), "win_centered": ("frame centered 1", "1 PRECEDING AND 1 FOLLOWING"),
}
for _name, (_f, _sql) in _FRAMES.items():
    _over, _rows = f"({_W} {_f})", f"({_SQLW} ROWS BETWEEN {_sql})"
    PROGRAMS[_name] = (
        f"{_EVENTS} | mutate s = sum(v) over {_over}, n = count() over {_over}, m = mean(v) over {_over}, lo = min(v) over {_over}, hi = max(v) over {_over} "
        "| select event_id, s, n, m, lo, hi",
        f"SELECT event_id, sum(v) OVER {_rows} AS s, count(*) OVER {_rows} AS n, avg(v) OVER {_rows} AS m, min(v) OVER {_rows} AS lo, max(v) OVER {_rows} AS hi FROM {_SQL_EVENTS}",
    )

_OUTPUTS = (
    'param status = "O" state floor = 1000 let o = load "orders.parquet" | filter o_orderstatus == $status and o_totalprice > @floor '
    "output by_priority = o | group_by o_orderpriority | agg n = count() output totals = o | agg n = count(), top = max(o_totalprice)"
)


def _program(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spark, PROGRAMS[name][0], sf_dir)

    query.__name__ = name
    return query


def _with(name: str, output: str, context: dict) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spark, _OUTPUTS, sf_dir, output, context=context)

    query.__name__ = name
    return query


_SAVED = (
    'param quote = "" param line = "" load "orders.parquet" '
    '| mutate flag = o_totalprice > 100000, note = if_else(o_orderkey % 3 == 0, null, concat("a ", $quote, o_orderstatus, $quote, ",", $line, o_orderpriority))'
)
_SAVED_SQL = (
    "SELECT o_orderkey::DOUBLE AS o_orderkey, o_custkey::DOUBLE AS o_custkey, o_orderstatus, o_totalprice::DOUBLE AS o_totalprice, "
    "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS o_orderdate, o_orderpriority, o_totalprice > 100000 AS flag, "
    "CASE WHEN o_orderkey % 3 <> 0 THEN 'a \"' || o_orderstatus || '\",' || chr(10) || o_orderpriority END AS note FROM orders"
)
_ENDINGS = {"csv": "csv", "jsonl": "jsonl", "parquet": "parquet", "arrow_file": "arrow", "arrow_stream": "arrows"}


def _scratch(spark: SparkSession) -> str:
    """A new folder that the driver can write files in: in the shared folder, or a temporary one where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or ""
    base = shared.removeprefix("file://").rstrip("/") if shared.startswith(("/", "file:///")) else tempfile.mkdtemp(prefix="pipeweave-")
    folder = f"{base}/saved-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def _saved(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Orders, with quotes and line ends in cells, saved to a file of a format by its writer and loaded by its reader."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{_scratch(spark)}/orders.{_ENDINGS[kind]}"
        clause = f' format "{kind.replace("_", "-")}"'
        run(spark, f'{_SAVED} | save "{path}"{clause}', folder=sf_dir, context={"quote": '"', "line": "\n"})
        return frame(spark, f'load "{path}"{clause}', sf_dir)

    query.__name__ = f"save_load_{kind}"
    return query


_DATES = {
    "filter_date_pushed": ('o_orderdate >= "1995-01-01" and o_orderdate < "1996-03-01"', "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'"),
    "filter_second_pushed": ('"1995-06-17T00:00:00Z" <= o_orderdate', "o_orderdate >= TIMESTAMP '1995-06-17'"),
}
for _name, (_f, _sql) in _DATES.items():
    PROGRAMS[_name] = (f'load "orders.parquet" | filter {_f} | select o_orderkey, o_totalprice', f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_sql}")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _program(name) for name in PROGRAMS} | {f"save_load_{k}": _saved(k) for k in _ENDINGS} | {
    "named_outputs": _with("named_outputs", "by_priority", {}),
    "param_override": _with("param_override", "totals", {"status": "F"}),
    "state_filter": _with("state_filter", "totals", {"floor": 150000}),
}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in PROGRAMS.items()} | {f"save_load_{k}": _SAVED_SQL for k in _ENDINGS} | {
    "named_outputs": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 GROUP BY 1",
    "param_override": "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000",
    "state_filter": "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 150000",
}
