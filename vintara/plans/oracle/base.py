"""The derived loan panel restated as SQL, for an independent check.

``with_sql`` prepends only the common table expressions a statement needs.
"""

from __future__ import annotations

import re

from vintara.sources.driver_tables import DRIVER_SETTINGS as S

H = S.horizon

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def with_sql(statement: str) -> str:
    """Prepend the needed CTEs, in definition order."""
    needed: set[str] = set()
    todo = [statement]
    while todo:
        words = set(re.findall(r"[a-z_][a-z0-9_]*", todo.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            todo.append(CTES[name])
    parts = [f"{name} AS (\n{CTES[name]}\n)" for name in CTES if name in needed]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + statement.strip()


def in_list(values) -> str:
    return "(" + ", ".join(repr(v) for v in values) + ")"


TRAIN, TEST = in_list(S.train_cohorts), in_list(S.test_cohorts)

cte("t_lines", """
SELECT lineitem.*, orders.*, year(o_orderdate)::INTEGER AS yr,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey,
           l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq,
       count(*) OVER (PARTITION BY l_orderkey) AS n_lines
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")

cte("t_steps", """
SELECT *,
       sum(CASE WHEN l_quantity >= 49 AND seq > 1 THEN 1 ELSE 0 END)
           OVER (PARTITION BY l_orderkey ORDER BY seq) AS jumps,
       CASE WHEN seq = n_lines AND o_orderstatus = 'F' AND l_returnflag = 'A' THEN '03'
            WHEN seq = n_lines AND o_orderstatus = 'O' AND l_linestatus = 'O' THEN '01'
            WHEN seq = n_lines AND o_orderstatus = 'P' AND l_returnflag = 'N' AND l_linestatus = 'F' THEN '16'
       END AS zb
FROM t_lines
""")

cte("t_aged", """
SELECT *,
       CASE WHEN l_quantity <= 2 AND seq > 1 THEN 0
            ELSE seq - 1 + (CASE WHEN l_orderkey % 6 = 0 THEN 2 ELSE 0 END) + jumps END::INTEGER AS age
FROM t_steps
""")

cte("t_perf", """
SELECT l_orderkey AS id, yr, seq::INTEGER AS period, age,
       (date_trunc('month', o_orderdate) + to_months((seq - 1)::INTEGER))::DATE AS month,
       (CASE WHEN l_orderkey % 97 = 0 THEN 60 ELSE 360 END) - age AS remaining,
       CASE WHEN zb IS NOT NULL THEN 0e0 ELSE o_totalprice * (1e0 - 0.02e0 * (seq - 1)) END AS bal,
       4e0 + 0.25e0 * (l_orderkey % 17) AS rate,
       CASE WHEN l_tax >= 0.08e0 THEN NULL
            WHEN l_returnflag = 'R' AND l_discount >= 0.095e0 THEN 'RA'
            WHEN l_returnflag = 'R' THEN '0' || (round(l_discount * 100)::INTEGER % 5)::VARCHAR
            ELSE '00' END AS status,
       zb,
       CASE WHEN zb IS NOT NULL THEN o_totalprice * (1e0 - 0.02e0 * (seq - 1)) END AS removed,
       CASE WHEN zb = '03' THEN o_totalprice * (0.1e0 + 5e0 * l_discount) END AS loss,
       CASE WHEN l_linestatus = 'O' THEN 'Y' END AS mod_flag
FROM t_aged
""")

cte("t_book", """
SELECT o_orderkey AS id, year(o_orderdate)::INTEGER AS yr,
       CASE WHEN o_custkey % 11 <> 0 THEN (600 + o_custkey * 7 % 221)::INTEGER END AS fico,
       (40 + o_orderkey * 13 % 61)::INTEGER AS cltv,
       CASE WHEN o_orderkey % 7 <> 0 THEN (10 + o_orderkey * 5 % 51)::INTEGER END AS dti,
       o_totalprice AS upb, 4e0 + 0.25e0 * (o_orderkey % 17) AS rate, 360 AS term,
       CASE WHEN o_orderkey % 9 <> 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'Y' ELSE 'N' END END AS first_home,
       o_orderstatus AS purpose, o_orderpriority[1:1] AS occupancy,
       CASE WHEN o_custkey % 500 = 0 THEN 'T' WHEN o_custkey % 3 = 0 THEN 'R' ELSE 'B' END AS channel,
       CASE WHEN o_orderkey % 10 < 6 THEN '2' ELSE '1' END AS borrowers,
       CASE WHEN o_custkey % 17 = 0 THEN '2' ELSE '1' END AS units,
       'S' || (o_custkey % 12)::VARCHAR AS state
FROM orders
""")

# A loan is one ordered list of months. Where its clock breaks is a list position, the usable months are the list
# cut there, and every exit is the smallest age of a filtered list. Nothing below runs a window over months.

cte("t_story", """
SELECT id, any_value(yr) AS yr, list({'period': period, 'age': age, 'month': month, 'remaining': remaining, 'bal': bal,
       'rate': rate, 'status': status, 'zb': zb, 'loss': loss, 'mod_flag': mod_flag} ORDER BY period) AS told
FROM t_perf GROUP BY id
""")

cte("t_breaks", """
SELECT *, list_filter(range(2, len(told) + 1), lambda i: told[i].age <= told[i - 1].age) AS resets,
       list_filter(range(2, len(told) + 1), lambda i: told[i].age > told[i - 1].age + 1) AS gaps
FROM t_story
""")


def _ages(months: str, condition: str) -> str:
    """Smallest age of the months of a list that meet a condition on m."""
    return f"list_min(list_transform(list_filter({months}, lambda m: {condition}), lambda m: m.age))"


# Conditions on one month m; the status codes are fixed values of the file layout.
MISSED = "try_cast(m.status AS INTEGER)"
LATE = f"(coalesce(m.status = 'RA', false) OR coalesce({MISSED} >= {S.delinquency_threshold}, false))"
CREDIT = "coalesce(list_contains(['02', '03', '09'], m.zb), false)"
PREPAID = "coalesce(m.zb = '01', false)"
OTHER_END = "coalesce(list_contains(['15', '16', '96'], m.zb), false)"
TOO_LATE = f"coalesce({MISSED} > m.age + 1, false)"

cte("t_usable", f"""
SELECT *, list_filter(told[1:least(resets[1], gaps[1], len(told) + 1) - 1], lambda m: m.age >= 0 AND m.age <= {H}) AS kept
FROM t_breaks
""")

cte("t_ends", f"""
SELECT *, kept[1].age AS first_age, kept[-1].age AS last_age,
       {_ages('kept', LATE)} AS late_age, {_ages('kept', CREDIT)} AS event_age, {_ages('kept', PREPAID)} AS prepaid_age,
       {_ages('kept', OTHER_END)} AS informative_age, {_ages('told', LATE)} AS late_age_all, {_ages('told', CREDIT)} AS event_age_all,
       list_min(list_transform(list_filter(told, lambda m: {LATE}), lambda m: m.month)) AS late_month,
       list_min(list_transform(list_filter(told, lambda m: {CREDIT}), lambda m: m.month)) AS event_month,
       CASE WHEN len(resets) > 0 THEN told[resets[1] - 1].age END AS before_reset,
       CASE WHEN len(gaps) > 0 THEN told[gaps[1] - 1].age END AS before_gap,
       len(list_filter(kept, lambda m: {TOO_LATE})) > 0 AS any_too_late, kept[1].age + kept[1].remaining AS entry_term
FROM t_usable
""")


def first_end(*ages: str) -> str:
    """Age of the exit: the smallest of these ages, the horizon and the last usable age."""
    return f"list_min([{', '.join(ages)}, {H}, last_age])"


def end_reason(default_age: str, exit_age: str) -> str:
    """Why a loan leaves: the first cause in order of rank whose age is the exit age."""
    causes = [(f"{default_age} = {exit_age}", "default"), (f"prepaid_age = {exit_age}", "prepaid"),
              (f"informative_age = {exit_age}", "informative_exit"), (f"{exit_age} >= {H}", "administrative_censor"),
              (f"before_reset = {exit_age}", "clock_reset_censor"), (f"before_gap = {exit_age}", "month_gap_censor")]
    listed = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in causes)
    return f"coalesce({listed}, 'data_censor')"


cte("t_left", f"""
SELECT *, list_min([late_age, event_age]) AS default_age, {first_end('late_age', 'event_age', 'prepaid_age', 'informative_age')} AS exit_age
FROM t_ends WHERE len(kept) > 0
""")

cte("t_exits", f"""
SELECT l.id, l.yr, kept, told, first_age, last_age, late_age, event_age, prepaid_age, informative_age, default_age, exit_age,
       late_age_all, event_age_all, late_month, event_month, before_reset, before_gap, entry_term, any_too_late,
       len(kept) AS n_in, len(told) AS n_all, len(resets) > 0 AS ever_reset, len(gaps) > 0 AS ever_gap,
       {end_reason('default_age', 'exit_age')} AS reason, b.term,
       coalesce(entry_term != b.term, false) AS term_differs, any_too_late OR coalesce(entry_term != b.term, false) AS off_clock
FROM t_left l LEFT JOIN t_book b ON b.id = l.id
""")

_AT_RISK = f"""
SELECT e.id, e.yr, m.age, m.period, m.month, m.bal, m.status, m.zb, m.loss, {MISSED} AS missed, m.mod_flag,
       e.exit_age, e.reason, e.first_age, e.ever_reset, b.* EXCLUDE (id, yr),
       m.age = e.exit_age AS leaves, m.age = e.exit_age AND e.reason = 'default' AS y_def,
       m.age = e.exit_age AND e.reason = 'prepaid' AS y_pre
FROM (SELECT *, unnest(list_filter(kept, lambda x: x.age <= exit_age)) AS m FROM t_exits) e JOIN t_book b ON b.id = e.id
"""
cte("t_panel", _AT_RISK + " WHERE NOT e.off_clock")
cte("t_panel_all", _AT_RISK)

# Every month with what its position in the list says.
cte("t_months", f"""
SELECT id, m.period, m.age, CASE WHEN i > 1 THEN told[i - 1].age END AS age_before, list_contains(resets, i) AS is_reset, list_contains(gaps, i) AS is_gap,
       coalesce(i >= resets[1], false) AS broken, coalesce(i >= gaps[1], false) AS gapped, {MISSED} AS missed, {LATE} AS is_late,
       {CREDIT} AS is_event, {PREPAID} AS is_prepaid, {OTHER_END} AS is_informative, m.age + m.remaining AS implied_term, {TOO_LATE} AS too_late
FROM (SELECT *, told[i] AS m FROM (SELECT *, unnest(range(1, len(told) + 1)) AS i FROM t_breaks))
""")
