"""Queries once more over tables with unknown keys: a null key matches nothing and counts
as no customer, although it is the most frequent one."""

from __future__ import annotations

import re

from cohorta.plans.base import QUERIES, SQL, UNKNOWN, SomeKeysUnknown, query

NAMES = [
    "assign_variant", "assign_variant_left", "assign_variant_closed", "assign_variant_closed_left", "session_funnel", "session_funnel_anchored",
    "position_funnel", "conversion_within", "nearest_follow_up", "time_gap_buckets", "time_gap_pairs", "subsequent_orders", "cross_sell_rate",
    "scd2_point_in_time_join", "exposures_by_day", "exposure_split_check", "self_followup_join", "cross_vertical_self_join", "daily_counts",
    "new_vs_recurrent_split", "orders_with_variant", "or_condition_join",
]


def with_unknown_keys(sql: str) -> str:
    """The SQL over the same tables with every seventh key value nulled."""
    parts = []
    for table, keys in UNKNOWN.items():
        changed = ", ".join(f"case when {k} % 7 <> 0 then {k} end as {k}" for k in keys)
        parts.append(f"some_{table} as (select * replace ({changed}) from {table})")
        sql = re.sub(rf"\b{table}\b(?!\s+as\s*\()", f"some_{table}", sql)
    return f"with {', '.join(parts)} select * from ({sql.strip().rstrip(';')})"


def _register(name: str) -> None:
    @query(f"{name}_unknown_keys", with_unknown_keys(SQL[name]))
    def _(spark, folder):
        return QUERIES[name](spark, SomeKeysUnknown(folder))


for _name in NAMES:
    _register(_name)
