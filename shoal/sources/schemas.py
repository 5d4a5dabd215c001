"""The stored tables: their columns, keys and, where one grows with the market's history, the column that deals it into partitions.

Fixed values of the data model. A column that was added later is null in rows written before it.
"""

from __future__ import annotations

from dataclasses import dataclass

_BARS = "code string, dt date, open double, high double, low double, close double, volume double, amount double"


@dataclass(frozen=True)
class Table:
    columns: str
    keys: tuple[str, ...]
    part: str | None = None


TABLES = {
    "stock_list": Table("code string, name string, exchange string, is_st boolean, industry string, updated string", ("code",)),
    "spot": Table("code string, price double, pct_chg double, volume double, amount double, turnover double, vol_ratio double, pe_dyn double, pb double, total_mv double, circ_mv double, chg_60d double, updated string", ("code",)),
    "fin_q": Table("code string, period string, eps double, roe double, gross_margin double, profit_yoy double, debt_ratio double, updated string, as_of string", ("code", "period")),
    "daily": Table(_BARS + ", month string", ("code", "dt"), "month"),
    "daily_qfq": Table(_BARS + ", month string", ("code", "dt"), "month"),
    "index_daily": Table(_BARS + ", month string", ("code", "dt"), "month"),
    "meta": Table("key string, value string", ("key",)),
    "recommendations": Table("run_date date, rank int, code string, name string, industry string, score double, price double, reasons string, metrics string, ret_5 double, ret_10 double, ret_20 double, ret_60 double, factor_set_id string", ("run_date", "code"), "run_date"),
    "active_sets": Table("run_at string, factors_json string, oos double, source string", ("run_at",)),
    "index_cons": Table("index_code string, code string, name string, industry string, snapshot_date date", ("index_code", "code", "snapshot_date")),
    "factor_library": Table("code string, category string, expr string, params_json string, desc string, source string, created_at string", ("code",)),
    "factor_eval": Table("code string, run_at string, is_icir double, oos_icir double, oos_is_ratio double, stability double, turnover double, net_ir double", ("code", "run_at")),
    "evolution_log": Table("run_at string, selected_json string, old_oos double, new_oos double, promoted boolean, notes string", ("run_at",)),
}


def table(name: str) -> Table:
    if name not in TABLES:
        raise KeyError(f"no table {name!r}")
    return TABLES[name]
