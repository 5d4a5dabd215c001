"""The catalogue of factor recipes, made from a rule: shapes of an expression, over fields, over windows."""

from __future__ import annotations

from shoal.plans.dsl import Spec, expand

GRID = {"w": [5, 10, 20, 30, 60], "k": [1, 5, 10, 20]}

#: name -> (category, expression over a field {x}, its parameters, the fields it makes sense for)
_PRICES, _SIZES = ("open", "high", "low", "close"), ("volume", "amount")
SHAPES = {
    "level": ("trend", "sub(div({x}, sma({x}, {{w}})), 1)", ["w"], _PRICES + _SIZES),
    "smooth": ("trend", "sub(div(ema({x}, {{w}}), {x}), 1)", ["w"], ("close", "volume")),
    "score": ("reversion", "sub(0, zscore({x}, {{w}}))", ["w"], _PRICES + _SIZES),
    "place": ("reversion", "sub(0, ts_rank({x}, {{w}}))", ["w"], ("close", "volume", "amount")),
    "change": ("momentum", "returns({x}, {{k}})", ["k"], _PRICES + _SIZES),
    "back": ("reversion", "sub(0, returns({x}, {{k}}))", ["k"], ("close",)),
    "ranked": ("momentum", "cs_rank(returns({x}, {{k}}))", ["k"], ("close", "volume", "amount")),
    "spread": ("risk", "sub(0, div(std({x}, {{w}}), sma({x}, {{w}})))", ["w"], ("close",) + _SIZES),
    "choppy": ("risk", "sub(0, std(returns({x}, {{k}}), {{w}}))", ["k", "w"], ("close",)),
    "under": ("range", "sub(div({x}, ts_max({x}, {{w}})), 1)", ["w"], ("close", "volume")),
    "over": ("range", "sub(div({x}, ts_min({x}, {{w}})), 1)", ["w"], ("close", "volume")),
    "with": ("volume", "sub(0, corr({x}, volume, {{w}}))", ["w"], _PRICES),
    "sized": ("size", "sub(0, log(add(sma({x}, {{w}}), 1)))", ["w"], _SIZES),
    "paid": ("volume", "div(abs(returns(close, {{k}})), sma({x}, {{w}}))", ["k", "w"], ("amount",)),
    "gap": ("shape", "sub(div({x}, ref(close, {{k}})), 1)", ["k"], ("open", "high", "low")),
}


def recipes() -> list[dict]:
    return [{"id": f"{name}_{x}", "category": kind, "expr": expr.format(x=x), "params": params} for name, (kind, expr, params, fields) in SHAPES.items() for x in fields]


def merged(*lists: list[dict]) -> list[dict]:
    """Recipes of all lists, the first of each id."""
    out: dict[str, dict] = {}
    for r in (r for rs in lists for r in rs):
        out.setdefault(r["id"], r)
    return list(out.values())


def catalogue(*more: list[dict], grid: dict[str, list[int]] = GRID) -> list[Spec]:
    return expand(merged(recipes(), *more), grid)
