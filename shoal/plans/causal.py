"""Whether a column reads later dates, told from the plan that Spark makes of it."""

from __future__ import annotations

import inspect
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from shoal.sources.bars import FIELDS


class LooksAhead(ValueError):
    """A column takes values of later dates."""


def nodes(tree: object) -> Iterator[dict]:
    """All nodes of a plan's JSON form. An expression is a list in which each node is followed by its children."""
    if isinstance(tree, list):
        for x in tree:
            yield from nodes(x)
    elif isinstance(tree, dict):
        yield tree
        for x in tree.values():
            yield from nodes(x)


def expressions(tree: object) -> Iterator[list[dict]]:
    """The lists of nodes in a plan's JSON form."""
    if isinstance(tree, list) and tree and all(isinstance(x, dict) for x in tree):
        yield tree
    for x in tree if isinstance(tree, list) else tree.values() if isinstance(tree, dict) else ():
        yield from expressions(x)


def _name(node: dict) -> str:
    return node.get("class", "").rsplit(".", 1)[-1]


def _number(expression: list[dict]) -> float | None:
    """The value of a frame's bound, if it is a plain number."""
    sign = 1
    for n in expression:
        if _name(n) == "UnaryMinus":
            sign = -sign
        elif _name(n) == "Literal":
            return sign * float(n["value"])
        elif _name(n) != "Cast":
            return None
    return None


def _subtree(flat: list[dict], at: int) -> int:
    """Where the node at ``at`` of a flattened expression ends."""
    end = at + 1
    for _ in range(flat[at].get("num-children", 0)):
        end = _subtree(flat, end)
    return end


def faults(plan: list, time: str = "dt") -> Iterator[str]:
    """What in an analysed plan's windows reads later rows. Windows over one date may read all of it."""
    for flat in expressions(plan):
        for at, node in enumerate(flat):
            if _name(node) != "WindowSpecDefinition":
                continue
            mine, children, k = flat[at : _subtree(flat, at)], [], 1
            for _ in range(node["num-children"]):
                end = _subtree(mine, k)
                children.append(mine[k:end])
                k = end
            orders = [c for c in children if _name(c[0]) == "SortOrder"]
            frame = next((c for c in children if _name(c[0]) == "SpecifiedWindowFrame"), None)
            if time in [c[0].get("name") for c in children]:
                continue
            if len(orders) != 1 or orders[0][1].get("name") != time or "Descending" in json.dumps(orders[0][0]):
                yield "a window over a code that isn't in the order of its dates"
            upper = frame[_subtree(frame, 1) :] if frame else []
            if not upper or _name(upper[0]) == "UnboundedFollowing$":
                yield "a frame that runs to the last date"
            elif _name(upper[0]) != "CurrentRow$":
                n = _number(upper)
                if n is None or n > 0:
                    yield "a frame that ends after the current date"


def check(spark: SparkSession, build, kind: str) -> None:
    """Raise LooksAhead if ``build``, given sample columns, makes a window over later dates, or one that its kind doesn't have."""
    takes = inspect.signature(build).parameters
    sample = [3 if name.startswith("n") else F.col(field) for name, field in zip(takes, [*FIELDS[3:], *FIELDS], strict=False)]
    frame = spark.range(0).select(F.lit("").alias("code"), F.current_date().alias("dt"), *(F.lit(0.0).alias(f) for f in FIELDS))
    plan = json.loads(frame.select(build(*sample).alias("x"))._jdf.queryExecution().analyzed().toJSON())
    if found := next(faults(plan), None):
        raise LooksAhead(found)
    if kind == "row" and any(_name(n) == "WindowSpecDefinition" for n in nodes(plan)):
        raise ValueError("a row operator has no windows")
