"""Factor expressions compiled to Spark columns.

Text becomes a tree; equal subtrees are one node, over all factors of a compilation. A node that needs a
window can't nest in another, so nodes are dealt to stages by window depth; each stage adds
its columns with one projection, windows by code before windows by date. No factor looks ahead: the built-in operators have only frames
that end at the current date, and operators that are added are refused if what they build reads later dates.

Many factors of a large panel (``compile_many``) leave what has no window over dates to numpy, on some codes' dates at a time: Spark goes over each row's
whole frame for each window, which costs some hundred times as much.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shoal.functions import panel as P
from shoal.functions.rolling import Series, ratio
from shoal.plans import causal
from shoal.sources.bars import FIELDS, dealt

#: How a word goes on after its first character.
_GOES_ON = {"digits": "0123456789.", "name": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"}


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Filled:
    """The last known value of an expression; made by operators that fill gaps, never written."""

    of: Node


@dataclass(frozen=True)
class Call:
    operator: str
    arguments: tuple[Node, ...]

    @property
    def form(self) -> Operator:
        return OPERATORS[self.operator]


Node = Number | Field | Filled | Call


def words(text: str) -> Iterator[str]:
    """Numbers, names and single signs, in order; an empty one at the end."""
    at = 0
    while at < len(text):
        c = text[at]
        if c in "(),":
            end = at + 1
        elif c.isspace():
            at += 1
            continue
        elif c in _GOES_ON["name"]:
            kind = "digits" if c.isdigit() else "name"
            end = at + 1
            while end < len(text) and text[end] in _GOES_ON[kind]:
                end += 1
        else:
            raise ValueError(f"{c!r} at {at} of {text!r} means nothing")
        yield text[at:end]
        at = end
    yield ""


class Reader:
    """One expression's words, one ahead."""

    def __init__(self, text: str) -> None:
        self.text, self.words = text, words(text)
        self.next = next(self.words)

    def take(self) -> str:
        word = self.next
        self.next = next(self.words, "")
        return word

    def fail(self, why: str) -> ValueError:
        return ValueError(f"{why} in {self.text!r}")

    def node(self) -> Node:
        word = self.take()
        if word[:1].isdigit():
            try:
                return Number(float(word))
            except ValueError:
                raise self.fail(f"bad number {word!r}") from None
        if not word or word in "(),":
            raise self.fail(f"unexpected {word or 'end'!r}")
        if self.next == "(":
            return self.call(word)
        if word not in FIELDS:
            raise self.fail(f"unknown field {word!r}")
        return Field(word)

    def call(self, name: str) -> Call:
        if name not in OPERATORS:
            raise self.fail(f"unknown operator {name!r}")
        self.take()
        arguments = []
        while self.next != ")":
            arguments.append(self.node())
            if self.next == ",":
                self.take()
            elif self.next != ")":
                raise self.fail("a bracket isn't closed")
        self.take()
        return Call(name, tuple(arguments))


def parse(text: str) -> Node:
    reader = Reader(text)
    found = reader.node()
    if reader.next:
        raise reader.fail(f"extra {reader.next!r}")
    return found


@dataclass(frozen=True)
class Operator:
    """kind: row (no window), code, date, or ewm; build(columns, numbers) -> Column; pads: fills its first argument forward in a stage before;
    array(series, numbers) -> matrix, the same over matrices of ``rolling``, where there is one."""

    kind: str
    build: object = None
    pads: bool = False
    array: object = None


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _roll(agg):
    return lambda x, n: P.rolling(agg, x, int(n), P.half(int(n)))


_MEAN = Operator("code", _roll(F.avg), array=Series.mean)
_LEAST, _MOST = Operator("code", _roll(F.min), array=Series.min), Operator("code", _roll(F.max), array=Series.max)
OPERATORS: dict[str, Operator] = {
    "sma": _MEAN,
    "ts_mean": _MEAN,
    "ema": Operator("ewm", array=Series.ema),
    "std": Operator("code", _roll(F.stddev_samp), array=Series.std),
    "ts_min": _LEAST,
    "min": _LEAST,
    "ts_max": _MOST,
    "max": _MOST,
    "zscore": Operator("code", lambda x, n: F.try_divide(x - _MEAN.build(x, n), F.nullif(_roll(F.stddev_samp)(x, n), F.lit(0.0))), array=Series.zscore),
    "ts_rank": Operator("code", lambda x, n: P.ts_rank(x, int(n), P.half(int(n))), array=Series.rank),
    "ref": Operator("code", lambda x, n: F.lag(x, int(n)).over(P.by_code()), array=Series.ref),
    "returns": Operator("code", lambda x, n: F.try_divide(x, F.lag(x, int(n)).over(P.by_code())) - 1, True, Series.returns),
    "corr": Operator("code", lambda a, b, n: P.corr(a, b, int(n), P.half(int(n))), array=Series.corr),
    "cs_rank": Operator("date", P.rank_pct),
    "cs_zscore": Operator("date", P.zscore_by_date),
    "add": Operator("row", lambda a, b: a + b, array=lambda a, b: a.x + b.x),
    "sub": Operator("row", lambda a, b: a - b, array=lambda a, b: a.x - b.x),
    "div": Operator("row", _ratio, array=lambda a, b: ratio(a.x, b.x)),
    "abs": Operator("row", F.abs, array=lambda a: np.abs(a.x)),
    "sign": Operator("row", F.signum, array=lambda a: np.sign(a.x)),
    "log": Operator("row", lambda x: F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(1e-12)))), array=lambda a: np.log(np.maximum(a.x, 1e-12))),
}


def over_dates(text: str) -> bool:
    """Whether an expression has windows over whole dates, which one task each must hold."""
    seen = lambda n: isinstance(n, Call) and (n.form.kind == "date" or any(map(seen, n.arguments)))
    return seen(parse(text))


def batches(factors: dict[str, str], most: int = 64, dated: int = 4) -> list[list[str]]:
    """Names of ``factors`` (name -> expression) in the parts to compile together: ``most`` of those with windows over codes alone, ``dated`` of
    those with windows over dates, so that a date's rows aren't sorted with the columns of many others."""
    ids: dict[bool, list[str]] = {False: [], True: []}
    for f, e in factors.items():
        ids[over_dates(e)].append(f)
    return [own[k : k + n] for own, n in ((ids[False], most), (ids[True], dated)) for k in range(0, len(own), n)]


def register_operator(name: str, build, kind: str = "row") -> None:
    """Add an operator: ``build`` takes columns, and plain numbers for parameters whose name begins with n, and returns a column.

    kind: row (no window), code (windows over a code's dates) or date (windows over one date). Refused with ``causal.LooksAhead`` if what it builds
    from sample columns reads later dates: ``lead``, a negative lag, a frame that ends after the current row or runs against time.
    """
    if kind not in ("row", "code", "date"):
        raise ValueError(f"unknown kind {kind!r}")
    causal.check(SparkSession.builder.getOrCreate(), build, kind)
    OPERATORS[name] = Operator(kind, build)


def compile_factors(panel: DataFrame, factors: dict[str, str]) -> DataFrame:
    """The dense panel with a column for each factor id. Many factors go in batches of some 64, to bound the plan."""
    return _staged(panel, _trees(panel, factors))


def _trees(panel: DataFrame, factors: dict[str, str]) -> dict[str, Node]:
    if both := set(factors) & set(panel.columns):
        raise ValueError(f"factors named as columns: {', '.join(sorted(both))}")
    return {f: parse(e) for f, e in factors.items()}


def _staged(panel: DataFrame, trees: dict[str, Node]) -> DataFrame:
    names: dict[Node, str] = {}
    stages: dict[int, dict[str, list[tuple[str, Node]]]] = {}

    def windowed_at(stage: int, kind: str, node: Node) -> None:
        if node not in names:
            names[node] = f"_w{len(names)}"
            stages.setdefault(stage, {}).setdefault(kind, []).append((names[node], node))

    def depth(node: Node) -> int:
        """Stages that must be there before the node; windowed nodes get a column in theirs."""
        if not isinstance(node, Call):
            return 0
        own = max(map(depth, node.arguments), default=0)
        if node.form.kind == "row":
            return own
        if node.form.pads:
            windowed_at(own, "code", Filled(node.arguments[0]))
            own += 1
        windowed_at(own, node.form.kind, node)
        return own + 1

    def column(node: Node) -> Column:
        match node:
            case Number(value):
                return F.lit(value)
            case Field(name):
                return F.col(name)
        return F.col(names[node]) if node in names else node.form.build(*map(column, node.arguments))

    def windowed(node: Filled | Call) -> Column:
        if isinstance(node, Filled):
            return P.filled(column(node.of))
        first, *rest = node.arguments
        first = F.col(names[Filled(first)]) if node.form.pads else column(first)
        return node.form.build(first, *(x.value if isinstance(x, Number) else column(x) for x in rest))

    for t in trees.values():
        depth(t)
    out = panel
    for k in sorted(stages):
        if ewm := stages[k].get("ewm"):
            spans = {n: int(node.arguments[1].value) for n, node in ewm}
            out = out.withColumns({f"{n}x": column(node.arguments[0]) for n, node in ewm})
            out = P.ewm(out, {n: (f"{n}x", 2 / (span + 1), P.half(span)) for n, span in spans.items()})
        for kind in ("code", "date"):
            if own := stages[k].get(kind):
                out = out.withColumns({n: windowed(node) for n, node in own})
    out = out.withColumns({f: column(t) for f, t in trees.items()})
    return out.select(*panel.columns, *trees)


#: Cells of a matrix of some codes' dates, about: some 20 of them stay in a core's cache.
MATRIX = 1 << 14


def _fields(node: Node) -> set[str]:
    match node:
        case Field(name):
            return {name}
        case Call(_, arguments):
            return set().union(*map(_fields, arguments))
    return set()


def _by_arrays(node: Node) -> bool:
    """Whether numpy can work out a node: all its operators have arrays, and only parameters of windows are numbers."""
    return not isinstance(node, Call) or node.form.array is not None and all(map(_by_arrays, node.arguments))


def matrices(fields: dict[str, np.ndarray], nodes: dict[str, Node]) -> dict[str, np.ndarray]:
    """The values of ``nodes`` from matrices dates x codes of the fields; equal subtrees are worked out once."""
    shape = next(iter(fields.values())).shape
    made: dict[Node, Series] = {}

    def series(node: Node) -> Series:
        if node not in made:
            match node:
                case Number(value):
                    x = np.full(shape, value)
                case Field(name):
                    x = fields[name]
                case Filled(of):
                    x = series(of).filled()
                case Call(_, (first, *rest)) if node.form.kind != "row":
                    rest = (int(k.value) if isinstance(k, Number) else series(k) for k in rest)
                    x = node.form.array(series(Filled(first) if node.form.pads else first), *rest)
                case Call(_, arguments):
                    x = node.form.array(*map(series, arguments))
            made[node] = Series(x)
        return made[node]

    return {f: series(n).x for f, n in nodes.items()}


def compile_many(panel: DataFrame, factors: dict[str, str], rows: int, keep: tuple[str, ...] = ("dt", "code")) -> DataFrame:
    """``keep`` and the factors of ``compile_factors``, for many factors of a panel of ``rows`` rows.

    Codes are dealt over tasks by rows and factors; a task gives the matrices of some codes at a time. Windows over dates are Spark's, on what numpy gives
    them, and so is all of an operator that was added. A code's dates must fit a task. NaN counts as missing.
    """
    made: dict[Node, str] = {}

    def rest(node: Node) -> Node:
        """What Spark has to do: arrays' results are fields to it."""
        if not isinstance(node, Call):
            return node
        if _by_arrays(node):
            return Field(made.setdefault(node, f"_a{len(made)}"))
        return Call(node.operator, tuple(map(rest, node.arguments)))

    trees = {f: rest(t) for f, t in _trees(panel, factors).items()}
    nodes = {name: node for node, name in made.items()}
    read = sorted(set().union(*map(_fields, nodes.values())))
    passed = [c for c in panel.columns if c in {"code", "dt", *keep} | set().union(*map(_fields, trees.values()))]
    out, most = panel, MATRIX
    if nodes:
        kinds = {x.name: x for x in panel.schema}
        schema = StructType([*(kinds[c] for c in passed), *(StructField(name, DoubleType()) for name in nodes)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if not held:
                return
            table = pa.Table.from_batches(held)
            code = table.column("code").combine_chunks().dictionary_encode("encode").indices
            order = pc.sort_indices(pa.table({"code": code, "dt": table.column("dt")}), [("code", "ascending"), ("dt", "ascending")], null_placement="at_start")
            table, code = table.take(order), code.take(order).to_numpy()
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            dates = np.diff(np.r_[first, len(code)])
            values = {c: table.column(c).cast(pa.float64(), safe=False).to_numpy() for c in read}
            width = max(1, most // dates.max())
            for k in range(0, len(first), width):
                here = slice(first[k], first[k] + dates[k : k + width].sum())
                across = np.repeat(np.arange(len(dates[k : k + width])), dates[k : k + width])
                at = (np.arange(here.start, here.stop) - first[k + across], across)
                empty = np.full((dates[k : k + width].max(), across[-1] + 1), np.nan)
                fields = {"": empty}
                for c, x in values.items():
                    fields[c] = empty.copy()
                    fields[c][at] = x[here]
                with np.errstate(all="ignore"):
                    found = {f: x[at] for f, x in matrices(fields, nodes).items()}
                part = table.select(passed).slice(here.start, here.stop - here.start)
                yield from pa.table([*part.columns, *(pa.array(x, mask=np.isnan(x)) for x in found.values())], names=[*passed, *found]).combine_chunks().to_batches()

        out = dealt(panel.select(*dict.fromkeys([*passed, *read])), len(nodes), rows).mapInArrow(run, schema)
    return _staged(out, trees).select(*keep, *factors)


@dataclass(frozen=True)
class Spec:
    """A factor to try: its name, the family it belongs to, and its expression."""

    id: str
    family: str
    expr: str


def expand(recipes: list[dict], grid: dict[str, list[int]]) -> list[Spec]:
    """A spec for each recipe and each choice of the parameters that its expression names in braces."""
    out = []
    for r in recipes:
        missing = [k for k in ("id", "category", "expr") if not r.get(k)]
        if missing:
            raise ValueError(f"recipe without {', '.join(missing)}")
        own = r.get("params", [])
        for values in product(*(grid[p] for p in own)):
            chosen = dict(zip(own, values, strict=True))
            tail = "_".join(f"{k}{v}" for k, v in chosen.items())
            out.append(Spec(f"{r['id']}__{tail}" if tail else r["id"], r["category"], r["expr"].format(**chosen)))
    return out
