"""Global statistics.

Order statistics are exact, and found in few passes whatever the values are. The first
pass takes counts, moments and a mergeable quantile sketch of each column; the sketch
brackets each wanted rank by two values of the data. A bracket holds a few ten-thousandths
of the rows: if that is little enough, the second pass counts its distinct values, and the
ranks follow. Otherwise a pass counts the rows below and inside each bracket and sketches
its inside, which narrows it a hundredfold. Counts are exact, so a sketch that errs costs
another pass, never a wrong value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values that one pass may count, over all open brackets.
COUNTED = 1 << 16
#: A bracket of so few rows isn't narrowed further.
TINY = 8
#: The sketch's rank error is 1 / ACCURACY of its rows; brackets leave twice that on either side.
ACCURACY = 10_000
_GRID = [k / 64 for k in range(65)]


@dataclass
class Described:
    """Statistics of columns; None for a column without values."""
    quantiles: dict[str, list[float | None]]
    means: dict[str, float | None]
    stds: dict[str, float | None]
    passes: int


@dataclass
class _Bracket:
    """Ranks of a column (0-based, among its finite values) that lie in [lo, hi]."""
    col: str
    lo: float
    hi: float
    rows: float
    ranks: set[int] = field(default_factory=set)


def _cut(grid: list[tuple[float, float]], share: float, n: float) -> tuple[float, float, float]:
    """The two sketched values around a share of the rows, and the rows between them, at most."""
    room = 2 / ACCURACY
    below = [g for g in grid if g[0] <= share - room]
    above = [g for g in grid if g[0] >= share + room]
    lo, hi = (below or grid[:1])[-1], (above or grid[-1:])[0]
    return lo[1], hi[1], (hi[0] - lo[0] + room) * n + 2


def _points(shares) -> list[float]:
    """Shares to sketch: a coarse grid, and close ones on either side of each wanted share."""
    close = [s + d for s in shares for d in (-2.5 / ACCURACY, 2.5 / ACCURACY)]
    return sorted({min(1.0, max(0.0, p)) for p in [*_GRID, *close]})


def _count_values(df: DataFrame, brackets: list[_Bracket], found: dict) -> list[_Bracket]:
    """Settle brackets by counting their distinct values; those the ranks aren't in come back wider."""
    cells = [F.when(F.col(b.col) < b.lo, F.struct(F.lit(k).alias("k"), F.lit(None).cast("double").alias("v")))
             .when(F.col(b.col) <= b.hi, F.struct(F.lit(k).alias("k"), F.col(b.col).alias("v"))) for k, b in enumerate(brackets)]
    counted = (df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
               .groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))
    through = F.sum("n").over(Window.partitionBy("k").orderBy(F.asc_nulls_first("v")))
    rows = counted.withColumn("through", through)
    wanted = F.lit(False)
    for k, b in enumerate(brackets):
        for r in b.ranks:
            wanted = wanted | ((F.col("k") == k) & (F.col("through") > r) & (F.col("through") - F.col("n") <= r))
    missed = {(k, r) for k, b in enumerate(brackets) for r in b.ranks}
    wider = []
    for row in rows.where(wanted).collect():  # one row a rank
        b = brackets[row["k"]]
        for r in [r for k, r in missed if k == row["k"] and row["through"] - row["n"] <= r < row["through"]]:
            missed.discard((row["k"], r))
            if row["v"] is None:
                wider.append((b, r, -math.inf, b.lo))
            else:
                found[b.col, r] = row["v"]
    wider += [(brackets[k], r, brackets[k].hi, math.inf) for k, r in missed]
    return [_Bracket(b.col, lo, hi, math.inf, {r}) for b, r, lo, hi in wider]


def _narrow(df: DataFrame, brackets: list[_Bracket]) -> list[_Bracket]:
    """Count the rows below and inside each bracket, and cut it by a sketch of its inside."""
    cells = []
    for k, b in enumerate(brackets):
        inside = F.when(F.col(b.col).between(b.lo, b.hi), F.col(b.col))
        cells.append(F.struct(F.count_if(F.col(b.col) < b.lo).alias("below"), F.count(inside).alias("n"), F.min(inside).alias("lo"),
                              F.max(inside).alias("hi"), F.percentile_approx(inside, [k / 512 for k in range(513)], ACCURACY).alias("grid"))
                     .alias(f"b{k}"))
    got, out = df.agg(*cells).first(), []
    for k, b in enumerate(brackets):
        cell = got[f"b{k}"]
        for r in b.ranks:
            at = r - cell["below"]
            if at < 0:
                out.append(_Bracket(b.col, -math.inf, b.lo, math.inf, {r}))
            elif at >= cell["n"]:
                out.append(_Bracket(b.col, b.hi, math.inf, math.inf, {r}))
            else:
                grid = [(0.0, cell["lo"]), *((p / 512, v) for p, v in enumerate(cell["grid"])), (1.0, cell["hi"])]
                out.append(_Bracket(b.col, *_cut(grid, at / cell["n"], cell["n"]), {r}))
    return out


def _merged(brackets: list[_Bracket]) -> list[_Bracket]:
    """One bracket for ranks of a column with the same ends."""
    out: dict[tuple, _Bracket] = {}
    for b in brackets:
        out.setdefault((b.col, b.lo, b.hi), _Bracket(b.col, b.lo, b.hi, b.rows)).ranks.update(b.ranks)
    return list(out.values())


def describe(df: DataFrame, cols: Sequence[str], probs: Sequence[float], counted: int = COUNTED) -> Described:
    """Exact quantiles, linear between order statistics, with mean and population deviation.

    Nulls and NaN are ignored by the quantiles; infinite values are the ends of the order.
    """
    values = df.select(*[F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")).alias(c)
                         for c in cols])
    inf = math.inf
    finite = {c: F.when((F.col(c) > -inf) & (F.col(c) < inf), F.col(c)) for c in cols}
    points = _points(probs)

    def first_pass(c: str) -> Column:
        return F.struct(
            F.count(F.col(c)).alias("n"), F.count_if(F.col(c) == -inf).alias("below"), F.count(finite[c]).alias("inside"),
            F.min(finite[c]).alias("lo"), F.max(finite[c]).alias("hi"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
            F.percentile_approx(finite[c], points, ACCURACY).alias("grid")).alias(c)

    ends, passes = values.agg(*[first_pass(c) for c in cols]).first(), 1
    places = {c: [p * (ends[c]["n"] - 1) for p in probs] if ends[c]["n"] else [] for c in cols}
    found: dict[tuple[str, int], float] = {}
    open_ones = []
    for c in cols:
        e = ends[c]
        for r in {r - e["below"] for x in places[c] for r in (math.floor(x), math.ceil(x))}:
            if r in (0, e["inside"] - 1):
                found[c, r] = e["lo"] if r == 0 else e["hi"]
            elif 0 <= r < e["inside"]:
                grid = [(0.0, e["lo"]), *zip(points, e["grid"]), (1.0, e["hi"])]
                open_ones.append(_Bracket(c, *_cut(grid, r / e["inside"], e["inside"]), {r}))
    inner = values.select(*[finite[c].alias(c) for c in cols])
    while open_ones:
        open_ones = _merged(open_ones)
        few = sum(b.rows for b in open_ones if b.lo < b.hi and b.rows > TINY) <= counted
        open_ones = _count_values(inner, open_ones, found) if few else _narrow(inner, open_ones)
        passes += 1

    def at(c: str, rank: int) -> float:
        inside = rank - ends[c]["below"]
        return -inf if inside < 0 else inf if inside >= ends[c]["inside"] else found[c, inside]

    def between(c: str, x: float) -> float:
        lo, hi = math.floor(x), math.ceil(x)
        return at(c, lo) if lo == hi or at(c, lo) == at(c, hi) else (hi - x) * at(c, lo) + (x - lo) * at(c, hi)

    return Described({c: [between(c, x) for x in places[c]] if places[c] else [None] * len(probs) for c in cols},
                     {c: ends[c]["mean"] for c in cols}, {c: ends[c]["std"] for c in cols}, passes)


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              counted: int = COUNTED) -> dict[str, list[float | None]]:
    """Exact quantiles per column; see :func:`describe`."""
    return describe(df, cols, probs, counted).quantiles
