"""Global statistics: quantiles at any size, thresholds, normalisation, anomaly ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions.bands import clip, finite

#: Values of a column up to which one exact percentile aggregate is used.
DIRECT_ROWS = 2_000_000
#: Fixed: makes the median absolute deviation a standard deviation under a normal law.
MAD_SCALE = 1.4826


#: Half the width of the bracket that percentile_approx puts around a wanted rank, and how exact it is asked to be (one part in so
#: many ranks), so that the rank is sure to be within.
BRACKET, ACCURACY = 0.001, 10_000


def quantiles(df: DataFrame, column: Column, probabilities: Sequence[float], direct_rows: int | None = None) -> list[float | None]:
    """Exact quantiles of one column, see quantiles_of."""
    return quantiles_of(df, {"v": (column, probabilities)}, direct_rows)["v"]


def quantiles_of(df: DataFrame, wanted: Mapping[str, tuple[Column, Sequence[float]]], direct_rows: int | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of many columns together; unknown values (null, NaN, infinite) are left out, None for an
    empty sample.

    percentile() keeps each distinct value in one task. The first scan counts, and brackets each wanted rank by
    percentile_approx. Up to DIRECT_ROWS rows one percentile() of each column follows: two scans in all. Over that the second scan
    counts what lies below and within the brackets of all columns, and the third sorts only what is within: three scans for any
    number of columns, two more for each time that a bracket has still over DIRECT_ROWS rows, which takes a thousand million.
    """
    direct_rows = DIRECT_ROWS if direct_rows is None else direct_rows
    width = max(BRACKET, 2 / direct_rows)
    if not wanted:
        return {}
    names = {name: f"v{k}" for k, name in enumerate(wanted)}
    values = df.select(*[finite(wanted[name][0].cast("double")).alias(v) for name, v in names.items()])
    bounds = {name: F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in wanted[name][1] for d in (-width, width)]) for name in names}
    one = values.agg(*[F.count(v).alias(f"n{v}") for v in names.values()], *[F.percentile_approx(v, bounds[name], ACCURACY).alias(f"b{v}") for name, v in names.items()]).first()
    out: dict[str, list[float | None]] = {name: [None] * len(wanted[name][1]) for name in names}
    small = [name for name, v in names.items() if 0 < one[f"n{v}"] <= direct_rows]
    if small:
        exact = values.agg(*[F.percentile(names[name], F.array(*[F.lit(float(p)) for p in wanted[name][1]])).alias(names[name]) for name in small]).first()
        out |= {name: list(exact[names[name]]) for name in small}
    open_: list[_Bracket] = []
    for name, v in names.items():
        if one[f"n{v}"] > direct_rows:
            near = one[f"b{v}"]
            open_ += [_Bracket(name, i, v, (one[f"n{v}"] - 1) * p, near[2 * i], near[2 * i + 1]) for i, p in enumerate(wanted[name][1])]
    while open_:
        counts = values.agg(*[c for k, b in enumerate(open_) for c in b.counts(k)]).first()
        for k, b in enumerate(open_):
            b.place(counts[f"u{k}"], counts[f"i{k}"])
        last = [b for b in open_ if b.inside <= direct_rows or b.settled]
        if last:
            found = values.agg(*[b.value().alias(f"q{k}") for k, b in enumerate(last)]).first()
            for k, b in enumerate(last):
                out[b.name][b.number] = found[f"q{k}"]
        open_ = [b for b in open_ if b.inside > direct_rows and not b.settled]
        if open_:
            near = values.agg(*[b.narrower(width).alias(f"b{k}") for k, b in enumerate(open_)]).first()
            for k, b in enumerate(open_):
                # A bracket that does not shrink has few different values, which one percentile() can hold.
                b.settled = list(near[f"b{k}"]) == [b.low, b.high]
                b.low, b.high = near[f"b{k}"]
    return out


@dataclass
class _Bracket:
    """Values around a wanted rank (counted from 0, with a fraction) of a column."""

    name: str
    number: int
    column: str
    rank: float
    low: float
    high: float
    under: int = 0
    inside: int = 0
    settled: bool = False

    def _within(self) -> Column:
        return F.col(self.column).between(self.low, self.high)

    def counts(self, k: int) -> list[Column]:
        return [F.count_if(F.col(self.column) < self.low).alias(f"u{k}"), F.count_if(self._within()).alias(f"i{k}")]

    def place(self, under: int, inside: int) -> None:
        self.under, self.inside = under, inside
        if not under <= self.rank <= under + inside - 1:  # beyond what the approximation promises
            raise RuntimeError("the bracket lacks the wanted rank")

    def value(self) -> Column:
        share = (self.rank - self.under) / max(1, self.inside - 1)
        return F.percentile(F.when(self._within(), F.col(self.column)), F.lit(min(1.0, share)))

    def narrower(self, width: float) -> Column:
        share = (self.rank - self.under) / max(1, self.inside - 1)
        ends = F.array(*[F.lit(min(1.0, max(0.0, share + d))) for d in (-width, width)])
        return F.percentile_approx(F.when(self._within(), F.col(self.column)), ends, ACCURACY)


def with_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    """df with the columns of a frame of one row."""
    return df.crossJoin(F.broadcast(stats.limit(1)))


def threshold(df: DataFrame, index: Column, method: str = "mean_std", k: float = 2.0) -> float | None:
    """The anomaly threshold of an index over a whole table, see thresholds; scene by scene: operators.scenes."""
    return thresholds(df, {"t": index}, method, k)["t"]


def thresholds(df: DataFrame, layers: Mapping[str, Column], method: str = "mean_std", k: float = 2.0) -> dict[str, float | None]:
    """The anomaly thresholds of many indices together: mean_std (population deviation), median_mad or percentile (95); None without
    values. Of any number of layers mean_std takes one scan, and all medians come from one quantiles_of, all deviations from another."""
    if method == "percentile":
        return {name: found[0] for name, found in quantiles_of(df, {name: (c, [0.95]) for name, c in layers.items()}).items()}
    if method == "median_mad":
        middle = {name: found[0] for name, found in quantiles_of(df, {name: (c, [0.5]) for name, c in layers.items()}).items()}
        apart = quantiles_of(df, {name: (F.abs(finite(layers[name].cast("double")) - m), [0.5]) for name, m in middle.items() if m is not None})
        return {name: None if m is None else m + k * MAD_SCALE * apart[name][0] for name, m in middle.items()}
    if method != "mean_std":
        raise ValueError(f"unknown threshold method: {method}")
    if not layers:
        return {}
    own = {f"t{i}": finite(c.cast("double")) for i, c in enumerate(layers.values())}
    return dict(zip(layers, df.agg(*[(F.avg(c) + k * F.stddev_pop(c)).alias(t) for t, c in own.items()]).first(), strict=True))


def over(index: Column, limit: float | None) -> Column:
    """Whether an index is strictly over its threshold; false where it is unknown (null, NaN, infinite) and without a threshold."""
    return F.coalesce(finite(index.cast("double")) > limit, F.lit(False)) if limit is not None else F.lit(False)


def anomaly_ratio(mask: Column, index: Column, roi: Column | None = None) -> Column:
    """The share of anomalies: of all pixels of the region with one, else of the pixels with a value."""
    base = F.count_if(roi) if roi is not None else F.count(finite(index.cast("double")))
    hits = F.count_if(mask & roi) if roi is not None else F.count_if(mask)
    return hits / F.greatest(base, F.lit(1))


def between_quantiles(df: DataFrame, layers: Mapping[str, Column], low: float = 0.02, high: float = 0.98, null_as: float | None = None) -> dict[str, Column]:
    """Each layer between two of its quantiles as 0 to 1 (see normalized); the quantiles of all layers are found together."""
    found = quantiles_of(df, {name: (c, [low, high]) for name, c in layers.items()})
    return {name: normalized(c, *found[name], null_as=null_as) for name, c in layers.items()}


def normalized(x: Column, low: float | None, high: float | None, null_as: float | None = None) -> Column:
    """x between two of its quantiles as 0 to 1; zeros for an empty or constant layer. null_as: what null becomes, if anything."""
    if low is None or high - low < 1e-9:
        return F.lit(0.0)
    out = clip((finite(x.cast("double")) - low) / (high - low))
    return out if null_as is None else F.coalesce(out, F.lit(null_as))


def stretched(df: DataFrame, layers: Mapping[str, Column], low: float = 0.02, high: float = 0.98, gamma: float | None = None) -> dict[str, Column]:
    """Each layer between two quantiles of its positive values as 0 to 1, for display: zeros without any. With gamma it is raised to
    that power, and unknown values are 0."""
    found = quantiles_of(df, {name: (F.when(c > 0, c), [low, high]) for name, c in layers.items()})
    out = {}
    for name, c in layers.items():
        a, b = found[name]
        own = finite(c.cast("double"))
        value = F.when(own.isNotNull(), F.lit(0.0)) if a is None else clip((own - a) / max(b - a, 1e-6))
        out[name] = value if gamma is None else F.coalesce(F.pow(value, F.lit(gamma)), F.lit(0.0))
    return out


def soft_over(df: DataFrame, index: Column, limit: float, roi: Column | None = None, share: float = 0.95) -> Column:
    """How far an index is over its threshold, as 0 to 1, for display: 1 at the 95th percentile of what is over it (or, if nothing is,
    at the largest value); 0 outside the region and where unknown."""
    own = finite((index if roi is None else F.when(roi, index)).cast("double"))
    found = quantiles_of(df, {"over": (F.when(own > limit, own), [share]), "all": (own, [1.0])})
    top = found["over"][0] if found["over"][0] is not None else found["all"][0]
    if top is None:
        return F.lit(0.0)
    return F.coalesce(clip((own - limit) / max(top - limit, 1e-6)), F.lit(0.0))
