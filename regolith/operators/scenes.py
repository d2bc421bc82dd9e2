"""Statistics image by image: exact quantiles, thresholds and stretches of each scene, for any number of scenes together.

A scene is what the columns of `key` tell apart; a null key is a scene too. Values that are null, NaN or infinite are unknown.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions.bands import clip, finite
from regolith.operators.stats import MAD_SCALE
from regolith.session import checkpointed

#: Values of a scene up to which all of them are sorted; of larger ones only those in brackets around the wanted ranks.
SMALL = 4000
#: Half the width of a bracket as a share of the ranks, and how exact percentile_approx is asked to be (one rank in so many): a bracket
#: of over SMALL values is sure to hold the wanted rank and its neighbours.
BRACKET, ACCURACY = 0.001, 10_000
#: Rows of statistics up to which they are sent to all tasks; more are joined by a shuffle.
SENT_ROWS = 200_000


def joined(df: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """df with the columns of `found`, which has a row for each scene; null keys meet. found is counted first, so it should be
    checkpointed, or come from what is."""
    names = {k: f"_{i}_key" for i, k in enumerate(key)}
    right = found.withColumnsRenamed(names)
    if found.count() <= SENT_ROWS:
        right = F.broadcast(right)
    same = F.lit(True)
    for k, name in names.items():
        same &= df[k].eqNullSafe(right[name])
    return df.join(right, same, "left").drop(*names.values())


def quantiles_by(df: DataFrame, key: Sequence[str], wanted: Mapping[str, tuple[Column, Sequence[float]]]) -> DataFrame:
    """Exact quantiles (linear between neighbours) of several layers of each scene: key, and for each layer its quantiles as an array in
    the order asked for, of nulls where the scene has no value; n_<layer> is the number of values.

    Three scans for any number of scenes and layers. The first brackets each wanted rank by percentile_approx. The second counts what
    lies under the brackets. The third takes what lies within, counts equal values together before they are shuffled, and sorts them;
    of a scene with more than SMALL values that is about one in 500, so a scene of any size is sorted in little time. No value comes to
    the driver, and the result is checkpointed.
    """
    key, names = list(key), list(wanted)
    values = df.select(*key, *[finite(wanted[name][0].cast("double")).alias(f"v{k}") for k, name in enumerate(names)])
    ends = {k: F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in wanted[name][1] for d in (-BRACKET, BRACKET)]) for k, name in enumerate(names)}
    first = values.groupBy(*key).agg(*[F.count(f"v{k}").alias(f"n{k}") for k in ends], *[F.percentile_approx(f"v{k}", ends[k], ACCURACY).alias(f"b{k}") for k in ends])
    brackets = checkpointed(first)
    bounded = joined(values, brackets, key)
    places = [(k, i, p) for k, name in enumerate(names) for i, p in enumerate(wanted[name][1])]

    def low(k: int, i: int) -> Column:
        return F.when(F.col(f"n{k}") <= SMALL, F.lit(float("-inf"))).otherwise(F.col(f"b{k}")[2 * i])

    def high(k: int, i: int) -> Column:
        return F.when(F.col(f"n{k}") <= SMALL, F.lit(float("inf"))).otherwise(F.col(f"b{k}")[2 * i + 1])

    under = checkpointed(bounded.groupBy(*key).agg(*[F.count_if(F.col(f"v{k}") < low(k, i)).alias(f"u{k}_{i}") for k, i, _ in places]))
    within = [F.when(F.col(f"v{k}").between(low(k, i), high(k, i)), F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.col(f"v{k}").alias("v"))) for k, i, _ in places]
    near = bounded.select(*key, F.explode(F.array_compact(F.array(*within))).alias("_at")).groupBy(*key, F.col("_at.k").alias("k"), F.col("_at.i").alias("i"), F.col("_at.v").alias("v")).agg(F.count("*").alias("times"))
    # Of each scene and wanted rank: how many values lie under its bracket, and the rank counted from 0, with a fraction.
    ranks = joined(brackets, under, key).select(
        *key, F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.col(f"u{k}_{i}").alias("under"), ((F.col(f"n{k}") - 1) * F.lit(float(p))).alias("rank")) for k, i, p in places]))
    )
    upto = F.sum("times").over(Window.partitionBy(*key, "k", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = joined(near.withColumn("upto", upto), checkpointed(ranks), [*key, "k", "i"])
    last = F.col("under") + F.col("upto") - 1  # the rank of the last of these equal values
    lower, upper = F.floor("rank"), F.ceil("rank")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((last - F.col("times") < rank) & (rank <= last), F.col("v")))

    found = counted.groupBy(*key, "k", "i").agg(value_at(lower).alias("a"), value_at(upper).alias("b"), F.first(F.col("rank") - lower).alias("part"))
    each = checkpointed(found.select(*key, F.struct("k", "i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("q")).alias("q")).groupBy(*key).agg(F.collect_list("q").alias("qs")))

    def quantile(k: int, i: int) -> Column:
        return F.get(F.filter("qs", lambda q: (q.k == k) & (q.i == i)), F.lit(0)).q

    whole = joined(brackets.select(*key, *[f"n{k}" for k in ends]), each, key)
    return checkpointed(whole.select(*key, *[F.array(*[quantile(k, i) for i in range(len(wanted[name][1]))]).alias(name) for k, name in enumerate(names)], *[F.col(f"n{k}").alias(f"n_{name}") for k, name in enumerate(names)]))


def thresholds(df: DataFrame, key: Sequence[str], layers: Mapping[str, Column], method: str = "mean_std", k: float = 2.0) -> DataFrame:
    """key and each layer's anomaly threshold of the scene: mean_std (population deviation), median_mad or percentile (95); null for a
    scene without values of the layer. mean_std takes one scan, percentile three, median_mad six, for any number of layers."""
    if method == "mean_std":
        own = {name: finite(c.cast("double")) for name, c in layers.items()}
        return checkpointed(df.groupBy(*key).agg(*[(F.avg(c) + k * F.stddev_pop(c)).alias(name) for name, c in own.items()]))
    if method == "percentile":
        found = quantiles_by(df, key, {name: (c, [0.95]) for name, c in layers.items()})
        return found.select(*key, *[F.col(name)[0].alias(name) for name in layers])
    if method != "median_mad":
        raise ValueError(f"unknown threshold method: {method}")
    names = {name: f"_median_{i}" for i, name in enumerate(layers)}
    own = df.select(*key, *[finite(c.cast("double")).alias(f"_v_{i}") for i, c in enumerate(layers.values())])
    found = quantiles_by(own, key, {name: (F.col(f"_v_{i}"), [0.5]) for i, name in enumerate(layers)})
    medians = found.select(*key, *[F.col(name)[0].alias(names[name]) for name in layers])
    apart = quantiles_by(joined(own, medians, key), key, {name: (F.abs(F.col(f"_v_{i}") - F.col(names[name])), [0.5]) for i, name in enumerate(layers)})
    return joined(medians, apart, key).select(*key, *[(F.col(names[name]) + k * MAD_SCALE * F.col(name)[0]).alias(name) for name in layers])


def anomalies(df: DataFrame, key: Sequence[str], layers: Mapping[str, Column], method: str = "mean_std", k: float = 2.0, roi: Column | None = None) -> DataFrame:
    """df with <layer>_threshold and <layer>_over for each layer: the scene's threshold and whether the layer is strictly over it. With
    roi only pixels where it holds count, and only they can be over. False where the layer is unknown or the scene has no threshold."""
    own = {name: finite((c if roi is None else F.when(roi, c)).cast("double")) for name, c in layers.items()}
    limits = thresholds(df, key, own, method, k).withColumnsRenamed({name: f"{name}_threshold" for name in layers})
    out = joined(df, limits, key)
    return out.withColumns({f"{name}_over": F.coalesce(c > F.col(f"{name}_threshold"), F.lit(False)) for name, c in own.items()})


def between_quantiles(df: DataFrame, key: Sequence[str], layers: Mapping[str, Column], low: float = 0.02, high: float = 0.98, null_as: float | None = None) -> DataFrame:
    """df with each layer, under its name, between two quantiles of its scene as 0 to 1; zeros where the scene's layer is empty or
    constant. null_as: what unknown values become, if anything."""
    return _between(df, key, layers, {name: (c, [low, high]) for name, c in layers.items()}, lambda c, a, b: F.when(a.isNull() | (b - a < 1e-9), F.lit(0.0)).otherwise(clip((c - a) / (b - a))), null_as)


def stretched(df: DataFrame, key: Sequence[str], layers: Mapping[str, Column], low: float = 0.02, high: float = 0.98, gamma: float | None = None) -> DataFrame:
    """df with each layer, under its name, between two quantiles of its scene's positive values as 0 to 1, for display: zeros where the
    scene has none. With gamma it is raised to that power, and unknown values are 0."""

    def scaled(c: Column, a: Column, b: Column) -> Column:
        value = F.when(c.isNotNull(), F.when(a.isNull(), F.lit(0.0)).otherwise(clip((c - a) / F.greatest(b - a, F.lit(1e-6)))))
        return value if gamma is None else F.pow(value, F.lit(gamma))

    return _between(df, key, layers, {name: (F.when(c > 0, c), [low, high]) for name, c in layers.items()}, scaled, None if gamma is None else 0.0)


def _between(df, key, layers, wanted, scaled, null_as) -> DataFrame:
    found = quantiles_by(df, key, wanted)
    own = {name: f"_q_{i}" for i, name in enumerate(layers)}
    out = joined(df, found.select(*key, *[F.col(name).alias(q) for name, q in own.items()]), key)
    made = {name: scaled(finite(c.cast("double")), F.col(own[name])[0], F.col(own[name])[1]) for name, c in layers.items()}
    if null_as is not None:
        made = {name: F.coalesce(c, F.lit(null_as)) for name, c in made.items()}
    return out.withColumns(made).drop(*own.values())


def soft_over(df: DataFrame, key: Sequence[str], index: Column, limits: DataFrame, roi: Column | None = None, share: float = 0.95, name: str = "soft") -> DataFrame:
    """df with `name`: how far an index is over its scene's threshold (limits: key and threshold, a row for each scene) as 0 to 1, for
    display: 1 at the 95th percentile of what is over it (or, if nothing is, at the largest value); 0 outside the region, where unknown
    and without a threshold."""
    own = finite((index if roi is None else F.when(roi, index)).cast("double"))
    placed = joined(df.withColumn("_index", own), limits.select(*key, F.col("threshold").alias("_limit")), key)
    found = quantiles_by(placed, key, {"over": (F.when(F.col("_index") > F.col("_limit"), F.col("_index")), [share]), "all": (F.col("_index"), [1.0])})
    out = joined(placed, found.select(*key, F.coalesce(F.col("over")[0], F.col("all")[0]).alias("_top")), key)
    soft = clip((F.col("_index") - F.col("_limit")) / F.greatest(F.col("_top") - F.col("_limit"), F.lit(1e-6)))
    return out.withColumn(name, F.coalesce(soft, F.lit(0.0))).drop("_index", "_limit", "_top")


def proximity(df: DataFrame, key: Sequence[str], distance: Column, name: str = "proximity") -> DataFrame:
    """df with `name`: exp(-distance / scale) by the median distance of the scene (1 where that is 0 or unknown); 0 where the distance is
    unknown."""
    own = finite(distance.cast("double"))
    found = quantiles_by(df, key, {"scale": (own, [0.5])}).select(*key, F.coalesce(F.nullif(F.col("scale")[0], F.lit(0.0)), F.lit(1.0)).alias("_scale"))
    return joined(df, found, key).withColumn(name, F.coalesce(F.exp(-own / (F.col("_scale") + 1e-9)), F.lit(0.0))).drop("_scale")


def anomaly_ratios(df: DataFrame, key: Sequence[str], masks: Mapping[str, tuple[Column, Column]], roi: Column | None = None) -> DataFrame:
    """key and, for each name, the share of anomalies (mask, index): of all pixels of the region with one, else of those with a value."""
    base = {name: F.count_if(roi) if roi is not None else F.count(finite(index.cast("double"))) for name, (_, index) in masks.items()}
    hits = {name: F.count_if(mask & roi) if roi is not None else F.count_if(mask) for name, (mask, _) in masks.items()}
    return df.groupBy(*key).agg(*[(hits[name] / F.greatest(base[name], F.lit(1))).alias(name) for name in masks])
