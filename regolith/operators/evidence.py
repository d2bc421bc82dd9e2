"""Evidence layers: structural weighting, fusion to prospectivity, mineral scores."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions.bands import clip, finite
from regolith.operators import spatial
from regolith.operators.stats import normalized, quantiles, quantiles_of
from regolith.session import checkpointed

#: Fixed: default weights of evidence layers, and that of a layer without one.
WEIGHTS = {"alteration": 0.30, "veg_stress": 0.25, "structure": 0.20, "deformation": 0.15, "terrain": 0.10}
OTHER_WEIGHT = 0.1


def proximity(distance: Column, scale: float | None) -> Column:
    """exp(-distance / scale), 0 where the distance is unknown. The scale is usually the median distance."""
    return F.coalesce(F.exp(-distance / ((scale or 1.0) + 1e-9)), F.lit(0.0))


def mean_light(df: DataFrame, hillshade: Column) -> float | None:
    """The mean of what a relief's light is over 0, by which terrain_normalized measures it; None where nothing is lit."""
    own = finite(hillshade.cast("double"))
    return df.agg(F.avg(F.when(own > 0, own)).alias("light")).first().light


def terrain_normalized(index: Column, hillshade: Column, mean_light: float | None) -> Column:
    """The index over the relative light, which is bounded by 0.3 and 3; unchanged without any light."""
    return index if mean_light is None else index / clip(hillshade / (mean_light + 1e-6), 0.3, 3.0)


def structural_weight(anomaly: Column, near: Column, weight: float = 0.15) -> Column:
    return anomaly * (1 - weight + weight * clip(F.coalesce(near, F.lit(0.0))))


def association(df: DataFrame, mask: Column, distance: Column, buffer: float = 300.0) -> DataFrame:
    """Anomalies, their median distance to a structure, and the share within the buffer; nulls where there is none."""
    hits = df.where(mask)
    median = F.lit(quantiles(hits, distance, [0.5])[0]).cast("double")
    return hits.agg(
        F.count("*").alias("n_anomaly"), median.alias("median_dist_m"), F.avg((distance <= buffer).cast("double")).alias("frac_within_buffer")
    )


def renormalized(names, weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """Weights of the layers that are there, with sum 1."""
    own = {n: {**WEIGHTS, **(weights or {})}.get(n, OTHER_WEIGHT) for n in names}
    total = sum(own.values()) or 1.0
    return {n: w / total for n, w in own.items()}


def fuse(df: DataFrame, layers: Mapping[str, Column], method: str = "weighted_sum", weights: Mapping[str, float] | None = None, gamma: float = 0.9) -> tuple[Column, dict[str, float]]:
    """The fused score of the informative layers, each between its 2nd and 98th percentile as 0 to 1 and null as 0; and the
    weights that count. A layer without two values says nothing. fuzzy_gamma takes no weights but reports them."""
    found = quantiles_of(df, {n: (c, [0.0, 0.02, 0.98, 1.0]) for n, c in layers.items()})
    names = [n for n, (least, _, _, most) in found.items() if least is not None and most - least > 1e-9]
    if not names:
        return F.lit(0.0), {}
    own = {n: normalized(layers[n], *found[n][1:3], null_as=0.0) for n in names}
    share = renormalized(names, weights)
    if method == "fuzzy_gamma":
        either = 1 - reduce(lambda a, b: a * b, [1 - c for c in own.values()])
        both = reduce(lambda a, b: a * b, own.values())
        return F.pow(clip(either), F.lit(gamma)) * F.pow(clip(both), F.lit(1 - gamma)), share
    return clip(reduce(lambda a, b: a + b, [share[n] * c for n, c in own.items()])), share


def prospectivity(df: DataFrame, layers: Mapping[str, Column], method: str = "weighted_sum", weights: Mapping[str, float] | None = None, gamma: float = 0.9, roi: Column | None = None, share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """df with the fused score (null outside the region) and high (over the score's quantile), and one row: threshold, high_ratio (of
    the pixels with a score) and score_mean. Without an informative layer the score is 0, nothing is high and the threshold is null."""
    score, used = fuse(df, layers, method, weights, gamma)
    scored = df.withColumn("score", score if roi is None else F.when(roi, score))
    limit = quantiles(scored, F.col("score"), [share])[0] if used else None
    high = F.lit(False) if limit is None else F.coalesce(F.col("score") >= limit, F.lit(False))
    scored = scored.withColumn("high", high)
    ratio = F.count_if("high") / F.greatest(F.count("score"), F.lit(1))
    return scored, scored.agg(F.lit(limit).cast("double").alias("threshold"), ratio.alias("high_ratio"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("score_mean"))


def prospectivity_at(
    target: DataFrame,
    layers: Mapping[str, Column],
    box: tuple[float, float, float, float],
    structure: tuple[DataFrame, DataFrame] | None = None,
    deformed: tuple[DataFrame, DataFrame] | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """prospectivity() of the target's layers with what products of the same place add: the nearness to structures from the `distance`
    layer of the first structural product that touches the box, and the `deformation` layer of the first product of deformation.

    target: scene, y, x, lon, lat and what the layers need, which name their columns (F.col). structure and deformed: products and their pixels, as
    spatial.layers_on_grid takes them. Evidence that no product has is left out, and the weights of the others count for it."""
    found, own = target, dict(layers)
    for products, name, column in ((structure, "distance", "_distance"), (deformed, "deformation", "_deformation")):
        placed = spatial.layers_on_grid(*products, found, box, (name,)) if products else None
        if placed is not None:
            found = placed.withColumnRenamed(name, column)
    if "_distance" in found.columns:
        found = checkpointed(found)
        scale = quantiles(found, F.col("_distance"), [0.5])[0]
        if scale is not None:
            own["structure"] = proximity(F.col("_distance"), scale)
    if "_deformation" in found.columns:
        own["deformation"] = F.col("_deformation")
    return prospectivity(found, own, **options)


def priority_weight(priority: Column) -> Column:
    return F.when(priority == 1, 1.0).when(priority == 2, 0.5).otherwise(0.25)


def mineral_score(masks: Mapping[str, Column | None], priority: Column, mode: str = "route") -> Column:
    """The weighted share of methods that see an anomaly. library: of all methods asked for; route: of those that worked (None:
    did not); hyper: weight times the single mask."""
    worked = [m.cast("double") for m in masks.values() if m is not None]
    if not worked:
        return F.lit(0.0)
    base = len(masks) if mode == "library" else 1 if mode == "hyper" else len(worked)
    return priority_weight(priority) * reduce(lambda a, b: a + b, worked) / base


def all_of(masks) -> Column:
    return reduce(lambda a, b: a & b, masks)


def any_of(masks) -> Column:
    return reduce(lambda a, b: a | b, masks)
