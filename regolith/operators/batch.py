"""Many minerals and methods over one scene: indices, thresholds and masks of all targets in a few passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions import bands as b
from regolith.operators import evidence, pca, stats

#: Fixed: the formulas of the small mineral catalogue, by sensor.
MINERALS = {
    "iron_oxide": {"Landsat8": "B4/B2", "Sentinel2": "B4/B2"},
    "aloh": {"Landsat8": "B6/B7", "Sentinel2": "B11/B12", "ASTER": "B5/B6"},
    "carbonate": {"ASTER": "B8/B9"},
    "ferrous": {"Landsat8": "B5/B4", "Sentinel2": "B8/B4", "ASTER": "B4/B5"},
    "silica": {"Landsat8": "B6/B5", "Sentinel2": "B11/B8", "ASTER": "B5/B4"},
    "propylitic": {"Landsat8": "(B5/B4)*(1+B6/B5)", "Sentinel2": "(B8/B4)*(1+B11/B8)", "ASTER": "(B4/B5)*(1+B5/B4)"},
}


def supported_minerals(sensor: str) -> list[str]:
    return [m for m, formulas in MINERALS.items() if sensor in formulas]


@dataclass
class Target:
    """A mineral with what each method needs; a method without it does not apply. stress: the five red-edge bands in order."""

    mineral: str
    priority: int = 2
    ratio: str | None = None
    pca: tuple[Sequence[str], Sequence[str], Sequence[str]] | None = None  # inputs, wanted positive, wanted negative
    depth: tuple[float, tuple[float, float], int] | None = None  # feature, shoulders, sign
    stress: Sequence[str] | None = None

    def applies(self, method: str) -> bool:
        return bool({"ratio": self.ratio, "pca": self.pca, "band_depth": self.depth, "veg_stress": self.stress}.get(method))


@dataclass
class Batch:
    """layers: the pixels with an index and a mask for each result and the score; results: a row for each result; warnings: what
    could not be computed, by mineral and method; masks: the mask's column by mineral and method."""

    layers: DataFrame
    results: DataFrame
    warnings: dict[tuple[str, str], str] = field(default_factory=dict)
    masks: dict[tuple[str, str], str] = field(default_factory=dict)


def scaled(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Digital numbers as reflectance: all bands over 10000 if the largest value of any is over 10, and no band has a gap."""
    one = pixels.agg(F.greatest(*[F.max(c) for c in bands]).alias("top"), F.count_if(sum((F.col(c).isNull().cast("int") for c in bands), F.lit(0)) > 0).alias("gaps")).first()
    if one.top is None or one.top <= 10 or one.gaps:
        return pixels
    return pixels.withColumns({c: F.col(c) / 10000 for c in bands})


def _index(pixels: DataFrame, target: Target, method: str, bands: Mapping[str, Column], roi: Column | None, wavelengths: Sequence[float] | None) -> Column:
    if method == "ratio" and target.ratio:
        return b.band_expression(target.ratio, bands)
    if method == "pca" and target.pca:
        inputs, positive, negative = target.pca
        if missing := [c for c in inputs if c not in bands]:
            raise ValueError(f"bands are missing: {missing}")
        return pca.projection(pca.crosta(pixels, inputs, positive, negative, roi), inputs)
    if method == "band_depth" and target.depth and wavelengths:
        return b.band_depth(F.col("spectrum"), wavelengths, *target.depth)
    if method == "veg_stress" and target.stress:
        return b.vegetation_stress(*[bands[c] for c in target.stress])
    raise ValueError(f"{target.mineral} has no {method}")


def analyze(
    pixels: DataFrame,
    targets: Sequence[Target],
    methods: Sequence[str] = ("ratio", "pca"),
    threshold: str = "mean_std",
    k: float = 2.0,
    roi: Column | None = None,
    wavelengths: Sequence[float] | None = None,
    mode: str = "route",
    selected: Sequence[str] | None = None,
    near: Column | None = None,
    prior_weight: float = 0.15,
) -> Batch:
    """All targets that are selected by all methods. Without a selection the mode `library` takes all, the others those of priority 1
    and 2.

    A method that a target has nothing for does not apply: no result. One that fails (a band is missing, say) is a warning and a
    result without anomalies, found when the plan is made, so it cannot stop the job. near: proximity to structures (0 to 1),
    which weights the score (evidence.structural_weight).
    All thresholds come together (stats.thresholds); the masks' counts from one aggregate. score: the sum over minerals of the
    weighted share of methods that see an anomaly (mode as in evidence.mineral_score; veg_stress does not count); high: all
    methods of some mineral see one.
    """
    chosen = [t for t in targets if (t.mineral in selected if selected is not None else mode == "library" or t.priority <= 2)]
    bands = {c: F.col(c) for c in pixels.columns if b.BAND_NAME.fullmatch(c)}
    found: dict[tuple[int, str], Column] = {}
    warnings: dict[tuple[str, str], str] = {}
    for i, target in enumerate(chosen):
        for method in methods:
            if not target.applies(method):
                continue
            try:
                index = _index(pixels, target, method, bands, roi, wavelengths)
            except (ValueError, KeyError) as wrong:
                warnings[target.mineral, method] = str(wrong)
            else:
                found[i, method] = index if roi is None else F.when(roi, index)
    name = {key: f"index_{key[0]}_{key[1]}" for key in found}
    layers = pixels.withColumns({name[key]: index for key, index in found.items()}) if found else pixels
    limits = stats.thresholds(layers, {key: F.col(name[key]) for key in found}, threshold, k)
    masks = {key: stats.over(F.col(name[key]), limits[key]) for key in found}
    scores, every = [F.lit(0.0)], [F.lit(False)]
    for i, target in enumerate(chosen):
        own = {m: masks.get((i, m)) for m in methods if m != "veg_stress"}
        scores.append(evidence.mineral_score(own, F.lit(target.priority), mode))
        if len(seen := [m for m in own.values() if m is not None]) > 1:
            every.append(evidence.all_of(seen))
    score = sum(scores[1:], scores[0])
    score = score if near is None else evidence.structural_weight(score, near, prior_weight)
    layers = layers.withColumns({"score": score, "high": evidence.any_of(every), **{f"mask_{key[0]}_{key[1]}": mask for key, mask in masks.items()}})
    inside = F.lit(True) if roi is None else roi
    counts = [F.count_if(inside).alias("pixels")]
    for key in found:
        counts += [F.count(name[key]).alias(f"n{name[key]}"), F.count_if(masks[key]).alias(f"a{name[key]}")]
    one = layers.agg(*counts).first()
    rows = []
    for i, target in enumerate(chosen):
        for method in methods:
            key = i, method
            if key in found:
                base = one["pixels"] if roi is not None else one[f"n{name[key]}"]
                hits = one[f"a{name[key]}"]
                rows.append((target.mineral, method, target.priority, limits[key], hits, hits / max(1, base)))
            elif target.applies(method):
                rows.append((target.mineral, method, target.priority, None, 0, 0.0))
    results = pixels.sparkSession.createDataFrame(rows, "mineral string, method string, priority int, threshold double, n_anomaly long, anomaly_ratio double")
    columns = {(chosen[i].mineral, method): f"mask_{i}_{method}" for i, method in found}
    return Batch(layers, results, warnings, columns)


def alteration(pixels: DataFrame, sensor: str, mineral: str, threshold: str = "mean_std", k: float = 1.5) -> Batch:
    """One mineral of the small catalogue by its formula for a sensor, without a region. ValueError for what the catalogue lacks."""
    formulas = MINERALS.get(mineral)
    if formulas is None:
        raise ValueError(f"unknown mineral: {mineral}")
    formula = formulas.get(sensor.replace("_L2", "").replace("Landsat8/9", "Landsat8"))
    if formula is None:
        raise ValueError(f"{sensor} does not show {mineral}")
    return analyze(pixels, [Target(mineral, 1, ratio=formula)], ["ratio"], threshold, k)


def associations(found: Batch, distance: Column, buffer: float = 300.0) -> DataFrame:
    """The batch's results with n_near (anomalies of a known distance), median_dist_m and frac_within_buffer: how each one's anomalies
    lie to structures. The medians of all are found together."""
    own = {key: F.when(F.col(column), distance) for key, column in found.masks.items()}
    medians = stats.quantiles_of(found.layers, {"/".join(key): (c, [0.5]) for key, c in own.items()})
    if own:
        counts = found.layers.agg(*[x for k, c in enumerate(own.values()) for x in (F.count(c).alias(f"n{k}"), F.avg((c <= buffer).cast("double")).alias(f"f{k}"))]).first()
        rows = [(*key, counts[f"n{k}"], medians["/".join(key)][0], counts[f"f{k}"]) for k, key in enumerate(own)]
    else:
        rows = []
    near = found.layers.sparkSession.createDataFrame(rows, "mineral string, method string, n_near long, median_dist_m double, frac_within_buffer double")
    return found.results.join(F.broadcast(near), ["mineral", "method"], "left")  # a row for each target and method


def sensor_totals(summaries: DataFrame) -> DataFrame:
    """roi_pixels (the largest region of the sensors) and high_pixels (of all together) of rows (sensor, roi_pixels, high_pixels)."""
    return summaries.agg(F.max("roi_pixels").alias("roi_pixels"), F.sum("high_pixels").alias("high_pixels"))


def spectral_composite(layers: DataFrame, masks: Sequence[tuple[str, int]]) -> DataFrame:
    """overlap (minerals that see an anomaly), score and high (two or more) from single masks (column, priority) of a cube."""
    overlap = sum((F.col(c).cast("int") for c, _ in masks), F.lit(0))
    score = sum((evidence.mineral_score({"band_depth": F.col(c)}, F.lit(p), "hyper") for c, p in masks), F.lit(0.0))
    return layers.withColumns({"overlap": overlap, "score": score, "high": overlap >= 2})
