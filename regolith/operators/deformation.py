"""Ground deformation from radar pairs: rates, coherence, decay, clusters, line features, fusion with mineral anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regolith.functions.bands import clip, finite
from regolith.operators import grid, scenes, spatial
from regolith.operators.stats import between_quantiles, quantiles
from regolith.session import checkpointed, staged

#: Fixed: the middle coherence, below which a pixel counts as unstable.
COHERENCE_MID = 0.3
DAYS = 365.25


def stack(displacement: DataFrame, coherence: DataFrame) -> DataFrame:
    """Displacement (pair, y, x and more) with the coherence of its pair and place, and `layered`: whether the pair has a coherence
    layer at all. A pair without one keeps all its pixels."""
    pairs = coherence.select("pair").distinct().withColumn("layered", F.lit(True))
    met = displacement.join(coherence.select("pair", "y", "x", "coherence"), ["pair", "y", "x"], "left")
    return met.join(pairs, "pair", "left").withColumn("layered", F.col("layered").isNotNull())


def first_pair_places(pairs: DataFrame) -> DataFrame:
    """pairs (pair, height, width) with row_scale and column_scale, by which a cell of the first pair's grid lies in its own: grids of
    other sizes are resampled to the first one's, first and last cells falling together (see spatial.zoom_place)."""
    first = pairs.groupBy().agg(F.min_by("height", "pair").alias("h"), F.min_by("width", "pair").alias("w"))
    scale = [F.when(F.col(own) > 1, (F.col(size) - 1) / (F.col(own) - 1)).otherwise(F.lit(0.0)) for size, own in (("height", "h"), ("width", "w"))]
    return pairs.crossJoin(F.broadcast(first)).withColumns({"row_scale": scale[0], "column_scale": scale[1]}).drop("h", "w")


def rates(observations: DataFrame, least_coherence: float = COHERENCE_MID) -> DataFrame:
    """Observations (y, x, pair, ref_date, sec_date, disp, coherence) with rate in mm a year: pairs that do not go forward in time
    are dropped; the rate is null where the coherence is too low or unknown, unless the whole pair has none (`layered`, see
    stack(); without that column a pair is layered if any of its rows has a coherence)."""
    if "layered" not in observations.columns:
        known = observations.groupBy("pair").agg((F.count("coherence") > 0).alias("layered"))
        observations = observations.join(known, "pair")
    days = F.datediff("sec_date", "ref_date")
    seen = ~F.col("layered") | F.coalesce(finite(F.col("coherence").cast("double")) >= least_coherence, F.lit(False))
    return observations.where(days > 0).withColumn("rate", F.when(seen, finite((F.col("disp") * DAYS / days).cast("double")))).drop("layered")


def velocity(rated: DataFrame) -> DataFrame:
    """y, x, velocity (median rate) and n_valid of each pixel. Rates are shuffled as they are: partial lists of them would take more bytes."""
    return rated.select("y", "x", "rate").repartition("y", "x").groupBy("y", "x").agg(F.median("rate").alias("velocity"), F.count("rate").alias("n_valid"))


def pairs_used(rated: DataFrame) -> int:
    """How many pairs the rates come from: those that go forward in time."""
    return rated.select("pair").distinct().count()


def velocity_summary(pixels: DataFrame) -> DataFrame:
    """The mean, median, least and greatest velocity of pixels (velocity), which are worked out once and written, as quantiles take scans."""
    v, pixels = F.col("velocity"), staged(pixels.select("velocity"), "velocity")
    return pixels.agg(F.avg(v).alias("mean_velocity"), F.lit(quantiles(pixels, v, [0.5])[0]).cast("double").alias("median_velocity"), F.min(v).alias("subsidence_max"), F.max(v).alias("uplift_max"))


def strict_median_coherence(observations: DataFrame) -> DataFrame:
    """y, x, coherence: the median over all pairs, null where one of them is."""
    own = finite(F.col("coherence").cast("double"))
    return observations.groupBy("y", "x").agg(F.when(~F.bool_or(own.isNull()), F.median(own)).alias("coherence"))


def stability(pixels: DataFrame, coherence: str = "coherence", limit: float = COHERENCE_MID) -> DataFrame:
    """Mean and median of the coherence as a score of 0 to 1, and the share of all pixels below the limit."""
    c = clip(finite(F.col(coherence).cast("double")))
    return pixels.agg(F.avg(c).alias("mean"), F.lit(quantiles(pixels, c, [0.5])[0]).cast("double").alias("median"), (F.count_if(c < limit) / F.count("*")).alias("low_coherence_ratio"))


def decay(pairs: DataFrame) -> DataFrame:
    """tau_days and samples: exp(-baseline / tau) fitted to the pairs' mean coherence (columns baseline and coherence), by least
    squares on logarithms; tau is null for fewer than three pairs or coherence that does not fall."""
    used = pairs.where("baseline > 0 AND coherence > 0 AND NOT isnan(baseline) AND NOT isnan(coherence)")
    y = F.log(F.greatest(F.least("coherence", F.lit(1.0)), F.lit(1e-6)))
    fit = used.agg(F.regr_slope(y, F.col("baseline").cast("double")).alias("slope"), F.count("*").alias("samples"))
    return fit.select(F.when((F.col("samples") >= 3) & (F.col("slope") < 0), -1 / F.col("slope")).alias("tau_days"), "samples")


def fusion(df: DataFrame, velocity: Column, mineral: Column, coherence: Column | None = None, weight_v: float = 0.5, weight_m: float = 0.5, limit: float = COHERENCE_MID) -> Column:
    """The joint anomaly of |velocity| and a mineral index, each between its 2nd and 98th percentile; 0 where incoherent."""
    parts = between_quantiles(df, {"velocity": F.abs(velocity), "mineral": mineral})
    both = weight_v * parts["velocity"] + weight_m * parts["mineral"]
    return both if coherence is None else F.when(finite(coherence.cast("double")) >= limit, both).otherwise(F.lit(0.0))


def active(velocity: Column, coherence: Column | None = None, least: float = 5.0, limit: float = COHERENCE_MID) -> Column:
    """Whether a pixel moves: |velocity| of at least `least` and, if there is one, a coherence of at least `limit`; false where either
    is unknown (null, NaN, infinite)."""
    moving = F.abs(finite(velocity.cast("double"))) >= least
    return F.coalesce(moving if coherence is None else moving & (finite(coherence.cast("double")) >= limit), F.lit(False))


def clusters(pixels: DataFrame, velocity: Column, coherence: Column | None = None, least: float = 5.0, limit: float = COHERENCE_MID, size: int = 5, least_pixels: int = 50) -> tuple[DataFrame, DataFrame]:
    """Regions that move: pixels over the limits, closed by a square, in connected clusters of at least so many pixels.

    Returns scene, y, x, label, velocity of the clusters' pixels, and one row: clusters, active_ratio (of all pixels) and
    subsidence_ratio (the share of clustered pixels with a negative velocity). pixels: a row for every cell of each grid.
    """
    closed = grid.closing(pixels, active(velocity, coherence, least, limit), size).where("closed = 1").select("scene", "y", "x")
    labelled = checkpointed(grid.components(closed))
    kept = labelled.groupBy("scene", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least_pixels).drop("n")
    found = labelled.join(kept, ["scene", "label"]).join(pixels.select("scene", "y", "x", velocity.alias("velocity")), ["scene", "y", "x"])
    found = checkpointed(found.select("scene", "y", "x", "label", "velocity"))
    every = pixels.agg(F.count("*").alias("every"))
    summary = found.agg(F.countDistinct("scene", "label").alias("clusters"), F.count("*").alias("n"), F.count_if(F.col("velocity") < 0).alias("down")).crossJoin(every)
    ratios = [(F.col("n") / F.greatest("every", F.lit(1))).alias("active_ratio"), (F.col("down") / F.greatest("n", F.lit(1))).alias("subsidence_ratio")]
    return found, summary.select("clusters", *ratios)


def lineaments(pixels: DataFrame, coherence: Column, limit: float = COHERENCE_MID, length: int = 9, directions: int = 6, share: float = 0.9, sigma: float = 0.8) -> DataFrame:
    """scene, y, x, strength (0 to 1, null where the coherence is unknown) and lineament: lines of low coherence.

    How far the coherence is under the limit (an unknown one counts as whole) is smoothed, averaged along lines of several
    directions of which the largest counts, and set between the 2nd and 98th percentile of its scene; lineaments are the strongest pixels
    of each scene.
    """
    coherence = finite(coherence.cast("double"))
    low = F.greatest(F.lit(limit) - clip(F.coalesce(coherence, F.lit(1.0))), F.lit(0.0))

    def lines(values):
        return spatial.line_means(spatial.gaussian(values, sigma), length, directions)

    raw = spatial.tiled(pixels, low, spatial.gaussian_reach(sigma) + max(3, length | 1) // 2, lines, "raw")
    known = pixels.select("scene", "y", "x", coherence.isNotNull().alias("known"))
    # Rounded, so that equal neighbourhoods are equal in whatever order they are summed.
    found = checkpointed(raw.join(known, ["scene", "y", "x"]).select("scene", "y", "x", F.when(F.col("known"), F.round("raw", 12)).alias("raw")))
    ends = scenes.quantiles_by(found, ["scene"], {"ends": (F.col("raw"), [0.0, 0.02, 0.98, 1.0])}).select("scene", "ends")
    least, first, last, most = (F.col("ends")[k] for k in range(4))
    strength = F.when(most - least > 1e-9, clip((F.col("raw") - first) / (last - first + 1e-9))).otherwise(F.col("raw"))
    scaled = checkpointed(scenes.joined(found, ends, ["scene"]).select("scene", "y", "x", strength.alias("strength")))
    limits = scenes.quantiles_by(scaled, ["scene"], {"over": (F.col("strength"), [share])}).select("scene", F.col("over")[0].alias("over"))
    line = F.coalesce((F.col("over") > 1e-4) & (F.col("strength") >= F.col("over")) & (F.col("strength") > 1e-4), F.lit(False))
    return scenes.joined(scaled, limits, ["scene"]).select("scene", "y", "x", "strength", line.alias("lineament"))


def lineament_shares(found: DataFrame) -> DataFrame:
    """scene and lineament_pixel_ratio: the share of lineament pixels among the scene's pixels of a known strength."""
    return found.groupBy("scene").agg((F.count_if("lineament") / F.greatest(F.count("strength"), F.lit(1))).alias("lineament_pixel_ratio"))


def high_shares(scored: DataFrame) -> DataFrame:
    """high_anomaly_pixel_ratio of a fused score: the share of all pixels that is high."""
    return scored.agg((F.count_if("high") / F.greatest(F.count("*"), F.lit(1))).alias("high_anomaly_pixel_ratio"))


MODES = ("coherence_stability", "velocity_cluster", "fusion_mineral", "structural_attribution")


def analyze(pixels: DataFrame, mode: str = "coherence_stability", least: float = 5.0, limit: float = COHERENCE_MID, least_pixels: int = 50, weight_v: float = 0.5, weight_m: float = 0.5, fault: float = 300.0, steep: float = 15.0) -> DataFrame:
    """One of the MODES on pixels (scene, y, x, velocity, coherence; mineral for fusion_mineral; distance and slope, if there are
    any, for structural_attribution): the summary of the coherence, that of the moving clusters, the joint anomaly of each pixel
    (score, and high for the top twentieth), or the clusters with their kinds and codes."""
    columns = {c: F.col(c) for c in pixels.columns}
    if mode == "coherence_stability":
        return stability(pixels, limit=limit)
    if mode == "fusion_mineral":
        score = fusion(pixels, columns["velocity"], columns["mineral"], columns["coherence"], weight_v, weight_m, limit)
        scored = pixels.select("scene", "y", "x", score.alias("score"))
        over = quantiles(scored, F.col("score"), [0.95])[0]
        return scored.withColumn("high", F.coalesce(F.col("score") >= F.lit(over), F.lit(False)))
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    found, summary = clusters(pixels, columns["velocity"], columns["coherence"], least, limit, least_pixels=least_pixels)
    if mode == "velocity_cluster":
        return summary
    more = [c for c in ("distance", "slope") if c in columns]
    placed = found.join(pixels.select("scene", "y", "x", *more), ["scene", "y", "x"])
    return grid.attribute(placed, "velocity", *[c if c in more else None for c in ("distance", "slope")], fault=fault, steep=steep)
