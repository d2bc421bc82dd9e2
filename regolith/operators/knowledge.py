"""Queries on the mineral knowledge base: targets for sensors, deposit types, candidates from structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regolith.functions.text import clean_ratio, normalized_sensor
from regolith.operators.batch import Target
from regolith.operators.unmixing import first_of

#: Fixed: multispectral sensors, in the order in which equals are preferred; and hyperspectral ones, which share absorption features.
SENSORS = ("ASTER", "Landsat8", "Sentinel2")
HYPERSPECTRAL = ("EnMAP", "PRISMA")
#: Fixed: bands of the sensors with red-edge bands that vegetation stress takes (red, three red-edge, near infrared), as wavelengths in
#: micrometres for the hyperspectral ones; and the stress target's specification.
RED_EDGE = {"Sentinel2": ("B4", "B5", "B6", "B7", "B8"), "EnMAP": (0.665, 0.705, 0.740, 0.783, 0.842), "PRISMA": (0.665, 0.705, 0.740, 0.783, 0.842)}
STRESS = {"priority": 1, "index": "ndre", "floor": 0.30}
#: Fixed: fallback order when the preferred sensor is not usable.
FALLBACK = ("ASTER", "Sentinel2", "Landsat8")
CONFIDENCE_BAND, NEARBY_BONUS = 0.12, 0.1


def pca_inputs(sensor: Column, declared: Column, inputs: Column, landsat: Column, criterion: Column) -> Column:
    """The input bands of a principal-component method for a sensor; null where there are none or no band criterion."""
    bands = F.when((sensor == "Landsat8") & (F.size(landsat) > 0), landsat).when((sensor == declared) | (sensor == "ASTER"), inputs)
    return F.when(criterion & (F.size(bands) > 0), bands)


def targets(alterations: DataFrame, sensor: Column) -> DataFrame:
    """alterations (deposit, mineral, priority, sensor_ratio, pca_sensor, input_bands, landsat_bands, has_criterion) with
    ratio_expr and pca_bands for a sensor, by priority and mineral; what neither method can find is left out."""
    ratio = clean_ratio(F.try_element_at(F.col("sensor_ratio"), sensor))
    pca = pca_inputs(sensor, F.col("pca_sensor"), F.col("input_bands"), F.col("landsat_bands"), F.col("has_criterion"))
    out = alterations.withColumns({"sensor": sensor, "priority": F.coalesce("priority", F.lit(2)), "ratio_expr": ratio, "pca_bands": pca})
    return out.where("ratio_expr IS NOT NULL OR pca_bands IS NOT NULL").orderBy("deposit", "priority", "mineral")


def sensor_methods(alterations: DataFrame) -> Column:
    """The methods of each mineral for every fixed sensor as an array of (rank, sensor, ratio_ok, pca_ok, depth_ok), as by_sensor gives them
    in rows; whatever one mineral needs of them takes no grouping."""

    def one(rank: int, name: str) -> Column:
        sensor, many = F.lit(name), name in HYPERSPECTRAL
        ratio, pca, depth = F.lit(False), F.lit(False), F.lit(False)
        if many and "enmap_feature" in alterations.columns:
            depth = F.col("enmap_feature").isNotNull()
        if not many:
            ratio = clean_ratio(F.try_element_at(F.col("sensor_ratio"), sensor)).isNotNull()
            pca = pca_inputs(sensor, F.col("pca_sensor"), F.col("input_bands"), F.col("landsat_bands"), F.col("has_criterion")).isNotNull()
        return F.struct(F.lit(rank).alias("rank"), sensor.alias("sensor"), ratio.alias("ratio_ok"), pca.alias("pca_ok"), depth.alias("depth_ok"))

    return F.array(*[one(rank, name) for rank, name in enumerate((*SENSORS, *HYPERSPECTRAL))])


def preferred_of(methods: Column, declared: Column) -> Column:
    """preferred_sensor for one mineral, of its methods (see sensor_methods) and the sensor that its components are declared for."""
    own = F.filter(methods, lambda m: m.pca_ok & (m.sensor == declared))
    counted = F.transform(methods, lambda m: F.struct((m.ratio_ok.cast("int") + m.pca_ok.cast("int")).alias("n"), (-m["rank"]).alias("place"), m.sensor.alias("sensor")))
    best = F.array_max(F.filter(counted, lambda m: m.n > 0))
    return F.coalesce(F.get(own, 0).sensor, best.sensor)


def able_of(methods: Column) -> Column:
    """The multispectral sensors that have a method."""
    return F.transform(F.filter(methods, lambda m: m.ratio_ok | m.pca_ok), lambda m: m.sensor)


def by_sensor(alterations: DataFrame) -> DataFrame:
    """The methods of each mineral for every sensor: a row for each of the fixed sensors (rank, ratio_ok, pca_ok, depth_ok). The
    hyperspectral ones have the absorption feature (enmap_feature) alone."""
    named = F.posexplode(F.array(*[F.lit(s) for s in (*SENSORS, *HYPERSPECTRAL)])).alias("rank", "sensor")
    rows = alterations.select("*", named)
    many = F.col("sensor").isin(*HYPERSPECTRAL)
    ratio = clean_ratio(F.try_element_at(F.col("sensor_ratio"), F.col("sensor"))).isNotNull()
    pca = pca_inputs(F.col("sensor"), F.col("pca_sensor"), F.col("input_bands"), F.col("landsat_bands"), F.col("has_criterion")).isNotNull()
    depth = F.col("enmap_feature").isNotNull() if "enmap_feature" in alterations.columns else F.lit(False)
    return rows.withColumns({"ratio_ok": ratio & ~many, "pca_ok": pca & ~many, "depth_ok": depth & many})


def multi_sensor(alterations: DataFrame, key: list[str]) -> DataFrame:
    """key (which tells the rows apart), deposit, mineral, priority, sensors (map of sensor to its methods) and preferred of each mineral
    that some sensor shows, by deposit, priority and mineral."""
    # Spread first, as few files are few tasks; one row each by explode, past which no filter takes the methods' terms again.
    own = alterations.repartition(*key).select("*", F.explode(F.array(sensor_methods(alterations))).alias("_m")).where(F.exists("_m", lambda m: m.ratio_ok | m.pca_ok | m.depth_ok))
    sensors = F.map_from_entries(F.transform("_m", lambda m: F.struct(m.sensor.alias("sensor"), F.struct(m.ratio_ok.alias("ratio_ok"), m.pca_ok.alias("pca_ok"), m.depth_ok.alias("depth_ok")).alias("methods"))))
    rows = own.select(*key, "deposit", "mineral", F.coalesce("priority", F.lit(2)).alias("priority"), sensors.alias("sensors"), preferred_of(F.col("_m"), F.col("pca_sensor")).alias("preferred"))
    return rows.orderBy("deposit", "priority", "mineral")


def present(sensors: Column, found: Column) -> Column:
    """data_present of each sensor that has a method: map of sensor to whether its data were found (found: array of sensors)."""
    return F.transform_values(F.map_filter(sensors, lambda k, v: v.ratio_ok | v.pca_ok | v.depth_ok), lambda k, v: F.array_contains(found, k))


def vegetation_target(sensor: str) -> Target | None:
    """The target of vegetation stress for jungle, which is the same for all deposits; None for sensors without red-edge bands. Its
    index and floor are STRESS."""
    name = sensor.replace("_L2", "").replace("Landsat8/9", "Landsat8")
    return Target("vegetation stress", STRESS["priority"], stress=RED_EDGE[name]) if name in RED_EDGE else None


def vegetation_targets(sensors: DataFrame) -> DataFrame:
    """sensors (a column sensor, with wire names) that have a vegetation target, with priority, stress_index and veg_floor."""
    own = sensors.where(normalized_sensor(F.col("sensor")).isin(*RED_EDGE))
    return own.withColumns({"priority": F.lit(STRESS["priority"]), "stress_index": F.lit(STRESS["index"]), "veg_floor": F.lit(STRESS["floor"])})


def commodities(types: DataFrame) -> DataFrame:
    """c_pos, commodity, commodity_en and category of all commodities in order (types: as sources.projects.read_types gives them)."""
    return types.select("c_pos", "commodity", F.coalesce("commodity_en", F.lit("")).alias("commodity_en"), F.coalesce("category", F.lit("")).alias("category")).distinct().orderBy("c_pos")


def deposit_types(types: DataFrame, commodity: str) -> DataFrame:
    """The deposit types of a commodity in order, of its first entry if there are several; none for an unknown one."""
    own = types.where(F.col("commodity") == commodity)
    first = own.agg(F.min("c_pos").alias("c_pos"))
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("type_en", "tectonic_setting", "alteration_zoning")]
    return own.join(F.broadcast(first), "c_pos").where("type_name IS NOT NULL").select("t_pos", "type_name", *texts).orderBy("t_pos")


def deposit_meta(types: DataFrame) -> DataFrame:
    """What is known of each deposit type by its first entry: commodity, texts, ore elements and host rocks."""
    first = first_of(types.where("type_name IS NOT NULL"), ["type_name"], ["c_pos", "t_pos"])
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("type_en", "commodity", "commodity_en", "category", "tectonic_setting", "alteration_zoning")]
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("ore_elements", "host_rocks")]
    return first.select("type_name", *texts, *lists)


def preferred_sensor(rows: DataFrame, key: list[str]) -> DataFrame:
    """key and preferred: the declared sensor if its components can be used, else the sensor with most methods (of equals the
    first), null without any."""
    methods = F.col("ratio_ok").cast("int") + F.col("pca_ok").cast("int")
    best = F.max_by(F.when(methods > 0, F.col("sensor")), F.struct(methods, -F.col("rank")))
    declared = F.max(F.when((F.col("sensor") == F.col("pca_sensor")) & F.col("pca_ok"), F.col("sensor")))  # hyperspectral ones have none
    return rows.groupBy(*key).agg(F.coalesce(declared, best).alias("preferred"))


def effective_sensor(preferred: Column, able: Column, usable: Column) -> Column:
    """The preferred sensor if usable, else the first fallback that is usable and has a method; arrays of sensors."""
    other = [F.when(F.array_contains(able, s) & F.array_contains(usable, s), F.lit(s)) for s in FALLBACK]
    return F.coalesce(F.when(F.array_contains(usable, preferred), preferred), *other)


def deposit_index(types: DataFrame) -> DataFrame:
    """The first entry of each deposit type by position."""
    return first_of(types, ["type_name"], ["pos"])


def best_by_overlap(areas: DataFrame, key: str, item: str) -> DataFrame:
    """For each key the item of the largest overlap, of equals the smallest item."""
    return areas.where("area > 0").groupBy(key).agg(F.max_by(item, F.struct("area", -F.col(item))).alias(item), F.max("area").alias("area"))


def evidence_text(evidence: Column, control: Column, fallback: Column) -> Column:
    """The evidence of a candidate (array of texts) as one text, with its control model; the fallback if there is neither."""
    joined = F.coalesce(F.array_join(evidence, "；"), F.lit(""))
    model = F.concat(F.lit("控矿模式:"), F.nullif(control, F.lit("")))
    both = F.when(model.isNull(), joined).when(joined == "", model).otherwise(F.concat(joined, F.lit("｜"), model))
    return F.coalesce(F.nullif(both, F.lit("")), fallback, F.lit(""))


def structural_candidates(candidates: DataFrame, mapping: DataFrame, known: DataFrame, region: str = "region", top: int = 3) -> DataFrame:
    """Deposit types of the knowledge base for the structural candidates of each region: candidates (region, pos,
    structure_type, confidence) close to the first one's confidence, mapped (structure_type, map_pos, deposit), kept if known, the
    best confidence of each to three places, at most `top`; of equals those that come first by pos and map_pos. An evidence column
    of the candidates comes along. None for a region whose first candidate maps to nothing known."""
    names = known.select("deposit").distinct()
    named = mapping.join(names, "deposit", "left_semi")
    first = first_of(candidates, [region], ["pos"]).select(region, F.col("structure_type").alias("first_type"), F.col("confidence").alias("first_confidence"))
    sound = first.join(named.select(F.col("structure_type").alias("first_type")).distinct(), "first_type", "left_semi")
    near = candidates.join(sound, region).where(F.col("first_confidence") - F.col("confidence") <= CONFIDENCE_BAND)
    place = F.struct("pos", "map_pos")
    rounded = F.round("confidence", 3)
    more = [F.max_by("evidence", F.struct(rounded, -F.col("pos"), -F.col("map_pos"))).alias("evidence")] if "evidence" in candidates.columns else []
    best = near.join(named, "structure_type").groupBy(region, "deposit").agg(F.max(rounded).alias("confidence"), F.min(place).alias("_place"), *more)
    w = Window.partitionBy(region).orderBy(F.desc("confidence"), "_place")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("_place")


def structural_states(regions: DataFrame, candidates: DataFrame, mapping: DataFrame, known: DataFrame, region: str = "region") -> DataFrame:
    """region, status, primary_model and primary_confidence (to three places) of every region: no_product without candidates,
    non_alteration where the first one maps to nothing known, else ok."""
    named = mapping.join(known.select("deposit").distinct(), "deposit", "left_semi").select(F.col("structure_type").alias("primary_model"), F.lit(True).alias("_known")).distinct()
    first = first_of(candidates, [region], ["pos"]).select(region, F.col("structure_type").alias("primary_model"), F.round("confidence", 3).alias("primary_confidence"))
    met = regions.select(region).distinct().join(first, region, "left").join(named, "primary_model", "left")
    status = F.when(F.col("primary_model").isNull(), "no_product").when(F.col("_known").isNull(), "non_alteration").otherwise("ok")
    return met.select(region, status.alias("status"), "primary_model", "primary_confidence")


def nearby_context(sites: DataFrame, codes: DataFrame, most: int = 8) -> DataFrame:
    """region, commodities (the distinct ones of its sites' codes, in order) and sample_sites (the first distinct names): sites
    (region, pos, name, codes) and codes (code, commodity)."""
    found = sites.select("region", F.explode("codes").alias("code")).distinct().join(codes.select("code", "commodity").distinct(), "code")
    sets = found.groupBy("region").agg(F.sort_array(F.collect_set("commodity")).alias("commodities"))
    named = sites.where("name <> ''").groupBy("region", "name").agg(F.min("pos").alias("pos"))
    ranked = named.withColumn("k", F.row_number().over(Window.partitionBy("region").orderBy("pos"))).where(F.col("k") <= most)
    samples = ranked.groupBy("region").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("sample_sites"))
    nothing = F.array().cast("array<string>")
    every = sites.select("region").distinct().join(sets, "region", "left").join(samples, "region", "left")
    return every.select("region", F.coalesce("commodities", nothing).alias("commodities"), F.coalesce("sample_sites", nothing).alias("sample_sites"))


def corroborated(candidates: DataFrame, nearby: DataFrame, top: int = 3) -> DataFrame:
    """candidates (region, pos, deposit, commodity, confidence) with the bonus where the region's nearby sites have the
    commodity; bounded by 1, to three places, the best `top` of each region, of equals the first by pos."""
    near = nearby.select("region", "commodity").distinct().withColumn("near", F.lit(True))
    bounded = F.greatest(F.least("confidence", F.lit(1.0)), F.lit(0.0))
    raised = F.round(F.least(bounded + F.when(F.col("near"), NEARBY_BONUS).otherwise(0.0), F.lit(1.0)), 3)
    rows = candidates.join(near, ["region", "commodity"], "left").withColumn("confidence", raised)
    w = Window.partitionBy("region").orderBy(F.desc("confidence"), "pos")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
