"""A store of runs in which a run is visible as a whole or not at all: a manifest, written last, publishes its tables.

Folders of the store: `attempts` holds what is being written, `data` the tables of runs, `manifests` a file for each visible run by its
id, `removed` one for each run that retention took out. Everything goes through Spark's own file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regolith.operators import runs

ITEM = ("sensor", "mineral", "method")
MANIFEST = "run_id string, created_at string, project string, deposit string, folder string, n_results long, n_layers long, n_pixels long, high_pixels long, usable_sensors array<string>, params map<string, string>, structural map<string, string>, warnings array<string>, schema_version int"
#: Runs of a project and deposit type that stay.
KEEP = 30
#: Seconds that a removed run's tables stay for those who read them, and that an attempt may take before it counts as abandoned.
GRACE, ABANDONED = 3600.0, 7 * 86400.0


class _Files:
    """The store's file system, as Spark has it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A file that is there as a whole or not at all; an error where one of its name is there already."""
        part = f"{name.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}.part"
        stream = self.fs.create(self.path(part), False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        if self.exists(name) or not self.fs.rename(self.path(part), self.path(name)):
            self.remove(part)
            raise FileExistsError(name)

    def move(self, name: str, to: str) -> None:
        self.fs.mkdirs(self.path(to).getParent())
        if not self.fs.rename(self.path(name), self.path(to)):
            raise OSError(f"{name} could not be moved to {to}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def listed(self, folder: str) -> list[tuple[str, float]]:
        """Names in a folder, and when each was last changed (seconds)."""
        if not self.exists(folder):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in self.fs.listStatus(self.path(folder)))


@dataclass
class Stored:
    """A visible run: its manifest, its results and its layers."""

    manifest: dict
    results: DataFrame
    layers: DataFrame


class RunStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), _Files(spark, root)

    def _manifest(self, run_id: str) -> str:
        """The place of a run's manifest: every id has one, within the store."""
        if not run_id:
            raise ValueError("a run needs an id")
        return f"{self.root}/manifests/run-{quote(run_id, safe='')}.json"

    def publish(self, run: Mapping[str, object], results: DataFrame, layers: DataFrame, keep: int = KEEP) -> dict:
        """Saves a run and makes it visible: run (run_id, created_at, project, deposit, and usable_sensors, params, structural or
        none), results (sensor, mineral, method, high_pixels and more) and layers (sensor, mineral, method, y, x and values).

        The tables are written apart first, layers in folders by sensor, mineral and method; then their folder gets its name, and the
        manifest, a single file that appears at once, makes the run visible. Who stops before leaves nothing visible, and of two who
        publish one id the second gets FileExistsError. Results without a layer are saved with a warning. At last, of this project's runs
        of this deposit type all but the newest `keep` are taken out (see prune); 0 keeps all.

        Returns run_id, n_results, n_layers, n_pixels, warnings and removed (the ids taken out)."""
        run_id, place = str(run["run_id"]), self._manifest(str(run["run_id"]))
        if self.files.exists(place):
            raise FileExistsError(run_id)
        attempt = f"{self.root}/attempts/{uuid.uuid4().hex}"
        try:
            layers.write.partitionBy(*ITEM).parquet(f"{attempt}/layers")
            written = self._read(f"{attempt}/layers", layers)
            counts = written.groupBy(*ITEM).agg(F.count("*").alias("n_pixels"))
            results.join(counts, list(ITEM), "left").write.parquet(f"{attempt}/results")
            saved = self.spark.read.parquet(f"{attempt}/results")
            high = F.sum("high_pixels") if "high_pixels" in results.columns else F.lit(None)
            total = saved.agg(F.count("*").alias("results"), F.count("n_pixels").alias("layers"), F.sum("n_pixels").alias("pixels"), high.cast("long").alias("high")).first()
            bare = saved.where("n_pixels IS NULL").select(*ITEM).orderBy(*ITEM).limit(100).collect()
            warnings = [f"no layer for {r.sensor} {r.mineral} {r.method}" for r in bare]
            folder = f"{quote(run_id, safe='')}-{uuid.uuid4().hex}"
            self.files.move(attempt, f"{self.root}/data/{folder}")
        except BaseException:
            self.files.remove(attempt)
            raise
        manifest = {
            "run_id": run_id, **{k: str(run[k]) for k in ("created_at", "project", "deposit")}, "folder": folder, "n_results": total.results, "n_layers": total.layers, "n_pixels": total.pixels or 0,
            "high_pixels": total.high or 0, "usable_sensors": list(run.get("usable_sensors") or []), "params": {k: str(v) for k, v in (run.get("params") or {}).items()},
            "structural": self._structural(run.get("structural")), "warnings": warnings, "schema_version": runs.SCHEMA_VERSION,
        }
        try:
            self._show(place, manifest)
        except BaseException:
            self.files.remove(f"{self.root}/data/{folder}")
            raise
        removed = self.prune(keep, manifest["project"], manifest["deposit"]) if keep > 0 else []
        return {"run_id": run_id, "n_results": total.results, "n_layers": total.layers, "n_pixels": total.pixels or 0, "warnings": warnings, "removed": removed}

    def _show(self, place: str, manifest: dict) -> None:
        self.files.fs.mkdirs(self.files.path(place).getParent())
        self.files.put(place, json.dumps(manifest, ensure_ascii=False))

    def _structural(self, structural: Mapping[str, object] | None) -> dict[str, str] | None:
        """Without the embedded rose diagram, but with whether there is one."""
        if not structural:
            return None
        bare = {k: str(v) for k, v in structural.items() if k != "rose_diagram"}
        return {**bare, "rose_diagram_present": str(bool(structural.get("rose_diagram"))).lower()}

    def _read(self, path: str, like: DataFrame | None = None) -> DataFrame:
        """Layers as they were written: sensors and minerals are texts, whatever they look like."""
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        found = reader.option("basePath", path).parquet(path)
        return found.withColumns({c: F.col(c).cast("string") for c in ITEM})

    def visible(self) -> DataFrame:
        """The manifests of all visible runs; damaged files are left out."""
        folder = f"{self.root}/manifests"
        if not any(name.startswith("run-") for name, _ in self.files.listed(folder)):
            return self.spark.createDataFrame([], MANIFEST)
        read = self.spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").option("pathGlobFilter", "run-*.json")
        return read.json(folder).where("run_id IS NOT NULL")

    def load(self, run_id: str) -> Stored | None:
        """A run by its id: one file tells where its tables are, and nothing else is listed. None where it is not visible."""
        place = self._manifest(run_id)
        if not self.files.exists(place):
            return None
        manifest = json.loads(self.files.read(place))
        folder = f"{self.root}/data/{manifest['folder']}"
        return Stored(manifest, self.spark.read.parquet(f"{folder}/results"), self._read(f"{folder}/layers"))

    def latest(self) -> DataFrame:
        return runs.latest(self.visible())

    def prune(self, keep: int, project: str | None = None, deposit: str | None = None) -> list[str]:
        """Takes out the runs that runs.surplus() lists, of one project and deposit type or of all, and returns their ids.

        A run's manifest goes, so nobody finds it any more; its tables stay until sweep() for those who have it open. A run that another
        writer took out meanwhile is passed over. keep of 0 or less keeps all."""
        own = self.visible()
        for name, value in (("project", project), ("deposit", deposit)):
            own = own if value is None else own.where(F.col(name) == value)
        out = []
        for r in runs.surplus(own, keep).select("run_id", "folder").collect():
            place = self._manifest(r.run_id)
            note = f"{self.root}/removed/{r.folder}.json"
            if not self.files.exists(place):
                continue
            self.files.fs.mkdirs(self.files.path(note).getParent())
            if not self.files.exists(note):
                self.files.put(note, json.dumps({"run_id": r.run_id, "folder": r.folder, "at": time.time()}))
            self.files.remove(place)
            out.append(r.run_id)
        return sorted(out)

    def sweep(self, grace: float = GRACE, abandoned: float = ABANDONED) -> list[str]:
        """Removes the tables of runs that were taken out over `grace` seconds ago, tables that no manifest came to name in that time,
        and attempts that nobody has touched for `abandoned` seconds. Returns the names of the folders."""
        now, out = time.time(), []
        named = {r.folder for r in self.visible().select("folder").collect()}
        for name, changed in self.files.listed(f"{self.root}/data"):
            note = f"{self.root}/removed/{name}.json"
            since = json.loads(self.files.read(note))["at"] if self.files.exists(note) else changed
            if name not in named and now - since >= grace:
                self.files.remove(f"{self.root}/data/{name}")
                self.files.remove(note)
                out.append(name)
        for name, changed in self.files.listed(f"{self.root}/attempts"):
            if now - changed >= abandoned:
                self.files.remove(f"{self.root}/attempts/{name}")
                out.append(name)
        return out
