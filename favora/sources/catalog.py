"""Projects: finding layer files in folders, and a registry of sample tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from favora.functions.crs import reproject
from favora.sources import readers

#: In the order in which they are looked for; later files override earlier ones.
SUFFIXES = (".shp", ".csv", ".tec")
Key = tuple[str, str, str]


@dataclass(frozen=True)
class Project:
    """A configuration of criteria, components and layers, with the DataFrames found for them; never changed in place."""

    config: dict
    data: dict[Key, DataFrame] = field(default_factory=dict)
    models: dict[Key, DataFrame] = field(default_factory=dict)

    def layers(self) -> list[tuple[Key, dict]]:
        """Every layer's key and its metadata, in order."""
        return [((c, k, n), meta) for c, cv in self.config["criteria"].items() for k, kv in cv["components"].items() for n, meta in kv["layers"].items()]

    def with_data(self, key: Key, df: DataFrame) -> Project:
        """The project with a layer's data."""
        return replace(self, data={**self.data, key: df})

    def with_model(self, key: Key, df: DataFrame) -> Project:
        """The project with a layer's model."""
        return replace(self, models={**self.models, key: df})


def positive_marks(areas: DataFrame, column: str = "DN") -> DataFrame:
    """The areas whose mark is positive."""
    return areas.where(F.col(column) > 0)


def gather_data(spark: SparkSession, folder: str, project: Project, suffixes: tuple[str, ...] = SUFFIXES) -> Project:
    """Layers' files `folder/criteria/component/layer.suffix` as data; missing files leave a layer without."""
    for suffix in suffixes:
        if suffix not in SUFFIXES:
            print(f"unknown file type {suffix} is left out")
    for suffix in (s for s in SUFFIXES if s in suffixes):
        for key, meta in project.layers():
            path = f"{folder}/{key[0]}/{key[1]}/{key[2]}{suffix}"
            if not readers.exists(spark, path):
                continue
            at = [meta.get(c) for c in ("x_col", "y_col", "z_col")]
            df = readers.read_shapefile(spark, path) if suffix == ".shp" else readers.read_csv(spark, path, meta.get("crs", 4326), *at) if suffix == ".csv" else readers.read_tec(spark, path, *at)
            project = project.with_data(key, df)
    return project


def gather_processed_data(spark: SparkSession, folder: str, project: Project, crs: str | int) -> Project:
    """Files `layer_processed.csv` with a WKT geometry as models (x, y, z and the columns)."""
    for key, _ in project.layers():
        path = f"{folder}/{key[0]}/{key[1]}/{key[2]}_processed.csv"
        if readers.exists(spark, path):
            df = readers.read_csv(spark, path, crs, geometry_col="geometry")
            v = F.expr("geometry.parts[0][0][0]")
            project = project.with_model(key, df.withColumns({"x": v["x"], "y": v["y"], "z": v["z"]}))
    return project


def gather_exclusion_areas(spark: SparkSession, folder: str, layers: list[str], crs: str | int | None = None, target_crs: str | int | None = None) -> dict[str, DataFrame]:
    """Edges (gid, x0, y0, x1, y1) of the polygons with a positive DN in `folder/exclusion/layer.shp`, from `crs` to `target_crs`."""
    out = {}
    for name in layers:
        shapes = readers.read_shapefile(spark, f"{folder}/exclusion/{name}.shp")
        good = positive_marks(shapes.withColumn("DN", F.expr("try_cast(attributes['DN'] as double)")))
        ring = good.select("gid", F.explode("parts").alias("r"))
        sides = ring.select("gid", F.explode(F.arrays_zip(F.expr("slice(r, 1, size(r) - 1)").alias("a"), F.expr("slice(r, 2, size(r) - 1)").alias("b"))).alias("s"))
        edges = sides.select("gid", F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))
        if crs is not None and target_crs is not None:
            for x, y in (("x0", "y0"), ("x1", "y1")):
                moved = reproject(edges.withColumnsRenamed({x: "x", y: "y"}), crs, target_crs)
                edges = moved.withColumnsRenamed({"x": x, "y": y})
        out[name] = edges.select("gid", "x0", "y0", "x1", "y1")
    return out


def fetch(spark: SparkSession, registry: dict[str, str], dataset: str) -> DataFrame:
    """A named sample table from a registry of local paths; KeyError for an unknown name."""
    return spark.read.parquet(registry[dataset])


def clean_config(config: dict) -> str:
    """The configuration as JSON, without anything that isn't plain data."""
    plain = lambda v: {k: plain(x) for k, x in v.items() if not isinstance(x, DataFrame)} if isinstance(v, dict) else v
    return json.dumps(plain(config), indent=2)
