"""Results: GeoParquet, WKT parquet, tables; their names and metadata."""

from __future__ import annotations

import hashlib
import json
import warnings
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.errors import EmptyResultWarning
from geoloom.functions import jts
from geoloom.functions import region as regions
from geoloom.functions.wkb import wkb_envelope, wkb_to_wkt, wkb_type
from geoloom.operators import ordering
from geoloom.schema import FEATURE_ID, GEOMETRY
from geoloom.sources.files import opened

VERSION = "0.2.0"
COMPRESSION, LEVEL, ROW_GROUP = "zstd", 3, 100_000


#: Longitude and latitude on WGS 84, as PROJ JSON (fixed values).
CRS = {
    "$schema": "https://proj.org/schemas/v0.7/projjson.schema.json", "type": "GeographicCRS", "name": "WGS 84 (CRS84)",
    "datum": {"type": "GeodeticReferenceFrame", "name": "World Geodetic System 1984", "ellipsoid": {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563}},
    "coordinate_system": {"subtype": "ellipsoidal", "axis": [
        {"name": "Geodetic longitude", "abbreviation": "Lon", "direction": "east", "unit": "degree"},
        {"name": "Geodetic latitude", "abbreviation": "Lat", "direction": "north", "unit": "degree"},
    ]},
    "id": {"authority": "OGC", "code": "CRS84"},
}


def geo_metadata(types: list[str], box: tuple[float, float, float, float] | None, encoding: str = "WKB", creator: str = "geoloom") -> str:
    """The ``geo`` entry of a GeoParquet 1.1.0 file."""
    column = {"encoding": encoding, "crs": CRS, "geometry_types": sorted(types)}
    if box is not None:
        column["bbox"] = list(box)
    return json.dumps({"version": "1.1.0", "primary_column": GEOMETRY, "columns": {GEOMETRY: column}, "creator": {"library": creator, "version": VERSION}})


def box_of(geometry: str) -> Column:
    """struct x_min, y_min, x_max, y_max."""
    return jts.box(F.col(geometry)) if jts.install(SparkSession.active()) else wkb_envelope(geometry)


def summary(features: DataFrame) -> DataFrame:
    """One row: the extent of all features and their geometry types."""
    rows = features.select(box_of(GEOMETRY).alias("e"), wkb_type(GEOMETRY).alias("t"))
    sides = [f(f"e.{c}").alias(c) for f, c in ((F.min, "x_min"), (F.min, "y_min"), (F.max, "x_max"), (F.max, "y_max"))]
    return rows.agg(*sides, F.sort_array(F.collect_set("t")).alias("types"))


def describe(features: DataFrame) -> tuple[list[str], tuple[float, float, float, float] | None]:
    """Geometry types and extent of all features, in one aggregation."""
    r = summary(features).first()
    return list(r.types), None if r.x_min is None else tuple(r[:4])


def with_centre(features: DataFrame) -> DataFrame:
    e = features.withColumn("__e", box_of(GEOMETRY))
    return e.withColumn("__x", (F.col("__e.x_min") + F.col("__e.x_max")) / 2).withColumn("__y", (F.col("__e.y_min") + F.col("__e.y_max")) / 2).drop("__e")


def sort_spatially(features: DataFrame, algorithm: str = "str", box: tuple | None = None) -> DataFrame:
    """``str``: sort-tile-recursive; ``hilbert``: along the curve, in the region's box or the data's."""
    rows = with_centre(features)
    if algorithm == "hilbert":
        done = ordering.sort_by_hilbert(rows, "__x", "__y", box)
    elif algorithm == "str":
        done = ordering.sort_by_tiles(rows, "__x", "__y")
    else:
        raise ValueError(f"Unknown order {algorithm!r}; there are str and hilbert.")
    return done.drop("__x", "__y")


def stamp_file(source: str, target: str, geo: str, compression: str = COMPRESSION, level: int | None = LEVEL, row_group: int = ROW_GROUP, version: str = "2.6") -> None:
    """Rewrite a parquet file, or a folder of them as one file, with the ``geo`` entry; a row group at a time."""
    system, inner = opened(source)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        files = sorted(f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".parquet"))
    else:
        files = [inner]
    schema = pq.read_schema(files[0], filesystem=system)
    meta = {k: v for k, v in (schema.metadata or {}).items() if not k.startswith(b"org.apache.spark")}
    schema = schema.with_metadata(meta | {b"geo": geo.encode()})
    out_system, out = opened(target)
    part = out + ".part"
    options = {"compression_level": level} if level is not None and compression in ("zstd", "gzip", "brotli") else {}
    with pq.ParquetWriter(part, schema, filesystem=out_system, compression=compression, version=version, data_page_version="2.0" if version != "1.0" else "1.0", **options) as writer:
        held: list[pa.RecordBatch] = []
        rows = 0
        for f in files:
            for b in pq.ParquetFile(f, filesystem=system).iter_batches(batch_size=row_group):
                held.append(b)
                rows += b.num_rows
                if rows >= row_group:
                    writer.write_table(pa.Table.from_batches(held).cast(schema), row_group_size=row_group)
                    held, rows = [], 0
        if held:
            writer.write_table(pa.Table.from_batches(held).cast(schema), row_group_size=row_group)
    out_system.move(part, out)


def write_geoparquet(features: DataFrame, path: str, single_file: bool = False, compression: str = COMPRESSION, level: int = LEVEL, row_group: int = ROW_GROUP, version: str = "v2", order: str | None = None, box: tuple | None = None) -> str:
    """Features as GeoParquet: a folder of files that the executors write and stamp, or one file that the driver joins.

    A single file passes through the driver a row group at a time; folders are the form for large results.
    """
    if order:
        features = sort_spatially(features, order, box)
    raw = f"{path}.parts"
    features.write.mode("overwrite").option("compression", compression if compression in ("zstd", "snappy", "gzip", "none") else "zstd").option("parquet.compression.codec.zstd.level", level).parquet(raw)
    spark = features.sparkSession
    written = spark.read.parquet(raw)
    types, extent = describe(written)
    if extent is None:
        warnings.warn("The result is empty.", EmptyResultWarning, stacklevel=2)
    geo, number = geo_metadata(types, extent), "1.0" if version == "v1" else "2.6"
    system, inner = opened(raw)
    if single_file:
        stamp_file(raw, path, geo, compression, level, row_group, number)
    else:
        out_system, out = opened(path)
        out_system.create_dir(out)
        files = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".parquet")]
        scheme = raw[: raw.index(inner)] if "://" in raw else ""

        def stamp(batches):
            for b in batches:
                for f in b.column(0).to_pylist():
                    stamp_file(scheme + f, f"{path}/{f.rsplit('/', 1)[-1]}", geo, compression, level, row_group, number)
                yield b

        spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files))).mapInArrow(stamp, "file string").count()
    system.delete_dir(inner)
    return path


def write_wkt(features: DataFrame, path: str, compression: str = COMPRESSION) -> str:
    """Features with their geometry as text."""
    features.withColumn(GEOMETRY, wkb_to_wkt(GEOMETRY)).write.mode("overwrite").option("compression", compression).parquet(path)
    return path


def write_table(features: DataFrame, name: str) -> str:
    features.write.mode("overwrite").saveAsTable(name)
    return name


def write_duckdb(features: DataFrame, path: str, table: str = "features") -> str:
    """A table of a DuckDB file, by way of parquet."""
    import shutil

    import duckdb

    parts = f"{path}.parts"
    features.write.mode("overwrite").parquet(parts)
    with duckdb.connect(path) as c:
        quoted = '"' + table.replace('"', '""') + '"'
        c.execute(f"create or replace table {quoted} as select * from read_parquet('{parts}/*.parquet')")
    shutil.rmtree(parts)
    return path


def to_pandas(features: DataFrame):
    """Features by id, maps as dicts; for results that the driver can hold.

    With geopandas a frame of geometries with their reference system, without it one of their WKB.
    """
    frame = features.toPandas().set_index(FEATURE_ID)
    try:
        import geopandas
    except ImportError:
        return frame
    shapes = geopandas.GeoSeries.from_wkb(frame["geometry"].map(bytes), crs="EPSG:4326")
    return geopandas.GeoDataFrame(frame, geometry=shapes)


def _short(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:8]


def result_name(sources: list[str] | None, tags_filter=None, sql: str | None = None, ignore_metadata: bool = True, keep_all: bool = False, explode: bool = False, region: regions.Region | None = None, ids: list[str] | None = None, wkt: bool = False, ordered: bool = False, switches: str = "") -> str:
    """Name of a result, the same for the same request; without sources it starts with the region."""
    tags = "nofilter"
    if tags_filter is not None or sql or not ignore_metadata:
        tags = _short(json.dumps(tags_filter or {}) + (sql or "") + ("" if ignore_metadata else "_with_metadata")) + ("_alltags" if keep_all else "")
    clip = regions.region_hash(region)
    names = "_".join(Path(s).name.removesuffix(".osm.pbf") for s in sources) if sources else None
    head = f"{names}_{tags}_{clip}" if names else f"{clip}_{tags}"
    tail = f"_{_short(json.dumps(sorted(set(ids))))}" if ids else ""
    return f"{head}_{'exploded' if explode else 'compact'}{tail}{switches}{'_sorted' if ordered else ''}{'_wkt' if wkt else ''}.parquet"
