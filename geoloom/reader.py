"""From PBF files, regions or extract names to features: the reader and one-call functions."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from geoloom import sink
from geoloom.functions import region as regions
from geoloom.functions import tags as tag_functions
from geoloom.functions.jts import DriverGeometry
from geoloom.operators import dedupe
from geoloom.operators import extracts as search
from geoloom.plans.features import all_features
from geoloom.plans.references import resolve
from geoloom.sources import extracts as sources
from geoloom.sources import files
from geoloom.sources.pbf import read_pbf


@dataclass
class OsmReader:
    """Reads OpenStreetMap data into features.

    ``tags_filter``: see :mod:`geoloom.functions.tags`. ``region``: list of polygons (:mod:`geoloom.functions.region`).
    ``sql_filter``: a Spark SQL predicate on id, kind and the tags without metadata. ``polygon_config``: a dict with ``all``, ``allowlist`` and
    ``denylist`` that says which closed ways are areas. ``cpu_limit``: partitions of a single-machine read.
    ``loose_ids``: ids count for elements of every kind. ``empty_filter_keeps_all``: a filter that merges to nothing (of wildcards without a
    match, say) is no filter, rather than one that nothing passes.
    """

    spark: SparkSession
    tags_filter: dict | None = None
    region: regions.Region | None = None
    sql_filter: str | None = None
    working_directory: str = "files"
    polygon_config: dict | None = None
    compression: str = sink.COMPRESSION
    compression_level: int = sink.LEVEL
    row_group_size: int = sink.ROW_GROUP
    parquet_version: str = "v2"
    extract_source: object = sources.Source.any
    min_iou: float = search.MIN_IOU
    allow_uncovered: bool = False
    ignore_metadata_tags: bool = True
    verbose: bool = False
    cpu_limit: int | None = None
    loose_ids: bool = False
    empty_filter_keeps_all: bool = False
    session_sql: tuple[str, ...] = ()
    fetch: Callable = field(default=sources.http_fetch, repr=False)
    fetch_bytes: Callable | None = field(default=None, repr=False)
    _held: list[DataFrame] = field(default_factory=list, init=False, repr=False)

    def __post_init__(self) -> None:
        if self.tags_filter is not None:
            tag_functions.check_filter(self.tags_filter)
        if self.region is not None:
            regions.check_region(self.region)
        if self.polygon_config is not None:
            check_polygon_config(self.polygon_config)
        if self.parquet_version not in ("v1", "v2"):
            raise ValueError("The parquet version is v1 or v2.")
        if not 0 <= self.min_iou <= 1:
            raise ValueError("The least intersection over union is between 0 and 1.")
        for statement in self.session_sql:
            self.spark.sql(statement)

    # ---- features

    def features(self, elements: DataFrame, ids: Iterable[str] | None = None, keep_all_tags: bool = False, explode_tags: bool | None = None, region: regions.Region | None = None) -> DataFrame:
        """Features of an element table, with tags in the form asked for."""
        expanded = tag_functions.expand_filter(elements, self.tags_filter) if self.tags_filter is not None else None
        flat = tag_functions.merge_filter(expanded) if expanded is not None else None
        if flat == {} and self.empty_filter_keeps_all:
            expanded = flat = None
        bundle = resolve(elements, flat, self.sql_filter, ids, region if region is not None else self.region, self.ignore_metadata_tags, self.loose_ids)
        return tag_functions.project_tags(all_features(bundle, self.polygon_config), expanded, keep_all_tags, explode_tags)

    def _elements(self, path: str) -> DataFrame:
        """Elements of a file, decoded once and kept on the executors' disks; lost parts are decoded again."""
        elements = read_pbf(self.spark, path)
        if self.cpu_limit:
            elements = elements.coalesce(self.cpu_limit)
        return self._hold(elements)

    def _hold(self, frame: DataFrame) -> DataFrame:
        """Keep a frame that several jobs read; :meth:`release` lets it go."""
        self._held.append(frame.persist(StorageLevel.DISK_ONLY))
        return frame

    def release(self) -> None:
        """Give back what reads have kept on the executors' disks; frames read before are then made anew when used."""
        while self._held:
            self._held.pop().unpersist()

    def read(self, paths: str | Iterable[str], ids: Iterable[str] | None = None, keep_all_tags: bool = False, explode_tags: bool | None = None, extract_regions: list[regions.Region] | None = None) -> DataFrame:
        """Features of one or several files; those in several files once, from the largest file that has them."""
        paths = [str(paths)] if isinstance(paths, (str, Path)) else [str(p) for p in paths]
        if extract_regions is not None and len(extract_regions) != len(paths):
            raise ValueError("There are as many extract regions as files, or none.")
        ids = list(ids) if ids else None
        paths = [sources.download(p, self.working_directory, self.fetch_bytes) if sources.is_url(p) else p for p in paths]
        parts = []
        for k, path in enumerate(paths):
            clip = None
            if self.region is not None and extract_regions is not None:
                g = DriverGeometry(self.spark)
                clip = g.region(g.of(self.region).intersection(g.of(extract_regions[k]))) or None
                if clip is None:
                    continue
            self.spark.sparkContext.setJobDescription(f"features of {path}")
            parts.append((-files.size(path), self.features(self._elements(path), ids, keep_all_tags, explode_tags, clip)))
        if not parts:
            return self.spark.createDataFrame([], "feature_id string, geometry binary")
        frames = [f for _, f in sorted(parts, key=lambda p: p[0])]
        # counting nulls, finding the order and writing all read the features: they are assembled once
        return tag_functions.drop_null_columns(self._hold(dedupe.combine(frames)))

    # ---- results

    def _name(self, names: list[str] | None, result: str | None, keep_all: bool, explode: bool | None, ids, wkt: bool, ordered: bool) -> str:
        explode = tag_functions.explodes(self.tags_filter, keep_all, explode)
        return result or files.join(str(self.working_directory), sink.result_name(names, self.tags_filter, self.sql_filter, self.ignore_metadata_tags, keep_all, explode, self.region, ids, wkt, ordered, self._switches(ids)))

    def _switches(self, ids) -> str:
        """What the name of a result adds for switches that change it."""
        return ("_loose" if self.loose_ids and ids else "") + ("_allifempty" if self.empty_filter_keeps_all and self.tags_filter is not None else "")

    def _write(self, features: DataFrame, path: str, wkt: bool, order: str | None, single_file: bool) -> str:
        files.make_parent(path)
        box = regions.bounds(self.region) if self.region else None
        try:
            if wkt:
                return sink.write_wkt(features, path, self.compression)
            return sink.write_geoparquet(features, path, single_file, self.compression, self.compression_level, self.row_group_size, self.parquet_version, order, box)
        finally:
            self.release()

    def pbf_to_parquet(self, paths, result: str | None = None, keep_all_tags: bool = False, explode_tags: bool | None = None, sort: bool = True, algorithm: str = "str", ignore_cache: bool = False, ids: Iterable[str] | None = None, wkt: bool = False, extract_regions: list | None = None, single_file: bool = False) -> str:
        """Write features to parquet and return the path; a result that is there already is used again.

        The result is a folder that the executors write; a ``single_file`` passes through the driver.
        """
        if sort and wkt:
            raise ValueError("A result as text can't be sorted spatially.")
        names = [str(paths)] if isinstance(paths, (str, Path)) else [str(p) for p in paths]
        ids = list(ids) if ids else None
        path = self._name(names, result, keep_all_tags, explode_tags, ids, wkt, sort)
        if not ignore_cache:
            if files.exists(path):
                return path
            old = files.with_ending(path, ".geoparquet")
            if files.exists(old):
                warnings.warn("A result with the older ending .geoparquet is used.", DeprecationWarning, stacklevel=2)
                return old
        return self._write(self.read(names, ids, keep_all_tags, explode_tags, extract_regions), path, wkt, algorithm if sort else None, single_file)

    def pbf_to_pandas(self, paths, **options):
        try:
            return sink.to_pandas(self.read(paths, **options))
        finally:
            self.release()

    def pbf_to_duckdb(self, paths, result: str | None = None, table: str = "features", **options) -> str:
        names = [str(paths)] if isinstance(paths, (str, Path)) else [str(p) for p in paths]
        name = self._name(names, None, options.get("keep_all_tags", False), options.get("explode_tags"), options.get("ids"), False, False)
        path = result or files.with_ending(name, ".duckdb")
        files.make_parent(path)
        try:
            return sink.write_duckdb(self.read(names, **options), path, table)
        finally:
            self.release()

    def pbf_to_table(self, paths, table: str, **options) -> str:
        try:
            return sink.write_table(self.read(paths, **options), table)
        finally:
            self.release()

    # ---- extracts

    @property
    def index_cache(self) -> str:
        return files.join(str(self.working_directory), "indexes")

    def _get(self, extract: sources.Extract) -> str | None:
        try:
            return sources.download(extract.url, self.working_directory, self.fetch_bytes)
        except OSError:
            return None

    def find_extracts(self) -> list[tuple[sources.Extract, str]]:
        """Downloaded extracts that cover the region."""
        if self.region is None:
            raise AttributeError("A region is needed to find extracts.")
        index = sources.load_indexes(self.extract_source, self.index_cache, self.fetch)
        return search.available_cover(DriverGeometry(self.spark), index, self.region, self._get, min_iou=self.min_iou, allow_uncovered=self.allow_uncovered)

    def extract_by_name(self, query: str, first: bool = True) -> str:
        index = sources.load_indexes(self.extract_source, self.index_cache, self.fetch)
        return search.available_by_name(index, query, self._get, first)

    def region_to_parquet(self, result: str | None = None, **options) -> str:
        """Features in the region, from extracts found for it."""
        found = self.find_extracts()
        path = self._name(None, result, options.get("keep_all_tags", False), options.get("explode_tags"), options.get("ids"), options.get("wkt", False), options.get("sort", True))
        return self.pbf_to_parquet([p for _, p in found], path, extract_regions=[e.geometry for e, _ in found], **options)

    def region_to_pandas(self, **options):
        found = self.find_extracts()
        return self.pbf_to_pandas([p for _, p in found], extract_regions=[e.geometry for e, _ in found], **options)

    def region_to_duckdb(self, result: str | None = None, table: str = "features", **options) -> str:
        found = self.find_extracts()
        return self.pbf_to_duckdb([p for _, p in found], result, table, extract_regions=[e.geometry for e, _ in found], **options)


def check_polygon_config(config: dict) -> None:
    lists = lambda d: isinstance(d, dict) and all(isinstance(k, str) and all(isinstance(v, str) for v in vs) for k, vs in d.items())
    if set(config) != {"all", "allowlist", "denylist"} or not all(isinstance(k, str) for k in config["all"]) or not lists(config["allowlist"]) or not lists(config["denylist"]):
        raise ValueError("A polygon config has all (keys), allowlist and denylist (values by key).")


_CALL = {"keep_all_tags", "explode_tags", "sort", "algorithm", "ignore_cache", "ids", "wkt", "single_file", "extract_regions"}


def _split(options: dict) -> tuple[dict, dict]:
    return {k: v for k, v in options.items() if k not in _CALL}, {k: v for k, v in options.items() if k in _CALL}


def convert_pbf_to_parquet(spark: SparkSession, paths, result: str | None = None, **options) -> str:
    own, call = _split(options)
    return OsmReader(spark, **own).pbf_to_parquet(paths, result, **call)


def convert_pbf_to_pandas(spark: SparkSession, paths, **options):
    own, call = _split(options)
    return OsmReader(spark, **own).pbf_to_pandas(paths, **call)


def convert_pbf_to_duckdb(spark: SparkSession, paths, result: str | None = None, table: str = "features", **options) -> str:
    own, call = _split(options)
    return OsmReader(spark, **own).pbf_to_duckdb(paths, result, table, **call)


def convert_region_to_parquet(spark: SparkSession, region: regions.Region, result: str | None = None, **options) -> str:
    own, call = _split(options)
    return OsmReader(spark, region=region, **own).region_to_parquet(result, **call)


def convert_region_to_pandas(spark: SparkSession, region: regions.Region, **options):
    own, call = _split(options)
    return OsmReader(spark, region=region, **own).region_to_pandas(**call)


def convert_region_to_duckdb(spark: SparkSession, region: regions.Region, result: str | None = None, table: str = "features", **options) -> str:
    own, call = _split(options)
    return OsmReader(spark, region=region, **own).region_to_duckdb(result, table, **call)


def convert_extract_to_parquet(spark: SparkSession, query: str, result: str | None = None, first: bool = True, **options) -> str:
    own, call = _split(options)
    reader = OsmReader(spark, **own)
    return reader.pbf_to_parquet(reader.extract_by_name(query, first), result, **call)


def convert_extract_to_pandas(spark: SparkSession, query: str, first: bool = True, **options):
    own, call = _split(options)
    reader = OsmReader(spark, **own)
    return reader.pbf_to_pandas(reader.extract_by_name(query, first), **call)


def convert_extract_to_duckdb(spark: SparkSession, query: str, result: str | None = None, table: str = "features", first: bool = True, **options) -> str:
    own, call = _split(options)
    reader = OsmReader(spark, **own)
    return reader.pbf_to_duckdb(reader.extract_by_name(query, first), result, table, **call)


def display_available_extracts(source=sources.Source.any, full_names: bool = False, working_directory: str = "files", fetch: Callable = sources.http_fetch) -> None:
    """Print the extracts that services offer, as trees."""
    for s in sources.resolve_sources(source):
        print("\n".join(sources.tree_lines(sources.load_index(s, files.join(str(working_directory), "indexes"), fetch), s.value, full_names)))
