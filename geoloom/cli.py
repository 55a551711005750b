"""Command line: ``python -m geoloom [PBF] [options]``."""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from geoloom.errors import OsmExtractSearchError, QueryNotGeocodedError
from geoloom.functions import region as regions
from geoloom.sources import extracts as sources

VERSION = "0.1.0"


def parse_ids(text: str) -> list[str]:
    ids = [t.strip() for t in text.split(",")]
    bad = [t for t in ids if not re.fullmatch(r"(node|way|relation)/\d+", t)]
    if bad:
        raise argparse.ArgumentTypeError(f"not an element id: {bad[0]!r}")
    return ids


def parse_tags(text: str) -> dict:
    from geoloom.functions.tags import check_filter

    try:
        tags = json.loads(text)
        check_filter(tags)
    except (ValueError, TypeError) as e:
        raise argparse.ArgumentTypeError(f"not a tags filter: {e}") from None
    return tags


def parse_file(text: str) -> regions.Region:
    """A file with GeoJSON, WKT or an Osmosis polygon."""
    body = Path(text).read_text()
    if text.endswith(".poly"):
        return sources.parse_poly(body.splitlines())
    return regions.from_geojson(body) if body.lstrip().startswith("{") else regions.from_wkt(body)


def geocode(query: str, fetch=sources.http_fetch) -> regions.Region:
    """The outline that the public geocoding service has for a name."""
    from urllib.parse import quote

    text = fetch(f"https://nominatim.openstreetmap.org/search?format=geojson&polygon_geojson=1&limit=5&q={quote(query)}")
    for f in json.loads(text or "{}").get("features", []):
        if f["geometry"]["type"] in ("Polygon", "MultiPolygon"):
            return regions.from_geojson(f)
    raise QueryNotGeocodedError(f"No outline was found for {query!r}.")


def _needs(library: str):
    def parse(text: str) -> regions.Region:
        try:
            module = __import__(library)
        except ImportError:
            raise argparse.ArgumentTypeError(f"cells of this grid need the library {library}") from None
        out: regions.Region = []
        for cell in text.split(","):
            corners = [(x, y) for y, x in module.cell_to_boundary(cell.strip())]
            out.append([[*corners, corners[0]]])
        return out

    return parse


def _checked(parse):
    def run(text: str) -> regions.Region:
        try:
            found = parse(text)
            regions.check_region(found)
        except argparse.ArgumentTypeError:
            raise
        except Exception as e:
            raise argparse.ArgumentTypeError(str(e)) from None
        return found

    return run


#: Options that give a region, and how each is read.
REGIONS = {
    "--geom-filter-bbox": regions.from_box, "--geom-filter-file": parse_file, "--geom-filter-geocode": geocode, "--geom-filter-geojson": regions.from_geojson,
    "--geom-filter-index-geohash": regions.from_geohash, "--geom-filter-index-h3": _needs("h3"), "--geom-filter-index-s2": _needs("s2"), "--geom-filter-wkt": regions.from_wkt,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("geoloom", description="OpenStreetMap data to features.")
    p.add_argument("pbf_file", nargs="?")
    filters = p.add_mutually_exclusive_group()
    filters.add_argument("--osm-tags-filter", type=parse_tags)
    filters.add_argument("--osm-tags-filter-file", type=lambda f: parse_tags(Path(f).read_text()))
    shapes = p.add_mutually_exclusive_group()
    for name, parse in REGIONS.items():
        shapes.add_argument(name, type=_checked(parse), dest="region", metavar=name.rsplit("-", 1)[1].upper())
    p.add_argument("--keep-all-tags", action="store_true")
    explode = p.add_mutually_exclusive_group()
    explode.add_argument("--explode-tags", action="store_true", default=None)
    explode.add_argument("--compact-tags", action="store_false", dest="explode_tags")
    p.add_argument("--custom-sql-filter")
    p.add_argument("--osm-extract-query")
    p.add_argument("--osm-extract-source", action="append")
    match = p.add_mutually_exclusive_group()
    match.add_argument("--select-first-match", action="store_true", default=True)
    match.add_argument("--only-single-match", action="store_false", dest="select_first_match")
    p.add_argument("--output", "-o", dest="result_file_path")
    p.add_argument("--duckdb", action="store_true")
    p.add_argument("--duckdb-table-name", default="features")
    p.add_argument("--compression", default="zstd")
    p.add_argument("--compression-level", type=int, default=3)
    p.add_argument("--row-group-size", type=int, default=100_000)
    p.add_argument("--parquet-version", choices=("v1", "v2"), default="v2")
    p.add_argument("--ignore-cache", action="store_true")
    p.add_argument("--working-directory", default="files")
    p.add_argument("--osm-way-polygon-config", type=lambda f: json.loads(Path(f).read_text()))
    p.add_argument("--filter-osm-ids", type=parse_ids)
    p.add_argument("--loose-ids", action="store_true", help="ids count for elements of every kind")
    p.add_argument("--empty-filter-keeps-all", action="store_true", help="a tags filter that merges to nothing is no filter")
    order = p.add_mutually_exclusive_group()
    order.add_argument("--sort", action="store_true", default=True)
    order.add_argument("--no-sort", action="store_false", dest="sort")
    p.add_argument("--sort-algorithm", choices=("str", "hilbert"), default="str")
    p.add_argument("--keep-metadata-tags", action="store_false", dest="ignore_metadata_tags")
    p.add_argument("--wkt-result", action="store_true")
    p.add_argument("--single-file", action="store_true", help="one file, by way of the driver, instead of a folder")
    loud = p.add_mutually_exclusive_group()
    loud.add_argument("--silent", action="store_true")
    loud.add_argument("--transient", action="store_true")
    p.add_argument("--iou-threshold", type=float, default=0.01)
    p.add_argument("--allow-uncovered-geometry", action="store_true")
    p.add_argument("--cpu-limit", type=int)
    p.add_argument("--show-extracts", action="store_true")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def main(argv: list[str] | None = None, spark=None, **hooks) -> int:
    """Run a command; ``hooks`` (fetch, fetch_bytes) stand for the network in tests."""
    p = parser()
    a = p.parse_args(argv)
    source = a.osm_extract_source or [sources.Source.any]
    if a.show_extracts:
        from geoloom.reader import display_available_extracts

        display_available_extracts(source, working_directory=a.working_directory, fetch=hooks.get("fetch", sources.http_fetch))
        return 0
    if a.pbf_file is None and a.osm_extract_query is None and a.region is None:
        p.error("a PBF file, an extract query or a region is needed")
    if not 0 <= a.iou_threshold <= 1:
        p.error("the IoU threshold is between 0 and 1")
    from pyspark.sql import SparkSession

    from geoloom.reader import OsmReader

    if spark is None:
        builder = SparkSession.builder.appName("geoloom")
        spark = (builder.master(f"local[{a.cpu_limit}]") if a.cpu_limit else builder).getOrCreate()
    reader = OsmReader(
        spark, a.osm_tags_filter or a.osm_tags_filter_file, a.region, a.custom_sql_filter, a.working_directory, a.osm_way_polygon_config, a.compression, a.compression_level,
        a.row_group_size, a.parquet_version, source, a.iou_threshold, a.allow_uncovered_geometry, a.ignore_metadata_tags, not a.silent, a.cpu_limit, a.loose_ids, a.empty_filter_keeps_all, **hooks,
    )
    tags = {"keep_all_tags": a.keep_all_tags, "explode_tags": a.explode_tags, "ids": a.filter_osm_ids}
    as_duckdb = a.duckdb or (a.result_file_path or "").endswith((".duckdb", ".db"))
    try:
        paths = a.pbf_file or (reader.extract_by_name(a.osm_extract_query, a.select_first_match) if a.osm_extract_query else None)
        if as_duckdb:
            to = reader.pbf_to_duckdb(paths, a.result_file_path, a.duckdb_table_name, **tags) if paths else reader.region_to_duckdb(a.result_file_path, a.duckdb_table_name, **tags)
        else:
            more = {"sort": a.sort and not a.wkt_result, "algorithm": a.sort_algorithm, "ignore_cache": a.ignore_cache, "wkt": a.wkt_result, "single_file": a.single_file}
            to = reader.pbf_to_parquet(paths, a.result_file_path, **tags, **more) if paths else reader.region_to_parquet(a.result_file_path, **tags, **more)
    except OsmExtractSearchError as e:
        print(e, file=sys.stderr)
        return 1
    if not a.silent:
        print(to)
    return 0
