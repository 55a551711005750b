"""Indexes of ready-made extracts: what services publish, parsed into one table.

Pages and files come through a ``fetch`` function (url -> text, None if missing), so parsers need no network. An index is
(id, name, file_name, parent, geometry as a region, area in km2, url), in order of area and id.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import time
import unicodedata
import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from enum import Enum
from html.parser import HTMLParser
from pathlib import Path
from urllib.error import HTTPError, URLError
from urllib.parse import urljoin, urlparse
from urllib.request import Request, urlopen

from geoloom.errors import MissingOsmCacheWarning, OldOsmCacheWarning, OsmExtractsIndexesUnavailableError, OsmExtractSourceUnavailableWarning
from geoloom.functions import region as regions
from geoloom.sources import files

Fetch = Callable[[str], str | None]

#: Where the services publish.
GEOFABRIK = "https://download.geofabrik.de/index-v1.json"
BBBIKE = "https://download.bbbike.org/osm/bbbike"
BBBIKE_CITIES = "https://raw.githubusercontent.com/wosch/bbbike-world/world/etc/cities.csv"
OSM_FR, OSM_FR_POLYGONS = "https://download.openstreetmap.fr/extracts", "https://download.openstreetmap.fr/polygons"
GEO2DAY = "https://geo2day.com/"
MOVISDA_ADMIN, MOVISDA_GRID = "https://osm.download.movisda.io/admin", "https://osm.download.movisda.io/grid"

OUTDATED_DAYS = 365


class Source(str, Enum):
    any = "any"
    bbbike = "BBBike"
    geofabrik = "Geofabrik"
    osm_fr = "osmfr"
    geo2day = "GEO2Day"
    movisda_admin = "Movisda-admin"
    movisda_grid = "Movisda-grid"

    @classmethod
    def _missing_(cls, value):
        return next((m for m in cls if str(value).lower() == m.value.lower()), None)


@dataclass(frozen=True)
class Extract:
    id: str
    name: str
    parent: str
    url: str
    geometry: regions.Region = field(repr=False)
    file_name: str = ""
    area: float = 0.0


def resolve_sources(source: Source | str | Iterable[Source | str]) -> list[Source]:
    """Sources named by a value, a comma-separated text or a collection; ``any`` is all of them; in order, without repeats."""
    parts = [source] if isinstance(source, (str, Source)) else list(source)
    names = [n for p in parts for n in ([p] if isinstance(p, Source) else p.split(","))]
    out: dict[Source, None] = {}
    for name in names:
        if isinstance(name, str) and not isinstance(name, Source) and not name.strip():
            continue
        found = name if isinstance(name, Source) else Source(name.strip())
        out.update(dict.fromkeys([s for s in Source if s is not Source.any] if found is Source.any else [found]))
    if not out:
        raise ValueError("No source of extracts is named.")
    return list(out)


# ---- files


def http_fetch(url: str, timeout: float = 30) -> str | None:
    try:
        with urlopen(Request(url, headers={"User-Agent": "geoloom"}), timeout=timeout) as answer:
            return answer.read().decode("utf-8")
    except HTTPError as e:
        if e.code == 404:
            return None
        raise


def parse_poly(lines: Iterable[str]) -> regions.Region:
    """Osmosis polygon file: a name, then rings up to END; those named with ``!`` are holes of the ring before."""
    out: regions.Region = []
    ring: list | None = None
    for line in list(lines)[1:]:
        word = line.strip()
        if ring is None:
            if word == "END":
                break
            if not word:
                continue
            ring = []
            if word.startswith("!") and out:
                out[-1].append(ring)
            else:
                out.append([ring])
        elif word == "END":
            if ring and ring[0] != ring[-1]:
                ring.append(ring[0])
            ring = None
        elif word:
            ring.append(tuple(float(v) for v in word.split()[:2]))
    return out


def fetch_poly(fetch: Fetch, url: str) -> regions.Region | None:
    text = fetch(url)
    return None if text is None else parse_poly(text.splitlines())


class _Table(HTMLParser):
    """Links of a page, with the class of their table row and whether that has a folder's icon."""

    def __init__(self, text: str):
        super().__init__()
        self.links: list[dict] = []
        self._row, self._link, self._in_row = {}, None, []
        self.feed(text)
        self._end_row()

    def _end_row(self) -> None:
        for link in self._in_row:
            link |= {"row": self._row.get("class", ""), "folder": self._row.get("folder", False)}
        self._in_row, self._row = [], {}

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "tr":
            self._end_row()
            self._row = {"class": attrs.get("class") or ""}
        elif tag == "img" and "folder" in (attrs.get("src") or ""):
            self._row["folder"] = True
        elif tag == "a" and attrs.get("href"):
            self._link = {"href": attrs["href"], "text": "", "row": "", "folder": False}
            self.links.append(self._link)
            self._in_row.append(self._link)

    def handle_data(self, data):
        if self._link is not None:
            self._link["text"] += data

    def handle_endtag(self, tag):
        if tag == "a":
            self._link = None
        elif tag == "tr":
            self._end_row()


# ---- services


def geofabrik(fetch: Fetch) -> list[Extract]:
    return parse_geofabrik(json.loads(fetch(GEOFABRIK)))


def parse_geofabrik(data: dict) -> list[Extract]:
    root, out = Source.geofabrik.value, []
    for f in data["features"]:
        p = f["properties"]
        parent = f"{root}_us" if p["id"].startswith("us/") else f"{root}_{p['parent']}" if p.get("parent") else root
        out.append(Extract(f"{root}_{p['id']}", p["id"].replace("/", "_"), parent, p["urls"]["pbf"], regions.from_geojson(f["geometry"])))
    return out


def bbbike(fetch: Fetch) -> list[Extract]:
    root, out = Source.bbbike.value, []
    names = [a["text"] for a in _Table(fetch(f"{BBBIKE}/") or "").links if "d" in a["row"].split() and a["text"] != ".."]
    cities = None
    for name in names:
        shape = fetch_poly(fetch, f"{BBBIKE}/{name}/{name}.poly")
        if shape is None:
            if cities is None:
                cities = (fetch(BBBIKE_CITIES) or "").splitlines()
            row = next((r for r in cities if r.startswith(name + ":")), None)
            if row is None:
                continue
            shape = regions.from_box(row.split(":")[6].split())
        out.append(Extract(f"{root}_{name}", name, root, f"{BBBIKE}/{name}/{name}.osm.pbf", shape))
    return out


def osm_fr(fetch: Fetch) -> list[Extract]:
    out, todo = [], [(Source.osm_fr.value, "/")]
    while todo:
        parent, path = todo.pop(0)
        for a in _Table(fetch(f"{OSM_FR}{path}") or "").links:
            if a["href"].endswith("-latest.osm.pbf"):
                name = a["href"].removesuffix("-latest.osm.pbf")
                shape = fetch_poly(fetch, f"{OSM_FR_POLYGONS}{path}{name}.poly")
                if shape is not None:
                    out.append(Extract(f"{parent}_{name}", name, parent, f"{OSM_FR}{path}{a['href']}", shape))
            elif a["folder"] and not a["href"].startswith(("/", ".")):
                todo.append((f"{parent}_{a['text'].strip('/ ')}", f"{path}{a['href']}"))
    return out


def _segments(url: str) -> list[str]:
    return [s for s in urlparse(url).path.strip("/").removesuffix(".html").split("/") if s]


def child_pages(url: str, text: str) -> list[tuple[str, str]]:
    """(url, name) of the pages one level below a page."""
    own, out = _segments(url), {}
    for a in _Table(text).links:
        if a["href"].endswith(".html"):
            there = urljoin(url, a["href"])
            path = _segments(there)
            if len(path) == len(own) + 1 and path[:-1] == own:
                out.setdefault(there, path[-1])
    return list(out.items())


def geo2day(fetch: Fetch) -> list[Extract]:
    out, todo = [], [(Source.geo2day.value, GEO2DAY)]
    while todo:
        parent, url = todo.pop(0)
        for page, name in child_pages(url, fetch(url) or ""):
            base, id_ = page.removesuffix(".html"), f"{parent}_{name}"
            text = fetch(f"{base}.geojson")
            if text is not None:
                out.append(Extract(id_, name, parent, f"{base}.pbf", regions.from_geojson(text)))
            todo.append((id_, page))
    return out


def parse_movisda(data: dict, base_url: str, source: Source, nested: bool) -> list[Extract]:
    """With ``nested``, ``RW-02`` is below ``RW`` if that is there; else all codes are below the source."""
    rows = [(f["properties"], str(f["properties"]["prefix"]), f["geometry"]) for f in data.get("features", [])]
    codes, out = {prefix.rstrip("-") for _, prefix, _ in rows}, []
    for p, prefix, geometry in rows:
        code = prefix.rstrip("-")
        above = code.rpartition("-")[0]
        parent = f"{source.value}_{above}" if nested and above in codes else source.value
        name = (p.get("name_en") or p["name"]) if nested else code
        out.append(Extract(f"{source.value}_{code}", name, parent, f"{base_url}/{prefix}latest.osm.pbf", regions.from_geojson(geometry)))
    return out


def movisda_admin(fetch: Fetch) -> list[Extract]:
    return parse_movisda(json.loads(fetch(f"{MOVISDA_ADMIN}/Admin-latest.geojson")), MOVISDA_ADMIN, Source.movisda_admin, True)


def movisda_grid(fetch: Fetch) -> list[Extract]:
    return parse_movisda(json.loads(fetch(f"{MOVISDA_GRID}/grid-latest.geojson")), MOVISDA_GRID, Source.movisda_grid, False)


LOADERS: dict[Source, Callable[[Fetch], list[Extract]]] = {
    Source.bbbike: bbbike, Source.geofabrik: geofabrik, Source.osm_fr: osm_fr, Source.geo2day: geo2day, Source.movisda_admin: movisda_admin, Source.movisda_grid: movisda_grid,
}


# ---- indexes


def slug(text: str) -> str:
    """Lower-case ASCII with underscores for white space."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9_-]+", "", re.sub(r"\s+", "_", plain.strip().lower()))


def finished(extracts: Iterable[Extract]) -> list[Extract]:
    """With full names from the root down and areas, by area and id."""
    rows = list(extracts)
    by = {e.id: e for e in rows}

    def full(id_: str) -> str:
        parts = []
        while id_ in by and len(parts) <= len(by):
            parts.append(slug(by[id_].name))
            id_ = by[id_].parent
        return "_".join([slug(id_), *reversed(parts)])

    done = [replace(e, file_name=full(e.id), area=regions.geodesic_area_km2(e.geometry)) for e in rows]
    return sorted(done, key=lambda e: (e.area, e.id))


def to_rows(extracts: list[Extract]) -> list[dict]:
    return [{"id": e.id, "name": e.name, "file_name": e.file_name, "parent": e.parent, "geometry": regions.to_wkt(e.geometry), "area": e.area, "url": e.url} for e in extracts]


def save_index(extracts: list[Extract], path: str) -> None:
    import pyarrow as pa
    import pyarrow.parquet as pq

    files.make_parent(path)
    system, inner = files.opened(path)
    pq.write_table(pa.Table.from_pylist(to_rows(extracts)), inner, filesystem=system)


def read_index(path: str) -> list[Extract]:
    import pyarrow.parquet as pq

    system, inner = files.opened(path)
    return [Extract(r["id"], r["name"], r["parent"], r["url"], regions.from_wkt(r["geometry"]), r["file_name"], r["area"]) for r in pq.read_table(inner, filesystem=system).to_pylist()]


def _cached(source: Source, cache: str | Path) -> str:
    return files.join(str(cache), f"{source.value.lower()}_index.parquet")


def load_index(source: Source, cache: str | Path, fetch: Fetch = http_fetch) -> list[Extract]:
    """A source's index from its cache, else from the service; an old cache is used with a warning."""
    path = _cached(source, cache)
    if files.exists(path):
        made = files.modified(path)
        if time.time() - made > OUTDATED_DAYS * 86400:
            warnings.warn(f"The index of {source.value} is of {dt.date.fromtimestamp(made)}.", OldOsmCacheWarning, stacklevel=2)
        return read_index(path)
    warnings.warn(f"The index of {source.value} isn't cached; it is made anew.", MissingOsmCacheWarning, stacklevel=2)
    found = finished(LOADERS[source](fetch))
    save_index(found, path)
    return found


def load_indexes(source, cache: str | Path, fetch: Fetch = http_fetch) -> list[Extract]:
    """Indexes of several sources as one. Of several, those out of reach are skipped with a warning; a single one has to load."""
    wanted = resolve_sources(source)
    if len(wanted) == 1:
        return load_index(wanted[0], cache, fetch)
    found, away = [], []
    for s in wanted:
        try:
            found.append(load_index(s, cache, fetch))
        except (URLError, OSError, TimeoutError):
            away.append(s.value)
    if not found:
        raise OsmExtractsIndexesUnavailableError(f"No index could be loaded: {away}.")
    if away:
        warnings.warn(f"Indexes out of reach: {away}.", OsmExtractSourceUnavailableWarning, stacklevel=2)
    return sorted((e for index in found for e in index), key=lambda e: (e.area, e.id))


def clear_cache(cache: str | Path, source=Source.any) -> None:
    for s in resolve_sources(source):
        files.remove(_cached(s, cache))


def human(number: float) -> str:
    """Three digits and K, M or B."""
    number, size = float(f"{number:.3g}"), 0
    while abs(number) >= 1000 and size < 3:
        number, size = number / 1000, size + 1
    return f"{number:f}".rstrip("0").rstrip(".") + ("", "K", "M", "B")[size]


def tree_lines(extracts: list[Extract], root: str, full_names: bool = False) -> list[str]:
    """The tree below ``root`` as indented lines; extracts whose parent isn't there come last, under its id."""
    by: dict[str, list[Extract]] = {}
    for e in sorted(extracts, key=lambda e: e.name):
        by.setdefault(e.parent, []).append(e)
    out = [root]

    def add(parent: str, depth: int) -> None:
        for e in by.get(parent, []):
            out.append("  " * depth + f"{e.file_name if full_names else e.name} ({human(e.area)} km²)")
            if e.id != parent:
                add(e.id, depth + 1)

    add(root, 1)
    for loose in sorted(set(by) - {e.id for e in extracts} - {root}):
        out.append(f"  {loose}")
        add(loose, 2)
    return out


def _chunks(url: str, size: int = 8 << 20) -> Iterator[bytes]:
    with urlopen(Request(url, headers={"User-Agent": "geoloom"}), timeout=600) as answer:
        while chunk := answer.read(size):
            yield chunk


def download(url: str, directory: str, fetch_bytes: Callable[[str], bytes] | None = None) -> str:
    """A file of a URL in a folder (a path or URI), kept by its name; one that is there is used again.

    The executors read it from there, so on a cluster the folder is in a store that they share.
    """
    path = files.join(str(directory), urlparse(url).path.rsplit("/", 1)[-1])
    if not files.exists(path):
        files.write(path, [fetch_bytes(url)] if fetch_bytes else _chunks(url))
    return path


def is_url(path: str) -> bool:
    return re.match(r"(ftp|https?|sftp|doi):", str(path)) is not None
