"""Geometry on the JVM, with the JTS library that Spark ships.

Small Java functions are compiled on the driver, against the classes that its JVM itself has loaded, and added to the session,
which sends them to the executors. Where that isn't possible (without a compiler, say) a warning says so, once, and geometries stay
unrepaired and rings nested as they are.
"""

from __future__ import annotations

import atexit
import importlib.resources
import shutil
import subprocess
import tempfile
import warnings
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from geoloom.errors import GeometryNotRepairedWarning
from geoloom.functions import region as regions
from geoloom.functions.wkb import decode, encode_polygons

_BOX = "struct<x_min:double,y_min:double,x_max:double,y_max:double>"
_FUNCTIONS = {"geoloom_way": ("Way", "binary"), "geoloom_area": ("Area", "binary"), "geoloom_box": ("Box", _BOX), "geoloom_inside": ("Inside", "boolean")}
#: Classes that the functions use, to find the libraries they are in.
_USED = ("org.locationtech.jts.geom.Geometry", "org.apache.spark.sql.api.java.UDF1", "org.apache.spark.sql.Row", "scala.collection.Seq")
_jars: dict[int, Path] = {}


def _libraries(jvm) -> str:
    """Class path of the compiler: where the JVM has the classes from, wherever PySpark itself lies."""
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    found = [jvm.java.lang.Class.forName(name, False, loader).getProtectionDomain().getCodeSource() for name in _USED]
    paths = {jvm.java.nio.file.Paths.get(s.getLocation().toURI()).toString() for s in found if s is not None}
    return jvm.java.io.File.pathSeparator.join(sorted(paths) + [jvm.java.lang.System.getProperty("java.class.path") or ""])


def _compiled(spark: SparkSession) -> Path:
    """A jar of the functions in a folder of this process alone, made once for a JVM."""
    jvm = spark._jvm
    mark = id(spark.sparkContext._gateway)
    if mark in _jars:
        return _jars[mark]
    own = Path(jvm.java.lang.System.getProperty("java.home")) / "bin" / "javac"
    compiler = str(own) if own.exists() else shutil.which("javac")
    if compiler is None:
        raise RuntimeError("there is no Java compiler")
    folder = Path(tempfile.mkdtemp(prefix="geoloom-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = folder / "classes"
    out.mkdir()
    source = folder / "Shapes.java"
    source.write_text(importlib.resources.files("geoloom.functions").joinpath("java", "Shapes.java").read_text())
    done = subprocess.run([compiler, "-nowarn", "-proc:none", "-d", str(out), "-cp", _libraries(jvm), str(source)], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(done.stderr[:2000])
    jar = folder / "geoloom-shapes.jar"
    with zipfile.ZipFile(jar, "w") as z:
        for p in sorted(out.rglob("*.class")):
            z.write(p, p.relative_to(out))
    _jars[mark] = jar
    return jar


def install(spark: SparkSession) -> bool:
    """Add the functions to the session; False, with a warning, if they can't be had."""
    if spark.catalog.functionExists("geoloom_area"):
        return True
    try:
        spark.sql(f"ADD JAR '{_compiled(spark)}'")
        for name, (java, kind) in _FUNCTIONS.items():
            spark.udf.registerJavaFunction(name, f"geoloom.Shapes${java}", kind)
    except Exception as e:  # a session without these functions still works
        warnings.warn(f"Geometries aren't repaired or overlaid: {e}", GeometryNotRepairedWarning, stacklevel=2)
        return False
    return True


def way(points: Column, is_area: Column) -> Column:
    return F.call_function("geoloom_way", points, is_area)


def area(members: Column) -> Column:
    return F.call_function("geoloom_area", members)


def box(geometry: Column) -> Column:
    return F.call_function("geoloom_box", geometry)


def inside(x: Column, y: Column, region: regions.Region) -> Column:
    return F.call_function("geoloom_inside", x, y, F.lit(bytearray(encode_polygons(region))))


class DriverGeometry:
    """Overlay of regions on the driver, for indexes of extracts."""

    def __init__(self, spark: SparkSession):
        jvm = spark._jvm.org.locationtech.jts
        self.reader, self.writer, self.fixer, self.union_op = jvm.io.WKBReader(), jvm.io.WKBWriter(2, 2), jvm.geom.util.GeometryFixer, jvm.operation.union.UnaryUnionOp
        self._list = spark._jvm.java.util.ArrayList

    def of(self, region: regions.Region):
        return self.fixer.fix(self.reader.read(encode_polygons(region)))

    def region(self, geometry) -> regions.Region:
        kind, parts = decode(bytes(self.writer.write(geometry)))
        return _polygons(kind, parts)

    def union(self, geometries: list):
        items = self._list()
        for g in geometries:
            items.add(g)
        return self.union_op.union(items)


def _polygons(kind: str, parts: list) -> regions.Region:
    if kind == "GeometryCollection":
        return [p for k, x in parts for p in _polygons(k, x)]
    return [parts] if kind == "Polygon" and parts else parts if kind == "MultiPolygon" else []
