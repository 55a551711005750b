"""Names from other SQL dialects that predicates on tags use, as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = {
    "starts_with": "(a string, b string) returns boolean return startswith(a, b)",
    "list_has_all": "(a array<string>, b array<string>) returns boolean return size(array_except(b, a)) = 0",
    "list_has_any": "(a array<string>, b array<string>) returns boolean return arrays_overlap(a, b)",
    "list_contains": "(a array<string>, b string) returns boolean return array_contains(a, b)",
    "regexp_matches": "(a string, b string) returns boolean return a rlike b",
}


def install(spark: SparkSession) -> None:
    for name, body in _FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}{body}")
