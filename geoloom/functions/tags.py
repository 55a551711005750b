"""The tag-filter language: algebra on the driver, predicates and projections as Columns.

A filter maps a key to ``True`` (has the key), ``False`` (lacks it), a value or a list of values; a grouped filter maps group names to
filters; a list holds either. ``*`` in a key stands for any text and expands to the keys that the data has; in a value it
is a wildcard, and there ``%`` and ``_`` keep their LIKE meaning.
"""

from __future__ import annotations

import functools
import operator
import re
import warnings
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.errors import EmptyFilterWarning, ManyColumnsWarning
from geoloom.schema import FEATURE_ID, GEOMETRY, METADATA_KEYS, METADATA_PREFIX

Value = bool | str | list[str]
Filter = Mapping[str, Value]
Grouped = Mapping[str, Filter]

MANY_COLUMNS = 100


# ---- algebra


def is_value(value: object) -> bool:
    return isinstance(value, (bool, str)) or (isinstance(value, list) and all(isinstance(v, str) for v in value))


def is_flat(tags: object) -> bool:
    return isinstance(tags, Mapping) and all(isinstance(k, str) and is_value(v) for k, v in tags.items())


def is_grouped(tags: object) -> bool:
    return isinstance(tags, Mapping) and bool(tags) and all(isinstance(k, str) and is_flat(v) and isinstance(v, Mapping) for k, v in tags.items())


def check_filter(tags: object) -> None:
    """TypeError unless ``tags`` is a filter, a grouped filter or an iterable of them."""
    if is_flat(tags) or is_grouped(tags):
        return
    if isinstance(tags, Iterable) and not isinstance(tags, (str, Mapping)) and all(is_flat(t) or is_grouped(t) for t in tags):
        return
    raise TypeError(f"Not a tags filter: {tags!r}")


def _join_values(key: str, old: Value | None, new: Value) -> Value:
    if old is None:
        return [new] if isinstance(new, str) else list(new) if isinstance(new, list) else new
    if (old is False) != (new is False):
        raise ValueError(f"Key {key!r} is both wanted and unwanted.")
    if isinstance(old, bool) or isinstance(new, bool):
        return old if isinstance(old, bool) else new
    return list(dict.fromkeys([*old, *([new] if isinstance(new, str) else new)]))


def merge_pairs(pairs: Iterable[tuple[str, Value]]) -> dict[str, Value]:
    """One flat filter: lists join, True absorbs values, a key both wanted and unwanted is a ValueError."""
    out: dict[str, Value] = {}
    for key, value in pairs:
        out[key] = _join_values(key, out.get(key), value)
    return out


def merge_filter(tags: Filter | Grouped | Iterable[Filter | Grouped]) -> dict[str, Value]:
    """Flat filters stay as they are; groups and lists merge into one flat filter."""
    check_filter(tags)
    if is_flat(tags):
        return dict(tags)
    if is_grouped(tags):
        return merge_pairs(p for group in tags.values() for p in group.items())
    return merge_pairs(p for part in tags for p in merge_filter(part).items())


def is_positive(tags: Filter | Grouped | Iterable | None) -> bool:
    """Whether anything is wanted, rather than only unwanted."""
    if not tags:
        return False
    if is_flat(tags):
        return any(v is not False for v in tags.values())
    return any(map(is_positive, tags.values() if isinstance(tags, Mapping) else tags))


# ---- wildcards


def like_pattern(text: str) -> str:
    """LIKE pattern of a text with stars."""
    return re.sub(r"\*+", "%", text).replace("\\", "\\\\")


def _like(column: Column, text: str) -> Column:
    return column.like(like_pattern(text))


def tag_keys(elements: DataFrame) -> DataFrame:
    """(key): the distinct tag keys."""
    return elements.select(F.explode(F.map_keys("tags")).alias("key")).distinct()


def expand_filter(elements: DataFrame, tags: Filter | Grouped | Iterable) -> dict:
    """Replace wildcard keys by the keys that the data has, in case-insensitive order.

    All patterns are looked up in one pass; the driver gets the keys that match one.
    """
    flats = list(tags.values()) if is_grouped(tags) else [tags] if is_flat(tags) else [merge_filter(t) for t in tags]
    stars = sorted({k for f in flats for k in f if "*" in k})
    found: dict[str, list[str]] = {}
    if stars:
        keys = tag_keys(elements).filter(functools.reduce(operator.or_, (_like(F.col("key"), s) for s in stars)))
        hits = keys.select("key", *[_like(F.col("key"), s).alias(f"s{k}") for k, s in enumerate(stars)]).collect()
        found = {s: sorted((r["key"] for r in hits if r[f"s{k}"]), key=str.casefold) for k, s in enumerate(stars)}

    def grown(flat: Filter) -> dict[str, Value]:
        if not any("*" in k for k in flat):
            return dict(flat)
        return merge_pairs((k, v) for key, v in flat.items() for k in (found[key] if "*" in key else [key]))

    if is_grouped(tags):
        out = {g: grown(f) for g, f in tags.items()}
        merge_filter(out)  # conflicts across groups
        return out
    return merge_pairs(p for f in flats for p in grown(f).items()) if not is_flat(tags) else grown(tags)


# ---- predicates


def matches_value(tags: Column, key: str, value: Value) -> Column:
    """Whether the tag has the key and, if values are given, one of them."""
    has = F.coalesce(F.map_contains_key(tags, F.lit(key)), F.lit(False))
    if isinstance(value, bool):
        return has if value else ~has
    found = F.try_element_at(tags, F.lit(key))
    values = [value] if isinstance(value, str) else value
    plain = [v for v in values if "*" not in v]
    tests = ([found.isin(plain)] if plain else []) + [_like(found, v) for v in values if "*" in v]
    return F.coalesce(functools.reduce(operator.or_, tests, F.lit(False)), F.lit(False))


def filter_column(flat: Filter | None, tags: Column | str = "tags") -> Column | None:
    """Wanted tags OR-ed, unwanted ones AND-ed; None without a filter.

    A filter that was given but is empty, as after a wildcard that no key matches, warns and matches nothing.
    """
    if flat is None:
        return None
    tags = F.col(tags) if isinstance(tags, str) else tags
    if not flat:
        warnings.warn("The tags filter is empty, nothing matches it.", EmptyFilterWarning, stacklevel=2)
        return F.lit(False)
    wanted = [matches_value(tags, k, v) for k, v in flat.items() if v is not False]
    unwanted = [matches_value(tags, k, v) for k, v in flat.items() if v is False]
    parts = ([functools.reduce(operator.or_, wanted)] if wanted else []) + unwanted
    return functools.reduce(operator.and_, parts)


def strip_metadata(tags: Column | str = "tags") -> Column:
    """Tags without metadata keys."""
    keys = list(METADATA_KEYS)
    return F.map_filter(tags, lambda k, v: ~k.isin(keys) & ~k.startswith(METADATA_PREFIX))


def has_tags(tags: Column | str = "tags") -> Column:
    return F.coalesce(F.size(tags) > 0, F.lit(False))


def elements_with_ids(ids: Iterable[str] | None, kind: Column | str = "kind", id_: Column | str = "id", loose: bool = False) -> Column | None:
    """Elements by ``kind/id``. Ids belong to their kind: ``way/5`` doesn't admit ``node/5``, unless they are ``loose``."""
    if ids is None:
        return None
    kind, id_ = (F.col(c) if isinstance(c, str) else c for c in (kind, id_))
    by: dict[str, set[int]] = {}
    for text in ids:
        m = re.fullmatch(r"(node|way|relation)/(\d+)", text)
        if not m:
            raise ValueError(f"Not an element id: {text!r}")
        by.setdefault(m[1], set()).add(int(m[2]))
    if loose:
        return id_.isin(sorted(set().union(*by.values())))
    return functools.reduce(operator.or_, ((kind == k) & id_.isin(sorted(v)) for k, v in by.items()), F.lit(False))


# ---- projections


def explodes(tags: Filter | Grouped | None, keep_all: bool, explode: bool | None) -> bool:
    """Whether tags become columns: by default if a filter wants some and not all are kept."""
    return explode if explode is not None else is_positive(tags) and not keep_all


def _exact_columns(columns: list[Column]) -> list[Column]:
    if len(columns) > MANY_COLUMNS:
        warnings.warn(f"The result has {len(columns)} tag columns.", ManyColumnsWarning, stacklevel=3)
    return columns


def all_key_columns(features: DataFrame) -> list[Column]:
    """A column for each key that the data has, by name."""
    keys = sorted(r["key"] for r in tag_keys(features).collect())
    return _exact_columns([F.try_element_at("tags", F.lit(k)).alias(k) for k in keys])


def narrowed(flat: Filter, tags: Column | str = "tags") -> Column:
    """The entries that match a wanted part of the filter."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    wanted = {k: v for k, v in flat.items() if v is not False}
    any_value = [k for k, v in wanted.items() if v is True]

    def test(key: Column, value: Column) -> Column:
        tests = [(key == k) & _value_test(value, v) for k, v in wanted.items() if v is not True]
        return functools.reduce(operator.or_, tests, key.isin(any_value) if any_value else F.lit(False))

    return F.map_filter(tags, test)


def _value_test(found: Column, value: Value) -> Column:
    values = [value] if isinstance(value, str) else value
    plain = [v for v in values if "*" not in v]
    tests = ([found.isin(plain)] if plain else []) + [_like(found, v) for v in values if "*" in v]
    return F.coalesce(functools.reduce(operator.or_, tests, F.lit(False)), F.lit(False))


def filter_key_columns(flat: Filter, tags: str = "tags") -> list[Column]:
    """A column for each wanted key, with the value where it matches."""
    return _exact_columns([
        F.when(matches_value(F.col(tags), k, v), F.try_element_at(tags, F.lit(k))).alias(k) for k, v in flat.items() if v is not False
    ])


def group_value(flat: Filter, tags: str = "tags") -> Column:
    """``key=value`` of the first key of a group that matches; null without one, as for a group that only unwants."""
    found = [F.when(matches_value(F.col(tags), k, v), F.concat(F.lit(f"{k}="), F.try_element_at(tags, F.lit(k)))) for k, v in flat.items() if v is not False]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def group_columns(grouped: Grouped, tags: str = "tags") -> list[Column]:
    return [group_value(grouped[g], tags).alias(g) for g in sorted(grouped)]


def group_map(grouped: Grouped, tags: str = "tags") -> Column:
    """Map of groups to ``key=value``, without groups that don't match."""
    pairs = [c for g in sorted(grouped) for c in (F.lit(g), group_value(grouped[g], tags))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def project_tags(features: DataFrame, expanded: Filter | Grouped | None, keep_all: bool = False, explode: bool | None = None) -> DataFrame:
    """Features (feature_id, tags, geometry) with their tags in the shape that the filter and the two switches ask for."""
    as_columns = explodes(expanded, keep_all, explode)
    flat = merge_filter(expanded) if expanded else None
    narrow = is_positive(flat) and not keep_all
    if narrow and is_grouped(expanded):
        tags = group_columns(expanded) if as_columns else [group_map(expanded).alias("tags")]
    elif narrow:
        tags = filter_key_columns(flat) if as_columns else [narrowed(flat).alias("tags")]
    else:
        tags = all_key_columns(features) if as_columns else [F.col("tags")]
    return features.select(FEATURE_ID, *tags, GEOMETRY)


def drop_null_columns(df: DataFrame, keep: Iterable[str] = (FEATURE_ID, GEOMETRY)) -> DataFrame:
    """Without the columns that are null in every row; one aggregation finds them."""
    names = [c for c in df.columns if c not in set(keep)]
    if not names:
        return df
    quoted = [F.count(F.col("`" + c.replace("`", "``") + "`")).alias(f"c{k}") for k, c in enumerate(names)]
    counts = df.agg(*quoted).first()
    empty = {c for k, c in enumerate(names) if not counts[k]}
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in empty])
