"""Metadata maps: layered merge, the merged view of a record, filters."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkwell.schemas import SYSTEM_FIELDS

_NO_FIELDS = "map<string,string>"


def string_map(fields: Mapping[str, object] | None) -> Column:
    """A literal map with all values as strings; NULL values are kept.

    A mapping within is flat: its values get dotted names, as ``address.city``.
    """
    if not fields:
        return F.create_map().cast(_NO_FIELDS)
    parts: list[Column] = []
    for key, value in _flat(fields):
        parts += [F.lit(key), F.lit(as_text(value)).cast("string")]
    return F.create_map(*parts) if parts else F.create_map().cast(_NO_FIELDS)


def _flat(fields: Mapping, prefix: str = "") -> Iterator[tuple[str, object]]:
    for key, value in fields.items():
        if isinstance(value, Mapping):
            yield from _flat(value, f"{prefix}{key}.")
        else:
            yield f"{prefix}{key}", value


def promoted_column(name: str) -> str:
    """The column that a caller field is stored in as well if it is promoted."""
    return "field_" + quote(name, safe="").replace(".", "%2E")


def as_text(value: object) -> str | None:
    """A metadata value as stored: NULL stays, booleans read as in SQL, lists as JSON."""
    if isinstance(value, (list, tuple)):
        return json.dumps(list(value), ensure_ascii=False)
    if value is None or isinstance(value, str):
        return value
    return str(value).lower() if isinstance(value, bool) else str(value)


_OPERATORS = ("eq", "ne", "in", "nin", "gt", "gte", "lt", "lte")


def _test(actual: Column, wanted: object, literal, key: str) -> Column:
    """One condition: a value, NULL, a list of values, or a mapping of operators.

    ``actual`` must be comparable with ``literal(value)``. Anything else is an error.
    """
    if isinstance(wanted, Mapping):
        unknown = [op for op in wanted if op.lstrip("$") not in _OPERATORS]
        if unknown or not wanted:
            raise ValueError(f"unknown condition on {key!r}: {unknown or wanted}")
        tests = []
        for op, value in wanted.items():
            op = op.lstrip("$")
            if op in ("in", "nin"):
                if not isinstance(value, (list, tuple, set, frozenset)):
                    raise ValueError(f"{op!r} on {key!r} takes a list")
                found = _test(actual, list(value), literal, key)
                tests.append(found if op == "in" else ~F.coalesce(found, F.lit(False)))
            elif op == "eq":
                tests.append(_test(actual, value, literal, key))
            elif op == "ne":
                tests.append(~F.coalesce(_test(actual, value, literal, key), F.lit(False)))
            else:
                bound = literal(value, ordered=True)
                at = literal.ordered(actual, value)
                tests.append({"gt": at > bound, "gte": at >= bound, "lt": at < bound, "lte": at <= bound}[op])
        return reduce(lambda a, b: a & b, tests)
    if isinstance(wanted, (list, tuple, set, frozenset)):
        values = [v for v in wanted if v is not None]
        tests = [actual.isin(*[literal(v) for v in values])] if values else []
        if len(values) < len(wanted):
            tests.append(actual.isNull())
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    if wanted is None:
        return actual.isNull()
    return actual == literal(wanted)


class _Literal:
    """Values as a column of ``kind`` compares them; map values are texts, numbers among them."""

    def __init__(self, kind: T.DataType | None):
        self.kind = kind

    def __call__(self, value: object, ordered: bool = False) -> Column:
        if self.kind is not None:
            return F.lit(as_text(value)).try_cast(self.kind)
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return F.lit(float(value)) if ordered and number else F.lit(as_text(value))

    def ordered(self, actual: Column, value: object) -> Column:
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return actual.try_cast("double") if self.kind is None and number else actual


def merge_metadata(*layers: Column) -> Column:
    """Merge maps from low to high precedence; a later NULL still wins.

    The lower map loses the keys the higher one has before both are joined:
    ``map_concat`` alone rejects repeated keys.
    """

    def over(low: Column, high: Column) -> Column:
        low = F.coalesce(low, F.create_map().cast(_NO_FIELDS))
        high = F.coalesce(high, F.create_map().cast(_NO_FIELDS))
        kept = F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k))
        return F.map_concat(kept, high)

    return reduce(over, layers)


def merged_view(df: DataFrame, metadata_col: str = "metadata") -> Column:
    """All metadata of a stored record as one map: caller fields win.

    System columns that are NULL are left out, as an absent field would be.
    """
    pairs = [
        F.struct(F.lit(name).alias("key"), F.col(name).cast("string").alias("value"))
        for name in SYSTEM_FIELDS
        if name in df.columns
    ]
    system = F.map_from_entries(
        F.filter(F.array(*pairs), lambda e: e["value"].isNotNull())
    ) if pairs else F.create_map().cast(_NO_FIELDS)
    if metadata_col not in df.columns:
        return system
    return merge_metadata(system, F.col(metadata_col))


def metadata_predicate(
    df: DataFrame,
    metadata_filter: Mapping[str, object] | Column | None,
    metadata_col: str = "metadata",
) -> Column | None:
    """Turn a filter into a predicate; ``None`` or an empty one means no filter.

    ``user_id`` and ``metadata.user_id`` mean the same, several keys are
    AND-ed. A value means equality, ``None`` an absent field, a list any of its
    values, and a mapping of ``eq ne in nin gt gte lt lte`` (with or without
    ``$``) all of its conditions. A key that names a real column is compared in
    its type; where the record's own map may override it, stored rows say whether it
    does, so a necessary part of the test still reaches the scan. Fields of the map are
    texts, and compare as numbers where a range is given in numbers; those that were
    promoted reach the scan as well. A key that is neither a column nor can be in a map
    is an error.
    """
    if metadata_filter is None:
        return None
    if isinstance(metadata_filter, Column):
        return metadata_filter
    prefix = metadata_col + "."
    tests: list[Column] = []
    for key, wanted in metadata_filter.items():
        name = key[len(prefix):] if key.startswith(prefix) else key
        in_map = metadata_col in df.columns
        held = F.col(metadata_col)[name] if in_map else None
        if name in df.columns and name != metadata_col:
            # compare in the column's own type, so that the test can be pushed down
            test = _test(F.col(name), wanted, _Literal(df.schema[name].dataType), key)
            if in_map:
                own = F.map_contains_key(F.col(metadata_col), F.lit(name))
                exact = F.when(own, _test(held, wanted, _Literal(None), key)).otherwise(test)
                if "overrides" in df.columns:  # true wherever a map hides any column
                    tests.append(F.col("overrides") | test)
                test = exact
        elif in_map:
            test = _test(held, wanted, _Literal(None), key)
            if (promoted := promoted_column(name)) in df.columns:
                # NULL where the write did not promote the field
                column = F.col(f"`{promoted}`")
                tests.append(column.isNull() | _test(column, wanted, _Literal(None), key))
        else:
            raise ValueError(f"no field {key!r} to filter on")
        tests.append(test)
    return reduce(lambda a, b: a & b, tests) if tests else None
