"""Steps without a fixed schema, as VARIANT: parsing, the schema of what is there, safe walks, and arrays of one value as that value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arrays nested deeper than this aren't collapsed.
NESTED = 8
_TEXT = r'"(?:[^"\\]|\\.)*"'
_ONE = rf"({_TEXT}|-?\d[^,\[\]{{}}\s]*|true|false|null)"


def collapsed(json: Column) -> Column:
    """JSON text in which every member that is an array of one value, however nested, is that value; other arrays stay as they are.

    ``{"a": [[5]], "b": [[1], [2]]}`` gives ``{"a":5,"b":[[1],[2]]}``.  Texts are matched first, so brackets in them
    stay; broken JSON is null.
    """
    plain = F.to_json(F.try_parse_json(json))
    nests = "|".join(r"\[" * k + _ONE + r"\]" * k for k in range(1, NESTED + 1))
    members = F.regexp_replace(plain, rf"({_TEXT})(?:(:)(?:{nests})(?=[,}}]))?", "".join(f"${k}" for k in range(1, NESTED + 3)))
    return F.regexp_replace(members, rf"^(?:{nests})$", "".join(f"${k}" for k in range(1, NESTED + 1)))


def as_variant(json: Column, collapse: bool = True) -> Column:
    """The value of JSON text, arrays of one value collapsed; null where it is broken."""
    return F.try_parse_json(collapsed(json) if collapse else json)


def walk(value: Column, *path: str | int, kind: str = "string") -> Column:
    """The value at a path of names and places, null where a part is missing or doesn't fit the kind.  A name may hold one sort of quotes."""
    quoted = lambda p: f'["{p}"]' if "'" in p else f"['{p}']"
    return F.try_variant_get(value, "$" + "".join(f"[{p}]" if isinstance(p, int) else quoted(p) for p in path), kind)


def with_batch(value: Column) -> Column:
    """A leading axis of one."""
    return F.array(value)


def without_batch(value: Column) -> Column:
    """The first along the leading axis, null of an empty one."""
    return F.get(value, F.lit(0))


def schema_of(rows: DataFrame, value: Column) -> DataFrame:
    """(schema): the type that all values of ``rows`` have in common, by partial aggregation."""
    return rows.agg(F.schema_of_variant_agg(value).alias("schema"))
