"""JSON text: extraction, removal, headers, stable encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import _c


def is_json(col: Column | str) -> Column:
    return F.try_parse_json(_c(col)).isNotNull()


def number_at(col: Column | str, path: str) -> Column:
    """A whole number at a path; null if there is none."""
    return F.try_variant_get(F.try_parse_json(_c(col)), path, "long")


def text_at(col: Column | str, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(_c(col)), path, "string")


def without_keys(col: Column | str, *keys: str) -> Column:
    """An object without some of its keys; other values keep their types."""
    m = F.from_json(_c(col), "map<string,variant>")
    return F.to_json(F.map_filter(m, lambda k, v: ~k.isin(*keys)))


def with_true(col: Column | str, key: str) -> Column:
    """An object with a key set to true."""
    m = F.from_json(_c(col), "map<string,variant>")
    rest = F.map_filter(m, lambda k, v: k != key)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(key), F.parse_json(F.lit("true")))))


def header(headers_json: Column | str, name: str) -> Column:
    """A header's value, whatever the case of its name; null if it is missing."""
    m = F.from_json(_c(headers_json), "map<string,string>")
    found = F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(found, F.lit(1))["value"]


def tag_list(col: Column | str) -> Column:
    """Strings of a JSON list; an empty list for anything else."""
    return F.coalesce(F.when(F.trim(_c(col)).startswith("["), F.from_json(_c(col), "array<string>")), F.array().cast("array<string>"))


def stable(**fields: Column) -> Column:
    """JSON of an object with sorted keys, nulls included, to be hashed."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def content_hash(**fields: Column) -> Column:
    """Hash of a record's content, by which changes are found."""
    return F.sha2(stable(**fields), 256)
