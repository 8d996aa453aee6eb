"""Scalar functions of the catalogue: hashes, ratios, names, sizes, labels, JSON."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, StructType


def salted_md5(value: Column, salt: str) -> Column:
    return F.md5(F.concat(F.lit(salt), value))


def request_key(request: dict[str, Any]) -> str:
    """Key of a request in the result cache."""
    return hashlib.md5(json.dumps(request, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


def ratio(width: Column, height: Column) -> Column:
    return F.round(F.try_divide(width * F.lit(1.0), height), 2)


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def main_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def upload_path(space_id: Column, user_id: Column, day: Column, name: Column, ending: Column) -> Column:
    """/prefix/date_key.suffix; the key is a hash of the name, so that a repeated job writes the same path."""
    prefix = F.when(space_id.isNull(), F.concat(F.lit("public/"), user_id)).otherwise(F.concat(F.lit("space/"), space_id))
    return F.concat(F.lit("/"), prefix, F.lit("/"), F.date_format(day, "yyyy-MM-dd"), F.lit("_"), F.substring(F.md5(name), 1, 16), F.lit("."), ending)


def renditions(path: Column) -> tuple[Column, Column]:
    """Names of the compressed picture and the thumbnail."""
    main = main_name(path)
    return F.concat(main, F.lit(".webp")), F.concat(main, F.lit("_thumbnail."), suffix(path))


def human_size(size: Column) -> Column:
    return (
        F.when(size.isNull() | (size == 0), F.lit("未知"))
        .when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.format_string("%.2f KB", size / F.lit(1024.0)))
        .otherwise(F.format_string("%.2f MB", size / F.lit(1048576.0)))
    )


def kilobytes(size: Column) -> Column:
    return F.format_string("%.2f KB", size / F.lit(1024.0))


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), 1)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def label(code: Column, pairs: Iterable[tuple]) -> Column:
    out = F.lit(None).cast("string")
    for value, text, *_ in pairs:
        out = F.when(code == value, F.lit(text)).otherwise(out)
    return out


def entity_of(path: Column) -> Column:
    """picture, spaceUser or space by the first part of the request path that names one."""
    head = F.substring_index(F.regexp_replace(path, "^/+(api/)?", ""), "/", 1)
    return F.when(head.isin("picture", "spaceUser", "space"), head)


def longs_as_text(value: Column | str, kind: DataType) -> Column:
    """The value with every long in it, at any depth, as text, for readers whose numbers are doubles."""
    value = F.col(value) if isinstance(value, str) else value
    if isinstance(kind, LongType):
        return value.cast("string")
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: longs_as_text(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[longs_as_text(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def envelope(data: Column, code: int = 0, message: str = "ok") -> Column:
    """Response as JSON text; null data stays in it."""
    return F.to_json(F.struct(F.lit(code).alias("code"), data.alias("data"), F.lit(message).alias("message")), {"ignoreNullFields": "false"})


def said(template: str, *values: Column | str) -> Column:
    """A message with %s for each value."""
    return F.format_string(template, *values)
