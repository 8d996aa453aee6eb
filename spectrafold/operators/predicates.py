"""Filters that are left out where their argument is absent, soft deletion and visibility.

Strings compare without regard to case; % and _ of a substring stay wildcards.
A null or blank argument leaves the predicate out; the number 0 does not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectrafold.sources.catalogue import PASS


def given(value: Any) -> bool:
    return value is not None and not (isinstance(value, str) and not value.strip()) and not (isinstance(value, (list, tuple)) and not value)


def equal(column: str, value: Any) -> Column:
    return F.lower(column) == str(value).lower() if isinstance(value, str) else F.col(column) == F.lit(value)


def like(column: str, value: str) -> Column:
    return F.col(column).ilike(f"%{value}%")


def tag_text(tag: str) -> Column:
    """The quoted tag stands somewhere in the JSON text."""
    return F.col("tags").ilike(f'%"{tag}"%')


def tag_typed(tag: str) -> Column:
    """The tag is one of the parsed list; text that does not parse has none."""
    return F.coalesce(F.array_contains(F.from_json("tags", "array<string>"), tag), F.lit(False))


def every(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass(frozen=True)
class Query:
    """Optional filters: `equals` and `contains` by column; the rest for pictures."""

    equals: dict[str, Any] = field(default_factory=dict)
    contains: dict[str, str | None] = field(default_factory=dict)
    search: str | None = None
    public_only: bool = False
    tags: Sequence[str] = ()
    category: str | None = None
    typed_tags: bool = False

    def predicate(self) -> Column:
        parts = [equal(c, v) for c, v in self.equals.items() if given(v)]
        parts += [like(c, v) for c, v in self.contains.items() if given(v)]
        if given(self.search):
            parts.append(like("name", self.search) | like("introduction", self.search))
        if self.public_only:
            parts.append(F.col("spaceId").isNull())
        if given(self.category) and self.category != "all":
            parts.append(equal("category", self.category))
        parts += [(tag_typed if self.typed_tags else tag_text)(t) for t in self.tags]
        return every(parts)


def live(df: DataFrame) -> DataFrame:
    """Rows that are not softly deleted; for tables with isDelete only."""
    return df.where(F.col("isDelete") == 0)


def public_visible() -> Column:
    return (F.col("reviewStatus") == PASS) & F.col("spaceId").isNull()


def space_visible(space_id: int) -> Column:
    return (F.col("reviewStatus") == PASS) & (F.col("spaceId") == space_id)


def credentials(account: str, password_hash: str) -> Column:
    return equal("userAccount", account) & (F.col("userPassword") == password_hash)


def menu_visible(path: str, role: str) -> Column:
    """Menu entries below /admin are for administrators."""
    return ~F.col(path).startswith("/admin") | (F.col(role) == "admin")


def masked(items: Column, mask: Column) -> Column:
    """The items whose place is true in the mask."""
    return F.filter(items, lambda _, i: F.coalesce(F.get(mask, i), F.lit(False)))


def outer_key(key: str, rows: DataFrame) -> Column:
    """The key for an outer join; rows without one, often a third of all, get negative numbers that spread them. Ids are positive."""
    return F.coalesce(F.col(key), F.lit(-1) - F.pmod(F.xxhash64(*rows.columns), F.lit(4096)))
