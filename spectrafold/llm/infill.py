"""Fill-in-middle transformation (operator 11).

A text is cut into units; two cuts, drawn from a hash of the document's id,
part it into prefix, middle and suffix, which are written again in another
order behind sentinels. What is kept of a text to find the cuts is its maximal
runs of one character class (white space or not) with the number of units up to
the end of each. A cut is looked up among these numbers by binary search, and
its code point follows from the run's start and the length of a unit in it.

Units are words with the white space before them, white space at the end of the
text being one of its own (`word`), or code points (`char`).

Forms: plain (the text), psm (prefix, suffix, middle) and spm (suffix, prefix,
middle). A text that is empty or holds a sentinel stays plain, so every sentinel
stands once in the other forms and `restore` is exact.

Scale: one Arrow map over the scan, no shuffle; a task holds a part of a batch.
A null text counts as empty. A null id draws as the empty string would. Repeated
rows give the same row again, extra columns are kept under any name but that of
the added one, an empty table gives no rows. A very long text is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import code_points
from .shared import PART_ROWS

SEED = 42
#: Of 100 documents, so many are rearranged; of 100 of these, so many in the order suffix, prefix, middle.
RATE, SPM = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
DRAWS = 4
_FIELDS = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
_KIND = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


@dataclass(frozen=True)
class Runs:
    """Maximal runs of white space or of other characters.

    start: the code point where each run starts, and the end of the text;
    units: units that end before each run, and the units of the text;
    width: code points of a unit that lies in the run.
    """

    start: np.ndarray
    units: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, text: str, unit: str = "word") -> Runs:
        codes = code_points(text)
        space = (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))
        inner = np.flatnonzero(space[1:] != space[:-1]) + 1
        start = np.concatenate(([0], inner, [len(codes)])) if len(codes) else np.zeros(1, np.int64)
        length = np.diff(start)
        if unit == "char":
            many, width = length, np.ones(len(length), np.int64)
        else:
            many, width = (~space[start[:-1]]).astype(np.int64), length
            many[-1:] = 1
        return cls(start, np.concatenate(([0], np.cumsum(many))), width)

    @property
    def n(self) -> int:
        return int(self.units[-1])

    def cut(self, k: int) -> int:
        """The code point where the first k units end."""
        if k == 0:
            return 0
        run = int(np.searchsorted(self.units, k)) - 1
        return int(self.start[run] + (k - self.units[run]) * self.width[run])


def rearranged(text: str, draws: list[int], rate: int = RATE, spm: int = SPM, unit: str = "word") -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output) of one text."""
    runs = Runs.of(text, unit)
    n = runs.n
    if not text or draws[2] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    first, last = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = runs.cut(first), runs.cut(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws_of(key: str, seed: int = SEED) -> Column:
    """The first groups of 8 digits of the hex sha256 of `seed:key`, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(DRAWS)])


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", out: str = "fim", seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = "word") -> DataFrame:
    """docs with `out`: struct<n, form, prefix_chars, middle_chars, output>."""
    if unit not in ("word", "char"):
        raise ValueError("unit must be word or char")
    docs = docs.drop(out)

    @F.arrow_udf(_KIND)
    def fim(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, draws in columns:
            for at in range(0, len(texts), PART_ROWS):
                some = zip(texts.slice(at, PART_ROWS).to_pylist(), draws.slice(at, PART_ROWS).to_pylist(), strict=True)
                rows = [rearranged(t, d, rate, spm, unit) for t, d in some]
                yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_FIELDS.values())], list(_FIELDS))

    return docs.withColumn(out, fim(F.coalesce(F.col(text), F.lit("")), draws_of(key, seed)))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill_documents(docs: DataFrame) -> DataFrame:
    """Digest of operator 11: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = transform(docs.select("doc_id", "text")).select("doc_id", "fim.*")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        sha(F.col("output")).alias("output_sha256"),
        sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The same by lists of units: DuckDB cuts with the pattern itself and joins the units again.
ORACLE_SQL = r"""
with cut as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
    sha256('42:' || coalesce(doc_id::varchar, '')) as h
  from documents),
drawn as (
  select doc_id, text, u, len(u) as n,
    ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from cut),
placed as (
  select doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) as p, greatest(h1 % (n + 1), h2 % (n + 1)) as q, u,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form
  from drawn),
parted as (
  select doc_id, text, n, form,
    coalesce(array_to_string(u[1:p], ''), '') as prefix,
    coalesce(array_to_string(u[p + 1:q], ''), '') as middle,
    coalesce(array_to_string(u[q + 1:], ''), '') as suffix
  from placed)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(prefix)::bigint end as prefix_chars,
  case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle
    else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end) as output_sha256,
  sha256(prefix || middle || suffix) as restored_sha256
from parted
"""
