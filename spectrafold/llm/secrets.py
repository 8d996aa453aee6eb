"""Secret scan (operator 1, DataFrame functions only).

Three pattern kinds (assign, access, hex) are found in every whole text. Then
the entropy method adds spans: candidate strings are maximal runs of
[A-Za-z0-9+/_=-] of 20 or more characters; each has a character class (hex,
alnum or mixed; runs without a digit have none); a window of 20 characters
slides over it and keeps its symbol counts and sum of c*log2(c) incrementally,
one symbol entering and one leaving a step. Windows whose Shannon entropy
reaches the class's threshold are merged from the first to the last into one
span. Pattern matches and the harmless words and paths of an allow-list are cut
out of a candidate first; what is left of it is examined in parts of 20 or more
characters, each with its own class. A part that is a UUID is harmless.

Positions are code points, end exclusive. The text is cut once by the pattern
(split) and the matches are extracted; their lengths in turn give positions.

Scale: one map over the scan, no shuffle. Texts are searched by two cheap
tests; only texts with a hit pay for extraction. Null and empty texts have no
spans; repeated rows give the same row again; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut_out, let, pages, sums_before, unused

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
#: Runs are maximal, so a length in the pattern drops the same matches as a later test.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits a symbol from which a window of a class counts as random.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "mixed": 3.8}
#: A candidate, or what is left of it, of this shape is harmless.
ALLOW_WHOLE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"  # UUID
#: Harmless by themselves, not with what stands beside them; group 1 is the repeated character.
ALLOW = "|".join(
    (
        r"(?i:example|sample|dummy|placeholder|changeme|redacted)",
        r"0123456789|1234567890|(?i:abcdefghij|qwertyuiop)",
        r"(.)\1{7,}",
        r"(?i:/(?:usr|home|var|etc|opt|static|assets|images)/)",
    )
)
KINDS = ("assign", "access", "hex", "entropy")
_SCALE = 1 << 20
#: What the start of a cut adds to a sum; the start of a run adds 1.
_CUT = 1 << 32


_SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))


def _spans(kind: str, pieces: Column, matches: Column, keep_match: Callable[[Column], Column] | None = None, tested: Column | None = None) -> Column:
    """array<struct<start, rank, end, kind>> of matches, from the pieces around them."""
    columns = [pieces.alias("p"), matches.alias("m")] + ([tested.alias("g")] if tested is not None else [])
    good = lambda x: x["m"].isNotNull() & (keep_match(x) if keep_match else F.lit(True))
    # Behind the last piece there is no match.
    sized = F.transform(F.arrays_zip(*columns), lambda x: F.struct(F.length(x["p"]).alias("p"), F.coalesce(F.length(x["m"]), F.lit(0)).alias("m"), good(x).alias("good")))

    def placed(sized: Column) -> Column:
        before = sums_before(F.transform(sized, lambda x: (x["p"] + x["m"]).cast("long")))
        start = lambda x: (x["before"] + x["x"]["p"]).cast("int")
        found = F.filter(F.arrays_zip(sized.alias("x"), before.alias("before")), lambda x: x["x"]["good"])
        return F.transform(found, lambda x: _span(start(x), start(x) + x["x"]["m"], kind))

    return let(sized, placed)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def window_span(candidate: Column) -> Column:
    """struct<lo, hi>: from the first to the last window of the candidate with enough entropy; lo is -1 if there is none."""
    weight = F.array(*[F.lit(round(c * math.log2(c) * _SCALE) if c else 0) for c in range(WINDOW + 1)])
    most = {k: int(WINDOW * (math.log2(WINDOW) - t) * _SCALE) for k, t in THRESHOLDS.items()}
    symbols = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c) - F.lit(1))
    symbols = F.filter(symbols, lambda a: a >= 0)
    kind_limit = (
        F.when(~candidate.rlike("[0-9]"), F.lit(-1))
        .when(candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$") & candidate.rlike("[A-Fa-f]"), F.lit(most["hex"]))
        .when(candidate.rlike("[a-z]") & candidate.rlike("[A-Z]"), F.lit(most["mixed"]))
        .when(candidate.rlike("[A-Za-z]"), F.lit(most["alnum"]))
        .otherwise(F.lit(-1))
    )
    state = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit(-1).alias("lo"), F.lit(0).alias("hi"), kind_limit.alias("limit"), symbols.alias("s"), F.lit(0).alias("i")
    )

    def step(acc: Column, entering: Column) -> Column:
        i = acc["i"]
        leaving = F.when(i >= WINDOW, F.get(acc["s"], i - WINDOW)).otherwise(F.lit(-1))
        c_in, c_out = F.get(acc["counts"], entering), F.get(acc["counts"], F.greatest(leaving, F.lit(0)))
        gain = F.get(weight, c_in + 1) - F.get(weight, c_in)
        loss = F.get(weight, c_out - 1) - F.get(weight, c_out)
        same = leaving == entering
        total = acc["total"] + F.when(same, F.lit(0)).otherwise(gain + F.when(leaving >= 0, loss).otherwise(F.lit(0)))
        counts = F.when(same, acc["counts"]).otherwise(
            F.transform(acc["counts"], lambda x, j: x + (j == entering).cast("int") - (j == leaving).cast("int"))
        )
        random = (i >= WINDOW - 1) & (total <= acc["limit"])
        return F.struct(
            counts.alias("counts"),
            total.cast("long").alias("total"),
            F.when(random & (acc["lo"] < 0), i - (WINDOW - 1)).otherwise(acc["lo"]).alias("lo"),
            F.when(random, i + 1).otherwise(acc["hi"]).alias("hi"),
            acc["limit"].alias("limit"),
            acc["s"].alias("s"),
            (i + 1).alias("i"),
        )

    scanned = F.aggregate(symbols, state, step, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))
    allowed = candidate.rlike(ALLOW_WHOLE)
    none = F.struct(F.lit(-1).alias("lo"), F.lit(0).alias("hi"))
    return F.when((kind_limit < 0) | allowed, none).otherwise(scanned)


def _rest(runs: Column, cuts: Column) -> Column:
    """Parts of WINDOW characters or more that are left of the runs, which neither overlap nor touch.

    Between two neighbouring starts or ends of runs and cuts, sums of what has begun and not ended say whether a run
    and no cut is there; such a stretch is a part.
    """
    edge = lambda at, by: F.struct(at.alias("at"), F.lit(by).cast("long").alias("by"))
    edges = lambda spans, by: F.flatten(F.transform(spans, lambda x: F.array(edge(x["start"], by), edge(x["end"], -by))))
    every = F.array_sort(F.concat(edges(runs, 1), edges(cuts, _CUT)))

    def parts(every: Column) -> Column:
        before = sums_before(F.transform(every, lambda x: x["by"]))
        # Before an edge lies the stretch from the edge ahead of it.
        stretch = F.transform(before, lambda sum, i: F.struct(F.get(every, i - F.lit(1))["at"].alias("start"), F.get(every, i)["at"].alias("end"), sum.alias("sum")))
        found = F.filter(stretch, lambda x: (x["sum"] == 1) & (x["end"] - x["start"] >= WINDOW))
        return F.transform(found, lambda x: _span(x["start"], x["end"], "entropy"))

    return let(every, parts)


def scan(docs: DataFrame, text: str = "text", base: str = "base_spans", every: str = "all_spans") -> DataFrame:
    """docs with `base_spans` and `all_spans`, arrays of struct<start, rank, end, kind> by start, then kind. Columns of these names in docs are replaced, all others are kept."""
    docs = docs.drop(base, every)
    has_assign, has_run, left, own = unused([*docs.columns, base, every], "assign", "run", "left", "own")
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{_SPAN}>")
    cut = lambda pattern: F.split(t, pattern, -1)
    out = docs.withColumn(has_assign, t.rlike(ASSIGN)).withColumn(has_run, t.rlike(CANDIDATE))
    assign = _spans("assign", cut(ASSIGN), _found(t, ASSIGN), lambda x: F.length(x["g"]) >= ASSIGN_MIN, _found(t, ASSIGN, 2))
    access = _spans("access", cut(ACCESS), _found(t, ACCESS))
    hexes = _spans("hex", cut(HEX), _found(t, HEX))
    runs = _spans("entropy", cut(CANDIDATE), _found(t, CANDIDATE))
    out = out.withColumn(
        base,
        F.array_sort(F.concat(F.when(F.col(has_assign), assign).otherwise(none), F.when(F.col(has_run), F.concat(access, hexes)).otherwise(none))),
    )
    out = out.withColumn(left, F.when(F.col(has_run), _rest(runs, F.col(base))).otherwise(none))
    shifted = lambda r: lambda h: _span(r["start"] + h["start"], r["start"] + h["end"], "entropy")

    def unharmed(r: Column, part: Column) -> Column:
        harmless = _spans("entropy", F.split(part, ALLOW, -1), _found(part, ALLOW))
        return F.when(part.rlike(ALLOW_WHOLE), none).otherwise(_rest(F.array(r), F.transform(harmless, shifted(r))))

    def judged(r: Column, part: Column) -> Column:
        w = window_span(part)
        return F.struct(r["start"].alias("start"), r["rank"].alias("rank"), r["kind"].alias("kind"), w.alias("w"))

    def added(paged: Column) -> Column:
        on = lambda f: lambda r: let(cut_out(paged, r["start"], r["end"]), lambda part: f(r, part))
        parts = F.filter(F.transform(F.flatten(F.transform(F.col(left), on(unharmed))), on(judged)), lambda r: r["w"]["lo"] >= 0)
        return F.transform(parts, lambda r: _span(r["start"] + r["w"]["lo"], r["start"] + r["w"]["hi"], "entropy"))

    out = out.withColumn(own, F.when(F.size(left) > 0, let(pages(t), added)).otherwise(none))
    return out.withColumn(every, F.array_sort(F.concat(base, own))).drop(has_assign, has_run, left, own)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy of every document."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda spans, kind: F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("base_spans", "assign").alias("n_assign"),
        count("base_spans", "access").alias("n_access"),
        count("base_spans", "hex").alias("n_hex"),
        F.sha2(_joined("base_spans").cast("binary"), 256).alias("base_sha256"),
        _joined("all_spans").alias("spans"),
        count("all_spans", "entropy").alias("n_entropy"),
    )
