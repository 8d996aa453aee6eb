"""Fill-in-middle, collocations and license scans against plain versions, on odd inputs too; line and secret work in proportion to a text."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.llm import hilbert, infill, licenses, lines, phrases, secrets
from spectrafold.llm.keyfilter import KeyFilter
from spectrafold.llm.shared import BATCH_BYTES, keep, numbered, sums_before

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, spans string, n_words string"


def odd_rows():
    rnd = random.Random(5)
    words = ["a", "b", "C", "naïve", "漢字", "🙂", "<P>", "MIT", "License", "license,", "Apache", "general", "public", "x" * 300, "\x1c", "\x85"]
    gaps = [" ", "  ", "\n", "\t", ". ", "", "\x0b", ", "]
    some = ["".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    texts = [None, "", " ", "\n \t", "one", " one ", "<S>", "ab <P> cd", "word " * 4000, "mit license " * 500, *some]
    rows = [(i, t, "xy" if i % 3 else None, "own", "own") for i, t in enumerate(texts)]
    return [*rows, rows[-1], rows[-1], (None, "null id, MIT license", "xy", "own", "own"), (None, "null id, MIT license", "xy", "own", "own"), (3, "same id, other text", None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where(F.lit(False))


def plain_infill(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:p]), "".join(units[p:q]), "".join(units[q:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        form, out = "plain", text
    elif h4 % 100 < 80:
        form, out = "spm", f"<S>{c}<P>{a}<M>{b}"
    else:
        form, out = "psm", f"<P>{a}<S>{c}<M>{b}"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, n, form, None if form == "plain" else len(a), None if form == "plain" else len(b), sha(out), sha(text)


def test_infill_as_plain(docs, rows, empty):
    got = [tuple(r) for r in infill.infill_documents(docs).collect()]
    assert Counter(got) == Counter(plain_infill(r[0], r[1]) for r in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert infill.infill_documents(empty).count() == 0


def test_runs_cut_where_the_pattern_does():
    for text in ["", " ", "a", " a", "a ", "a b", "\n\na  b\t", "漢 字🙂 "]:
        units, runs = UNIT.findall(text), infill.Runs.of(text)
        assert runs.n == len(units)
        assert [runs.cut(k) for k in range(runs.n + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]
        chars = infill.Runs.of(text, "char")
        assert [chars.cut(k) for k in range(chars.n + 1)] == list(range(len(text) + 1))


def test_infill_keeps_other_columns(docs):
    made = infill.transform(docs, out="spans", rate=100, unit="char")
    assert made.columns == ["doc_id", "text", "lang", "n_words", "spans"]
    assert made.where(~infill.restore(F.col("spans.output"), F.col("spans.form")).eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    with pytest.raises(ValueError):
        infill.transform(docs, unit="token")


def plain_collocations(rows, longest=3, least=10, cover=50, top=2000):
    counts = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in cands.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= cover * f[p[i:j]]}
        best = []
        for p, a in cands.items():
            if p not in gone:
                score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), l, r))
        out.extend((lang, rank, p.decode(), -a, l, r, n, -s) for rank, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1))
    return out


def test_collocations_as_plain(docs, rows, empty, spark):
    assert sorted(map(tuple, phrases.collocations_of_documents(docs).collect())) == sorted(plain_collocations(rows))
    rnd = random.Random(8)
    made = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 40))).replace("h ", ". "), "xy") for i in range(300)]
    some = spark.createDataFrame(made, "doc_id bigint, text string, lang string").repartition(5)
    for longest, least, cover, top in ((3, 10, 50, 2000), (4, 5, 80, 50), (2, 3, 50, 7)):
        got = phrases.collocations(some, longest=longest, least=least, cover=cover, top=top)
        assert sorted(map(tuple, got.collect())) == sorted(plain_collocations(made, longest, least, cover, top))
    assert phrases.collocations_of_documents(empty).count() == 0


def test_blocks_end_with_pieces(spark, docs, rows):
    parts = list(phrases._at_ends(phrases.tokens("a b. c d e f. g. " + "h " * 20 + ". i"), 4))
    assert b" ".join(sum(parts, [])).count(b"\xff") == 5 and all(p[-1] == b"\xff" for p in parts)
    whole = phrases.frequent(keep(phrases.postings(docs), "t"))
    small = phrases.frequent(keep(phrases.postings(docs, block=50), "t"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, small.collect()))


@pytest.mark.parametrize("least", [10, 300])
def test_hashed_phrases_travel_packed(least):
    rnd = np.random.default_rng(3)
    hashes = [rnd.choice(rnd.integers(0, 1 << 33, 5000, dtype=np.uint64), 20_000) for _ in range(3)]
    hashes.append(np.full(1000, hashes[0][0]))
    rows = phrases._packed(hashes, 33, 25, least)
    assert rows.num_rows <= 256 and rows.nbytes < (6 if least < 256 else 9) * len(np.unique(np.concatenate(hashes)))
    got = {}
    for r in rows.to_pylist():
        low, many = np.frombuffer(r["h"], "<u4").tolist(), np.frombuffer(r["f"], "u1" if least < 256 else "<u4").tolist()
        got |= {(r["part"] << 25) + h: f for h, f in zip(low, many, strict=True)}
    assert got == {h: min(f, least) for h, f in Counter(np.concatenate(hashes).tolist()).items()}
    assert phrases._packed([hashes[0][:0]], 33, 25, least).num_rows == 0


def test_collocations_in_many_parts(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(phrases, "PART", 64)
    monkeypatch.setattr(phrases, "GATHERED", 100)
    assert sorted(map(tuple, phrases.collocations_of_documents(docs).collect())) == sorted(plain_collocations(rows))
    made = [(i, "a b c " * 30 + "d", "xy") for i in range(20)]
    some = spark.createDataFrame(made, "doc_id bigint, text string, lang string").repartition(3)
    got = phrases.collocations(some, longest=4, least=300)
    assert sorted(map(tuple, got.collect())) == sorted(plain_collocations(made, 4, 300))


def test_key_filter_loses_no_key(spark):
    keys = keep(spark.range(5000).select(F.xxhash64("id").alias("h")), "keys")
    own = keys.toArrow().column("h").to_numpy().view("uint64")
    for most in (1 << 28, 1 << 16):
        known = KeyFilter.of(keys, "h", most)
        assert known.has(own).all()
    other = spark.range(10000, 20000).select(F.xxhash64("id").alias("h")).toArrow().column("h").to_numpy().view("uint64")
    assert KeyFilter.of(keys, "h").has(other).mean() < 0.2
    assert not KeyFilter.of(keys.where("h is null"), "h").has(own).any()


def test_numbered(spark):
    rows = [(x % 7, str(x)) for x in range(500)]
    got = numbered(spark.createDataFrame(rows, "a int, b string").repartition(6), [F.col("a").desc(), F.col("b")], "i").orderBy("i").collect()
    assert [(r["a"], r["b"]) for r in got] == sorted(rows, key=lambda x: (-x[0], x[1])) and [r["i"] for r in got] == list(range(500))


def plain_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(k, t.label) for t in licenses.BASE for p in [t.text.split()] for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    starts = [k for k, _ in found]
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))


def test_license_phrases_as_plain(docs, rows, empty):
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan_documents(docs).collect())
    assert got == Counter((r[0], *plain_base(r[1])) for r in rows)
    assert max(r[2] for r in got) == 500
    assert licenses.scan_documents(empty).count() == 0


def test_license_texts_with_changes(spark):
    rnd = random.Random(2)
    noise = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    wanted, rows = {}, []
    for i, t in enumerate(t for t in licenses.TEXTS if len(licenses.words_of(t.text)) > 15):
        w = t.text.split()
        at = len(w) // 2
        changed = [*w[:at], "one", "two", "three", *w[at:]]
        changed[3] = "other"
        rows.append((i, f"{noise(40)} {' '.join(changed).upper()} {noise(2000)}"))
        wanted[i] = (t.label, 40, 40 + len(licenses.words_of(" ".join(changed))))
    two = " ".join([licenses.TEXTS[0].text, noise(30), licenses.TEXTS[0].text, licenses.TEXTS[6].text])
    rows += [(100, two), (101, noise(3000)), (102, licenses.TEXTS[0].text[:60]), (103, " ".join(reversed(licenses.TEXTS[0].text.split())))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit("own")).withColumn("a", F.lit("own"))
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for i, (label, start, end) in wanted.items():
        assert any((s["label"], s["start"], s["end"]) == (label, start, end) and s["share"] > 0.9 for s in got[i]["spans"]), i
    long = [s for s in got[100]["spans"] if not s["base"]]
    assert [s["label"] for s in long] == ["mit", "mit", "bsd"] and got[100]["a"] == "own" and got[100]["text"] == two
    assert not got[101]["spans"] and not got[102]["spans"] and not got[103]["spans"]


def test_long_texts_are_hashed_in_parts(spark):
    filler = "word " * (licenses.PART_WORDS - 1)
    docs = spark.createDataFrame([(1, f"{filler}MIT License {filler}general public license")], "doc_id bigint, text string")
    (r,) = licenses.scan_documents(docs).collect()
    assert (r["n_base"], r["first_word"], r["last_word"]) == (2, licenses.PART_WORDS - 1, 2 * licenses.PART_WORDS)


def test_license_scan_bounds_batches_and_files(spark, docs, monkeypatch):
    name, files = "spark.sql.execution.arrow.maxBytesPerBatch", []
    monkeypatch.setattr(licenses, "keep", lambda df, name: files.append(kept := keep(df, name)) or kept)
    before, partitions = spark.conf.get(name), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        many = docs.crossJoin(spark.range(5)).select((F.col("doc_id") * 1000 + F.col("id")).alias("doc_id"), "text")
        got = licenses.scan_documents(many)
        assert spark.conf.get(name) == str(BATCH_BYTES)
        assert got.where("n_base > 0").count() > 40
        assert len(files[0].inputFiles()) <= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set(name, before)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sums_before(spark):
    for n in (0, 1, 63, 64, 65, 5000):
        got = spark.range(1).select(sums_before(F.transform(F.slice(F.sequence(F.lit(1), F.lit(n + 1)), 1, F.lit(n)), lambda x: x.cast("long"))).alias("s")).first()["s"]
        assert got == [k * (k + 1) // 2 for k in range(n)]


def seconds(make):
    t = time.time()
    make()
    return time.time() - t


@pytest.mark.parametrize("scan", [lambda d: secrets.scan_documents(d), lambda d: lines.dedup_documents(d, runs=True)], ids=["secrets", "lines"])
def test_time_is_in_proportion_to_a_text(spark, scan):
    def of(n):
        text = "\n".join(f"password=abcdefgh{k % 97} of line {k}" for k in range(n))
        docs = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string").coalesce(1)
        return seconds(lambda: scan(docs).collect())

    of(100)
    fixed, small, large = of(100), of(8000), of(32000)
    assert large - fixed < 6 * max(small - fixed, 1.0)


def test_shards_prune_on_every_dimension(spark):
    rnd = random.Random(1)
    made = [(i, "x" * int(2 ** rnd.uniform(3, 13)), rnd.choice(["en"] * 6 + ["de", "es", "fr"]), f"src{rnd.randrange(20)}") for i in range(4000)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string")
    shard = {r["doc_id"]: r["shard"] for r in hilbert.shard_documents(docs, 40).collect()}
    read = []
    for k, size in ((3, lambda r: r[3]), (2, lambda r: r[2]), (1, lambda r: len(r[1]))):
        low, high = {}, {}
        for r in made:
            s, v = shard[r[0]], size(r)
            low[s], high[s] = min(low.get(s, v), v), max(high.get(s, v), v)
        values = sorted({size(r) for r in made}) if k != 1 else [16, 64, 256, 1024, 4096]
        read.append(sum(low[s] <= v <= high[s] for v in values for s in low) / len(values))
    assert read[0] <= 16 and read[1] <= 20 and read[2] <= 26
