"""Sharding, fingerprints, line dedup, the Jaccard join, decontamination and the pipeline against brute force and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spectrafold.llm import decontam, hilbert, jaccard, lines, minhash, wordhash
from spectrafold.llm.shared import unused

DOCS = "doc_id bigint, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def corpus():
    """Texts with exact copies, near copies, a shared passage, odd ones, repeated rows and null ids."""
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: rnd.choices(vocabulary, k=n)
    passage = make(40)
    out, n = [], 0
    for _ in range(25):
        base = make(rnd.randrange(8, 120))
        for _ in range(rnd.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = "edit"
            if rnd.random() < 0.3:
                w += passage
            out.append((n, "\n".join(" ".join(w[k : k + 7]) for k in range(0, len(w), 7))))
            n += 1
    hub = make(100)  # a dense group: copies of one text that often link through it alone
    for _ in range(40):
        w = list(hub)
        for _ in range(rnd.randrange(0, 4)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(9)}"
        out.append((n, " ".join(w)))
        n += 1
    out += [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "ONE two"), (905, "one two three four five"), (None, out[3][1]), out[5], out[5], (5, "other text under a used id of five"), (906, "long " * 2000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).withColumn("n", F.lit(1)).withColumn("class", F.lit("clash")).withColumn("matches", F.lit("clash"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where(F.lit(False))


def plain_components(corpus):
    sets = [shingles(t) for _, t in corpus]
    parent = list(range(len(corpus)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(corpus)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(corpus):
        least[find(k)].append(i)
    named = {k: min((i for i in v if i is not None), default=None) for k, v in least.items()}
    return [(i, len(sets[k]), named[find(k)]) for k, (i, _) in enumerate(corpus)], [find(k) for k in range(len(corpus))]


def test_jaccard_join(docs, corpus, empty):
    want, _ = plain_components(corpus)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert jaccard.link_documents(empty).count() == 0


def test_jaccard_join_in_small_blocks_with_salts(docs, corpus, monkeypatch):
    monkeypatch.setattr(jaccard, "SALTED", 3)
    want, _ = plain_components(corpus)
    for tokens, classes in ((40, 60_000), (1_000_000, 2)):
        monkeypatch.setattr(jaccard, "BLOCK_TOKENS", tokens)
        monkeypatch.setattr(jaccard, "BLOCK_CLASSES", classes)
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(docs.repartition(3)).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_jaccard_join_with_ids_of_text(docs, corpus):
    named = docs.withColumn("doc_id", F.format_string("d%04d", "doc_id"))
    want, _ = plain_components([(f"d{i:04d}" if i is not None else "dnull", t) for i, t in corpus])
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(named).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_one_of_each_group_stays(docs, corpus):
    _, group = plain_components(corpus)
    kept = jaccard.keep_one(docs).collect()
    blank = sum(not words(t) for _, t in corpus)
    assert len(kept) == blank + len({g for g, (_, t) in zip(group, corpus, strict=True) if words(t)})
    assert {r["class"] for r in kept} == {"clash"}


def test_own_columns_of_any_name_stay(docs, spark):
    names = ["own", "key", "what", "place", "_own", "_hash", "_id", "_kept", "_row", "text_hash", "label", "_a", "_b", "_lines", "_removed", "removed", "_bytes", "_matches", "name", "match"]
    named = docs.select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    (out,) = unused(names, "removed")
    items = spark.createDataFrame([(1, "one two three four five")], "item_id int, text string")
    for got in (
        jaccard.keep_one(named),
        lines.dedup(named, runs=True, removed=out).drop(out),
        decontam.decontaminate(named, items),
        corpus_pipeline.line_dedup(spark, named, ""),
    ):
        assert got.columns == named.columns
        assert {tuple(r[n] for n in names) for r in got.collect()} == {tuple(names)}
    assert unused(["A", "_a"], "a", "a") == ["__a", "___a"]


def test_every_item_row_counts_by_itself(docs, spark, monkeypatch):
    items = spark.createDataFrame([("x", "one two three four five"), ("x", "one two three four five"), ("x", "long " * 40), (None, "one two three four five")], "item_id string, text string")
    got = [(r["doc_id"], r["item_id"], r["n_windows"]) for r in decontam.contaminated(docs, items).where("doc_id = 905").collect()]
    assert sorted(got, key=repr) == sorted([(905, "x", 1), (905, "x", 1), (905, None, 1)], key=repr)
    want = sorted(decontam.decontaminate(docs, items).select("doc_id").collect(), key=repr)
    found = sorted(decontam.contaminated(docs, items).collect(), key=repr)
    monkeypatch.setattr(decontam, "ITEM_BYTES", 200)  # several blocks
    assert sorted(decontam.decontaminate(docs, items).select("doc_id").collect(), key=repr) == want
    assert sorted(decontam.contaminated(docs, items).collect(), key=repr) == found


def test_prefix_lemma(spark):
    """Linking sets meet in the lesser of their demands, at places that the open pairs ask for."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        n = int(rng.integers(1, 60))
        a = set(rng.integers(0, 500, n).tolist())
        for _ in range(3):
            drop = int(rng.integers(0, max(1, len(a) // 6) + 1))
            sets.append(set(rng.permutation(sorted(a))[drop:].tolist()) | set(rng.integers(500, 900, drop).tolist()))
    sets = [s for s in {frozenset(s) for s in sets} if s]
    rows = [(k, len(s), t) for k, s in enumerate(sets) for t in s]
    tokens = jaccard._counted(spark.createDataFrame(rows, "class bigint, n int, token bigint"))
    prefix = defaultdict(dict)
    asked = {}
    for r in jaccard.postings(tokens).collect():
        prefix[r["class"]][r["token"]] = r["place"]
        asked[r["class"]] = r["matches"]
    linked = 0
    for x, a in enumerate(sets):
        for y, b in enumerate(sets[:x]):
            both = len(a & b)
            if 4 * both < 3 * (len(a) + len(b) - both):
                continue
            linked += 1
            demand = min(asked[x], asked[y])
            after = [min(len(a) - prefix[x][t], len(b) - prefix[y][t]) for t in prefix[x].keys() & prefix[y].keys()]
            assert sum(7 * (n + demand - 1) >= 3 * (len(a) + len(b)) for n in after) >= demand
            assert 7 * max(after) >= 3 * (len(a) + len(b))
    assert linked > 50 and max(asked.values()) > 1


def chunk_table(df):
    own = df.select("doc_id", "text", F.xxhash64("text").alias("a"), lines.chunks(lines.line_hashes(lines.lines_of(F.col("text")))).alias("c"))
    return [(r["doc_id"], r["text"], r["a"], [(c["start"], c["end"]) for c in r["c"]]) for r in own.where("text is not null").collect()]


def test_line_dedup(docs, empty):
    table = chunk_table(docs)
    seen = defaultdict(list)
    rank = lambda i, a, s: (i is not None, i or 0, a, s)
    for i, text, a, chunks in table:
        split = text.split("\n")
        assert [c[0] for c in chunks] == [0, *[c[1] for c in chunks[:-1]]] and chunks[-1][1] == len(split)
        for s, e in chunks:
            if e - s >= 2:
                seen["\n".join(split[s:e])].append(rank(i, a, s))
    want = []
    for i, text, a, chunks in table:
        split, gone = text.split("\n"), set()
        for s, e in chunks:
            if e - s >= 2 and min(seen["\n".join(split[s:e])]) != rank(i, a, s):
                gone.update(range(s, e))
        want.append((i, len(gone), hashlib.sha256("\n".join(x for k, x in enumerate(split) if k not in gone).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in lines.dedup_documents(docs).collect()]
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(got, key=repr) == sorted([*want, (900, 0, nothing)], key=repr)
    assert sum(w[1] for w in want) > 0
    assert lines.dedup_documents(empty).count() == 0
    assert lines.dedup(docs).where("doc_id = 900 and text is null").count() == 1


def test_chunks_meet_again_after_an_inserted_line(spark):
    body = [f"line {k}" for k in range(60)]
    table = chunk_table(spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join([*body[:20], "new", *body[20:]]))], DOCS))
    cut = [{"\n".join(t.split("\n")[s:e]) for s, e in c} for _, t, _, c in table]
    assert len(cut[0] & cut[1]) >= len(cut[0]) - 3 and len(cut[0]) > 8


def test_line_runs_go_whole(spark):
    rnd = random.Random(8)
    number = iter(range(10**6))
    line = lambda n: " ".join(f"u{next(number)}" for _ in range(n))
    rows, planted, i = [], [], 0
    for k in range(60):  # passages of 2 to 8 lines and 50 words or more, each time between other neighbours
        passage = [line(rnd.randrange(26, 34) if k % 3 == 0 else 13) for _ in range(2 if k % 3 == 0 else rnd.randrange(4, 9))]
        for copy in range(3):
            before, after = [line(5) for _ in range(rnd.randrange(3))], [line(5) for _ in range(rnd.randrange(3))]
            rows.append((i, "\n".join([*before, *passage, *after])))
            planted.append((i, copy, "\n".join([*before, *after] if copy else [*before, *passage, *after])))
            i += 1
    alone, short, pair = line(50), line(49), [line(20), line(20)]
    rows += [(900, alone), (901, f"{line(3)}\n{alone}\n{line(3)}"), (902, short), (903, f"{line(3)}\n{short}\n{line(3)}")]
    parted = [line(20) for _ in range(4)]  # both pairs stand earlier, the step between them nowhere: 40 words twice
    rows += [(904, "\n".join([line(3), *parted[:2]])), (905, "\n".join([line(3), *parted[2:]])), (906, "\n".join(parted)), (907, "\n".join([line(3), *pair, *pair, *pair]))]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["text"] for r in lines.dedup(df, runs=True).collect()}
    assert [got[n] for n, _, _ in planted] == [want for _, _, want in planted]
    assert got[900] == alone and got[901].split("\n") == [rows[-7][1].split("\n")[0], rows[-7][1].split("\n")[2]]
    assert got[902] == short and got[903] == rows[-5][1]
    held = {x for text in got.values() for x in text.split("\n")}
    assert held >= {x for _, text in rows for x in text.split("\n")}
    by_chunks = {r["doc_id"]: r["text"] for r in lines.dedup(df).collect()}
    assert sum(by_chunks[n] == want for n, copy, want in planted if copy) < sum(copy > 0 for _, copy, _ in planted) / 2


def test_line_runs_on_odd_texts(docs, corpus, empty):
    got = lines.dedup(docs, runs=True).collect()
    assert len(got) == len(corpus) and lines.dedup_documents(empty, runs=True).count() == 0
    assert {x for r in got for x in (r["text"] or "").split("\n")} >= {x for _, t in corpus for x in (t or "").split("\n")}
    assert [r["text"] for r in got if r["doc_id"] == 900] == [None]


@pytest.fixture(scope="module")
def items(spark, corpus):
    w = words(corpus[0][1])
    rows = [(1, " ".join(w[:30])), (2, " ".join([*w[:15], "changed", *w[16:30]])), (3, None), (4, " "), (5, "One TWO"), (6, " ".join(f"z{k}" for k in range(25))), (6, " ".join(f"z{k}" for k in range(25)))]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def plain_matches(corpus, items):
    out = set()
    for item_id, item in items:
        v = words(item)
        wide = min(5, len(v))
        bag = Counter(tuple(v[k : k + wide]) for k in range(len(v) - wide + 1)) if v else None
        for i, text in corpus:
            w = words(text)
            s = [tuple(w[k : k + wide]) for k in range(len(w) - wide + 1)] if v else []
            size = min(sum(bag.values()), len(s)) if v else 0
            if not size:
                continue
            best = max(sum((Counter(s[k : k + size]) & bag).values()) for k in range(0, len(s) - size + 1, 1 if len(s) < 1000 else 997))
            if best / (size + sum(bag.values()) - best) >= 0.75:
                out.add((i, item_id))
    return out


def test_decontamination(docs, items, corpus, empty):
    want = plain_matches(corpus, [tuple(r) for r in set(items.collect())])
    got = decontam.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and (0, 1) in want and (903, 5) in want
    assert all(0.75 <= r["similarity"] <= 1 for r in got)
    left = decontam.decontaminate(docs, items)
    assert left.count() == sum(not plain_matches([row], [tuple(r) for r in set(items.collect())]) for row in corpus)
    assert left.columns == docs.columns
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.contaminated(docs, items.where(F.lit(False))).count() == 0


def test_multi_index_finds_every_fingerprint_within_the_radius(monkeypatch):
    rng = np.random.default_rng(5)
    own = decontam.Sized(20, ids=list(range(50)), prints=[int(x) for x in rng.integers(0, 2**64, 50, dtype=np.uint64)])
    own.close()
    found = []
    for k in range(50):
        flips = rng.permutation(64)[: k % 30]
        found.append(own.prints[k] ^ sum(1 << int(b) for b in flips))
    monkeypatch.setattr(decontam, "CANDIDATES", 4000)  # some windows at a time
    got = [pair for window, item in own.candidates(np.array(found, np.uint64)) for pair in zip(window.tolist(), item.tolist(), strict=True)]
    want = {(w, k) for w, f in enumerate(found) for k, p in enumerate(own.prints) if (f ^ p).bit_count() <= decontam.RADIUS}
    assert sorted(got) == sorted(want)


def test_shingle_sets_as_plain():
    texts = ["A b c d e f", "a B", "", "é  É\tx \x85y z w v", " ".join("ab" * 50)]
    for text, got in zip(texts, wordhash.shingle_sets([t.encode() for t in texts]), strict=True):
        assert len(got) == len(shingles(text))
    same = list(wordhash.shingle_sets([b"a b c d e", b"x", b"A  B\nC d E", None]))
    assert (same[0] == same[2]).all() and len(same[3]) == 0


def test_hilbert_curve_is_a_walk(spark):
    bits, side = 3, 8
    cells = spark.range(side**3).select(*[(F.floor(F.col("id") / side**k) % side).cast("int").alias(f"x{k}") for k in range(3)])
    walk = cells.select("*", hilbert.hilbert_index([F.col("x0"), F.col("x1"), F.col("x2")], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in walk] == list(range(side**3))
    assert all(sum(abs(a[k] - b[k]) for k in range(3)) == 1 for a, b in zip(walk, walk[1:], strict=False))


def test_written_shards_hold_every_row_once(docs, corpus, tmp_path):
    wide = docs.withColumn("source", F.lit("s")).withColumn("lang", F.col("n").cast("string")).withColumn("place", F.lit("own")).withColumn("size_cell", F.lit("own"))
    hilbert.write_shards(wide, f"file://{tmp_path}/shards", 5)
    back = docs.sparkSession.read.parquet(f"file://{tmp_path}/shards")
    rows = back.collect()
    assert Counter((r["doc_id"], r["text"], r["place"], r["size_cell"]) for r in rows) == Counter((i, t, "own", "own") for i, t in corpus)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards(docs, corpus, empty, spark, tmp_path):
    wide = docs.withColumn("source", F.lit("s")).withColumn("lang", F.lit(None).cast("string"))
    got = hilbert.shard_documents(wide, 7).collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(
        ((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in corpus), key=repr
    )
    by = Counter(r["shard"] for r in got)
    assert max(by.values()) - min(by.values()) <= 1 and set(by) == set(range(7))
    for shard, n in by.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    assert hilbert.shard_documents(empty.withColumn("source", F.lit("s")).withColumn("lang", F.lit("x")), 7).count() == 0


def test_fingerprints(spark, corpus, docs, empty):
    unique = {i: t for i, t in corpus if i is not None and i != 5}
    df = spark.createDataFrame(list(unique.items()), DOCS)
    got = {r["doc_id"]: r for r in minhash.fingerprint_with_next(df).collect()}
    order = sorted(unique, reverse=True)
    for k, i in enumerate(order):
        text, following = unique[i] or "", unique[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        a, b = shingles(text), shingles(edited)
        if len(a) > 20:
            assert abs(got[i]["near_edited"] - len(a & b) / len(a | b)) < 0.25
    prints = defaultdict(set)
    for r in minhash.fingerprint_with_next(docs).join(docs.select("doc_id", F.col("text").alias("own")), "doc_id").where("doc_id <> 5").collect():
        prints[r["own"]].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert minhash.fingerprint_with_next(docs).count() == len(corpus)
    assert minhash.fingerprint_with_next(empty).count() == 0


def test_pipeline(spark, corpus, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus if i is not None]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"z{k}" for k in range(25)))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == [n for n, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.where(F.lit(False)), str(tmp_path)).count() == 0, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 10 < len(out) < len(rows) and all(len(r["ids"]) == 4 * r["n_tokens"] for r in out)
    assert {900, 901, 902}.isdisjoint(r["doc_id"] for r in out)


def test_pipeline_bounds_batches_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    rows = spark.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), 10_000).alias("text"), F.lit("en").alias("lang"))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.nbytes], pa.int64())})

    def largest():
        return max(r["n"] for r in rows.mapInArrow(sizes, "n long").collect())

    try:
        assert largest() > 16_000_000
        corpus_pipeline.language_id(spark, rows, "")
        assert largest() < 6_000_000
        spark.conf.set(name, "1000000")
        corpus_pipeline.byte_level_bpe(spark, rows, "")
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.unset(name)


def test_means_of_clusters_copy_few_columns():
    import tracemalloc

    from spectrafold.llm import langid

    vectors = np.random.default_rng(5).random((1000, 1 << langid.BITS), np.float32)
    tracemalloc.start()
    centres = langid._cluster(vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < vectors.nbytes / 4
    chosen = np.argmax(vectors @ centres.T, axis=1) == 0
    assert (langid._mean(vectors, chosen) == vectors[chosen].mean(0)).all()


def plain_fingerprint(text):
    """One-permutation MinHash, bin by bin."""
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    number = lambda seed, x: signed(xxhash.xxh64(x.to_bytes(8, "little", signed=True), seed=seed % (1 << 64)).intdigest())
    two = lambda a, b: number(number(42, a), b)
    own = [w for w in re.split(r"[ \t-\r]+", text.lower()) if w]
    h = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in own]
    if not h:
        return ""
    if len(h) < 5:
        seed = 42
        for x in h:
            seed = number(seed, x)
        hashes = [seed]
    else:
        hashes = [two(two(two(h[i], h[i + 1]), two(h[i + 2], h[i + 3])), h[i + 4]) for i in range(len(h) - 4)]
    least = {}
    for x in hashes:
        b = (x >> 57) + 64
        least[b] = min(least.get(b, x), x)
    slots = {b: x & 255 for b, x in least.items()}
    out = []
    for i in range(128):
        found = slots.get(i)
        for t in range(12):
            if found is None:
                found = slots.get(zlib.crc32(f"{t}:{i}".encode()) % 128)
        if found is None:
            factor, offset = (i * 1103515245 + 12345) % (1 << 15) * 2 + 1, (i * 69069 + 7) % 128
            found = min(((b * factor + offset) % 128, low) for b, low in slots.items())[1]
        out.append(found)
    return bytes(out).hex()


def test_fingerprints_as_plain(spark):
    rnd = random.Random(21)
    texts = [" ".join(f"W{rnd.randrange(3000)}é"[: rnd.randrange(2, 7)] for _ in range(n)) for n in (1, 2, 4, 5, 6, 9, 20, 60, 300, 2000)] + ["", " \n "]
    df = minhash.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), DOCS), "text", "print")
    got = {r["doc_id"]: r["hex"] for r in df.select("doc_id", minhash.as_hex("print").alias("hex")).collect()}
    assert [got[k] for k in range(len(texts))] == [plain_fingerprint(t) for t in texts]


def test_next_rows_across_many_ranges(spark):
    rows = [(k if k % 7 else None, f"text {k}") for k in range(200)] + [(5, "again"), (-(1 << 40), "low")]
    got = minhash.with_next(spark.createDataFrame(rows, DOCS), "doc_id", ["text"], 23).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    follow = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    assert len(got) == len(rows) and {(r["doc_id"], r["text"]): r["next_text"] for r in got} == follow
    with pytest.raises(TypeError):
        minhash.with_next(spark.createDataFrame([("a", "b")], "doc_id string, text string"), "doc_id", ["text"], 3)


def test_next_rows_of_one_frequent_id(spark):
    rnd = random.Random(8)
    often = [(7, f"{rnd.choice(['', 'The ', 'é, ', 'x'])}{rnd.randrange(10**6)} {k}") for k in range(300)] + [(7, None), (7, "")]
    rows = often + [(None, f"n{k}") for k in range(200)] + [(k * 3 - 500, f"text {k}") for k in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    got = minhash.with_next(df, "doc_id", ["text"], 23).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    follow = {r: order[(k + 1) % len(order)][1] for k, r in enumerate(order)}
    assert len(got) == len(rows) and {(r["doc_id"], r["text"]): r["next_text"] for r in got} == follow
    place, bounds = minhash._ordered(df, "doc_id", ["text"], 23)
    most = df.groupBy(minhash._range_of(place, bounds).alias("r")).count().agg(F.max("count")).first()[0]
    assert most < 120  # of 302 and 200 rows of one id
    same = spark.createDataFrame([(7, "same")] * 50 + [(None, "same")] * 50, DOCS)
    assert [r["next_text"] for r in minhash.with_next(same, "doc_id", ["text"], 9).collect()] == ["same"] * 100


def test_fingerprints_keep_columns_of_any_name(spark):
    own = {"h": 1, "p": 2, "s": 3, "m": 4, "slots": 5, "filled": 6, "range": 7, "place": 8, "to": 9, "lent": 10, "_h": 11, "next_text": 12}
    df = spark.createDataFrame([(k, f"a b c d e f {k}", *own.values()) for k in range(9)], ", ".join([DOCS, *[f"{n} int" for n in own]]))
    for r in minhash.with_next(minhash.with_fingerprint(df, "text", "print"), "doc_id", ["text"], 3).collect():
        assert {n: r[n] for n in own if n != "next_text"} == {n: v for n, v in own.items() if n != "next_text"}
        assert r["next_text"] == f"a b c d e f {(r['doc_id'] - 1) % 9}" and len(r["print"]) == minhash.BINS
