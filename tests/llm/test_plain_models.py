"""The two classifiers against plain versions: n-grams by slicing, vectors as dicts, loops instead of matrices."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from spectrafold.llm import langid, ngrams, quality

WORDS = {
    "aa": "der die und nicht mit auf haben werden über schön".split(),
    "bb": "the and not with have will over nice house tree".split(),
    "cc": "los las y no con tener sobre bonito casa árbol".split(),
}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    out = []
    for i in range(240):
        lang = rnd.choice(list(WORDS))
        good = rnd.random() < 0.6
        text = " ".join(rnd.choices(WORDS[lang], k=rnd.randrange(2, 30)))
        # One row in ten is labelled against its text, so that the hinge loss has something to trade.
        noisy = rnd.random() < 0.1
        out.append((i, text if good != noisy else text.upper() + "!! 7", lang, int(good)))
    return out


def trained(rows):
    import zlib

    return [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]


def bin_of(units, bits):
    return int(ngrams.hashed(np.array(units, np.uint32), len(units), bits)[0])


def bins_of(units, widths, bits):
    return Counter(bin_of(units[i : i + w], bits) for w in widths for i in range(len(units) - w + 1))


def letters_of(text):
    """Lower case, each run of other characters than letters as one space, then a space at either end; and the number of letters."""
    clean = "".join("a" if c.isalpha() else " " for c in text.lower())
    kept = [c if k == "a" else " " for i, (c, k) in enumerate(zip(text.lower(), clean, strict=True)) if k == "a" or i == 0 or clean[i - 1] == "a"]
    return [32, *map(ord, kept), 32], clean.count("a")


def dot(a, b):
    return sum(x * b.get(k, 0.0) for k, x in a.items())


def unit(v):
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()} if norm else v


def mean(vectors):
    out = Counter()
    for v in vectors:
        for k, x in v.items():
            out[k] += x / len(vectors)
    return dict(out)


def plain_centroids(vectors):
    middle = mean(vectors)
    seeds = [max(vectors, key=lambda v: dot(v, middle))]
    while len(seeds) < min(langid.CENTROIDS, len(vectors)):
        seeds.append(min(vectors, key=lambda v: max(dot(v, s) for s in seeds)))
    for _ in range(langid.ROUNDS):
        groups = [[] for _ in seeds]
        for v in vectors:
            groups[max(range(len(seeds)), key=lambda k: dot(v, seeds[k]))].append(v)
        seeds = [unit(mean(g)) for g in groups if g]
    return seeds


def test_language_as_plain(spark, rows):
    known = [(r, bins_of(letters_of(r[1])[0], langid.WIDTHS, langid.BITS)) for r in trained(rows)]
    df = Counter(b for _, bins in known for b in bins)
    idf = lambda b: math.log((1 + len(known)) / (1 + df[b])) + 1
    vector = lambda bins: unit({b: (1 + math.log(n)) * idf(b) for b, n in bins.items()})
    centres, radius = {}, {}
    for lang in WORDS:
        own = sorted([(letters_of(r[1])[1], vector(b)) for r, b in known if r[2] == lang], key=lambda x: x[0])
        centres[lang] = plain_centroids([v for _, v in own])
        seen = [(n.bit_length(), max(dot(v, c) for c in centres[lang])) for n, v in own]
        radius[lang] = []
        for k in range(langid._LENGTHS):
            near = [c for length, c in seen if abs(length - k) <= 1]
            far = langid.LENIENCE * min(near) if near else radius[lang][max(k - 1, 0)] if radius[lang] else 0.0
            radius[lang].append(far if len(near) >= langid.ENOUGH else min(far, langid.FEW))
    docs = spark.createDataFrame([*rows, (900, "", "aa", 0), (901, "qqq zzz xxx " * 30, None, 0)], "doc_id long, text string, lang string, quality int")
    got = {r["doc_id"]: r for r in langid.predict_documents(docs).collect()}
    for i, text, *_ in [*rows, (901, "qqq zzz xxx " * 30)]:
        units, n = letters_of(text)
        v = vector(bins_of(units, langid.WIDTHS, langid.BITS))
        best = {lang: max(dot(v, c) for c in cs) for lang, cs in centres.items()}
        lang = max(best, key=best.get)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - best[lang]) < 1e-3
        assert got[i]["rejected"] == (best[lang] < radius[lang][min(n.bit_length(), langid._LENGTHS - 1)])
    assert got[901]["rejected"] and got[900]["lang_pred"] == "und"


def plain_margin(weights, bias, vector):
    return dot(vector, weights) + bias


def primal(weights, bias, vectors, sign, cost):
    loss = sum(c * max(0.0, 1 - y * plain_margin(weights, bias, v)) for v, y, c in zip(vectors, sign, cost, strict=True))
    return 0.5 * (sum(x * x for x in weights.values()) + bias * bias) + loss


def plain_solver(vectors, sign, cost, rounds=400):
    """The dual by coordinates in fixed order, over dicts; gives weights, bias and the value of the dual, a bound from below."""
    weights, bias, alpha = Counter(), 0.0, [0.0] * len(vectors)
    for _ in range(rounds):
        for i, (v, y, c) in enumerate(zip(vectors, sign, cost, strict=True)):
            size = sum(x * x for x in v.values()) + 1
            new = min(max(alpha[i] - (y * plain_margin(weights, bias, v) - 1) / size, 0.0), c)
            for k, x in v.items():
                weights[k] += (new - alpha[i]) * y * x
            bias += (new - alpha[i]) * y
            alpha[i] = new
    return weights, bias, sum(alpha) - 0.5 * (sum(x * x for x in weights.values()) + bias * bias)


def test_quality_as_plain(spark, rows):
    known = trained(rows)[:90]
    label = np.array([r[3] for r in known])
    bins = [set(bins_of(list(r[1].encode()), quality.WIDTHS, quality.BITS)) for r in known]
    good, bad = int(label.sum()), int((1 - label).sum())
    of = [Counter(b for s, y in zip(bins, label, strict=True) if y == k for b in s) for k in (0, 1)]
    ratio = {b: math.log((of[1][b] + 1) / (good + 2)) - math.log((of[0][b] + 1) / (bad + 2)) for s in bins for b in s}
    vectors = [unit({b: ratio[b] for b in s}) for s in bins]
    sign = [1.0 if y else -1.0 for y in label]
    cost = [quality.PENALTY * len(label) / (2 * (good if y else bad)) for y in label]
    model = quality.train([quality.indicators(r[1]) for r in known], label)
    for r, s in zip(known, bins, strict=True):
        assert set(quality.indicators(r[1]).tolist()) == s
    assert all(abs(model.ratio[b] - x) < 1e-9 for b, x in ratio.items())
    weights = {b: float(model.weight[b]) for b in ratio}
    _, _, least = plain_solver(vectors, sign, cost)
    reached = primal(weights, model.bias, vectors, sign, cost)
    assert least - 1e-9 <= reached <= 1.05 * least
    for r, v in zip(known, vectors, strict=True):
        margin = plain_margin(weights, model.bias, v)
        assert abs(model.score(r[1]) - 1 / (1 + math.exp(-(model.slope * margin + model.shift)))) < 1e-9
    docs = spark.createDataFrame(known, "doc_id long, text string, lang string, quality int")
    fitted = quality.fit(docs, docs.select("doc_id", "quality"))
    # The rows come in the order of their hash, so the fit ends elsewhere near the same optimum.
    assert np.allclose(fitted.ratio, model.ratio)
    assert primal({b: float(fitted.weight[b]) for b in ratio}, fitted.bias, vectors, sign, cost) <= 1.05 * least
