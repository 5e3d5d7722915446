import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skerry.llm import quality_model as q
from skerry.llm import toxicity as t
from skerry.llm.labelled import labelled_sample, remainder
from skerry.llm.word_hashes import Words

SCHEMA = "doc_id long, text string, lang string, score int, label int"
LABELS = "doc_id long, quality int, toxic int, text string"


def rows(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "ko", "ti", "ru", "ne", "lo"]) for _ in range(rng.randint(1, 4)))
    out, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 120))]
        bad, toxic = i % 4 == 0, i % 5 == 1
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(["grubnik", "zlotch", "vremm" + word()]) for _ in range(rng.randint(1, 3))]
        out.append((i, " ".join(w), "xx", 0, 1))
        labels.append((i, int(not bad), int(toxic), "clash"))
    return out, labels


def test_tokens_and_their_hashes():
    texts = ["Ab,cd  12é!", None, "", "ab", "x" * 9000 + " ab", "AB Ab"]
    w = Words(pa.array(texts))
    assert np.diff(w.offsets).tolist() == [6, 0, 0, 1, 2, 2] and w.kinds.tolist() == [1, 3, 1, 2, 1, 3, 1, 1, 1, 1, 1]
    h = w.hashes()
    assert h[0] == h[6] == h[8] == h[9] == h[10] and len(set(h.tolist())) == 7
    assert w.upper().tolist()[-2:] == [2, 1] and w.upper()[0] == 1
    p = w.prefix_hashes(2)
    assert p[0] == p[6] and p[1] == 0
    assert np.array_equal(Words(pa.array(texts[3:])).hashes(), h[6:])


def test_best_and_maximal_segments_match_brute_force():
    rng = random.Random(2)
    for _ in range(400):
        s = [rng.choice([-2.0, -1.0, -0.5, 1.0, 1.5, 3.0]) for _ in range(rng.randint(0, 14))]
        sums = {(a, b): sum(s[a:b]) for a, b in itertools.combinations(range(len(s) + 1), 2)}
        want = max([0.0, *sums.values()])
        got = t.maximal_segments(s)
        assert all(math.isclose(v, sums[a, b]) for a, b, v in got)
        assert max([0.0, *(v for *_, v in got)]) == want
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        for a, b, v in got:  # no segment within scores as much, none around it has only smaller prefixes and suffixes
            assert all(sums[c, d] < v for c, d in sums if a <= c and d <= b and (c, d) != (a, b))
        assert sum(b - a for a, b, _ in got) >= sum(x > 0 for x in s)


def test_ftrl_and_segments_learn_what_held_out_rows_show(spark):
    docs, labels = rows(900)
    docs += [(5000, None, "", 0, 0), (5001, "", "", 0, 0), (None, docs[0][1], "", 0, 0), (7, docs[7][1], "", 0, 0), (5002, "e" * 300000, "", 0, 0)]
    labels += [(3, 1, 1, ""), (None, 1, 1, ""), (5000, None, None, ""), (9999, 1, 1, "")]
    d, lab = spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, LABELS)
    truth = {r[0]: r for r in labels[:900]}
    for module, column, n, held in ((q, 1, 3, 1), (t, 2, 5, 0)):
        learn = remainder(F.col("doc_id"), n) != held if module is q else remainder(F.col("doc_id"), n) != 0
        model = module.fitted(d, lab, learn)
        got = module.scored(d, model).collect()
        assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        out = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % n == held]
        right = sum(r.predicted == truth[r.doc_id][column] for r in out) / len(out)
        assert len(out) > 100 and right > 0.95, (module.__name__, right)
        again = module.scored(d, module.fitted(d.repartition(2), lab, learn)).collect()
        key = lambda r: (r.doc_id is None, r.doc_id, r.score)
        assert sorted(map(key, got)) == sorted(map(key, again))
    found = [(r.doc_id, p) for r in t.scored(d, model).collect() for p in r.passages]
    assert len({i for i, _ in found if truth.get(i, (0, 0, 0))[2]}) > 150
    words = {r[0]: r[1].split() for r in docs if r[1]}
    assert all(p["first"] <= p["last"] < len(words[i]) and p["e"] <= t.MOST_E for i, p in found)
    held = [(i, p) for i, p in found if i is not None and zlib.crc32(str(i).encode()) % 5 == 0]  # learned rows show what was learned of them
    marked = sum(any(x.startswith(("grub", "zlot", "vremm")) for x in words[i][p["first"] : p["last"] + 1]) for i, p in held)
    assert len(held) > 20 and marked / len(held) > 0.75, (marked, len(held))


def test_no_labels_and_empty_tables(spark):
    docs, _ = rows(5)
    d, none = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([], LABELS)
    for module, score in ((q, 0.5), (t, 0.0)):
        model = module.fitted(d, none, F.lit(True))
        assert all(abs(r.score - score) < 1e-9 for r in module.scored(d, model).collect())
        assert module.scored(spark.createDataFrame([], SCHEMA), model).count() == 0
    one = spark.createDataFrame([(i, 1, 0, "") for i in range(5)], LABELS)
    assert all(r.predicted == 0 for r in t.scored(d, t.fitted(d, one, F.lit(True))).collect())


def test_sample_is_bounded(spark):
    docs, labels = rows(60)
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)
    got = labelled_sample(d, lab, F.lit(True), "doc_id", "text", "toxic", 17)
    assert got.count() == 17 and got.columns == ["text", "label"]


def test_many_weak_passages_outscore_one(spark):
    rng = random.Random(9)
    keys = Words(pa.array(["zlotch"])).hashes()
    model = t.Model(keys, np.array([2.0]), lam=1.2, k=0.02, slope=1.0, shift=-4.0, crowd=0.02)
    calm = ["".join(rng.choice("abdeo") for _ in range(5)) for _ in range(600)]
    one, many = calm[:], calm[:]
    one[30] = "zlotch"
    for k in range(30, 600, 30):
        many[k] = "zlotch"
    d = spark.createDataFrame([(i, " ".join(w), "xx", 0, 1) for i, w in enumerate((calm, one, many))], SCHEMA)
    p = {r.doc_id: r.score for r in t.scored(d, model).collect()}
    assert p[0] < p[1] < p[2] and p[2] > 0.9 > 0.1 > p[1]


def test_segment_sums_are_those_of_the_maximal_segments():
    rng = random.Random(10)
    for _ in range(300):
        s = [rng.choice([-2.0, -1.0, -0.5, 1.0, 1.5, 3.0]) for _ in range(rng.randint(0, 40))]
        found = t.segments(np.array(s), np.array([0, 0, len(s)]))
        assert found == [[], t.maximal_segments(s)]
        none, got = t.segment_sums(found)
        assert not len(none) and got.tolist() == sorted((v for *_, v in t.maximal_segments(s)), reverse=True)


def test_segments_take_linear_time():
    import time

    rng = random.Random(13)
    shapes = {
        "random": lambda n: [rng.choice([-1.0, 1.1]) for _ in range(n)],
        "falling": lambda n: [x for k in range(n // 2) for x in (1.0 + (n - k) / n, -1.0)],
        "rising": lambda n: [x for k in range(n // 2) for x in (1.0 + k / n, -1.5)],
        "steps": lambda n: [x for k in range(n // 2) for x in (1.0, -2.0)],
    }
    for name, shape in shapes.items():
        took = []
        for n in (20_000, 160_000):
            s = shape(n)
            start = time.perf_counter()
            t.maximal_segments(s)
            took.append(time.perf_counter() - start)
        assert took[1] < 8 * 4 * took[0] + 0.2, (name, took)


def test_ftrl_against_a_plain_form(monkeypatch):
    """The update of McMahan et al. written out, coordinate by coordinate, over the same order of rows."""
    docs, labels = rows(60, 3)
    texts, y = pa.array([d[1] for d in docs] + [None]), np.array([r[1] for r in labels] + [0])
    got = q.train(texts, y, seed=4)
    size, z, n = 1 << q.BITS, {}, {}
    counted = []
    for k in range(len(texts)):
        places, _ = q.features(texts.slice(k, 1))
        c = {}
        for p in places.tolist():
            c[p] = c.get(p, 0) + 1
        counted.append([(p, float(np.float32(q.SCALE * v / len(places)))) for p, v in sorted(c.items())] + [(size, 1.0)])

    def weight(p):
        zp = z.get(p, 0.0)
        return 0.0 if abs(zp) <= q.L1 else -(zp - math.copysign(q.L1, zp)) / ((q.BETA + math.sqrt(n.get(p, 0.0))) / q.ALPHA + q.L2)

    rate, order = y.mean(), np.random.default_rng(4)
    cost = {0: math.sqrt(0.5 / (1 - rate)), 1: math.sqrt(0.5 / rate)}
    for _ in range(q.EPOCHS):
        for i in order.permutation(len(counted)):
            margin = sum(weight(p) * x for p, x in counted[i])
            p_hat = 1 / (1 + math.exp(-max(min(margin, 50), -50)))
            for p, x in [(p, x) for p, x in counted[i]]:
                g = (p_hat - y[i]) * cost[int(y[i])] * x
                sigma = (math.sqrt(n.get(p, 0.0) + g * g) - math.sqrt(n.get(p, 0.0))) / q.ALPHA
                z[p] = z.get(p, 0.0) + g - sigma * weight(p)
                n[p] = n.get(p, 0.0) + g * g
    want = np.array([weight(p) for p in range(size)])
    assert np.allclose(got.weights, want, atol=1e-5) and abs(got.bias - weight(size)) < 1e-8
    assert (want != 0).sum() > 50
    margins = [sum((want[p] if p < size else weight(size)) * x for p, x in row) for row in counted]
    assert np.allclose(got.score(texts), 1 / (1 + np.exp(-np.array(margins))), atol=1e-5)


def test_log_odds_and_law_against_plain_forms():
    rng = np.random.default_rng(3)
    text, forms = rng.integers(0, 40, 900), rng.integers(0, 60, 900)
    forms = np.where((text % 3 == 0) & (forms > 20), forms % 5, forms)
    text, forms = np.unique(np.stack([text, forms]), axis=1)
    toxic = np.arange(40) % 3 == 0
    keys, values = t.log_odds(text, forms.astype(np.uint64), toxic)
    found = dict(zip(keys.tolist(), values.tolist()))
    a = {f: sum(toxic[int(x)] for x, g in zip(text, forms) if g == f) for f in set(forms.tolist())}
    b = {f: sum(not toxic[int(x)] for x, g in zip(text, forms) if g == f) for f in set(forms.tolist())}
    n1, n0 = sum(a.values()), sum(b.values())
    for f in a:
        prior, total = t.PRIOR * (a[f] + b[f]), t.PRIOR * (n1 + n0)
        odds = math.log((a[f] + prior) / (n1 + total - a[f] - prior)) - math.log((b[f] + prior) / (n0 + total - b[f] - prior))
        low = odds - t.SHRINK * math.sqrt(1 / (a[f] + prior) + 1 / (b[f] + prior))
        assert (f in found) == (low > t.DRIFT) and (f not in found or math.isclose(found[f], low))
    assert found
    scores = rng.choice([-0.5, 1.0], 4000, p=[0.9, 0.1])
    lam = t._background(scores)
    assert abs(np.mean(np.exp(lam * scores)) - 1) < 1e-3 and lam > 0.1
    sums, n = [np.array([3.0, 2.0, 2.0]), np.zeros(0), np.array([1.0])], np.array([50, 0, 9])
    plain = []
    for s, m in zip(sums, n):
        best = -math.log(0.1 * max(m, 1)) + (0.7 * s[0] if len(s) else 0)
        for r in range(2, len(s) + 1):  # E^r / r! of the r-th best, twice for each further one
            e = 0.2 * max(m, 1) * math.exp(-0.7 * s[r - 1])
            best = max(best, -(r * math.log(e) - math.lgamma(r + 1)) - (r - 1) * math.log(2))
        plain.append(best)
    assert np.allclose(t.evidence(sums, n, 0.7, 0.1, 0.2), plain)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, shift = t._logistic(x, y)
    loss = lambda w, c: -np.sum(y * (w * x + c) - np.log1p(np.exp(w * x + c)))
    near = min((loss(w, c), w, c) for w in np.linspace(1, 3, 41) for c in np.linspace(-2, 0, 41))
    assert loss(slope, shift) < near[0] + 0.05
