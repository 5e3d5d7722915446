import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from test_near_dup import brute_classes, brute_print  # noqa: E402

from skerry.llm import secret_scan  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "wJalrXUtnFEMI7MDENG9bPxRfiCYzQ3rKtVd"


def documents(n=160, seed=3):
    rng = random.Random(seed)
    stop = ["the", "of", "and", "to", "in", "that"]
    out = []
    for i in range(n):
        words = [rng.choice(stop) if rng.random() < 0.3 else "".join(rng.choice("abdeglnorstu") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(30, 400))]
        text = " ".join(words)
        if i % 9 == 1:
            text = out[rng.randrange(len(out))][1]
        if i % 11 == 2:
            text += f" password={KEY}"
        if i % 13 == 3:
            text = "*** " * 50
        out.append((i, text, "en", rng.choice(["a", "b", "b", None]), len(text)))
    return out + [(None, None, None, None, None), (n, "", "en", "a", 0), out[5]]


def stages(spark, tmp_path, rows):
    docs, got = spark.createDataFrame(rows, SCHEMA), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        got.append(docs)
    return got


def test_each_stage_against_brute_force(spark, tmp_path):
    rows = documents()
    quality, near, secret, mix, packed = stages(spark, tmp_path, rows)
    for df in (quality, near, secret, mix):
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = [tuple(r) for r in quality.collect()]
    assert {r[0] for r in kept} == {r[0] for r in rows if r[1] and not r[1].startswith("***")}
    classes = brute_classes({r[0]: brute_print(r[1]) for r in kept})
    single = [tuple(r) for r in near.collect()]
    assert sorted(r[0] for r in single) == sorted(set(classes.values())) and len(single) < len(kept)
    clean = {r.doc_id: r for r in secret.collect()}
    for r in single:
        want = re.sub(f"password={KEY}", "[secret]", r[1])
        assert clean[r[0]].text == want and clean[r[0]].n_chars == len(want) and secret_scan.redact(want) == want
    size = lambda t: len(t.split())
    taken, of = {}, {}
    for r in clean.values():
        of[r.source] = of.get(r.source, 0) + size(r.text)
    copies = [tuple(r) for r in mix.collect()]
    for r in copies:
        assert tuple(clean[r[0]]) == r
        taken[r[3]] = taken.get(r[3], 0) + size(r[1])
    assert max(sum(c[0] == i for c in copies) for i in clean) <= 3
    from skerry.llm.mixing import capped_shares, cyclic_weights

    target = capped_shares(of, cyclic_weights(list(of)), sum(of.values()))
    assert all(abs(taken[s] - target[s]) <= 400 for s in target)
    from test_packing import check

    check(packed.collect(), copies, 2048)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None)]])
def test_nothing_left(spark, tmp_path, rows):
    assert [df.count() for df in stages(spark, tmp_path, rows)] == [0] * 5
