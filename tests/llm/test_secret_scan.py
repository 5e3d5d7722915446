import hashlib
import math
import random
import re
from collections import Counter

from skerry.llm import secret_scan as s

SCHEMA = "doc_id long, text string, spans string, n_chars long"
KEY = "wJalrXUtnFEMI7MDENG9bPxRfiCYzQ3rKtVd"


def brute_base(text):
    out = []
    for m in re.finditer(r"(?i)(?a)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def brute_windows(text, cls):
    for i in range(len(text) - s.WIDTH + 1):
        w = text[i : i + s.WIDTH]
        h = -sum(c / s.WIDTH * math.log2(c / s.WIDTH) for c in Counter(w).values())
        if h >= cls.bits - 1e-9 and all(sum(ch in g for ch in w) >= n for g, n in cls.needs):
            yield i, i + s.WIDTH


def test_base_spans_match_brute_force():
    rng = random.Random(5)
    bits = ["token", "=", ":", " ", '"', "AKIA", "AKIA" * 6, "0a1b2c", "Password", "ſecret", "api_key", "apikey: ", "x.y", "\n", "é", "deadbeef", "Z9"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert s.base_spans(text) == brute_base(text), text


def test_incremental_windows_match_recounting():
    rng = random.Random(6)
    for cls in s.CLASSES:
        for _ in range(150):
            chars = rng.choice([cls.chars, cls.chars[:6], cls.chars[-9:]])
            text = "".join(rng.choice(chars) for _ in range(rng.randint(0, 60)))
            want = []
            for a, b in brute_windows(text, cls):
                if want and a <= want[-1][1]:
                    want[-1] = (want[-1][0], b)
                else:
                    want.append((a, b))
            assert list(s.windows_above(text, cls)) == want


def test_very_long_runs_take_linear_time_and_little_memory():
    import time
    import tracemalloc

    rng = random.Random(7)
    blob = "".join(rng.choices(s._NUM + s._LOW + s._UP + "+/", k=150_000))
    tracemalloc.start()
    assert s.entropy_spans("x " + blob)[0][0] == 2
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()
    for text in ("x" * 2_000_000 + "1", "xxxx-1234567890/" * 100_000, "example1" * 200_000):
        start = time.perf_counter()
        assert s.entropy_spans(text) == []
        assert time.perf_counter() - start < 30


def test_placeholders_and_spans_by_brute_force():
    rng = random.Random(11)
    bits = ["example", "xxxx", "your_key", "abc", "Q7", KEY, "-", "/", "_", "1234567890", "K9x", "+"]
    for _ in range(2000):
        run = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        apart, within = {m.span() for m in s._UUID.finditer(run)}, []
        for m in s._WORD.finditer(run):
            a, b = m.span()
            while a and run[a - 1].isalnum():
                a -= 1
            while b < len(run) and run[b].isalnum():
                b += 1
            if s.plain(run[a:b]):
                apart.add((a, b))
            else:
                within.append(m.span())
        assert s.harmless(run) == (sorted(apart), within), run


def test_entropy_finds_keys_and_leaves_prose_paths_and_placeholders():
    assert s.entropy_spans(f"é the key {KEY} here") == [(10, 10 + len(KEY))]
    clean = ["thwhbleoushingeronsandtheothers and more", "123e4567-e89b-12d3-a456-426614174000", "your_key_0123456789abcdefXYZabc", "usr/local/share/doc/packages/readme-12", "2024-01-02-03-04-05-06-07-08"]
    for text in clean:
        assert s.entropy_spans(text) == [], text


def test_rows(spark):
    long = "ab " * 200000 + KEY
    texts = [None, "", f"x {KEY}", 'token = "0b54a2c7e1f09d8836aa5c21"', "plain words only", long]
    rows = [(i, t, "clash", -1) for i, t in enumerate(texts)] + [(None, texts[3], None, None), (3, texts[3], "", -1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = s.scanned(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    none = hashlib.sha256(b"").hexdigest()
    assert tuple(by[0])[1:] == tuple(by[1])[1:] == tuple(by[4])[1:] == (0, 0, 0, none, "")
    assert by[2].spans == f"entropy:2:{2 + len(KEY)}" and by[2].base_sha256 == none
    assert by[3].spans == "assign:0:33,hex:9:33" and tuple(by[3])[1:4] == (1, 0, 1) and tuple(by[None])[1:] == tuple(by[3])[1:]
    assert by[5].spans == f"entropy:600000:{600000 + len(KEY)}"
    clean = {r.doc_id: r for r in s.redacted(docs).collect()}
    assert clean[2].text == "x [secret]" and clean[2].n_chars == 10 and clean[0].text is None and clean[4].n_chars == -1
    assert clean[3].text == '[secret]"' and s.redacted(docs).columns == docs.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert s.scanned(empty).count() == 0 and s.redacted(empty).count() == 0


def test_entropy_spans_inside_a_base_span_are_dropped_wherever_it_lies():
    text = "secret=" + "aB3dE5gH7jK9mN1pQ2sT4v" + " x " * 50 + "token: 9f8e7d6c5b4a39281706f5e4d3c2b1a0 " + "Zx8Kq2Lw9Rt4Yp6Mn1Bv3C"
    base, spans = s.all_spans(text)
    more = [x for x in spans if x[1] == 3]
    assert more == [(a, 3, b) for a, b in s.entropy_spans(text) if not any(p <= a and b <= e for p, _, e in base)]
    assert len(more) == 1


def test_url_safe_keys_are_found_and_slugs_are_not():
    rng = random.Random(8)
    chars = s._NUM + s._LOW + s._UP + "-_"
    for n, least in ((24, 0.93), (32, 0.98), (43, 0.99)):
        keys = ["x" + "".join(rng.choice(chars) for _ in range(n - 2)) + "x" for _ in range(500)]
        assert sum(bool(s.entropy_spans(f"a {k} b")) for k in keys) / len(keys) > least
    assert s.entropy_spans("k9Xw-Rt4Yp_6Mn1-Bv3C_Zx8") == [(0, 24)]
    clean = ["My-Long-Title-Of-A-Page-2024-01-02", "IMG_20240102_Foo_Bar_Baz_v2", "getUserById_Quick-Brown-Fox_2024", "Chapter-12-The-Quick-Brown-Fox-Jumps-34", "request-123E4567-E89B-12D3-A456-426614174000-Log"]
    clean += ["_".join(rng.choice(["Quick", "brown", "FOX", "Jumped", "over", "Lazy", "dogs"]) + rng.choice(["", "7"]) for _ in range(9)) for _ in range(200)]
    for text in clean:
        assert s.entropy_spans(text) == [], text


def test_a_placeholder_word_hides_only_its_own_part():
    for joined, at in ((f"example-{KEY}", 8), (f"{KEY}/1234567890", 0), (f"your_key_{KEY}", 9), (f"Docs/example_{KEY}-xxxx", 13)):
        assert any(a <= at and at + len(KEY) <= b for a, b in s.entropy_spans(joined)), joined
    for text in ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "aB3dE5gH7jK9mN1pQ2sT4vEXAMPLE8Zr", "example_your-key_0123456789"):
        assert s.entropy_spans(text) == [], text


def test_redacted_drops_url_safe_keys(spark):
    docs = spark.createDataFrame([(1, "key k9Xw-Rt4Yp_6Mn1-Bv3C_Zx8 end", "", 32)], SCHEMA)
    assert [tuple(r) for r in s.redacted(docs).collect()] == [(1, "key [secret] end", "", 16)]
