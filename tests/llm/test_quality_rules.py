import re
from collections import Counter

from skerry.llm import quality_rules as q

SCHEMA = "doc_id long, text string, n_words int, m string"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_match_brute_force_on_odd_rows(spark):
    prose = "The cat sat on the mat and looked at it for a long while. " * 1
    texts = [None, "", " \n\t ", prose, prose + prose, "a " * 30, "x\n x\nx\n\n\nx", "é " * 9 + "# $ <", "w w a", " ".join(map(str, range(5000))) + " " + " ".join(map(str, range(50)))]
    rows = [(i, t, -1, "clash") for i, t in enumerate(texts)] + [(None, prose, None, None), (3, prose, -1, "clash")]
    got = q.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id if r.doc_id is not None else "null"): r for r in got}
    for i, t in enumerate(texts):
        assert tuple(by[i])[1:6] == brute(t), t
        n = brute(t)
        assert by[i].base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
    assert tuple(by["null"])[1:] == tuple(by[3])[1:]


def test_empty_table_and_passing_keeps_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert q.judged(empty).count() == 0 and q.passing(empty).columns == empty.columns
    good = "the quick fox and a dog went to the market in the town for some bread and then came back home at night"
    docs = spark.createDataFrame([(1, good, 7, "m"), (2, "###", 7, "m"), (3, (good + " !!").upper().replace(" ", "!! "), 1, "")], SCHEMA)
    assert [tuple(r) for r in q.passing(docs).collect()] == [(1, good, 7, "m")]


def test_passing_keeps_columns_of_any_name_and_type(spark):
    good = "the quick fox and a dog went to the market in the town for some bread and then came back home at night"
    schema = "doc_id long, text string, `__measured` string, measured int, `a.b` int, x map<string,int>"
    rows = [(1, good, "mine", 5, 6, {"k": 1}), (2, "###", "mine", 5, 6, None)]
    got = q.passing(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "__measured", "measured", "a.b", "x"] and [tuple(r) for r in got.collect()] == rows[:1]
