import pytest
from pyspark.sql import functions as F

from skerry.operators import features as f
from skerry.operators import graphs


def test_layout_and_odd_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 3.0]), (3, None), (None, [9.0, 9.0]), (1, [1.0, 2.0])], "row long, values array<double>")
    sparse = spark.createDataFrame([(1, 4, 0.5), (1, 4, 0.25), (2, 0, None), (7, 1, 1.0)], "row long, slot long, value double")
    channels = [f.Channel("s", 5, sparse), f.Channel.dense("d", 2, rows.dropDuplicates(["row"]), F.col("values"))]
    assert f.directory(channels) == [("s", 0, 5), ("d", 5, 2)]
    got = {r.row: list(r.vector) for r in f.assembled(rows, channels).collect()}
    assert got == {1: [0, 0, 0, 0, 0.75, 1, 2], 2: [0, 0, 0, 0, 0, 0, 3], 3: [0] * 7}
    assert f.assembled(rows.where("false"), channels).collect() == []
    with pytest.raises(Exception, match="slot outside channel s"):
        f.assembled(rows, [f.Channel("s", 4, sparse)]).collect()


def test_vocabulary_is_fitted_on_training_rows(spark):
    counts = spark.createDataFrame([(g, d, label, 1.0 + g) for g in range(6) for d in (0, 1) for label in ("abc"[: 1 + g % 3])] + [(5, 0, "late", 2.0)], "gidx long, depth int, label string, cnt double")
    vocab = f.fitted_vocabulary(counts, F.col("gidx") < 4, 2)
    assert [(r.depth, r.label, r.doc_freq, r.col) for r in vocab.orderBy("col").collect()] == [(0, "a", 4, 0), (0, "b", 2, 1), (1, "a", 4, 2), (1, "b", 2, 3)]
    matrix, unseen = f.label_matrix(counts, vocab)
    assert {(r.row, r.col): r.val for r in matrix.where("row = 5").collect()} == {(5, k): 6.0 for k in range(4)}
    assert {r.row: round(r.unseen, 6) for r in unseen.collect()} == {0: 0, 1: 0, 2: round(1 / 3, 6), 3: 0, 4: 0, 5: round(14 / 38, 6)}


@pytest.mark.parametrize("edge_label", [None, "kind"])
def test_refinement_inside_rows(spark, edge_label):
    import hashlib

    nodes = [(1, 5, "a"), (1, 7, "b"), (1, 9, "a"), (2, 1, "c")]
    edges = [(1, 5, 7, 1), (1, 7, 5, 1), (1, 7, 9, 2), (1, 9, 7, 2), (1, 9, 100, 2)]  # the last leads nowhere
    now = {(g, i): label for g, i, label in nodes}
    want = {(g, i, 0, label) for (g, i), label in now.items()}
    for d in (1, 2):
        told = lambda g, j, k: now[g, j] if edge_label is None else f"{k}~{now[g, j]}"
        now = {(g, i): hashlib.md5(f"{label}|{','.join(sorted(told(g, j, k) for h, a, j, k in edges if (h, a) == (g, i) and (g, j) in now))}".encode()).hexdigest() for (g, i), label in now.items()}
        want |= {(g, i, d, label) for (g, i), label in now.items()}
    got = graphs.refine(spark.createDataFrame(nodes, "gidx long, i int, label string"), spark.createDataFrame(edges, "gidx long, i int, j int, kind int"), 2, edge_label)
    assert {tuple(r) for r in got.collect()} == want


def test_labels_are_counted_in_their_row(spark):
    from skerry.operators import graphs

    nodes = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, None), (2, 5, "a")], "gidx long, i int, label string")
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 2, 3), (1, 3, 2)], "gidx long, i int, j int")
    rows = graphs.rounds(graphs.gathered(nodes, edges), 2)
    for normalise in (False, True):
        got, want = graphs.row_counts(rows, normalise), graphs.label_counts(graphs.refine(nodes, edges, 2), normalise)
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr) and got.columns == want.columns
    records = rows.localCheckpoint()
    assert "Exchange" not in graphs.row_counts(records, True)._jdf.queryExecution().executedPlan().toString()


def test_zeros_of_a_dense_channel_do_not_move(spark):
    rows = spark.createDataFrame([(1, [0.0, 2.0, None]), (2, [0.0, 0.0, 0.0])], "row long, v array<double>")
    channel = f.Channel.dense("d", 3, rows, F.col("v"))
    assert [tuple(r) for r in channel.entries.collect()] == [(1, 1, 2.0)]
    assert {r.row: list(r.vector) for r in f.assembled(rows, [channel]).collect()} == {1: [0.0, 2.0, 0.0], 2: [0.0, 0.0, 0.0]}


def test_binned_shares_compute_their_values_once(spark):
    from skerry.functions import structures as st

    rows = spark.createDataFrame([([0.1, 0.2, 5.0],), ([],)], "v array<double>")
    slow = F.transform("v", lambda x: x + F.rand(3))  # differs by call: bins of one evaluation hold each value once
    assert [sum(r[0]) for r in rows.select(st.binned_shares(slow, 0.0, 0.25, 4)).collect()] == [1.0, 0.0]
    assert [list(r[0]) for r in rows.select(st.binned_shares(F.col("v"), 0.0, 0.25, 4)).collect()] == [[2 / 3, 0.0, 0.0, 1 / 3], [0.0] * 4]
