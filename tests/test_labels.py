"""Labels by stretches of cells and validation by pieces, against painted samples and a plain scan."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from pulseloom.operators import labels

SPANS = "rec long, start long, end long, label int, idx long"
SPAN = st.tuples(st.integers(0, 1), st.integers(0, 120), st.integers(1, 90), st.integers(1, 2), st.integers(0, 9))


def painted(spans, lengths):
    out = {rec: [0] * n for rec, n in lengths.items()}
    for rec, start, end, label, _ in sorted(spans, key=lambda s: (s[4], s[3])):
        for i in range(start, min(end, lengths[rec])):
            out[rec][i] = label
    return out


@settings(max_examples=20, deadline=None)
@given(st.lists(SPAN, max_size=14), st.integers(7, 64))
def test_runs_equal_painted_samples(spark, drawn, cell):
    lengths = {0: 200, 1: 150, 2: 30}
    spans = [(rec, start, min(start + size, lengths[rec]), label, idx) for rec, start, size, label, idx in drawn if start < lengths[rec]]
    want = painted(spans, lengths)
    df, n = spark.createDataFrame(spans, SPANS), spark.createDataFrame(list(lengths.items()), "rec long, n long")
    run = labels.runs(df, n, cell)
    rows = sorted((r["rec"], r["start"], r["end"], r["label"]) for r in run.collect())
    got = {rec: [] for rec in lengths}
    for rec, start, end, label in rows:
        assert start == len(got[rec]) and end > start and not (got[rec] and got[rec][-1] == label)  # no gaps, no overlaps, as long as can be
        got[rec] += [label] * (end - start)
    assert got == want
    assert sorted(tuple(r) for r in labels.samples_of(run).collect()) == sorted((rec, i, v) for rec, x in want.items() for i, v in enumerate(x))
    points = n.selectExpr("rec", "explode(sequence(0L, n - 1, 7)) AS sample")
    assert {(r["rec"], r["sample"]): r["label"] for r in labels.labels_at(points, df, cell).collect()} == {(rec, i): x[i] for rec, x in want.items() for i in range(0, len(x), 7)}
    stats = {r["label"]: r["n"] for r in labels.label_stats(run, 4).collect()}
    assert stats == {v: sum(x.count(v) for x in want.values()) for v in range(3)}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(900, 20_000)), min_size=1, max_size=60))
def test_validation_equals_a_scan(spark, drawn):
    events = [(rec, i, onset) for i, (rec, onset) in enumerate(drawn)]
    want = {}
    for rec in {r for r, _, _ in events}:
        last = None
        for onset, i in sorted((o, i) for r, i, o in events if r == rec):
            want[i] = onset >= 1200 and (last is None or not 0 < onset - last <= 1800)
            last = onset if want[i] else last
    got = labels.validated(spark.createDataFrame(events, "rec long, idx long, onset_s long"))
    assert got.columns == ["rec", "idx", "onset_s", "is_valid"] and {r["idx"]: r["is_valid"] for r in got.collect()} == want
