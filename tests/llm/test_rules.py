"""Decision lists and the audit of filters, against plain versions."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import same
from pulseloom.llm import audit, rules
from pulseloom.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), by loops."""
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_loops(spark, tables, sf_dir):
    for d in (sf_dir, tables["odd"]):
        want = Counter((r["doc_id"], *plain(r["text"])) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
        got = rules.op11_decision_list(spark, d).collect()
        assert Counter(tuple(r)[:6] for r in got) == want
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert rules.op11_decision_list(spark, tables["empty"]).collect() == []


@settings(max_examples=20, deadline=None)
@given(texts=st.lists(st.text(alphabet="ab \n\t!|<éA 😀", max_size=60), min_size=1, max_size=20))
def test_counts_of_any_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rules.measured(docs).select("doc_id", "stats.*").collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_columns_of_the_input_stay(spark, odd):
    out = rules.measured(odd, "score")
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score"] and out.count() == odd.count()


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in rules.op11_decision_list(spark, d).collect() if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    clean = [r for r in held if labels[r["doc_id"]] == 1 and not r["base_failed"]]
    junk = [r for r in held if labels[r["doc_id"]] == 0]
    assert len(clean) > 40 and sum(r["kept"] for r in clean) >= 0.98 * len(clean)
    assert len(junk) > 5 and sum(not r["kept"] for r in junk) >= 0.95 * len(junk)


def test_a_known_list_is_found_and_spark_agrees_with_it(spark):
    rng = np.random.default_rng(5)
    x = {k: rng.uniform(size=3000) for k in rules.STATISTICS}
    truth = (x["capitals"] > 0.8) | ((x["digits"] > 0.6) & (x["dup_lines"] <= 0.3))
    found = rules.learned(x, (~truth).astype(int), rng.uniform(size=3000) < 1 / 3)
    first = lambda i: next((r.label for r in found if r.holds({k: v[i : i + 1] for k, v in x.items()})[0]), 1)
    said = np.array([first(i) for i in range(500)])
    assert ((said == 0) == truth[:500]).mean() > 0.97 and {lit.name for r in found for lit in r.literals} >= {"capitals", "digits"}
    from pyspark.sql import functions as F

    t = spark.createDataFrame([(i, *[float(v[i]) for v in x.values()]) for i in range(500)], "i int, " + ", ".join(f"{k} double" for k in x))
    label, number = rules.verdict(found)
    rows = t.select("i", F.struct(*x).alias("stats")).select("i", label.alias("label"), number.alias("rule")).orderBy("i").collect()
    assert [r["label"] for r in rows] == list(said) and all((r["rule"] > 0) == (r["label"] == found[0].label) for r in rows)


def test_gains_equal_those_of_all_cuts(monkeypatch):
    """The first literal is the best of all cuts of all statistics, counted one by one."""
    monkeypatch.setattr(rules, "LITERALS", 1)
    rng = np.random.default_rng(6)
    x = {k: rng.integers(0, 6, 60).astype(float) for k in ("capitals", "digits")}
    y = rng.uniform(size=60) < 0.2 + 0.1 * x["digits"]
    cuts = {k: np.arange(5) + 0.5 for k in x}

    def gain(rows):
        p, n = (y & rows).sum(), (~y & rows).sum()
        return p * (np.log2(p / (p + n)) - np.log2(y.mean())) if p else 0.0

    best = max(gain(rules.Literal(k, above, c).holds(x)) for k in x for above in (False, True) for c in cuts[k])
    assert np.isclose(gain(rules.grown(x, y, cuts)[0].holds(x)), best)


def test_lists_of_too_few_labels(spark, tables):
    assert rules.learned({k: np.zeros(0) for k in rules.STATISTICS}, np.zeros(0, int), np.zeros(0, bool)) == []
    assert rules.learned({k: np.ones(9) for k in rules.STATISTICS}, np.ones(9, int), np.zeros(9, bool)) == []
    docs = spark.createDataFrame([(1, "x " * 5 + " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    none = rules.fit(docs, table(spark, tables["empty"], "labels"), rules.usable_for_fit())
    assert none == [] and rules.verdict(none)


# -- the audit ----------------------------------------------------------------------------


def test_audit_equals_sql(spark, duck, sf_dir):
    same(audit.op12_filter_lattice(spark, sf_dir), duck.sql(audit.SQL))


def walked(rows, labels):
    """All orders, document by document."""
    label = {}
    for i, q, t in labels:
        for k, v in (("good", q), ("toxic", t)):
            if i is not None and v is not None:
                label[i, k] = max(v, label.get((i, k), v))
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = Counter()
    for i, source, text in rows:
        t, w, part = text or "", WORD.findall(text or ""), source or ""
        failed = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                key, before = (part, "".join(order), step), any(failed[x] for x in order[: step - 1])
                here = failed[f] and not before
                for name, hit in (
                    ("rows", True), ("kept", not before and not failed[f]), ("removed", here), ("redundant", failed[f] and before), ("unique_fails", failed[f] and sum(failed.values()) == 1),
                    ("good_lost", here and label.get((i, "good")) == 1), ("toxic_lost", here and label.get((i, "toxic")) == 1),
                ):
                    out[(*key, name)] += hit
                out[part, f] += here
    return out


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_audit_of_odd_tables_equals_a_walk_of_all_orders(spark, tables, name):
    d = tables[name]
    rows = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want, got = walked(rows, labels), audit.op12_filter_lattice(spark, d).collect()
    assert len(got) == 600 * len({s or "" for _, s, _ in rows})
    for r in got:
        key = (r["part"], r["filter_order"], r["step"])
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[c] == want[(*key, c)], (key, c)
        assert r["shapley"] == want[r["part"], r["filter_order"][r["step"] - 1]]


def test_edges_are_eighty(spark):
    one = spark.createDataFrame([("x", 0, 7, 0, 0)], "part string, fails int, n long, good long, toxic long")
    rows = audit.edges(one, "ABCDE").collect()
    assert len(rows) == 80 and all(r["kept"] == 7 for r in rows)
    assert audit.steps(spark, "ABCDE").distinct().count() == 600
