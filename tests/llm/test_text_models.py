"""Quality, toxicity, personal data and token counts."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseloom.llm import pii, quality, tokens, toxicity

QUERIES = [quality.op2_quality_trees, toxicity.op3_toxic_spans, pii.op6_pii_anchors, tokens.op8_token_counts]


@pytest.mark.parametrize("query", QUERIES)
def test_odd_and_empty_tables(spark, tables, query):
    rows = query(spark, tables["odd"]).collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 12]
    assert query(spark, tables["empty"]).collect() == []
    again = query(spark, tables["odd"]).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    for r in rows:
        if "score" in r:
            assert 0 <= r["score"] <= 1 and r["predicted"] in (0, 1)


def area(rows, labels):
    y = np.array([labels[r["doc_id"]] for r in rows])
    s = np.array([r["score"] for r in rows])
    return (s[y == 1][:, None] > s[y == 0][None]).mean() + (s[y == 1][:, None] == s[y == 0][None]).mean() / 2


@pytest.mark.parametrize(("query", "label", "least"), [(quality.op2_quality_trees, "quality", 0.95), (toxicity.op3_toxic_spans, "toxic", 0.88)])
def test_held_out_rows(spark, query, label, least):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in query(spark, d).collect() if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) > 50 and area(rows, labels) >= least


def test_toxic_documents_of_each_language_are_found(spark):
    """On the larger tables: the area over all held-out rows, recall and precision at the limit."""
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in toxicity.op3_toxic_spans(spark, d).select("doc_id", "held_out", "score", "predicted").collect() if r["held_out"] and r["doc_id"] in labels]
    assert area(rows, labels) >= 0.95
    found = Counter((lang[r["doc_id"]], r["predicted"]) for r in rows if labels[r["doc_id"]])
    for name in {k for k, _ in found}:
        assert found[name, 1] >= 0.85 * (found[name, 0] + found[name, 1]), (name, found)
    assert sum(r["predicted"] for r in rows if not labels[r["doc_id"]]) <= 0.01 * len(rows)


def test_trees_learn_and_agree_with_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    trees = quality.grow(x, y, 40, 3)
    s = trees.score(x)
    assert ((s > 0.5) == y).mean() > 0.95

    def walk(row):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] >= 0:
                at = trees.left[at] + (row[trees.feature[at]] > trees.cut[at])
            total += trees.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(s[:20], [walk(r) for r in x[:20]])
    assert set(quality.grow(x[:10], y[:10]).score(x[:3])) == set(quality.grow(x[:10], y[:10]).score(x[3:6]))


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    trans = rng.uniform(0.2, 1, (2, 2))
    sizes = [3, 0, 1, 5]
    unary = rng.normal(size=sum(sizes))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    got, pairs = toxicity.marginals(unary, trans, starts, ends)
    want_pairs = np.zeros((2, 2))
    for a, b in zip(starts, ends, strict=True):
        p, total = np.zeros(b - a), 0.0
        both = np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(unary[a + i] * v for i, v in enumerate(path))) * np.prod([trans[i, j] for i, j in itertools.pairwise(path)])
            total += w
            p += w * np.array(path)
            for i, j in itertools.pairwise(path):
                both[i, j] += w
        assert np.allclose(got[a:b], p / total)
        want_pairs += both / total
    assert np.allclose(pairs, want_pairs)


def test_toxic_spans_and_offsets(spark):
    bad, clean = "wretch", [f"w{i}" for i in range(40)]
    rng = np.random.default_rng(3)
    texts, y = [], []
    for i in range(400):
        words = list(rng.choice(clean, 30))
        if i % 2:
            words[int(rng.integers(30))] = bad
        texts.append(" ".join(words))
        y.append(i % 2)
    model = toxicity.train(texts, np.array(y, float), 0.5)
    text = "😀 w1 w2 Wretch! w3"
    each, score = model.read([text, "w1 w2 w3", "", None])
    assert toxicity.spans(text, each[0]) == [(8, 15)] and score[0] > 0.7 > 0.3 > score[1]
    assert len(each[2]) == len(each[3]) == 0 and score[2] == score[3]


# -- personal data ---------------------------------------------------------------------

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}
            if fine[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


CUES = pii.automaton()


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a.@-+ 0123456789()é😀%_\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    base, every = pii.find(text, CUES)
    assert base == plain_spans(text)
    assert set(base) <= set(every)


def test_base_spans_of_cards_and_addresses():
    for text in ("4539 1488 0343 6467 and 4539-1488-0343-6467", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.002.003.004", "+1 (437) 555-0689 x", "a@b.c@d.e f@g", "😀 x@y.zz"):
        assert pii.find(text, CUES)[0] == plain_spans(text)
    assert [s[2] for s in pii.find("4539148803436467", CUES)[0]] == ["card"]


def test_cued_spans():
    text = 'mail jo.doe at mail dot example dot com, https://user:pw@host/x, token = "b44e15e09fd311c3cf31", IBAN GB82 WEST 1234 5698 7654 32, SSN: 123-45-6789, meet at noon'
    kinds = {s[2]: text[s[0] : s[1]] for s in pii.find(text, CUES)[1]}
    assert kinds["email_words"] == "jo.doe at mail dot example dot com" and kinds["url_user"] == "user:pw" and kinds["secret"] == "b44e15e09fd311c3cf31"
    assert {text[s[0] : s[1]] for s in pii.find(text, CUES)[1] if s[2] == "account"} == {"GB82 WEST 1234 5698 7654 32", "123-45-6789"}
    assert pii.find(None, CUES) == ([], [])


def test_cued_spans_of_any_length():
    for cue, value in (("token=", "aB3" * 1000), ("password: ", "hunter2"), ("passwd = ", "Tr0ub4dor&3!"), ("Password='", "pw" * 900), ("https://", "u" * 500 + ":" + "p" * 900)):
        text = f"see {cue}{value}" + ("@host/x" if "//" in cue else "' end")
        assert [text[a:b] for a, b, k in pii.find(text, CUES)[1] if k in ("secret", "url_user")] == [value]


def test_parsers_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "+1" + "(" * 300_000, "1." * 150_000, "@" * 300_000, " at " * 60_000):
        pii.find(text, CUES)


def test_digest(spark, tables):
    r = {x["doc_id"]: x for x in pii.op6_pii_anchors(spark, tables["odd"]).collect()}
    assert r[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and r[2]["spans"] == ""


# -- tokens ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter(spark, sf_dir):
    text = tokens.default_tokenizer()
    return tokens.Counter(text, tokens.frequent(spark.read.parquet(f"{sf_dir}/documents.parquet"), text, entries=5000)), text


def test_table_holds_the_most_frequent_pre_tokens(counter, spark, tables, sf_dir):
    c, text = counter
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = Counter(p for r in docs.select("text").collect() for p in c.cut(r["text"] or "") if len(p) <= tokens.LONGEST)
    want = [p for p, n in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:5000] if n > 1]
    assert list(c.lengths.frequent) == want
    some = tokens.frequent(docs, text, sample=docs.count() // 4)
    assert some and set(some) < set(count)
    for name in ("odd", "empty"):
        found = tokens.frequent(spark.read.parquet(f"{tables[name]}/documents.parquet"), text)
        assert bool(found) == (name == "odd") and max(map(len, found), default=0) <= tokens.LONGEST


@pytest.mark.parametrize("sizes", [{"TABLE": 0}, {"TABLE": 3}, {"SAMPLE": 20}])
def test_counts_are_alike_with_any_table(counter, spark, sf_dir, monkeypatch, sizes):
    real = tokens.frequent
    monkeypatch.setattr(tokens, "frequent", lambda docs, text: real(docs, text, **{{"TABLE": "entries", "SAMPLE": "sample"}[k]: v for k, v in sizes.items()}))
    rows = tokens.op8_token_counts(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r["n_tokens"] == counter[0].count(texts[r["doc_id"]]) for r in rows)


def test_counts_equal_the_library(counter, spark, tables, sf_dir):
    from tokenizers import Tokenizer

    c, text = counter
    whole = Tokenizer.from_str(text)
    docs = [r["text"] or "" for d in (sf_dir, tables["odd"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("text").collect()]
    docs += ["", " ", "  a", "\n\n x", "don't we'll I'M", "a b　c\x85d", "١٢٣ ½ ² Ⅷ", "<|endoftext|><|endoftext|> x<|endoftext|>", "<|endoftext", "​́é", "".join(map(chr, range(1, 3000)))]
    assert [c.count(t) for t in docs] == [len(e.ids) for e in whole.encode_batch(docs, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_counts_of_any_text(counter, text):
    from tokenizers import Tokenizer

    c, raw = counter
    global _whole
    _whole = globals().get("_whole") or Tokenizer.from_str(raw)
    text = text.encode("utf-8", "ignore").decode()
    assert c.count(text) == len(_whole.encode(text, add_special_tokens=False).ids)


def test_cache_is_bounded(counter, monkeypatch):
    c, _ = counter
    monkeypatch.setattr(tokens, "CACHE", 50)
    c.lengths.clear()
    c.lengths.update(c.lengths.frequent)
    want = [c.count(f"zq{i}xj{i} {'y' * 200}") for i in range(200)]
    assert len(c.lengths) <= len(c.lengths.frequent) + 50 and want == [c.count(f"zq{i}xj{i} {'y' * 200}") for i in range(200)]


def test_toxic_words_of_a_language_with_few_toxic_documents_are_learned():
    """Four vocabularies; in one of them only a twentieth of all toxic documents, whose marked beginning others share rarely."""
    rng = np.random.default_rng(12)
    texts, y, lang = [], [], []
    for k, n_toxic in enumerate((200, 60, 60, 16)):
        words = [f"v{k}" + "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 5)) for _ in range(300)]
        for i in range(n_toxic * 3 + 300):
            toxic = i < n_toxic * 3 and i % 3 == 0
            text = rng.choice(words, 60).tolist()
            if toxic:
                for at in rng.choice(60, 7, replace=False):
                    text[at] = f"bad{k}" + "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 3))
            elif rng.random() < 0.05:  # a single such word is no offence
                text[int(rng.integers(60))] = f"bad{k}" + "".join(chr(97 + int(x)) for x in rng.integers(0, 26, 3))
            texts.append(" ".join(text))
            y.append(float(toxic))
            lang.append(k)
    y, lang = np.array(y), np.array(lang)
    learn = np.arange(len(y)) % 4 != 1
    model = toxicity.train([t for t, use in zip(texts, learn, strict=True) if use], y[learn], float(y[learn].mean()))
    _, score = model.read([t for t, use in zip(texts, learn, strict=True) if not use])
    y, lang = y[~learn], lang[~learn]
    for k in range(4):
        assert (score[(lang == k) & (y == 1)] >= toxicity.TOXIC_AT).mean() >= 0.8, k
    assert (score[y == 0] >= toxicity.TOXIC_AT).mean() < 0.02
