"""Parts of the quality trees against plain versions, and what the mix leaves of its targets."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pulseloom.llm import mixing, quality

SYMBOLS = "#$%&*+<=>@\\^_`{}~"
SPACES = "\t\n\x0b\x0c\r "
ODD = [None, "", " \n\t ", "word", "Two Words\n\nthree", "naïve café 😀 ### $x", "A!!! B!! | c | d\x0bd", "same line\nsame line\nother", "x" * 5000, "one two " * 4000]


def plain(text):
    """The statistics by their meaning, byte by byte and word by word."""
    raw = (text or "").encode()
    out = dict.fromkeys(quality.STATISTICS, 0.0)
    if not raw:
        return out
    n, seen = len(raw), Counter(raw)
    share = lambda test: sum(test(b) for b in raw) / n
    out |= {
        "log_bytes": math.log1p(n), "upper": share(lambda b: 65 <= b <= 90), "lower": share(lambda b: 97 <= b <= 122), "digits": share(lambda b: 48 <= b <= 57), "non_ascii": share(lambda b: b > 127),
        "punctuation": share(lambda b: 33 <= b <= 126 and not chr(b).isalnum()), "symbols": share(lambda b: b < 128 and chr(b) in SYMBOLS), "pipes": share(lambda b: b == 124), "bangs": share(lambda b: b == 33),
        "stops": share(lambda b: b == 46), "commas": share(lambda b: b == 44), "entropy": -sum(k / n * math.log2(k / n) for k in seen.values()), "top_byte": max(seen.values()) / n,
        "white": share(lambda b: b < 128 and chr(b) in SPACES),
    }
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    if words:
        k, sizes, half = len(words), [len(w) for w in words], set(words[: len(words) // 2])
        pairs = [(words[i], words[i + 1]) for i in range(k - 1)]
        mean = sum(sizes) / k
        out |= {
            "log_words": math.log1p(k), "mean_word": mean, "std_word": math.sqrt(sum((s - mean) ** 2 for s in sizes) / k), "longest_word": math.log1p(max(sizes)), "short_words": sum(s <= 3 for s in sizes) / k,
            "distinct_words": len(set(words)) / k, "distinct_pairs": len(set(pairs)) / max(1, k - 1), "log_lines": math.log1p(len(lines)), "distinct_lines": len(set(lines)) / max(1, len(lines)),
            "mean_line": math.log1p(k / max(1, len(lines))), "capitalised": sum(w.istitle() for w in words) / k, "odd_ends": sum(w[-1:].decode("latin1") in SYMBOLS for w in words) / k,
            "repeat_next": sum(a == b for a, b in pairs) / k, "half_overlap": sum(w in set(words[k // 2 :]) for w in half) / max(1, len(half)),
        }
    return out


def test_statistics_of_odd_texts():
    for text, row in zip(ODD, quality.statistics(ODD), strict=True):
        assert np.allclose(row, list(plain(text).values()), rtol=1e-9, atol=1e-12), text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB1 \n\t#|!.,é😀", max_size=80))
def test_statistics_of_any_text(text):
    want = plain(text)
    got = dict(zip(quality.STATISTICS, quality.statistics([text])[0], strict=True))
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want), {k: (got[k], want[k]) for k in want if not math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12)}


def test_first_split_has_the_best_gain_of_all_cuts():
    """Second-order gains of every feature at every value, one by one."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = (rng.uniform(size=300) < 0.15 + 0.7 * (x[:, 2] > 6)).astype(float)
    tree = quality.grow(x, y, 1, 1)
    p = 1 / (1 + math.exp(-tree.base))
    g, h = p - y, np.full(300, p * (1 - p))
    part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + quality.L2)
    gains = {}
    for j in range(4):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= quality.LEAST_ROWS:
                gains[j, cut] = part(left) + part(~left) - part(np.ones(300, bool))
    j, cut = tree.feature[0], tree.cut[0]
    left = x[:, j] <= cut
    assert math.isclose(part(left) + part(~left) - part(np.ones(300, bool)), max(gains.values()), rel_tol=1e-9)
    for rows, node in ((left, tree.left[0]), (~left, tree.left[0] + 1)):
        assert math.isclose(tree.value[node], -quality.RATE * g[rows].sum() / (h[rows].sum() + quality.L2), rel_tol=1e-9)


def test_held_out_predictions(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in quality.op2_quality_trees(spark, d).collect() if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert len(rows) > 50 and sum(r["predicted"] == labels[r["doc_id"]] for r in rows) >= 0.97 * len(rows)


def test_mixes_of_few_uneven_documents(spark):
    """200 sources of 1 to 12 documents of 1 to 5,000 words: words taken are within half of the smallest size that has room."""
    rng = np.random.default_rng(4)
    rows = []
    for s in range(200):
        sizes = Counter(int(v) for v in np.exp(rng.uniform(0, math.log(5000), rng.integers(1, 13))))
        rows += [(f"s{s:03}", size, n) for size, n in sizes.items()]
    sizes = spark.createDataFrame(rows, "source string, size long, n long")
    plan = mixing.copies_by_size(sizes, mixing.targets(sizes)).collect()
    by = {}
    for r in plan:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["copies"] <= 2 * r["n"]
    assert len(by) == 200
    for source, part in by.items():
        off = part[0]["target"] - sum(r["size"] * r["copies"] for r in part)
        room = [r["size"] for r in part if r["copies"] < 2 * r["n"]]
        assert off <= min(room, default=0) / 2 + 1e-6 and off >= -max(r["size"] for r in part) / 2 - 1e-6, (source, off)
