"""Near duplicates, contamination, licenses, mixing, shards and search, against plain versions."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pulseloom.llm import decontamination, licences, mixing, near_dedup, sharding, topk


def shingles(text, size):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset(zip(*[w[i:] for i in range(size)], strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def plain_components(rows, size):
    """rows: (doc_id, text) -> {doc_id: component}; all pairs are compared."""
    sets = defaultdict(set)
    for i, t in rows:
        if i is not None and (s := shingles(t, size)):
            sets[i].add(s)
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in root}


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_all_pairs(spark, tables, sf_dir, size):
    for d in (sf_dir, tables["odd"]):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = plain_components(rows, size)
        got = near_dedup.grouped(docs, size).collect()
        assert len(got) == len(rows)
        counts = Counter((i, len(shingles(t, size))) for i, t in rows)
        assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == counts
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_chains_and_hubs_of_near_copies(spark):
    """Groups whose members are linked only through others; pivots alone would miss some."""
    rng = np.random.default_rng(5)
    rows, words = [], [f"t{i}" for i in range(120)]
    for k in range(60):  # copies of one text with many edits each: linked to the text, hardly to each other
        w = list(words)
        for at in rng.choice(120, 6, replace=False):
            w[at] = f"e{k}x{at}"
        rows.append((1000 - k, " ".join(w)))
    rows.append((2000, " ".join(words)))
    for k in range(30):  # a chain: each text drops two words of the one before
        rows.append((3000 + k, " ".join(f"c{i}" for i in range(2 * k, 2 * k + 80))))
    want = plain_components(rows, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.grouped(docs, 2).collect()}
    assert got == want


def test_tiles_give_the_pairs_of_whole_bands(spark):
    rng = np.random.default_rng(3)
    marks = [[int(x) for x in rng.integers(-(2**62), 2**62, n)] for n in (8, 16)]
    rows = [(b, r, int(rng.integers(0, 40)), n, 50, *marks) for b, n in ((1, 90), (2, 7), (3, 1)) for r in range(n)]
    df = spark.createDataFrame(rows, 'band long, rep long, label long, "all" long, n long, sketch array<long>, parity array<long>'.replace('"', "`"))
    want = sorted((b, r, s) for b, r, p, *_ in rows for c, s, q, *_ in rows if b == c and p < q)
    for tile in (10, 1000):
        got = near_dedup.met_in_tiles(df, 80, tile).select("x.band", "x.rep", "y.rep").collect()
        assert sorted(map(tuple, got)) == want


def test_more_pivots_give_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(map(tuple, near_dedup.grouped(docs, 2).collect()))
    monkeypatch.setattr(near_dedup, "PAIRS_A_ROW", 0)
    assert sorted(map(tuple, near_dedup.grouped(docs, 2).collect())) == want


def test_empty_documents(spark, tables):
    assert near_dedup.op4_odd_sketches(spark, tables["empty"]).collect() == []


def test_sketches_estimate_and_parity_never_exceeds():
    rng = np.random.default_rng(6)
    errors = []
    for j in (0.8, 0.85, 0.9, 0.95):
        for _ in range(40):
            n = 600
            both = int(round(2 * n * j / (1 + j)))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
            x, y = (near_dedup.sketch(near_dedup.minhash(s)) for s in (a, b))
            z = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
            errors.append(near_dedup.similarity(z) - j)
            assert z <= near_dedup.most_differing()
            p = (near_dedup.parity(a) ^ near_dedup.parity(b)).view(np.uint64)
            assert sum(int(v).bit_count() for v in p) <= len(np.setxor1d(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06


def test_star_components_equal_union_find(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["label"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == find(i) for i in root)


# -- contamination ---------------------------------------------------------------------

ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"


def test_contamination_tolerates_substitutions(spark):
    w = ITEM.split()
    cases = {1: (ITEM, True), 2: ("Before. " + ITEM.upper().replace("HOTEL", "MOTEL").replace(" PAPA", ", poppa") + " after", True), 3: (" ".join(w[:17]), True), 4: (" ".join(w[:6] + ["x"] * 14), False), 5: (" ".join(reversed(w)), False), 6: (None, False), 7: ("x " * 3000 + ITEM + " y" * 3000, True)}
    docs = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()] + [(1, ITEM), (None, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (None, ITEM)], "item_id long, text string")
    rows = decontamination.contaminated(docs, bench).collect()
    assert {r["doc_id"] for r in rows} == {i for i, (_, bad) in cases.items() if bad} | {None}
    assert len(rows) == 5 and {r["start"] for r in rows if r["doc_id"] == 7} == {3000}


def test_contamination_equals_a_plain_search(spark, sf_dir):
    tok = lambda t: re.findall(r"[^\W_]+", t.lower())
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r["item_id"]: tok(r["text"]) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        w = tok(r["text"])
        for i, x in items.items():
            n = min(16, len(x))
            grams = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            if n >= 9 and any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                want.add((r["doc_id"], i))
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.op7_spaced_seeds(spark, sf_dir).collect()} >= want


def hit(masks, same):
    """Whether a mask finds all its places equal somewhere."""
    return any(all(same[p + i] for i, c in enumerate(m) if c == "1") for m in masks for p in range(len(same) - len(m) + 1))


def test_seeds_hit_every_pattern_that_the_verifier_accepts():
    for n in range(1, 17):
        masks = [m for m, served in decontamination.shapes([n]).items() if n in served]
        for k in range(n):
            if (n - k) / n >= decontamination.AGREE:
                assert all(hit(masks, [i not in bad for i in range(n)]) for bad in itertools.combinations(range(n), k)), (n, k)
    assert list(decontamination.shapes([15, 16])) == list(decontamination.MASKS)


def brute(docs, items):
    """Pairs by comparing at every offset."""
    found = set()
    for d, w in docs:
        for i, x in items:
            n = min(16, len(x))
            for shift in range(-len(x) + n, len(w) - n + 1):
                a, b = max(shift, 0), max(-shift, 0)
                same = [p == q for p, q in zip(w[a:], x[b:], strict=False)]
                if any(sum(same[k : k + n]) / n >= 0.8 for k in range(len(same) - n + 1)):
                    found.add((d, i))
    return found


def test_contamination_equals_a_search_of_all_offsets(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = [(i, rng.choices(words, k=n)) for i, n in enumerate([*range(5, 21), *range(5, 21), 40])]
    docs = []
    for i, x in items:
        for k in range(6):
            copy = [rng.choice(words) if rng.random() < 0.2 else w for w in x]
            docs.append((len(docs), rng.choices(words, k=k * 3) + copy + rng.choices(words, k=k)))
        for first in range(5):  # every fifth token replaced
            docs.append((len(docs), ["z" if j % 5 == first else w for j, w in enumerate(x)]))
    for n in range(1, 5):  # short items, copied and not
        i, x = len(items), [f"s{n}{j}" for j in range(n)]
        items.append((i, x))
        docs += [(len(docs), rng.choices(words, k=5) + x + rng.choices(words, k=5)), (len(docs) + 1, x), (len(docs) + 2, x[:-1] + ["z"])]
    items.append((len(items), ["漢字だけの長い文"]))
    docs.append((len(docs), ["漢字だけの長い文", "w1"]))
    rows = [spark.createDataFrame([(i, " ".join(w)) for i, w in x], f"{c}_id long, text string") for x, c in ((docs, "doc"), (items, "item"))]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(*rows).collect()}
    assert got == brute(docs, items) and len(got) > 150


def test_contamination_beyond_a_broadcast(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(decontamination, "FILTER_BITS", 14)
    assert sorted(map(tuple, decontamination.contaminated(docs, items).collect())) == want and want


def test_seed_filter_marks_all_seeds_and_few_others(spark):
    from pyspark.sql import functions as F

    seeds = spark.range(2000).select(F.xxhash64("id").alias("seed"))
    known = decontamination.bitmap(seeds, 16)
    assert known.select(F.size("filter")).first()[0] == 1024
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("seed")).join(F.broadcast(known))
    hits = rows.select("id", decontamination.marked(F.col("seed"), 16).alias("hit")).where("hit").select("id").collect()
    assert {r["id"] for r in hits} >= set(range(2000)) and len(hits) < 3500


@pytest.mark.parametrize("query", [decontamination.op7_spaced_seeds, licences.op5_license_scan])
def test_odd_and_empty_tables(spark, tables, query):
    got = query(spark, tables["odd"]).collect()
    assert {r["doc_id"] for r in got} == ({1, 6, 7} if "item_id" in got[0] else set()) if got else True
    assert query(spark, tables["empty"]).collect() == []


# -- licenses --------------------------------------------------------------------------


def test_band_settings_and_cues():
    for text in licences.TEMPLATES.values():
        w = licences.cut(text)
        assert licences.chance(len(w)) > 0.999
        sets = [w[i : i + 5] for i in range(max(1, len(w) - 4))]
        alike = {n: t for n, t in licences.TEMPLATES.items() if licences.length_class(len(licences.cut(t))) == licences.length_class(len(w))}
        free = sum(not any(c in s for c in licences.cues(alike)) for s in sets)
        assert free < 0.8 * len(sets)


def test_licenses_equal_a_plain_scan(spark, sf_dir):
    tok = lambda t: licences.cut(t or "")
    five = lambda w: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    filler = " ".join(f"f{i}" for i in range(300))
    docs = [(10_000 + i, f"{filler[: 37 * i]} {t} {filler}") for i, t in enumerate(licences.TEMPLATES.values())] + [(20_000, "the license of the released software"), (20_001, None), (20_002, "")]
    rng = random.Random(2)
    for i, (_, t) in enumerate(licences.TEMPLATES.items()):  # words left out, replaced, and added, some far apart
        w = tok(t)
        docs.append((30_000 + i, " ".join(x for x in w if rng.random() > 0.04)))
        docs.append((31_000 + i, filler[: 11 * i] + " " + " ".join("other" if rng.random() < 0.05 else x for x in w)))
        docs.append((32_000 + i, " ".join(w[: len(w) // 2]) + " " + " ".join(filler.split()[: rng.choice([3, len(w) // 2, 4 * len(w)])]) + " " + " ".join(w[len(w) // 2 :])))
    docs += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = licences.scanned(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    wanted = {n: five(tok(t)) for n, t in licences.TEMPLATES.items()}
    want = set()
    for i, t in docs:
        w = tok(t)
        for n, s in wanted.items():
            size = licences.length_class(len(tok(licences.TEMPLATES[n])))
            if len(five(w) & s) >= 0.8 * len(s) and any(len(five(w[k : k + 2 * size]) & s) >= 0.8 * len(s) for k in range(0, max(1, len(w)), size)):
                want.add((i, n))
    assert sum(i >= 32_000 for i, _ in want) > 10 and any((32_000 + k, n) not in want for k, n in enumerate(wanted))
    assert {(r["doc_id"], r["template"]) for r in got} == want and len(got) == len(want)
    by = {i: tok(t) for i, t in docs}
    for r in got:
        if r["containment"] == 1:
            assert by[r["doc_id"]][r["start"] : r["start"] + r["n_tokens"]] == tok(licences.TEMPLATES[r["template"]])


# -- mixing ----------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2)):
    """The resharing, round by round."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mix_targets_rounding_and_reruns(spark, tables, sf_dir):
    for d in (sf_dir, tables["odd"]):
        docs = [(r["doc_id"], r["source"], len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or ""))) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
        sizes = Counter()
        for _, s, n in docs:
            sizes[s] += n
        want = plain_targets(dict(sizes))
        rows = mixing.op9_entropy_mix(spark, d).collect()
        assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in rows) == Counter((i, n, sizes[s]) for i, s, n in docs)
        assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.op9_entropy_mix(spark, d).collect()), key=repr)
        taken, target, least = Counter(), {}, {}
        for r in rows:
            assert 0 <= r["taken"] <= 2 * r["size"] and (r["taken"] == 0 or r["taken"] % r["size"] == 0)
            taken[r["source_size"]] += r["taken"]
        for s, t in want.items():
            target[sizes[s]] = target.get(sizes[s], 0) + t
            least[sizes[s]] = max(min((n for _, x, n in docs if x == s and n), default=0), least.get(sizes[s], 0))
        for key, t in target.items():
            # Off by the smallest document, but where a source is one long text, by half of that.
            assert abs(taken[key] - t) <= max(2 * least[key], (0.02 if d == sf_dir else 0.0) * t) + 1 or (d != sf_dir and abs(taken[key] - t) <= max(n for _, _, n in docs) / 2)
        for r in rows:
            assert any(math.isclose(r["target"], t, rel_tol=1e-9, abs_tol=1e-9) for s, t in want.items() if sizes[s] == r["source_size"])


def test_mix_of_a_hot_size(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('s', id % 2) AS source", "'a b c d e' AS text")
    rows = mixing.mixed(docs).groupBy("source", "mix.copies").count().collect()
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["copies"] * r["count"] * 5
    assert taken == {"s0": 100_000, "s1": 50_000} or all(abs(taken[s] - t) <= 5 for s, t in plain_targets({"s0": 50_000, "s1": 50_000}).items())


def test_mix_of_nothing(spark, tables):
    assert mixing.op9_entropy_mix(spark, tables["empty"]).collect() == []


def plain_tilt(sizes, target, most=2):
    """The root of sum(n * size * min(most, exp(x * size))) = target, by halving."""
    words = lambda x: sum(n * s * (most if x * s >= math.log(most) else math.exp(x * s)) for s, n in sizes.items())
    low, high = -50.0, math.log(most) / min(sizes)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if words(mid) < target else (low, mid)
    return high


def test_newton_solves_the_dual(spark):
    rng = random.Random(6)
    sizes, goals = [], []
    for i, share in enumerate((0.0, 1e-4, 0.3, 0.999, 1.0, 1.3, 1.9, 1.9999, 2.0)):
        of = {s: rng.randint(1, 40) for s in {rng.choice([rng.randint(1, 9), rng.randint(50, 500), rng.randint(1, 200_000)]) for _ in range(60)}}
        total = sum(s * n for s, n in of.items())
        goals.append((f"s{i}", total, share * total))
        sizes += [(f"s{i}", s, n) for s, n in of.items()] + [(f"s{i}", 0, 7)]
    got = mixing.newton(spark.createDataFrame(sizes, "key string, size long, n long"), spark.createDataFrame(goals, "key string, source_size long, target double"))
    tilts = {r["key"]: r["tilt"] for r in got.collect()}
    for key, total, target in goals:
        of = {s: n for k, s, n in sizes if k == key and s}
        words = sum(n * s * (2 if tilts[key] * s >= math.log(2) else math.exp(max(-700, tilts[key] * s))) for s, n in of.items())
        assert abs(words - target) <= 2e-9 * max(target, 1)
        if 0 < target < 2 * total:
            assert math.isclose(tilts[key], plain_tilt(of, target), rel_tol=1e-5, abs_tol=1e-9)


def test_rates_are_tilted_by_size_and_near_copies(spark):
    rng = random.Random(7)
    docs = [(i, f"s{i % 3}", " ".join("w" * 1 for _ in range(rng.randint(1, 300)))) for i in range(3000)]
    rows = mixing.mixed(spark.createDataFrame(docs, "doc_id long, source string, text string")).select("source", "mix.*").collect()
    for s in ("s0", "s1", "s2"):
        mine = [r for r in rows if r["source"] == s]
        of = Counter(r["size"] for r in mine)
        x = plain_tilt(of, mine[0]["target"])
        copies = Counter()
        for r in mine:
            assert math.isclose(r["rate"], min(2, math.exp(x * r["size"])), rel_tol=1e-6, abs_tol=2e-9)
            copies[r["size"]] += r["copies"]
        rate = {r["size"]: r["rate"] for r in mine}
        assert all(abs(copies[n] - rate[n] * of[n]) <= 2 for n in of)  # rounding, and one of the rounds that fill up
        assert abs(sum(n * c for n, c in copies.items()) - mine[0]["target"]) <= 2


# -- shards ----------------------------------------------------------------------------


def test_store_versions_compaction_and_conflicts(spark, tmp_path, odd):
    store = sharding.Store(spark, str(tmp_path / "s"), target=200_000)
    batches = [spark.range(i * 3000, (i + 1) * 3000, 1, 3).selectExpr("id AS doc_id", "repeat(sha2(string(id), 256), 2) AS text") for i in range(4)]
    for i, b in enumerate(batches):
        assert store.append(b) == i + 1
    before = store.manifest()["shards"]
    assert len(before) == 12
    version = store.compact()
    after = store.manifest()["shards"]
    assert version == 5 and len(after) < len(before) and max(x["bytes"] for x in after) < 2 * store.target
    ids = sorted(r[0] for r in store.read().select("doc_id").collect())
    assert ids == list(range(12_000)) == sorted(r[0] for r in store.read(4).select("doc_id").collect())
    with pytest.raises(sharding.ConflictError):
        store.commit(4, [], "{}")
    files = lambda: sum(len(store._files(f.name)) for f in (tmp_path / "s").iterdir() if f.name[0] not in "._")
    store.vacuum()  # two versions stay, and all files, which are young
    assert store.versions() == [4, 5] and store.read(4).count() == 12_000 and files() == len(before) + len({x["file"] for x in after} - {x["file"] for x in before})
    store.vacuum(1, 0)
    assert store.versions() == [5] and store.read().count() == 12_000 and files() == len(after)
    placed = store.placed().select("doc_id", "placed.*").collect()
    assert len(placed) == 12_000 and {r["shard"] for r in placed} == {sharding.short(x["file"]) for x in after}


def test_vacuum_spares_writers_that_have_not_committed(spark, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "s"))
    rows = spark.range(10).selectExpr("id AS doc_id")
    store.append(rows)
    store._write(rows, "arrivals-second")  # a second writer's finished files
    store.vacuum()
    new = store._files("arrivals-second")
    assert new and store.change(lambda now: now["shards"] + [x | {"tier": 1} for x in new]) == 2 and store.read().count() == 20


def test_writers_that_lose_a_race_commit_on_top(spark, tmp_path, monkeypatch):
    store, other = (sharding.Store(spark, str(tmp_path / "s"), target=100_000) for _ in range(2))
    rows = spark.range(0, 4000, 1, 8).selectExpr("id AS doc_id", "repeat(sha2(string(id), 256), 2) AS text")
    store.append(rows)
    seen = []
    commit = store.commit

    def late(base, shards, schema):
        if not seen:  # another writer is first, once
            seen.append(other.append(rows))
        return commit(base, shards, schema)

    monkeypatch.setattr(store, "commit", late)
    store.append(rows)
    assert seen == [2] and store.versions() == [1, 2, 3] and store.read().count() == 12_000
    seen.clear()
    store.compact()  # merges what it saw; the arrivals of the other writer stay beside it
    assert store.read().count() == 16_000
    monkeypatch.setattr(store, "commit", commit)
    seen.clear()
    lost = {"now": store.manifest()}
    monkeypatch.setattr(store, "manifest", lambda v=None, real=store.manifest: lost.pop("now", None) or real(v))
    other.compact()
    store.compact()  # its plan is of shards that the other has merged already
    monkeypatch.undo()
    assert store.read().count() == 16_000 and sorted(r[0] for r in store.read().select("doc_id").collect()) == sorted(list(range(4000)) * 4)


def plain_groups(sizes, target):
    """Shards by name -> groups to merge: tiers by powers of 4 below half the target, smallest shards first, groups up to 1.25 targets."""
    tier = lambda n: 0 if n >= target // 2 else 1 + max(i for i in range(40) if i == 0 or n < target // 2 // 4**i)
    out = []
    for t in sorted({tier(n) for n in sizes.values()} - {0}, reverse=True):
        run = sorted((n, f) for f, n in sizes.items() if tier(n) == t)
        if len(run) >= 4:
            groups = [[]]
            for n, f in run:
                if groups[-1] and sum(sizes[g] for g in groups[-1]) + n > target * 5 // 4:
                    groups.append([])
                groups[-1].append(f)
            out += [g for g in groups if len(g) > 1]
    return out


def test_groups_and_merged_sizes_equal_a_plain_plan(spark, tmp_path):
    store = sharding.Store(spark, str(tmp_path / "g"), target=1 << 16)
    rng = random.Random(4)
    for _ in range(30):
        sizes = {f"f{i:03}": int(2 ** rng.uniform(4, 18)) for i in range(rng.randrange(40))}
        got = store.groups([{"file": f, "bytes": n, "tier": store.tier(n)} for f, n in sizes.items()])
        assert [[x["file"] for x in g] for g in got] == plain_groups(sizes, 1 << 16)
    rows = spark.range(0, 9000, 1, 12).selectExpr("id AS doc_id", "repeat(sha2(string(id), 256), 2) AS text")
    store.append(rows)
    before = {x["file"]: x["bytes"] for x in store.manifest()["shards"]}
    want = plain_groups(before, 1 << 16)
    store.compact()
    after = {x["file"] for x in store.manifest()["shards"]}
    assert len(after - set(before)) == len(want) and after & set(before) == set(before) - {f for g in want for f in g}


def test_large_arrivals_are_cut_and_merged(spark, tmp_path):
    docs = spark.range(0, 12_000, 1, 1).selectExpr("id AS doc_id", "repeat(sha2(string(id), 256), 2) AS text")
    store = sharding.Store(spark, str(tmp_path / "s"), target=200_000)
    store.append(docs)
    arrived = store.manifest()["shards"]
    assert len(arrived) > 4 and all(x["bytes"] < store.target // 2 and x["tier"] > 0 for x in arrived)
    assert sum(len(store._files(f.name)) for f in (tmp_path / "s").iterdir() if f.name[0] not in "._") == len(arrived)
    assert store.compact() == 2
    merged = store.manifest()["shards"]
    assert len(merged) < len(arrived) and max(x["bytes"] for x in merged) < 2 * store.target
    assert sorted(r[0] for r in store.read().select("doc_id").collect()) == list(range(12_000))
    small = sharding.Store(spark, str(tmp_path / "s"), target=20_000)  # its shards are far above this target
    while small.versions()[-1] != small.compact():
        pass
    assert max(x["bytes"] for x in small.manifest()["shards"]) < 2 * small.target
    assert sorted(r[0] for r in small.read().select("doc_id").collect()) == list(range(12_000))
    huge = spark.sql("SELECT 1L AS doc_id, array_join(transform(sequence(1, 20000), i -> sha2(string(i), 256)), '') AS text")
    one = sharding.sharded(huge, str(tmp_path / "one"), target=20_000)  # a single row can't be cut
    assert one.read().count() == 1 and len(one.manifest()["shards"]) == 1


def test_sharded_odd_documents(spark, tables, odd):
    rows = sharding.op1_tiered_shards(spark, tables["odd"]).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    store = sharding.sharded(odd, target=1 << 20)
    assert sorted(map(repr, store.read().select(*odd.columns).collect())) == sorted(map(repr, odd.collect()))
    assert sharding.op1_tiered_shards(spark, tables["empty"]).collect() == []


# -- search ----------------------------------------------------------------------------


def plain_search(vectors, k=5):
    rows = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            rows.setdefault((i, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        scores = {(sum(a * b for a, b in zip(u, v, strict=False)), i) for p, u in rows if p == q for i, v in rows if i != q}
        out += [(q, r, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return out


def test_search_equals_brute_force(spark, tables, sf_dir):
    for d in (sf_dir, tables["odd"]):
        vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
        assert sorted(map(tuple, topk.op10_block_topk(spark, d).collect())) == plain_search(vectors)
    assert topk.op10_block_topk(spark, tables["empty"]).collect() == []


def test_search_of_many_equal_vectors(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, [1.0, 0.5]) for i in range(700)] + [(i, rng.normal(size=2).tolist()) for i in range(700, 1500)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    got = topk.searched(df, df.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == plain_search(vectors)


def test_bounds_hold_for_every_vector():
    rng = np.random.default_rng(9)
    for dims, spread in ((3, 2.0), (16, 0.05), (64, 30_000.0)):
        q = np.floor(256 * rng.normal(size=(20, dims))).astype(np.int64)
        for _ in range(10):
            m = np.floor(256 * (rng.normal(size=(40, dims)) * spread + rng.normal(size=dims))).astype(np.int64)
            mid = np.rint(m.mean(axis=0)).astype(np.int64)
            radius = float(np.sqrt(((m - mid) ** 2).sum(axis=1).max()))
            s = topk.Summary("b", dims, *(topk.narrow(x) for x in (m.max(0), m.min(0), mid)), radius)
            assert (topk.bounds(q, [s])[:, 0] >= (q @ m.T).max(axis=1)).all()
            assert (topk.array(topk.narrow(m), dims) == m).all() and (topk.scores_of(q, m) == q @ m.T).all()


def test_clustered_blocks_are_pruned_and_results_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "PACK", 16)
    monkeypatch.setattr(topk, "RUN", 20)
    monkeypatch.setattr(topk, "CELL", 1000)
    rng = np.random.default_rng(10)
    middles = rng.normal(size=(12, 16))
    at = np.concatenate([np.zeros(2500, int), rng.integers(1, 12, 3500)])  # one cluster has a good third
    x = middles[at] + 0.05 * rng.normal(size=(6000, 16))
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    asked = df.where("vec_id % 50 = 0")
    packs, blocks, _ = topk.indexed(df, asked)
    all_pairs = packs.count() * blocks.count()
    left = topk.surviving(packs, blocks).selectExpr("count(*) AS n", "sum(open) AS open", "sum(queries) AS queries").first()
    per_query = 120 * blocks.count()
    assert left["n"] < 0.65 * all_pairs and left["open"] < 0.4 * per_query, (left, all_pairs, per_query)
    got = topk.searched(df, asked).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == plain_search(vectors)


def test_search_sql(spark, duck, sf_dir):
    from compare import same

    from pulseloom.llm import queries

    same(topk.op10_block_topk(spark, sf_dir), duck.sql(queries.oracle_sql()["op10_block_topk"]))


def test_components_sql(spark, duck, sf_dir):
    from compare import same

    from pulseloom.llm import queries

    same(near_dedup.op4_odd_sketches(spark, sf_dir), duck.sql(queries.oracle_sql()["op4_odd_sketches"]))
