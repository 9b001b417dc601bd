"""The operators for training data against plain versions and edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dipweave.llm.mixing import mixture, shares, source_name
from dipweave.llm.nearest_time import match_dips
from dipweave.llm import overlaps
from dipweave.llm.overlaps import FEATURES, FLAGS, overlapping, targets_in_train
from dipweave.llm.packing import best_fit, pack, pack_documents
from dipweave.llm.splits import choose, components, grouped_splits, quotas, reserve, same_names
from dipweave.llm.splitting import SparseTable, cuts, split_texts, strengths

CATALOG = "tic_id bigint, kic bigint"


# ---- splits


@pytest.mark.parametrize("seed", [1, 2])
def test_components(rows, seed):
    rng = random.Random(seed)
    names = [f"n{k:03d}" for k in range(120)]
    edges = [(rng.choice(names[:80]), rng.choice(names[:80])) for _ in range(60)] + [(names[k], names[k + 1]) for k in range(80, 119)] + [(None, "n001"), ("n005", "n005")]
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    linked = set()
    for a, b in edges:
        if a and b and a != b:
            linked |= {a, b}
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components(rows(edges, "a string, b string")).collect()}
    assert got == {n: root(n) for n in linked}
    assert components(rows([], "a string, b string")).count() == 0


def test_same_names(rows):
    hosts = ["KIC 9", "kic 9", "TIC 5", "TIC_06", "TIC 7", "tic 7", None, "", "x", "KIC 9"]
    got = {tuple(r) for r in same_names(rows([(h,) for h in hosts], "host_star string"), rows([(5, 9), (6, 9), (7, None)], CATALOG)).collect()}
    star = ["KIC 9", "kic 9", "TIC 5", "TIC_06"]
    assert got == {(min(p), max(p)) for p in itertools.combinations(star, 2)} | {("TIC 7", "tic 7")}


def test_names_linked_by_way_of_others(rows):
    # one TIC with two KIC numbers names both stars; these are two
    got = {tuple(r) for r in same_names(rows([("TIC 1",), ("KIC 10",), ("KIC 20",), ("kic10",)], "host_star string"), rows([(1, 10), (1, 20)], CATALOG)).collect()}
    assert got == {("KIC 10", "TIC 1"), ("KIC 20", "TIC 1"), ("TIC 1", "kic10"), ("KIC 10", "kic10")}


def test_nearest_totals():
    rng = random.Random(3)
    for _ in range(300):
        sizes = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(1, 5))}
        target = rng.randint(0, 160)
        sums = {sum(s * n for s, n in zip(sizes, c)) for c in itertools.product(*(range(m + 1) for m in sizes.values()))}
        got = choose(sizes, target)
        assert all(n <= sizes[s] for s, n in got.items())
        assert abs(sum(s * n for s, n in got.items()) - target) == min(abs(x - target) for x in sums)
    big = {10**6 + 7: 500, 1: 10**7, 3: 10**6}
    assert sum(s * n for s, n in choose(big, 15 * 10**6).items()) == 15 * 10**6
    plan = quotas({1: 1000, 7: 30, 300: 2}, {"v": 181, "t": 181})
    assert sum(s * n["v"] for s, n in plan.items()) == 181 and sum(s * n["t"] for s, n in plan.items()) == 181


def test_totals_of_many_sizes_in_little_memory():
    import tracemalloc

    sizes = dict.fromkeys(range(1, 100_001), 1)
    target = sum(sizes) // 10
    tracemalloc.start()
    got = choose(sizes, target)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(s * n for s, n in got.items()) == target and peak < 200e6


def test_reserved_components():
    rng = random.Random(9)
    for _ in range(300):
        units = [str(k) for k in range(rng.randint(3, 7))]
        labels_of = {x: c for x in "ABCD"[: rng.randint(1, 4)] if (c := [u for u in units if rng.random() < 0.6])}
        full = [c for c in labels_of.values() if len(c) >= 3]
        can = any(all({a[units.index(u)] for u in c} == {0, 1, 2} for c in full) for a in itertools.product(range(3), repeat=len(units)))
        got = reserve(labels_of, ["p", "q", "r"])
        assert all({got.get(u) for u in c} >= {"p", "q", "r"} for c in full) == can


def test_each_label_in_each_split(rows):
    hosts = [("KIC 1", "AB"), ("KIC 2", "BC"), ("KIC 3", "BBB")] + [(f"KIC {k}", x * 5) for k, x in enumerate("AC" * 20, 10)]
    data = [(n, h, x) for n, (h, x) in enumerate((h, x) for h, xs in hosts for x in xs)]
    got = grouped_splits(rows(data, "label_id bigint, host_star string, label string"), rows([], CATALOG)).collect()
    for x in "ABC":
        assert {r["split"] for r in got if r["label"] == x} == {"train", "validation", "test"}
    with pytest.raises(ValueError):
        grouped_splits(rows([(n, "KIC 1", str(n)) for n in range(501)], "label_id bigint, host_star string, label string"), rows([], CATALOG))


def labels(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        host = "KIC 1" if rng.random() < 0.3 else rng.choice([None, "", "x"]) if rng.random() < 0.1 else f"{rng.choice(['KIC ', 'kic_0', 'TIC ', 'tic'])}{rng.randint(2, 60)}"
        out.append((k, host, rng.choice(["a", "b", "c", None]) if k % 50 else "rare"))
    return out


def test_grouped_splits(rows):
    data = labels(1500, 4)
    catalog = rows([(t, t + 1) for t in range(2, 30)], CATALOG)
    df = rows(data, "label_id bigint, host_star string, label string").withColumn("star", F.lit("clash")).withColumn("unit", F.lit(1))
    got = grouped_splits(df, catalog).collect()
    assert sorted(r["label_id"] for r in got) == list(range(1500))
    seen = {}
    for r in got:
        if r["star"] is not None:
            seen.setdefault(r["star"], set()).add(r["split"])
    assert all(len(s) == 1 for s in seen.values())
    count = {k: sum(r["split"] == k for r in got) for k in ("train", "validation", "test")}
    assert abs(count["validation"] - 150) <= 1 and abs(count["test"] - 150) <= 1
    for k in count:
        assert {r["label"] for r in got if r["split"] == k} >= {"a", "b", "c", "rare"}
    again = grouped_splits(df.repartition(3), catalog).collect()
    assert {(r["label_id"], r["split"]) for r in again} == {(r["label_id"], r["split"]) for r in got}


def test_splits_of_little(rows):
    schema = "label_id bigint, host_star string, label string"
    none = rows([], CATALOG)
    assert grouped_splits(rows([], schema), none).count() == 0
    got = grouped_splits(rows([(1, "KIC 1", "a"), (1, "KIC 1", "a"), (2, None, None), (None, "", "b")], schema), none).collect()
    assert len(got) == 4 and len({r["split"] for r in got if r["star"] == "KIC 1"}) == 1


# ---- nearest time


def test_nearest_time(rows):
    rng = random.Random(5)
    stars = ["KIC 1", "kic_01", "TIC 5", "TIC 8", "EPIC 2", None, "junk"]
    shift = {"Kepler": 0, "K2": 0, "TESS": 2167}
    dips = [(k, rng.choice(stars), rng.choice([None, math.nan, math.inf]) if rng.random() < 0.1 else round(rng.uniform(3000, 3010), 4)) for k in range(80)]
    found = [(1000 + k, rng.choice(stars), m := rng.choice([*shift, None]), rng.choice([None, math.nan]) if rng.random() < 0.1 else round(rng.uniform(3000, 3010) - shift.get(m, 0), 4), k % 9) for k in range(150)]
    key = {"KIC 1": {"KIC 1"}, "kic_01": {"KIC 1"}, "TIC 5": {"KIC 1"}, "TIC 8": {"TIC 8"}, "EPIC 2": {"EPIC 2"}}
    want = {}
    for d, s, t in dips:
        near = [(round(abs(t - u - shift[m]), 9), c) for c, r, m, u, _ in found if t and math.isfinite(t) and u is not None and math.isfinite(u) and m in shift and key.get(s, set()) & key.get(r, set())]
        near = [x for x in near if x[0] <= 0.5]
        if near:
            want[d] = min(near)[1]
    old = [(1000, "EPIC 2", "K2", 3005.0, -1)]
    catalog = rows([(5, 1), (5, 1), (9, None)], CATALOG)
    a = rows(dips + dips[:20], "dip_id bigint, target_id string, t_min_bkjd double").withColumn("bucket", F.lit(0))
    b = rows(found + old + found[:30], "candidate_id bigint, target_id string, mission string, t_min double, found_at int").withColumn("entity", F.lit("x"))
    got = {r["dip_id"]: r["candidate_id"] for r in match_dips(a, b, catalog).collect()}
    assert got == want
    assert match_dips(a.limit(0), b, catalog).count() == 0 and match_dips(a, b.limit(0), catalog).count() == 0


def test_exactly_at_the_tolerance(rows):
    a = rows([(1, "KIC 1", 10.5), (2, "KIC 1", 20.1)], "dip_id bigint, target_id string, t_min_bkjd double")
    b = rows([(7, "KIC 1", "K2", 10.0, 1), (8, "KIC 1", "K2", 19.5999, 1), (9, "KIC 1", "K2", 11.0, 1)], "candidate_id bigint, target_id string, mission string, t_min double, found_at int")
    assert [tuple(r)[:2] for r in match_dips(a, b, rows([], CATALOG)).collect()] == [(1, 7)]


# ---- overlaps

LABELS = "label_id bigint, host_star string, split string, author string, " + ", ".join(f"{f} double" for f in FEATURES)


def plain_overlaps(data, star):
    out = set()
    for a in data:
        for b in data:
            if a[2] in ("validation", "test") and b[2] == "train" and a[0] is not None and b[0] is not None and star.get(a[1]) and star.get(a[1]) == star.get(b[1]):
                both = [(x, y) for x, y in zip(a[4:], b[4:]) if x is not None and y is not None and x == x and y == y]
                close = all(x == y or (math.isfinite(x) and math.isfinite(y) and abs(x - y) <= 0.01 * max(abs(x), abs(y))) for x, y in both)
                if len(both) >= 8 and close:
                    out.add((a[0], b[0]))
    return out


def test_chunks():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 1 << 63, (500, 17), dtype=np.uint64)
    there = rng.random((500, 17)) < 0.8
    lengths, digests = np.zeros(500, int), [set() for _ in range(500)]
    for rows_, digest, length in overlaps.chunks(tokens, there):
        assert (length <= overlaps.LONGEST).all()
        np.add.at(lengths, rows_, length)
        for r, d in zip(rows_, digest):
            digests[r].add(int(d))
    assert (lengths == there.sum(axis=1)).all()
    # content decides: without the first few tokens the later chunks are the same
    later = there.copy()
    later[:, :4] = False
    again = [set() for _ in range(500)]
    for rows_, digest, _ in overlaps.chunks(tokens, later):
        for r, d in zip(rows_, digest):
            again[r].add(int(d))
    assert np.mean([len(a & d) / max(1, len(a)) for a, d in zip(again, digests)]) > 0.5
    # six features in five groups: two of one
    pairs = overlaps.index_groups(17, 5)
    assert len(pairs) == 21 and all(any(i in s and j in s for i, j in pairs) for s in map(set, itertools.islice(itertools.combinations(range(17), 6), 0, None, 7)))


@pytest.mark.parametrize("seed", [6, 7])
def test_overlaps(rows, seed):
    rng = random.Random(seed)
    star = {"KIC 1": "KIC 1", "kic 01": "KIC 1", "TIC 5": "KIC 1", "TIC 8": "TIC 8"}
    data = []
    for _ in range(60):
        base = [rng.choice([0.0, 1.0]) if f in FLAGS else rng.choice([-1, 1]) * math.exp(rng.uniform(-8, 8)) if rng.random() < 0.95 else rng.choice([0.0, math.inf, -math.inf]) for f in FEATURES]
        for _ in range(rng.randint(1, 4)):
            wide = rng.choice([0, 0.004, 0.0099, 0.012])
            copy = [x if f in FLAGS or not math.isfinite(x) else x * (1 + rng.uniform(-wide, wide)) for f, x in zip(FEATURES, base)]
            gone = rng.choice([0, 0, 3, 6, 9, 11])
            for k in rng.sample(range(19), gone):
                copy[k] = rng.choice([None, math.nan])
            data.append((len(data), rng.choice([*star, None, "junk"]), rng.choice(["train", "train", "validation", "test", None]), rng.choice(["A", None]), *copy))
    data += [(1000 + k, "KIC 1", "train" if k % 2 else "test", "A", *[1.0] * 19) for k in range(12)] + [(2000, "KIC 1", "test", "A", *[None] * 19), (None, "KIC 1", "test", "A", *[1.0] * 19)]
    catalog = rows([(5, 1)], CATALOG)
    df = rows(data, LABELS).withColumn("star", F.lit("clash")).withColumn("class", F.lit(0))
    got = [(r["eval_id"], r["train_id"]) for r in overlapping(df, catalog).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_overlaps(data, star) and len(got) > 36


def test_overlaps_of_nothing(rows):
    catalog = rows([], CATALOG)
    assert overlapping(rows([], LABELS), catalog).count() == 0
    targets = rows([(1, "kic 7"), (2, None), (None, "KIC 7"), (3, "TIC 9")], "target_no bigint, target_id string")
    data = [(10, "KIC 7", "train", None, *[None] * 19), (11, "KIC 7", "test", None, *[None] * 19), (12, "TIC 9", "train", "A", *[None] * 19)]
    assert {(r[0], r[1]) for r in targets_in_train(rows(data, LABELS), targets, catalog).collect()} == {(1, 10), (3, 12)}


# ---- packing


def test_best_fit():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 100, 500)
    bins = best_fit(sizes, 100)
    assert sorted(sum(bins, [])) == list(range(500)) and all(sizes[b].sum() <= 100 for b in bins)
    assert len(bins) <= 1.05 * sizes.sum() / 100 + 1


@pytest.mark.parametrize("parts", [1, 9])
def test_packing(rows, parts):
    rng = random.Random(9)
    items = [(k, rng.choice([0, None, 100, 250, 1, rng.randint(1, 99), rng.randint(1, 30)])) for k in range(600)] + [(None, 40), (None, 40), (5, 60)]
    df = rows(items, "doc_id bigint, tokens bigint").withColumn("container", F.lit("clash")).repartition(parts)
    got = pack(df, 100, fan_in=3).collect()
    fill, per = {}, {}
    for r in got:
        per.setdefault(r["doc_id"], []).append(r["tokens"])
        if r["container"] is None:
            assert r["tokens"] == 0
        else:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 100
    want = {}
    for k, n in items:
        n = n or 0
        want.setdefault(k, []).extend([100] * (n // 100) + ([n % 100] if n % 100 else []) if n else [0])
    assert {k: sorted(v) for k, v in per.items()} == {k: sorted(v) for k, v in want.items()}
    total = sum(fill.values())
    assert len(fill) <= math.ceil(total / 100) * 1.04 + 2


def test_nothing_to_pack(rows):
    assert pack(rows([], "doc_id bigint, tokens bigint"), 10).count() == 0
    got = pack_documents(rows([(1, "é" * 3), (2, None), (3, "")], "doc_id bigint, text string"), 4).collect()
    assert sorted((r["doc_id"], r["piece"], r["tokens"], r["container"] is None) for r in got) == [(1, 0, 4, False), (1, 1, 2, False), (2, 0, 0, True), (3, 0, 0, True)]


@pytest.mark.parametrize("at_once", [3, 7, 100])
def test_packing_a_few_at_once(rows, at_once):
    rng = random.Random(at_once)
    data = [(k, rng.choice([rng.randint(1, 99), 60, 5])) for k in range(400)]
    got = pack(rows(data, "doc_id bigint, tokens bigint").repartition(5), 100, fan_in=2, at_once=at_once).collect()
    assert sorted((r["doc_id"], r["tokens"]) for r in got) == data
    fill = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 100 and sum(2 * f <= 100 for f in fill.values()) <= 1


@pytest.mark.parametrize("sizes", [[60, 30, 5, 100, 45] * 20, [100] * 40, [50] * 40])
def test_packing_further_batches(spark, rows, sizes):
    """A partition may have more than at_once items, in several batches, and may leave none of its containers open."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = pack(rows([*enumerate(sizes)], "doc_id bigint, tokens bigint").coalesce(1), 100, at_once=20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["doc_id"], r["tokens"]) for r in got) == [*enumerate(sizes)]
    fill = {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
    assert max(fill.values()) <= 100 and sum(2 * f <= 100 for f in fill.values()) <= 1


def test_items_that_never_fit_together(rows):
    got = pack(rows([(k, 60) for k in range(50)], "doc_id bigint, tokens bigint").repartition(9), 100).collect()
    assert len({r["container"] for r in got}) == 50


# ---- mixing


def test_mixture(rows):
    rng = random.Random(10)
    spelled = {"big": ["big", "BIG", " big "], "small one": ["small-one", "Small One", "small_one"], "tiny": ["tiny"]}
    docs = []
    for k in range(700):
        s = rng.choices(list(spelled), [80, 15, 5])[0]
        docs.append((k, rng.choice(spelled[s]), rng.choice(["x" * rng.randint(1, 90), "same text", "", None]) if k % 4 == 0 else f"{k} " * rng.randint(1, 30)))
    docs += [(900, None, "no source"), (901, "else", "another source"), (902, "tiny", docs[1][2])]
    targets = rows([("Big", 0.5, 1), ("small_one", 0.3, 3), ("tiny", 0.2, 4), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    df = rows(docs, "doc_id bigint, source string, text string").withColumn("tokens", F.lit("clash"))
    mixed = mixture(df, targets)
    got = mixed.collect()
    text = {k: t for k, _, t in docs}
    most = {"big": 1, "small_one": 3, "tiny": 4}
    assert len({r["doc_id"] for r in got}) == len(got) and len({text[r["doc_id"]] for r in got}) == len(got)
    assert all(0 < r["uses"] <= most[r["source"]] and r["tokens"] == len(text[r["doc_id"]]) for r in got)
    total = sum(r["uses"] * r["tokens"] for r in got)
    for s, share in (("big", 0.5), ("small_one", 0.3), ("tiny", 0.2)):
        assert sum(r["uses"] * r["tokens"] for r in got if r["source"] == s) / total == pytest.approx(share, abs=0.02)
    report = {r["source"]: r for r in shares(mixed, targets).collect()}
    assert sum(r["share"] for r in report.values()) == pytest.approx(1) and report["absent"]["n_records"] == 0
    # the scarcest source is used up
    limit = {s: sum(len(t) for t in {x for k, a, x in docs if x and a and a.strip().lower().replace("-", "_").replace(" ", "_") == s}) * n / w for s, n, w in (("big", 1, 0.5), ("small_one", 3, 0.3), ("tiny", 4, 0.2))}
    assert total >= 0.9 * min(limit.values())
    assert {tuple(r) for r in mixture(df.repartition(5), targets).collect()} == {tuple(r) for r in got}


def test_mixture_of_nothing(rows):
    targets = rows([("a", 1.0, 2), (None, 0.5, 1), ("b", 0.0, 1)], "source string, target_share double, max_repeats int")
    empty = rows([], "doc_id bigint, source string, text string")
    assert mixture(empty, targets).count() == 0 and shares(mixture(empty, targets), targets.where("source = 'a'")).first()["share"] == 0
    one = mixture(rows([(1, "A", "abc"), (None, "a", "xyz"), (2, "b", "x")], "doc_id bigint, source string, text string"), targets).collect()
    assert [tuple(r) for r in one] == [(1, "a", 3, 2)]
    assert rows([(" \t ",), ("A - b",)], "s string").select(source_name(F.col("s"))).collect()[1][0] == "a_b"


# ---- splitting


def plain_cuts(text, limit, overlap):
    s = strengths(text).tolist()
    out, start = [], 0
    least = max(overlap + 4, limit // 2)
    while len(text) - start > limit:
        end = max(range(start + least, start + limit + 1), key=lambda p: (s[p], p))
        out.append((start, end))
        start = end - overlap
        while text[start] & 0xC0 == 0x80:
            start += 1
    return out + [(start, len(text))]


def page(rng, n):
    words = ["plaza", "été", "山の", "x. ", "end! ", "== Head ==\n", "\n\n", "\n", "{{box}}\n", "|-\n| a || b\n", "。", ", ", " "]
    return "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(n))


@pytest.mark.parametrize(("limit", "overlap"), [(64, 8), (200, 0), (333, 100)])
def test_cuts(limit, overlap):
    rng = random.Random(limit)
    for n in (5, 60, 900):
        text = page(rng, n).encode()
        got = cuts(text, limit, overlap)
        assert got == plain_cuts(text, limit, overlap)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(b - a <= limit for a, b in got)
        assert all(overlap - 3 <= b - c <= overlap for (_, b), (c, _) in zip(got, got[1:]))
        for a, b in got:
            text[a:b].decode()


def test_long_text_in_parts():
    text = page(random.Random(11), 160_000).encode()
    assert len(text) > 3 * (1 << 18)
    assert cuts(text, 4096, 128) == plain_cuts(text, 4096, 128)
    bare = ("語" * 200_000).encode()
    got = cuts(bare, 4096, 128)
    assert all(b - a <= 4096 for a, b in got) and got[-1][1] == len(bare) and bare[got[0][0] : got[0][1]].decode()


def test_sparse_table():
    v = np.array([1, 3, 3, 0, -1, 2, 3, 0])
    t = SparseTable(v, 8)
    for a in range(8):
        for b in range(a + 1, 9):
            assert t.best(a, b) == max(range(a, b), key=lambda p: (v[p], p))


def test_split_texts(rows):
    long = page(random.Random(12), 400)
    df = rows([(1, long), (1, long), (2, "short"), (3, None), (4, ""), (None, "y" * 300)], "doc_id bigint, text string").withColumn("piece", F.lit("clash"))
    got = split_texts(df, 100, 10).collect()
    assert {r["doc_id"] for r in got} == {1, None}
    assert all(r["tokens"] == len(r["text"].encode()) <= 100 for r in got)
    none = sorted((r["start"], r["end"], r["text"]) for r in got if r["doc_id"] is None)
    assert none[0][:2] == (0, 100) and none[-1][1] == 300
    assert split_texts(df.limit(0), 100, 10).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, 100, 60)
