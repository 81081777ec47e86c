import random
import time
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from terseflow.llm import order_minhash as om


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=24), st.integers(0, 8))
def test_banded_distance_is_exact_within_the_band(a, b, limit):
    true = distance(a, b)
    assert om.banded_distance(a, b, limit) == (true if true <= limit else limit + 1)


def groups(pairs):
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        if x != y:
            root[y] = x
    return {x: find(x) for p in pairs for x in p if find(x) != x}


def test_groups_equal_brute_force(make, vocabulary):
    rng = random.Random(1)
    texts = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 120))] for _ in range(40)]
    rows = []
    for t in texts:
        rows.append(t)
        for _ in range(rng.randint(0, 3)):
            copy = list(t)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    docs = [(i, " ".join(t)) for i, t in enumerate(rows)]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if distance(rows[i], rows[j]) <= om.allowed(max(len(rows[i]), len(rows[j])), om.THRESHOLD)]
    found = {r.doc_id: r.duplicate_of for r in om.duplicates(make(docs)).collect()}
    assert found == groups(near)


def test_sketches_follow_order():
    words = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.array([0, len(words)])
    same = om.sketch(words, first)
    turned = om.sketch(words[::-1].copy(), first)
    assert (om.sketch(words.copy(), first) == same).all()
    assert (turned == same).sum() == 0


def test_edge_cases(make):
    long_text = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "..."), (4, "Same Text here"), (5, "same text, here!"), (None, "same text here"), (4, "Same Text here"), (6, long_text), (7, long_text + " tail"), (8, "one"), (9, "one")]
    found = {(r.doc_id, r.duplicate_of) for r in om.duplicates(make(rows)).collect()}
    assert found == {(5, 4), (7, 6), (9, 8)}
    kept = om.drop_near_duplicates(make(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 8]
    assert om.duplicates(make([])).count() == 0


def test_clashing_columns(spark):
    rows = [(1, "a b c", 1, "x"), (2, "a b c", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, keys string")
    assert [r.asDict() for r in om.drop_near_duplicates(docs).collect()] == [{"doc_id": 1, "text": "a b c", "id": 1, "keys": "x"}]


def edited(rng, words, edits, vocabulary):
    copy = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(copy)), rng.choice("sid")
        copy[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice(vocabulary)]
    return copy


def test_short_texts_equal_brute_force(make, vocabulary):
    rng = random.Random(5)
    rows = []
    for n in range(1, 15):
        for _ in range(12):
            rows.append([rng.choice(vocabulary) for _ in range(n)])
            rows.append(edited(rng, rows[-1], om.allowed(n, om.THRESHOLD), vocabulary))
        if 5 <= n <= 9:
            rows.append([*rows[-2][: n // 2], "middle", *rows[-2][n // 2 + 1 :]])
    near = [(i, j) for i in range(len(rows)) for j in range(i) if distance(rows[i], rows[j]) <= om.allowed(max(len(rows[i]), len(rows[j])), om.THRESHOLD)]
    found = {r.doc_id: r.duplicate_of for r in om.duplicates(make([(i, " ".join(t)) for i, t in enumerate(rows)])).collect()}
    assert found == groups(near)


def test_candidates_at_the_threshold():
    rng = np.random.default_rng(6)
    for n, edits in ((5, 1), (7, 1), (10, 2), (14, 2), (15, 3), (20, 3), (20, 4), (50, 10), (100, 15), (100, 20), (250, 50)):
        x = rng.integers(1, 1 << 63, (150, n)).astype(np.uint64)
        y = x.copy()
        for i in range(len(x)):
            y[i, rng.choice(n, edits, replace=False)] = rng.integers(1, 1 << 63, edits)
        first = np.arange(len(x) + 1) * n
        with np.errstate(over="ignore"):
            (a, bounds), (b, _) = om.keys_of(x.ravel(), first, om.THRESHOLD), om.keys_of(y.ravel(), first, om.THRESHOLD)
        hit = [len(np.intersect1d(a[p:q], b[p:q])) > 0 for p, q in zip(bounds[:-1], bounds[1:])]
        assert np.mean(hit) >= (1 if n <= om.SHORT else 0.96), (n, edits, np.mean(hit))


def test_band_moves_over_long_sequences():
    rng = random.Random(9)
    a = bytes(rng.randrange(256) for _ in range(300_000))
    b = b"x" + a[:-1] + b"yz"  # differences at both ends, so nothing can be set aside
    began = time.perf_counter()
    assert om.banded_distance(a, b, 4) == om.banded_distance(a, b, 2) == 3
    assert time.perf_counter() - began < 10


def test_wide_bands_stay_small():
    rng = random.Random(10)
    a = [rng.randrange(200 if i % 2 else 1 << 40) for i in range(12_000)]
    b = [7, *a[:6000], 8, *a[6001:-1], 9]
    tracemalloc.start()
    assert om.banded_distance(a, b, 5000) == om.banded_distance(a, b, 100) == 3
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_hot_buckets_equal_brute_force(make, vocabulary):
    """Documents that share a head, of which some are near to each other but not to the first; few members count as many here."""
    rng = random.Random(11)
    head = [rng.choice(vocabulary) for _ in range(70)]
    tails = [[rng.choice(vocabulary) + str(rng.randrange(9)) for _ in range(30)] for _ in range(60)]
    rows = [head + t for t in tails]
    rows += [head + edited(rng, t, 8, vocabulary) for t in tails[:20]]
    rows += [head + t[::-1] for t in tails[20:24]]  # the same words, another order
    near = [(i, j) for i in range(len(rows)) for j in range(i) if distance(rows[i], rows[j]) <= om.allowed(max(len(rows[i]), len(rows[j])), om.THRESHOLD)]
    assert len(groups(near)) >= 20
    found = {r.doc_id: r.duplicate_of for r in om.duplicates(make([(i, " ".join(t)) for i, t in enumerate(rows)]), small=8).collect()}
    assert found == groups(near)


def test_a_shared_head_makes_no_pairs(make):
    rng = random.Random(12)
    head = " ".join(f"h{i}" for i in range(140))
    rows = [(i, head + " " + " ".join(f"t{rng.randrange(100_000)}" for _ in range(60))) for i in range(1500)]
    rows.append((1500, rows[77][1] + " more"))
    assert [(r.doc_id, r.duplicate_of) for r in om.duplicates(make(rows)).collect()] == [(1500, 77)]


def test_names_with_dots_and_case(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2), (2, "a b c", 3, 4)], "doc_id long, text string, `a.b` long, u long")
    assert [tuple(r) for r in om.drop_near_duplicates(docs).collect()] == [(1, "a b c", 1, 2)]


def repetitive(rng, vocabulary):
    """Documents of a few words, each many times over, so that many share keys and few are near."""
    rows = []
    for i in range(70):
        own = [rng.choice(vocabulary) for _ in range(4)]
        rows.append(["the"] * rng.randint(30, 90) + [w for w in own for _ in range(rng.randint(8, 20))])
        if i % 7 == 0:
            rows.append(edited(rng, rows[-1], 6, vocabulary))
    return rows


def test_large_buckets_take_one_round(make, vocabulary, monkeypatch):
    """However the members of large buckets overlap, and over however many blocks they spread."""
    rows = repetitive(random.Random(13), vocabulary)
    near = [(i, j) for i in range(len(rows)) for j in range(i) if distance(rows[i], rows[j]) <= om.allowed(max(len(rows[i]), len(rows[j])), om.THRESHOLD)]
    labels, written = [], om.materialize
    monkeypatch.setattr(om, "materialize", lambda df, label: labels.append(label) or written(df, label))
    monkeypatch.setattr(om, "BLOCK_MEMBERS", 9, raising=False)
    docs = make([(i, " ".join(t)) for i, t in enumerate(rows)])
    found = {r.doc_id: r.duplicate_of for r in om.duplicates(docs, small=8).collect()}
    assert found == groups(near) and len(found) >= 10
    assert labels.count("buckets") == 1


def test_blocks_equal_brute_force(vocabulary):
    rng = random.Random(14)
    texts = repetitive(rng, vocabulary)
    number = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t), 1)}
    rows = [om.mix(np.array([number[w] for w in t], np.uint64)) for t in texts]
    ids, sides = np.arange(len(rows)) + 5, np.array([rng.randrange(2) for _ in rows])
    near = [(i + 5, j + 5) for i in range(len(rows)) for j in range(i) if om.near(rows[i], rows[j], om.THRESHOLD)]
    assert groups(om.near_in_block(ids, ids, np.zeros_like(sides), rows, om.THRESHOLD)) == groups(near)
    across = [(a, b) for a, b in near if sides[a - 5] != sides[b - 5]]
    assert across and groups(om.near_in_block(ids, ids, sides, rows, om.THRESHOLD)) == groups(across)
    assert om.near_in_block(ids, np.zeros_like(ids), sides, rows, om.THRESHOLD) == []
