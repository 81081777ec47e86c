import random
import re
from collections import Counter

import numpy as np

from terseflow.llm import substring_repeats as sr


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def covered(rows, least=50):
    """Brute force: the places of every word inside a run of `least` words that is found at two places."""
    seen = Counter()
    texts = [(d, words(t)) for d, t in rows]
    for _, w in texts:
        for i in range(len(w) - least + 1):
            seen[tuple(w[i : i + least])] += 1
    out = set()
    for d, w in texts:
        for i in range(len(w) - least + 1):
            if seen[tuple(w[i : i + least])] > 1:
                out |= {(d, j) for j in range(i, i + least)}
    return out


def test_equals_brute_force(make, vocabulary):
    rng = random.Random(4)
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (50, 51, 75, 120, 400, 49)]
    rows = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((i, ", ".join(w).capitalize()))
    rows.append((100, rows[3][1]))
    rows.append((101, " ".join(["loop", "of", "words"] * 60)))
    found = sr.repeats(make(rows)).collect()
    texts = {d: words(t) for d, t in rows}
    for r in found:
        assert texts[r.doc_id][r.start : r.end] == texts[r.other_id][r.other_start : r.other_start + r.end - r.start] and r.end - r.start >= 50
        assert (r.doc_id, r.start) != (r.other_id, r.other_start)
    own, true = {(r.doc_id, j) for r in found for j in range(r.start, r.end)}, covered(rows)
    assert own <= true and {d for d, _ in own} == {d for d, _ in true}
    assert len(true - own) <= 0.005 * len(true)  # ends that only a third document shares
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.end))
    assert all(not (a <= c and d <= b) for spans in by_doc.values() for a, b in spans for c, d in spans if (a, b) != (c, d))


def test_edge_cases(make):
    p = " ".join(f"w{i}" for i in range(60))
    long_text = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, p), (3, p), (None, p), (4, long_text), (5, long_text), (6, "short text")]
    found = sorted((r.doc_id, r.start, r.end, r.other_id) for r in sr.repeats(make(rows)).collect())
    assert found == [(4, 0, 30_000, 5), (5, 0, 30_000, 4)]
    assert sr.repeats(make([])).count() == 0


def test_nested_phrases_equal_brute_force(make, vocabulary):
    rng = random.Random(9)

    def random_words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    rows = []
    for s, p in [(49, 50), (49, 55), (45, 50), (45, 55), (49, 60), (40, 50), (26, 50)] * 12:
        phrase, tail = random_words(s), random_words(p - s)
        for more in ([], tail, tail):
            rows.append((len(rows), " ".join(random_words(rng.randint(0, 40)) + phrase + more + random_words(rng.randint(0, 40)))))
    # a long passage of which each earlier document has another part
    long = random_words(200)
    for a in (0, 37, 81, 110, 149):
        rows.append((len(rows), " ".join(random_words(5) + long[a : a + 51] + random_words(5))))
    rows += [(len(rows), " ".join(long)), (len(rows) + 1, " ".join(random_words(3) + long))]
    found = sr.repeats(make(rows)).collect()
    assert {(r.doc_id, j) for r in found for j in range(r.start, r.end)} == covered(rows)


def test_every_window_has_an_anchor():
    rng = np.random.default_rng(2)
    hashes, first = rng.integers(0, 3, 900).astype(np.uint64), np.array([0, 0, 49, 99, 700, 900])
    with np.errstate(over="ignore"):
        places, _, starts, owner = sr.anchors(hashes * np.uint64(0x9E3779B97F4A7C15), first)
    assert starts.tolist() == [*range(49, 50), *range(99, 651), *range(700, 851)]
    gap = places[owner] - starts
    assert ((gap >= 0) & (gap <= 24)).all() and (np.diff(owner) >= 0).all()


def test_a_passage_in_many_documents(make, vocabulary):
    """A passage of 60 words in thousands of documents, each with other words round it; a reader holds many of them at once."""
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(20)] + passage + [f"b{i}x{k}" for k in range(20)])) for i in range(5000)]
    found = sr.repeats(make(rows)).collect()
    assert {(r.doc_id, r.start, r.end) for r in found} == {(i, 20, 80) for i in range(5000)} and len(found) == 5000


def test_readers_of_any_size_cover_the_same_words(make, vocabulary):
    rng = random.Random(5)
    base = [rng.choice(vocabulary) for _ in range(300)]
    rows = []
    for i in range(40):
        a, b = sorted(rng.sample(range(301), 2))
        rows.append((i, " ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 30))] + base[a:b] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))])))
    for parts in (1, 7):
        found = sr.repeats(make(rows).repartition(parts)).collect()
        assert {(r.doc_id, j) for r in found for j in range(r.start, r.end)} == covered(rows)


def test_clashing_columns(spark):
    p = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, p, 5, 6), (2, p, 7, 8)], "doc_id long, text string, u int, `a.b` int")
    assert sorted((r.doc_id, r.start, r.end, r.other_id) for r in sr.repeats(docs).collect()) == [(1, 0, 60, 2), (2, 0, 60, 1)]
