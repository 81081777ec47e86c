import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terseflow.llm import line_edit_join as lj
from tests.llm.test_order_minhash import distance


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=40))
def test_within(x, y):
    assert lj.within(x, y, 2) == (distance(x, y) <= min(2, min(len(x), len(y)) // lj.EDIT_BYTES))


def near(x, y):
    most = min(2, min(len(x), len(y)) // lj.EDIT_BYTES)
    return abs(len(x) - len(y)) <= most and distance(x, y) <= most


def brute(rows):
    seen, out = [], {}
    places = sorted(((d, i, line.encode()) for d, t in rows if t is not None for i, line in enumerate(t.split("\n"))))
    for d, i, line in places:
        if not line.strip(b" \t\r\f\v"):
            continue
        gone = any(line == x or near(line, x) for x in seen)
        seen.append(line)
        if gone:
            out.setdefault(d, set()).add(i)
    return out


@pytest.mark.parametrize("crowd", [lj.CROWD, 2])
def test_equals_brute_force(make, monkeypatch, crowd):
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(3, 60))) for _ in range(25)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(line) + 1)
                line[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
            lines.append("".join(line))
        rows.append((d, "\n".join(lines)))
    gone = brute(rows)
    found = {r.doc_id: r for r in lj.dedup_lines(make(rows), crowd=crowd).collect()}
    for d, text in rows:
        kept = [x for i, x in enumerate(text.split("\n")) if i not in gone.get(d, set())]
        assert found[d].text == "\n".join(kept) and found[d].n_removed == len(gone.get(d, ()))


def test_edge_cases(make):
    line = "a line that is long enough to be compared"
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, line), (4, line), (5, line + "!"), (None, "first of all lines, in front of one"), (6, "first of all lines, in front of one\nx\nx"), (7, "y" * 50_000 + "\n" + "y" * 50_000)]
    found = {(r.doc_id, r.text, r.n_removed) for r in lj.dedup_lines(make(rows)).collect()}
    assert found == {(1, None, 0), (2, "", 0), (3, "\n \n", 0), (4, line, 0), (5, "", 1), (None, rows[6][1], 0), (6, "x", 2), (7, "y" * 50_000, 1)}
    left = lj.dedup_lines(make(rows), drop_emptied=True)
    assert {r.doc_id for r in left.collect()} == {1, 2, 3, 4, None, 6, 7}
    assert lj.dedup_lines(make([])).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "same\nsame", 5, "p")], "doc_id long, text string, id int, place string")
    assert lj.dedup_lines(docs).collect()[0].asDict() == {"doc_id": 1, "text": "same", "id": 5, "place": "p", "n_removed": 1}
    clash = spark.createDataFrame([(1, "same\nsame", 5, 7, 8)], "doc_id long, text string, `a.b` int, N_removed int, kept int")
    assert lj.dedup_lines(clash).collect()[0].asDict() == {"doc_id": 1, "text": "same", "a.b": 5, "kept": 8, "n_removed": 1}


def test_templated_lines_equal_brute_force(make):
    """All lines share their head and tail; with such small crowds all of them are split more than once."""
    rng = random.Random(3)
    lines = [f"Posted on 20{rng.randrange(100):02d}-0{rng.randrange(10)}-11 by user {rng.randrange(10**6)} in the forum" for _ in range(150)]
    lines += [x.replace("user", "uzer") for x in lines[:20]] + ["0" * rng.randint(30, 34) + "x" * rng.randint(0, 3) for _ in range(20)]
    rows = [(i, x) for i, x in enumerate(lines)]
    gone = brute(rows)
    assert len(gone) > 30
    assert {r.doc_id for r in lj.dedup_lines(make(rows), crowd=3).where("n_removed > 0").collect()} == set(gone)


def test_hot_segment_and_hot_line(make):
    rng = random.Random(4)
    rows = [(i, f"The template of all these lines is long enough to fill segments, and its number is {rng.randrange(10**18):018d}\nEverywhere the same line") for i in range(20_000)]
    rows.append((20_000, rows[5][1].replace("template", "temp1ate")))
    began = time.perf_counter()
    found = {r.doc_id: r.n_removed for r in lj.dedup_lines(make(rows)).select("doc_id", "n_removed").collect()}
    assert found == {0: 0, 20_000: 2} | {i: 1 for i in range(1, 20_000)}
    assert time.perf_counter() - began < 120


def test_very_long_lines_that_differ_at_both_ends(make):
    line = "".join(random.Random(5).choice("abcdefgh ") for _ in range(1_000_000))
    found = lj.dedup_lines(make([(1, line), (2, "x" + line[:-1]), (3, "xyz" + line)])).collect()
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, 2: 1, 3: 0}
