from terseflow.llm import mixing


def levels(sizes, weights, target, cap):
    """Brute force: clamp one source after another."""
    open_ = {s for s in sizes if sizes[s] and weights[s]}
    full = {}
    while open_:
        rest = target - sum(sizes[s] * cap for s in full)
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if rest * weights[s] / total >= sizes[s] * cap}
        if not over:
            return {s: (cap if s in full else rest * weights[s] / total / sizes[s] if s in open_ else 0.0) for s in sizes}
        full |= dict.fromkeys(over)
        open_ -= over
    return {s: float(cap) if s in full else 0.0 for s in sizes}


def docs(make, sizes):
    return make([(i, "x" * n, "en", s, n) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)])


def test_water_filling_equals_brute_force(make):
    sizes = {"a": [10] * 40, "b": [5, 5], "c": [20], None: [7, 1], "d": [0, 0]}
    totals = {s: sum(v) for s, v in sizes.items()}
    for weights, target in ((None, None), ({"a": 1, "b": 5, "c": 2, None: 1, "zz": 9}, 300), ({"b": 1}, 10**6), ({"a": 3, "c": 1}, 50)):
        found = {r.source: r.epochs for r in mixing.source_epochs(docs(make, sizes), weights, target).collect()}
        given = {s: (1 if weights is None else weights.get(s, 0)) for s in sizes}
        true = levels(totals, given, sum(totals.values()) if target is None else target, mixing.MAX_EPOCHS)
        assert found.keys() == true.keys() and all(abs(found[s] - true[s]) < 1e-9 for s in true)


def test_repetitions_are_whole_and_fractional(make):
    table = docs(make, {"a": [10] * 2000, "b": [10] * 100})
    rows = mixing.mix_sources(table).collect()
    epochs = {r.source: r.epochs for r in mixing.source_epochs(table).collect()}
    for s, n in (("a", 2000), ("b", 100)):
        mine = [r for r in rows if r.source == s]
        assert abs(len(mine) / n - epochs[s]) < 0.05
        per_doc = {}
        for r in mine:
            per_doc.setdefault(r.doc_id, []).append(r.copy_no)
        assert all(sorted(c) == list(range(len(c))) and len(c) in (int(epochs[s]), int(epochs[s]) + 1) for c in per_doc.values())
    assert sorted(rows) == sorted(mixing.mix_sources(table).collect())


def test_edge_cases(make):
    assert mixing.mix_sources(make([])).count() == 0
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "text", "en", "b", 4), (3, "text", None, "b", None), (3, "text", None, "b", None)]
    found = mixing.mix_sources(make(rows), numbered=False)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.source for r in found.collect()} == {"b"} and found.count() == 3
    clash = make([(1, "x", "en", "a", 1)]).withColumnRenamed("lang", "copy_no")
    assert mixing.mix_sources(clash, numbered=False).columns == clash.columns


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "text", "a", 5, 6, 7)], "doc_id long, text string, source string, copy_no int, `a.b` int, weight int")
    found = mixing.mix_sources(docs)
    assert found.columns == ["doc_id", "text", "source", "a.b", "weight", "copy_no"]
    assert [tuple(r) for r in found.collect()] == [(1, "text", "a", 6, 7, 0)]
    assert mixing.mix_sources(docs, numbered=False).columns == docs.columns
