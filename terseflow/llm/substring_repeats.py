"""Substring dedup by seed and extend.

Words are lower-cased runs of letters and digits. Anchors are winnowed K-grams of words: of every W neighbouring ones the
lowest hash, so that each passage of K + W - 1 = MIN_WORDS words holds an anchor at the same place in all its copies.
Each anchor carries the hashes of the MIN_WORDS windows whose lowest k-gram it is; every window has one such anchor.
Occurrences of an anchor meet in one shuffle. Each of its windows is paired with the first occurrence of that window, and
the anchor with the first whose next anchor is also equal and with the first whose previous anchor is; a pair names a
diagonal of two documents. The words of the partner along the diagonal are fetched, and equal runs are extended both ways to their
ends; runs of at least MIN_WORDS words are repeats. Runs inside another run of the same document are not maximal and go.

Work grows with the number of words, not with its square: pairs are to first occurrences, so a passage in a million
documents makes about a million pairs. Every word inside a passage of MIN_WORDS words found elsewhere is in a reported
run; where no partner shares the whole of a longest run, it is reported as overlapping runs with several partners. A first
occurrence is the first of what one task read at once, then the first of those: which partner is named, and where such
runs overlap, may differ with the layout of the table, the covered words do not. Anchors at the edges of a passage, with
other words beside them each time, are the ones that still meet whole in one task, about 150 bytes each.

Defined cases: null and empty texts and texts of fewer than MIN_WORDS words have no repeats; a null doc_id is left out;
rows that share a doc_id are one document, in which an equal place is not a repeat of itself, and its first row in the
order of text gives the words; repeats inside one document count. Of equal runs the lowest other document and place is
named. Texts are read whole. Columns besides doc_id and text are not looked at, whatever their names. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terseflow.llm.common import BLOCK_SCHEMA, NOT_ALNUM, U64, materialize, mix, named, pack, part_of, shuffle_parts, small_batches, text_chunks, unpack, words

MIN_WORDS = 50
K = 26
#: Partners that a document is sent along with.
PARTNERS = 1024
LAST = U64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, U64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, U64(b), U64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each place on; the last k - 1 places have none."""
    n = len(hashes)
    if n < k:
        return np.empty(0, U64)
    up, down = _powers(n)
    total = np.zeros(n + 1, U64)
    np.cumsum(hashes * up[:n], out=total[1:])
    return np.minimum(mix((total[k:] - total[:-k]) * down[: n - k + 1]), LAST - U64(1))


def slide(x: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick over each w neighbours."""
    size = 1
    while size * 2 <= w:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(hashes: np.ndarray, first: np.ndarray, k: int = K, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes) of the winnowed k-grams of all rows, (starts, anchors) of their windows: of equal lowest k-grams the first has the window."""
    w = least - k + 1
    grams = gram_hashes(hashes, k)
    if len(grams) < w:
        return np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    low = slide(grams, w, np.minimum)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = row[: len(low)] == row[least - 1 : least - 1 + len(low)]
    low = np.where(inside, low, U64(0))
    edge = np.zeros(w - 1, U64)
    chosen = slide(np.concatenate([edge, low, edge]), w, np.maximum) == grams
    places = np.flatnonzero(chosen)
    starts = np.flatnonzero(inside)
    owner = np.searchsorted(places, starts)
    left = np.arange(len(starts))
    while len(left := left[grams[places[owner[left]]] != low[starts[left]]]):
        owner[left] += 1
    return places, grams[places], starts, owner


#: Of an anchor: hash, next, previous, document, place, words of the document, words from its first window to it, its windows.
_DTYPES = ["u8", "u8", "u8", "i8", "i4", "i4", "u1", "u1"]
_WIDTH = sum(np.dtype(d).itemsize for d in _DTYPES)


def pack_anchors(columns: list[np.ndarray], windows: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors, each followed by its anchors' windows in their order."""
    part = part_of(columns[0], parts)
    for own in pack(part, columns, parts):
        there = {}
        for more in pack(np.repeat(part, columns[-1]), [windows], parts):
            there = dict(zip(more.column(0).to_pylist(), more.column(1)))
        blocks = [b.as_py() + (there[p].as_py()[8:] if p in there else b"") for p, b in zip(own.column(0).to_pylist(), own.column(1))]
        yield pa.RecordBatch.from_arrays([own.column(0), pa.array(blocks, pa.binary())], names=["part", "block"])


def unpack_anchors(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns, windows) of all blocks of a task."""
    kept = list(batches)
    windows = []
    for batch in kept:
        for block in batch.column(batch.schema.get_field_index("block")):
            raw = block.as_buffer()
            windows.append(np.frombuffer(raw, U64, offset=8 + _WIDTH * int(np.frombuffer(raw, np.uint64, 1)[0])))
    return unpack(iter(kept), _DTYPES), np.concatenate(windows) if windows else np.empty(0, U64)


def anchor_blocks(docs: DataFrame, parts: int, k: int, least: int) -> DataFrame:
    """Blocks of anchors with their windows (part below `parts`), and of the pairs of repeats within what a task read at once (part from there on).

    Of repeats within that, only the first goes on: groups of copies and the inside of common passages are one anchor a task.
    """
    assert least - k < 256, "counts of windows are bytes"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[] for _ in [*_DTYPES, "windows"]]
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if kept[0]:
                columns = [np.concatenate(c) for c in kept]
                for c in kept:
                    c.clear()
                rows, wanted = pair_up(columns[:-1], columns[-1])
                windows = columns[-1][np.repeat(wanted, columns[-2])]
                yield from pack_anchors([c[wanted] for c in columns[:-1]], windows, parts)
                for batch in pack(part_of(mix(rows[0].view(U64)), parts), list(rows), parts):
                    yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy() + parts, pa.int32()), batch.column(1)], names=["part", "block"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, raw, offsets in text_chunks(batch.column(1)):
                hashes, first = words(raw, offsets, NOT_ALNUM)
                places, grams, starts, owner = anchors(hashes, first, k, least)
                if not len(places):
                    continue
                row = np.searchsorted(first, places, "right") - 1
                after, before = np.zeros(len(places), U64), np.zeros(len(places), U64)
                same = row[1:] == row[:-1]
                after[:-1][same] = grams[1:][same]
                before[1:][same] = grams[:-1][same]
                count, lead = np.bincount(owner, minlength=len(places)), np.zeros(len(places), np.int64)
                lead[owner[::-1]] = (places[owner] - starts)[::-1]  # the first window's stays
                values = (grams, after, before, ids[a + row], (places - first[row]).astype(np.int32), np.diff(first)[row].astype(np.int32), lead.astype(np.uint8), count.astype(np.uint8), gram_hashes(hashes, least)[starts])
                for c, v in zip(kept, values):
                    c.append(v)
                held += len(places)
                if held > 1 << 19:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def _first_of(group: np.ndarray) -> np.ndarray:
    """For runs of equal numbers: the index of the first of each element's run."""
    lead = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.repeat(lead, np.diff(np.append(lead, len(group))))


def pair_up(columns: list[np.ndarray], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs (u, v, shift, n), which anchors are still wanted) of anchors with their windows.

    An anchor without any window, or neighbourhood, that it is the first to have is not wanted: who meets it meets the first.
    """
    h, after, before, doc, place, n, lead, count = columns
    wanted = np.ones(len(h), bool)
    begin = np.cumsum(count, dtype=np.int64) - count
    order = np.argsort(h, kind="stable")
    hs = h[order]
    many = np.zeros(len(hs), bool)
    if len(hs) > 1:
        equal = hs[1:] == hs[:-1]
        many[1:] |= equal
        many[:-1] |= equal
    order = order[many]
    h, after, before, doc, place, n, lead, count, begin = (x[order] for x in (h, after, before, doc, place, n, lead, count, begin))
    found, first = [np.empty((4, 0), np.int64)], np.zeros(len(h), bool)
    if len(h):
        own = np.repeat(np.arange(len(h)), count)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(count, dtype=np.int64) - count, count)
        windows = windows[np.repeat(begin, count) + nth]
        spots = place.astype(np.int64)[own] - lead[own] + nth
        for extra in (None, after, before):
            if extra is None:
                by = np.lexsort((spots, doc[own], windows))
                lead_of = _first_of(windows[by])
                u, v, at = own[by], own[by[lead_of]], spots[by]
                shift = at[lead_of] - at
                other = (doc[u] != doc[v]) | (shift != 0)
                first[u[lead_of == np.arange(len(by))]] = True
            else:
                by = np.lexsort((place, doc, extra, h))
                lead_of = _first_of(mix(h[by] + mix(extra[by])))
                u, v = by, by[lead_of]
                shift = place[v].astype(np.int64) - place[u]
                other = ((doc[u] != doc[v]) | (shift != 0)) & (extra[u] != 0)
                first[u[(lead_of == np.arange(len(by))) & (extra[u] != 0)]] = True
            # a first occurrence needs no partner of its own: the runs of a pair count for both sides
            u, v, shift = u[other], v[other], shift[other]
            found.append(np.stack([doc[u], doc[v], shift, n[u].astype(np.int64)]))
    wanted[order] = first
    rows = np.concatenate(found, axis=1)
    if rows.shape[1]:
        rows = rows[:, np.lexsort(rows[::-1])]
        rows = rows[:, np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])]
    return rows, wanted


def seeds(blocks: DataFrame, parts: int) -> DataFrame:
    """(u, v, n, shifts): document u has seeds with v, each `shift` words further on in v; n words in u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            known = batch.column(0).to_numpy() >= parts  # pairs of one map task
            yield from pair_rows(np.stack(unpack(iter([batch.filter(pa.array(known))]), ["i8"] * 4)))
            kept.append(batch.filter(pa.array(~known)))
        yield from pair_rows(pair_up(*unpack_anchors(iter(kept)))[0])

    def pair_rows(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, rows.shape[1], 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[a : a + (1 << 16)])) for x in rows], names=["u", "v", "shift", "n"])

    sent = blocks.withColumn("to", F.pmod("part", F.lit(parts))).repartitionById(parts, F.col("to")).drop("to")
    return sent.mapInArrow(run, "u long, v long, shift long, n long").groupBy("u", "v").agg(F.max("n").alias("n"), F.collect_set("shift").alias("shifts"))


def equal_runs(x: np.ndarray, y: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The maximal runs of at least `least` equal elements of two arrays side by side."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], x == y, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]


def repeats(docs: DataFrame, least: int = MIN_WORDS, k: int = K) -> DataFrame:
    """(doc_id, start, end, other_id, other_start): the maximal repeats of each document in words, with one other place that has it."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    small_batches(spark)
    texts = named(docs, "doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.lower("text").alias("text"))
    found = materialize(seeds(anchor_blocks(texts, parts, k, least), parts), "seeds")
    # one strategy at every size: the texts are never broadcast; both joins use one exchange of them
    span = F.struct("u", "shifts", F.array_min("shifts").alias("least"), (F.array_max("shifts") + F.col("n")).alias("most"))
    # a document that many ask for is sent once for each PARTNERS of them
    chunks = found.where("u <> v").groupBy("v").agg(F.ceil(F.count("*") / PARTNERS).alias("chunks"))
    asked = found.where("u <> v").join(chunks, "v").groupBy("v", F.pmod(F.xxhash64("u"), F.col("chunks")).alias("chunk")).agg(F.collect_list(span).alias("asked")).drop("chunk")
    mine = texts.hint("merge").join(asked, texts["id"] == asked["v"]).select("v", "text", "asked")

    def word_hashes(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return words(raw, np.array([0, len(raw)]), NOT_ALNUM)[0].astype(np.uint32)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["u", "v", "shifts", "at", "cut"])
            rows.clear()
            return made

        for batch in batches:
            for v, text, requests in zip(*(batch.column(i) for i in range(3))):
                v, h = v.as_py(), word_hashes(text.as_py())
                for r in requests:
                    u, shifts, low, high = (r[k].as_py() for k in ("u", "shifts", "least", "most"))
                    at = max(low, 0)
                    rows.append((u, v, shifts, at, h[at : max(at, high)].tobytes()))
                    held += len(rows[-1][4]) + 200
                    if held > 4 << 20:
                        yield flush()
                        held = 0
        if rows:
            yield flush()

    fetched = mine.mapInArrow(slices, "u long, v long, shifts array<long>, at long, cut binary")
    own = found.where("u = v").select("u", "v", "shifts", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("cut"))
    fetched = fetched.unionByName(own)
    both = texts.hint("merge").join(fetched, texts["id"] == fetched["u"]).select("u", "text", "v", "shifts", "at", "cut")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, np.empty(0, np.uint32)
        for batch in batches:
            rows = []
            for u, text, v, shifts, at, cut in zip(*(batch.column(i) for i in range(6))):
                u, v, at, text, cut = u.as_py(), v.as_py(), at.as_py(), text.as_py(), cut.as_py()
                if (u, text) != last:
                    last, h = (u, text), word_hashes(text)
                y = h if cut is None else np.frombuffer(cut, np.uint32)
                for shift in shifts.as_py():
                    begin = max(0, at - shift)
                    n = min(len(h) - begin, at + len(y) - begin - shift)
                    if n < least:
                        continue
                    for a, b in equal_runs(h[begin : begin + n], y[begin + shift - at : begin + shift - at + n], least):
                        a, b = a + begin, b + begin
                        rows.append((u, a, b, v, a + shift))
                        rows.append((v, a + shift, b + shift, u, a))
            columns = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["doc_id", "start", "end", "other_id", "other_start"])

    runs = both.mapInArrow(extend, "doc_id long, start long, end long, other_id long, other_start long")
    best = runs.groupBy("doc_id", "start").agg(F.max(F.struct("end", (-F.col("other_id")).alias("o"), (-F.col("other_start")).alias("p"))).alias("b"))
    best = best.select("doc_id", "start", F.col("b.end").alias("end"), (-F.col("b.o")).alias("other_id"), (-F.col("b.p")).alias("other_start"))
    reach = F.max("end").over(Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("__tf_reach", reach).where(F.col("__tf_reach").isNull() | (F.col("end") > F.col("__tf_reach"))).drop("__tf_reach")
