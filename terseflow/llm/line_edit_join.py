"""Line dedup by a segment-partition edit join (PassJoin, Li et al. 2011).

A line is removed when an equal line, or one within a few byte edits, comes earlier, by doc_id and then by place in the
document. Two lines may differ in one edit for each EDIT_BYTES bytes of the shorter one, and in EDITS at most; so the
same rule holds for lines of every length, and lines too short for an edit have only equal ones. Lines within t edits
share one of the t + 1 segments of the shorter one, not far from its place: every line is indexed under its segments and
probes the substrings that can match those of lines as long or up to t shorter. Index and probe keys meet in one shuffle
of (key, line hash) records; pairs of lines that share a key are verified by banded bit-parallel edit distance.

A key of more than CROWD lines is hot: its lines are never paired with each other, nor brought to one task. Where a map
task sees that many, they bypass the shuffle but for a mark. Hot lines are split again (see split_hot): what all lines of
the key begin and end with changes no distance and is cut off, and the rest is partitioned into segments anew, until the
groups are small. Copies of a line are folded where they are read, so a line that is everywhere is one record a map task;
what a document keeps are the first places of lines, never a list of its copies elsewhere.

Edits are counted over UTF-8 bytes. Defined cases: blank lines (white space only) are never removed; null texts have no
lines and stay null; an empty text has one blank line; a document that loses all its lines has an empty text; rows that
share a doc_id count as one document whose equal places are equal in rank, so that repeated rows keep or lose a line
together; a null doc_id ranks before all ids; of equal lines the first stays; an empty table stays empty. All columns
come back under their names, whatever these are, but one called n_removed, which gives way to the result's.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terseflow.llm.common import BLOCK_SCHEMA, GOLD, SPACE, U64, by_part, give_back, materialize, mix, named, neutral, pack, part_of, shuffle_parts, small_batches, text_chunks, tidy, unpack
from terseflow.llm.order_minhash import banded_distance

EDITS = 2
EDIT_BYTES = 16
#: Lines under one key that are paired with each other as they are.
CROWD = 32
#: Bytes of text whose records a task holds before it sends them; each becomes about ten bytes of records.
FLUSH_BYTES = 12 << 20
NULL_ID = np.iinfo(np.int64).min

_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TABLES: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _base_powers(n: int) -> list[np.ndarray]:
    if len(_TABLES[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _TABLES[k] = np.concatenate([np.ones(1, U64), np.cumprod(np.full(n + (n >> 1), base, U64))])
    return _TABLES


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """h with the polynomial of bytes a..b as (h[b] - h[a]) * base**-a."""
    h = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _base_powers(len(raw) + 1)[0][: len(raw)], out=h[1:])
    return h


def line_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in the row, first byte, byte after the last) of each line of each row."""
    breaks = np.flatnonzero(raw == 10)
    row_of_break = np.searchsorted(offsets, breaks, "right") - 1
    rows = np.concatenate([np.arange(len(offsets) - 1), row_of_break])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, rows))
    rows, starts = rows[order], starts[order]
    ends = np.append(starts[1:] - 1, 0)
    last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, bool)
    ends[last] = offsets[1:][rows[last]]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
    number = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return rows, number, starts, ends


def segments(length: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first byte, length) of each of the edits + 1 even segments; the longer ones come last."""
    parts = edits + 1
    base, extra = length // parts, length % parts
    for i in range(parts):
        yield i * base + np.maximum(0, i - (parts - extra)), base + (i >= parts - extra)


def allowed(n, edits: int):  # noqa: ANN001, ANN201
    """The edits that a line of n bytes may be away from a longer one."""
    return np.minimum(n // EDIT_BYTES, edits)


#: Low bits of a key: HOT, then 0 for an index key (which also probes) or 1 + how many bytes the prober is longer than what it looks for.
CODE_BITS, HOT = 4, U64(8)
BASE = ~U64(15)


def edit_keys(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, edits: int, full: np.ndarray | None = None, longer: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(which lines, keys with their code, first byte, byte after the last). For rests of lines: the lengths of the shorter whole lines, and how much longer each is than what it looks for."""
    inverse = _TABLES[1]
    n = ends - starts
    for t in range(1, edits + 1):
        parts = t + 1
        for delta in range(t + 1):
            length = n - delta  # of the lines that these keys can find
            fits = allowed(length if full is None else full, edits) == t
            which = np.flatnonzero(fits if longer is None else fits & (longer == delta))
            for i, (place, size) in enumerate(segments(length[which], t)):
                low = max(-i, delta - (parts - 1 - i))
                high = min(i, delta + (parts - 1 - i))
                for shift in range(low, high + 1):
                    a = starts[which] + place + shift
                    inside = (place + shift >= 0) & (place + shift + size <= n[which])
                    a, rows = a[inside], which[inside]
                    b = a + size[inside]
                    value = (h[b] - h[a]) * inverse[a]
                    tag = (length[rows].astype(U64) << U64(8)) | U64(i)
                    yield rows, mix(value + tag * GOLD) & BASE | U64(0 if delta == 0 and shift == 0 else 1 + delta), a, b


def sorted_keys(keys: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys without their code, lines, lowest code) of the distinct lines of each key, and marks, which have no line."""
    order = np.lexsort((keys & ~BASE, lines, keys & BASE))
    keys, lines = keys[order], lines[order]
    base = keys & BASE
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (base[1:] != base[:-1]) | (lines[1:] != lines[:-1])
    return base[fresh], lines[fresh], (keys & ~BASE)[fresh]


def group_sizes(base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], base[1:] != base[:-1]])) if len(base) else np.empty(0, np.int64)
    return begin, np.diff(np.append(begin, len(base)))


def line_records(docs: DataFrame, edits: int, parts: int, crowd: int) -> DataFrame:
    """Blocks of near keys (part below `parts`) and of whole lines (part from there on), from one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        near: list[list[np.ndarray]] = [[], []]
        whole: list[list[np.ndarray]] = [[], [], [], []]

        def flush() -> Iterator[pa.RecordBatch]:
            if near[0]:
                base, lines, code = sorted_keys(*(np.concatenate(c) for c in near))
                begin, size = group_sizes(base)
                crowded = np.repeat(size > crowd, size)
                marks = base[begin[size > crowd]]
                keys = np.concatenate([base | code | np.where(crowded, HOT, U64(0)), marks | HOT])
                target = np.concatenate([part_of(np.where(crowded, mix(lines), base), parts), part_of(marks, parts)])
                yield from pack(target, [keys, np.concatenate([lines, np.zeros(len(marks), U64)])], parts)
            if whole[0]:
                h1, h2, ids, number = (np.concatenate(c) for c in whole)
                order = np.lexsort((number, ids, h2, h1))
                lead = np.ones(len(h1), bool)
                lead[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
                columns = [c[order[lead]] for c in (h1, h2, ids, number)]
                for batch in pack(part_of(columns[0], parts), columns, parts):
                    shifted = pa.array(batch.column(0).to_numpy() + parts, pa.int32())
                    yield pa.RecordBatch.from_arrays([shifted, batch.column(1)], names=["part", "block"])
            for c in (*near, *whole):
                c.clear()
            give_back()

        held = 0
        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for first_row, _, raw, offsets in text_chunks(batch.column(1)):
                rows, number, starts, ends = line_bounds(raw, offsets)
                blanks = np.concatenate([[0], np.cumsum(~SPACE[raw])])
                used = blanks[ends] > blanks[starts]
                rows, number, starts, ends = rows[used], number[used], starts[used], ends[used]
                text = raw.tobytes()
                digest = xxhash.xxh3_128_digest
                both = np.frombuffer(b"".join([digest(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), U64).reshape(-1, 2)
                for c, v in zip(whole, (both[:, 0].copy(), both[:, 1].copy(), ids[first_row + rows], number.astype(np.int32))):
                    c.append(v)
                h = prefix_hashes(raw)
                # equal lines have equal keys: one of each in a chunk will do
                once = np.sort(np.unique(both[:, 0], return_index=True)[1])
                for lines, keys, _, _ in edit_keys(h, starts[once], ends[once], edits):
                    near[0].append(keys)
                    near[1].append(both[once[lines], 0])
                held += len(raw)
                if held >= FLUSH_BYTES:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null").mapInArrow(tidy(run), BLOCK_SCHEMA)


def near_pairs(base: np.ndarray, lines: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of lines of which one is indexed under a key of the other; sorted keys of small groups."""
    begin, size = group_sizes(base)
    left, right = [np.empty(0, U64)], [np.empty(0, U64)]
    for step in range(1, int(size.max(initial=1))):  # each with the one `step` places on
        a = np.flatnonzero(base[step:] == base[:-step])
        a = a[(code[a] == 0) | (code[a + step] == 0)]
        left.append(lines[a])
        right.append(lines[a + step])
    u, v = np.concatenate(left), np.concatenate(right)
    u, v = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    once = np.ones(len(u), bool)
    once[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[once], v[once]


_FOUND = "kind int, a long, b long, c long"
#: Two line hashes; line hash, id and place of the first such line; hot key, line hash and code.
PAIR, FIRST, CROWDED = 0, 1, 2


def gather(records: DataFrame, parts: int, crowd: int) -> DataFrame:
    """Rows of the kinds PAIR, FIRST and CROWDED."""

    def rows(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(columns[0]), 1 << 16):
            part = [c[a : a + (1 << 16)] for c in columns]
            filled = [pa.array(c.view(np.int64) if c.dtype == U64 else c.astype(np.int64)) for c in part]
            filled += [pa.nulls(len(part[0]), pa.int64())] * (3 - len(part))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *filled], names=["kind", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, whole = [], []
        for batch in batches:
            is_near = pa.array(batch.column(0).to_numpy() < parts)
            near.append(batch.filter(is_near))
            whole.append(batch.filter(pa.array(batch.column(0).to_numpy() >= parts)))
        keys, lines = unpack(iter(near), ["u8", "u8"])
        near.clear()
        away = (keys & HOT != 0) & (lines != 0)  # from a crowd elsewhere: only passing through
        yield from rows(CROWDED, keys[away] & BASE, lines[away], keys[away] & U64(7))
        keys, lines = keys[~away], lines[~away]
        base, lines, code = sorted_keys(keys, lines)
        del keys
        begin, size = group_sizes(base)
        marked = np.maximum.reduceat(code, begin) >= HOT if len(begin) else np.zeros(0, bool)
        crowded = np.repeat(marked | (size > crowd), size)
        out = crowded & (code < HOT)
        yield from rows(CROWDED, base[out], lines[out], code[out])
        yield from rows(PAIR, *near_pairs(base[~crowded], lines[~crowded], code[~crowded]))
        del base, lines, code
        give_back()
        h1, h2, ids, number = unpack(iter(whole), ["u8", "u8", "i8", "i4"])
        whole.clear()
        order = np.lexsort((number, ids, h2, h1))
        h1, h2, ids, number = h1[order], h2[order], ids[order], number[order]
        lead = np.ones(len(h1), bool)
        lead[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        yield from rows(FIRST, h1[lead], ids[lead], number[lead])

    return records.withColumn("to", F.pmod("part", F.lit(parts))).repartitionById(parts, F.col("to")).drop("to").mapInArrow(tidy(run), _FOUND)


def within(x: bytes, y: bytes, edits: int) -> bool:
    edits = int(min(allowed(min(len(x), len(y)), edits), edits))
    if abs(len(x) - len(y)) > edits:
        return False
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    return banded_distance(a[: len(a) - tail].tobytes(), b[: len(b) - tail].tobytes(), edits) <= edits


def verify(lines: DataFrame, edits: int) -> DataFrame:
    """h of the later line of each pair that is near; `lines` has h and the two lines as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within(x.as_py(), y.as_py(), edits) for x, y in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["h"]).filter(pa.array(keep, pa.bool_()))

    return lines.mapInArrow(tidy(run), "h long")


def lines_at(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line) of the wanted (h, id, place)."""
    per_doc = wanted.groupBy("id").agg(F.collect_list(F.struct("place", "h")).alias("at"))  # lines of one document
    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), "text").hint("merge")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            hashes, found = [], []
            for text, at in zip(batch.column(0), batch.column(1).to_pylist()):
                parts = text.as_py().encode().split(b"\n")
                for x in at:
                    # rows that share an id have other lines at this place
                    if x["place"] < len(parts) and line_hash(xxhash, parts[x["place"]]) == x["h"]:
                        hashes.append(x["h"])
                        found.append(parts[x["place"]])
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], names=["h", "line"])

    return texts.join(per_doc, "id").select("text", "at").mapInArrow(tidy(run), "h long, line binary")


def line_hash(xxhash, line: bytes) -> int:  # noqa: ANN001
    return int.from_bytes(xxhash.xxh3_128_digest(line)[:8], "little", signed=True)


# -- hot keys ------------------------------------------------------------------------------------------------------

_STATE = "key long, code int, h long, full int, id long, place long, line binary, rest binary, back binary"
_CARRIED = ["key", "code", "h", "full", "id", "place", "line"]
#: After so many splits the rests are a hundredth of their lines; groups that are still hot are compared pair by pair.
SPLITS = 12


def split_hot(state: DataFrame, edits: int, crowd: int) -> DataFrame:
    """h of the lines under hot keys that are near to an earlier one. `state` has key, code, h, line and the line's first id and place.

    A row is a line under a key with what is left of it, read both ways. Every line of a hot key is compared with the first
    one; lines found near to it need no other partner, and a key all of whose lines have one is done. Else what all rests of
    a key begin and end with, known from the least and greatest of them, is cut off, and segments of what remains make the
    next keys. Keys of few lines are compared pair by pair, as are rests with less than a byte for each segment. Rests tell
    where to look; it is the lines that are compared.
    """

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(5).to_pylist()
            full = [len(x) - max(0, c - 1) for x, c in zip(lines, batch.column(1).to_pylist())]
            columns = [*batch.columns[:3], pa.array(full, pa.int32()), *batch.columns[3:6], batch.column(5), pa.array([x[::-1] for x in lines], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*_CARRIED, "rest", "back"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(1).to_numpy()
            rests, lows, highs, low_backs, high_backs = (batch.column(i).to_pylist() for i in range(7, 12))
            shortest = batch.column(12).to_pylist()
            left = []
            for i, rest in enumerate(rests):
                head = len(os.path.commonprefix((lows[i], highs[i])))
                tail = min(len(os.path.commonprefix((low_backs[i], high_backs[i]))), shortest[i] - head)
                left.append(rest[head : len(rest) - tail])
            raw = np.frombuffer(b"".join(left), np.uint8)
            sizes = np.array([len(x) for x in left], np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            keys = batch.column(0).to_numpy().view(U64)
            longer = np.maximum(codes.astype(np.int64) - 1, 0)
            for rows, fresh, a, b in edit_keys(prefix_hashes(raw), starts, ends, edits, batch.column(3).to_numpy().astype(np.int64), longer):
                own = mix(fresh & BASE ^ keys[rows]) & BASE
                rest = [left[i][:f] + left[i][t:] for i, f, t in zip(rows.tolist(), (a - starts[rows]).tolist(), (b - starts[rows]).tolist())]
                kept = [batch.column(i).take(pa.array(rows)) for i in range(2, 7)]
                columns = [pa.array(own.view(np.int64)), pa.array((fresh & U64(7)).astype(np.int32)), *kept, pa.array(rest, pa.binary()), pa.array([x[::-1] for x in rest], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*_CARRIED, "rest", "back"])

    def pairs_of(x: DataFrame) -> DataFrame:
        """The later line of each pair of lines of a key of which one is indexed."""
        early = x.select("key", F.col("line").alias("y"), F.struct("id", "place").alias("before"), F.col("code").alias("code2"))
        return x.join(early, "key").where((F.struct("id", "place") > F.col("before")) & ((F.col("code") == 0) | (F.col("code2") == 0))).select("h", "line", "y")

    state = state.select("key", "code", "h", "id", "place", "line").mapInArrow(tidy(begin), _STATE)
    done = None
    for n in range(SPLITS + 1):
        state = materialize(state.dropDuplicates(["key", "h", "code", "rest"]), "hot-lines")
        order = F.struct("id", "place")
        sizes = state.groupBy("key").agg(
            F.count_distinct("h").alias("n"), F.min("rest").alias("low"), F.max("rest").alias("high"), F.min("back").alias("low_back"), F.max("back").alias("high_back"), F.min(F.length("rest")).alias("shortest"),
            F.min(F.when(F.col("code") == 0, F.length("rest"))).alias("least"), F.min("full").alias("whole"), F.min_by("h", order).alias("first"), F.min_by("line", order).alias("y"),
        )
        sizes = materialize(sizes.where("n > 1 and least is not null"), "hot-keys")
        t = F.least(F.floor(F.col("whole") / EDIT_BYTES), F.lit(edits))
        hot = sizes.where(F.col("n") > crowd)
        star = state.join(hot.select("key", "first", "y"), "key").where("h <> first").select("h", "line", "y")
        cold = pairs_of(state.join(sizes.where(F.col("n") <= crowd).select("key"), "key"))
        found = materialize(verify(star.unionByName(cold).distinct(), edits).distinct(), "removed")
        done = found if done is None else done.unionByName(found)
        if hot.isEmpty():
            break
        open_keys = state.join(done, "h", "left_anti").join(hot.select("key"), "key").select("key").distinct()
        hot = materialize(hot.join(open_keys, "key"), "open-keys")
        last = F.lit(n == SPLITS) | (F.col("least") <= t)
        stuck = pairs_of(state.join(hot.where(last).select("key"), "key")).join(done, "h", "left_anti")
        done = done.unionByName(materialize(verify(stuck.distinct(), edits).distinct(), "removed"))
        hot = hot.where(~last)
        if hot.isEmpty():
            break
        state = state.join(hot.drop("n", "least", "whole", "first", "y"), "key").select(*_CARRIED, "rest", "low", "high", "low_back", "high_back", "shortest").mapInArrow(tidy(cut), _STATE)
    return done.distinct()


# -- documents -----------------------------------------------------------------------------------------------------


def kept_lines(docs: DataFrame, edits: int = EDITS, crowd: int = CROWD) -> DataFrame:
    """(h, id, place) of every filled line that stays; a null doc_id is NULL_ID. Lines are told by 64 bits of their hash."""
    parts = 2 * shuffle_parts(docs.sparkSession)  # the keys are several times the size of the texts
    small_batches(docs.sparkSession)
    found = materialize(gather(line_records(docs, edits, parts, crowd), parts, crowd), "lines", "kind")
    first = found.where(F.col("kind") == FIRST).select(F.col("a").alias("h"), F.col("b").alias("id"), F.col("c").alias("place"))
    pairs = found.where(F.col("kind") == PAIR).select("a", "b")
    crowded = found.where(F.col("kind") == CROWDED).groupBy(F.col("a").alias("key"), F.col("b").alias("h")).agg(F.min("c").cast("int").alias("code"))
    crowded = materialize(crowded, "crowded")
    pairs = materialize(pairs.distinct(), "candidates")
    x = pairs.join(first.select(F.col("h").alias("a"), F.struct("id", "place").alias("x")), "a")
    both = materialize(x.join(first.select(F.col("h").alias("b"), F.struct("id", "place").alias("y")), "b"), "pairs")
    places = both.select(F.col("a").alias("h"), F.col("x").alias("s")).unionByName(both.select(F.col("b").alias("h"), F.col("y").alias("s")))
    crowd_places = materialize(crowded.select("h").distinct().join(first, "h"), "crowd-places")
    wanted = places.select("h", "s.id", "s.place").unionByName(crowd_places.select("h", "id", "place")).distinct()
    lines = materialize(lines_at(docs, wanted).dropDuplicates(["h"]), "texts")  # the one time that lines are fetched
    later = F.when(F.col("x") > F.col("y"), F.col("a")).otherwise(F.col("b"))
    sides = both.select("a", "b", later.alias("h")).join(lines.select(F.col("h").alias("a"), F.col("line").alias("la")), "a").join(lines.select(F.col("h").alias("b"), F.col("line").alias("lb")), "b")
    removed = verify(sides.select("h", "la", "lb"), edits)
    if not crowded.isEmpty():
        removed = removed.unionByName(split_hot(crowded.join(lines, "h").join(crowd_places, "h"), edits, crowd))
    return first.join(removed.distinct(), "h", "left_anti")


def dedup_lines(docs: DataFrame, edits: int = EDITS, crowd: int = CROWD, drop_emptied: bool = False, numbered: bool = True) -> DataFrame:
    """The documents with all their columns, `text` without the removed lines (and `n_chars`, where there is one, its new length) and, if `numbered`, `n_removed`.

    `drop_emptied` leaves out documents all of whose lines were removed: what they said stands earlier.
    """
    kept = kept_lines(named(docs, "doc_id", "text"), edits, crowd)
    kept = kept.groupBy("id").agg(F.collect_list(F.struct("place", "h")).alias("kept")).hint("merge")  # lines of one document

    @F.pandas_udf("struct<text string, n long>")
    def without(text, kept):  # noqa: ANN001, ANN202
        import pandas as pd
        import xxhash

        texts, counts = [], []
        for t, k in zip(text, kept):
            stay = set() if k is None else {(int(x["place"]), int(x["h"])) for x in k}
            out, n = [], 0
            for i, line in enumerate((t or "").split("\n")):
                raw = line.encode()
                if raw.strip(b" \t\r\f\v") and (i, line_hash(xxhash, raw)) not in stay:
                    n += 1
                else:
                    out.append(line)
            texts.append("\n".join(out) if t is not None else None)
            counts.append(n)
        give_back()
        return pd.DataFrame({"text": pd.Series(texts, dtype=object), "n": counts})

    plain, names = neutral(docs)
    text = F.col(names.of("text"))
    joined = plain.join(kept, F.coalesce(plain[names.of("doc_id")].cast("long"), F.lit(NULL_ID)) == kept["id"], "left").withColumn("done", without(text, F.col("kept")))
    changed = {"text": F.col("done.text")}
    if "n_chars" in docs.columns:
        n_chars = F.col(names.of("n_chars"))
        changed["n_chars"] = F.when(F.col("done.n") > 0, F.length("done.text").cast(docs.schema["n_chars"].dataType)).otherwise(n_chars)
    if drop_emptied:
        joined = joined.where("done.n = 0 or done.text <> ''")
    return names.restore(joined, changed, {"n_removed": F.col("done.n")} if numbered else None)


PARTS = EDITS + 1
#: Lines within EDITS byte edits are within as many character edits, so they share a segment by characters; that keeps the SQL from comparing all pairs.
ORACLE_SQL = f"""
WITH l AS (SELECT doc_id, u.i - 1 AS place, u.line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL) d,
  LATERAL (SELECT unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i) u),
w AS (SELECT *, regexp_matches(line, '[^\\t\\n\\x0B\\f\\r ]') AS filled FROM l),
f AS (SELECT line, min((doc_id, place)) AS first, strlen(line) AS n FROM w WHERE filled GROUP BY line),
g AS (SELECT line, first, length(line) AS c FROM f WHERE n >= {EDIT_BYTES}),
i AS (SELECT line, first, c, i, hash(substr(line, i * (c // {PARTS}) + greatest(0, i - {PARTS} + c % {PARTS}) + 1, c // {PARTS} + (i >= {PARTS} - c % {PARTS})::INT)) AS s
  FROM g, range({PARTS}) AS x(i)),
q AS (SELECT line, first, c + d AS c, i, i * ((c + d) // {PARTS}) + greatest(0, i - {PARTS} + (c + d) % {PARTS}) + m AS at,
  (c + d) // {PARTS} + (i >= {PARTS} - (c + d) % {PARTS})::INT AS z FROM g, range({PARTS}) AS x(i), range(-{EDITS}, {PARTS}) AS y(d), range(-{EDITS}, {PARTS}) AS v(m)),
j AS (SELECT DISTINCT i.line AS a, q.line AS b FROM i JOIN q ON i.c = q.c AND i.i = q.i AND i.s = hash(substr(q.line, q.at + 1, q.z)) AND i.first < q.first WHERE q.at >= 0),
p AS (SELECT b AS line FROM j WHERE strlen(a) - strlen(b) BETWEEN -{EDITS} AND {EDITS} AND levenshtein(a, b) <= least({EDITS}, least(strlen(a), strlen(b)) // {EDIT_BYTES}) GROUP BY b),
k AS (SELECT w.doc_id, w.place, w.line, w.filled AND ((w.doc_id, w.place) <> f.first OR p.line IS NOT NULL) AS gone
  FROM w LEFT JOIN f ON w.line = f.line LEFT JOIN p ON w.line = p.line),
t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT coalesce(gone, false)), '') AS text,
  count(*) FILTER (coalesce(gone, false)) AS n_removed FROM k GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE t.text END AS text, d.lang, d.source,
  CASE WHEN coalesce(t.n_removed, 0) = 0 THEN d.n_chars ELSE length(t.text) END::BIGINT AS n_chars, coalesce(t.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id
"""
