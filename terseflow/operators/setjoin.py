"""Candidates of an exact set-similarity self-join, as NumPy blocks: what may be alike shares a rare token, early in both.

A set's tokens are ordered by any order that all sets share, rare ones first. Where two sets of n and k tokens meet for
the m-th time, at the i-th of one and the j-th of the other, they have at most m + min(n - i, k - j) tokens in common, and
Jaccard t asks for t / (1 + t) (n + k). So each token of a set's head bounds the size of the partners that it may lead
to, and long sets must meet there several times (meetings()). Counts of 64 classes of tokens, up to 3 each, then rule out
pairs that differ in too many tokens. Nothing that meets the threshold is lost by any of these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Sizes are kept in 16 bits; above that pairs go on without being bounded.
TOP = 65535
#: Pairs that are looked at together.
CHUNK = 1 << 21
#: Tokens whose sets are worked on together.
TOKENS = 1 << 20
#: 48 bits of a code are the token, those above its rank.
TOKEN_BITS = 48
RECORD = np.dtype([("token", "<u4"), ("n", "<u2"), ("most", "<u2"), ("id", "<i8"), ("lo", "<u8"), ("hi", "<u8")])
Batches = Iterator[pa.RecordBatch]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def meetings(n: np.ndarray, threshold: float) -> np.ndarray:
    """How often a set of n tokens must meet a partner in both heads; no more than the tokens that they have in common."""
    return np.minimum(1 + n // 24, np.maximum(1, np.ceil(threshold * n - 1e-6).astype(np.int64)))


def whole_sets(batches: Batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, sizes, codes) of some sets from rows (id, pos, code), of which those of a set follow one another from pos 0 on."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def sets(ids: np.ndarray, pos: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.flatnonzero(pos == 0)
        return ids[first], np.diff(np.append(first, len(pos))), codes

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy() for c in ("id", "pos", "code")))
        rows += batch.num_rows
        if rows >= TOKENS:
            joined = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.flatnonzero(joined[1] == 0)[-1])  # the last set may go on
            if cut:
                yield sets(*[c[:cut] for c in joined])
            held = [tuple(c[cut:] for c in joined)]
            rows = len(held[0][0])
    if rows:
        yield sets(*[np.concatenate(c) for c in zip(*held)])


def heads(threshold: float, parts: int) -> Callable[[Batches], Batches]:
    """(id, pos, code) of sets to (part, size, block): a record for each token of their heads that another set may have. The rank of a token that is in one set alone is 0."""

    def run(batches: Batches) -> Batches:
        for names, sizes, flat in whole_sets(batches):
            flat = flat.astype(U64)
            unique = np.unique(names, return_index=True)[1]  # copies of a set
            at = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, at))
            flat = flat[order]
            first = np.cumsum(sizes) - sizes
            place = np.arange(len(flat)) - first[at] + 1
            n = sizes[at]
            # the largest partner: n - i + m >= t / (1 + t) (n + k)
            most = np.floor((n - place + meetings(n, threshold)) * (1 + threshold) / threshold - n + 1e-6).astype(np.int64)
            token = mixed(flat & U64((1 << TOKEN_BITS) - 1))
            kinds = np.minimum(np.bincount(at * 64 + (token & U64(63)).astype(np.int64), minlength=64 * len(sizes)), 3).reshape(-1, 64).astype(U64)
            lo, hi = (np.bitwise_or.reduce((kinds >> U64(k) & U64(1)) << np.arange(64, dtype=U64), axis=1) for k in (0, 1))
            once = np.zeros(len(sizes), bool)
            once[unique] = True
            most = np.minimum(most, np.floor(n / threshold + 1e-6).astype(np.int64))
            keep = np.flatnonzero(once[at] & (most >= np.ceil(threshold * n - 1e-6)) & (flat >> U64(TOKEN_BITS) > 0))
            if not len(keep):
                continue
            rows, spread = at[keep], token[keep] >> U64(8)
            found = np.empty(len(keep), RECORD)
            found["token"] = spread.astype(np.uint32)
            found["n"], found["most"] = np.minimum(n[keep], TOP), np.minimum(most[keep], TOP)
            found["id"], found["lo"], found["hi"] = names[rows], lo[rows], hi[rows]
            part = ((spread >> U64(32)) % U64(parts)).astype(np.int64)
            order = np.lexsort((found["token"], part))
            found, part = found[order], part[order]
            bounds = np.searchsorted(part, np.arange(parts + 1))
            took = [p for p in range(parts) if bounds[p] < bounds[p + 1]]
            blocks = [b"".join(found[f][bounds[p] : bounds[p + 1]].tobytes() for f in RECORD.names) for p in took]
            yield pa.RecordBatch.from_arrays([pa.array(took, pa.int32()), pa.array([len(b) for b in blocks], pa.int32()), pa.array([pa.compress(b, "zstd", asbytes=True) for b in blocks], pa.binary())], names=["part", "size", "block"])

    return run


def unpacked(batches: Batches) -> np.ndarray:
    tables = [np.empty(0, RECORD)]
    for batch in batches:
        for size, block in zip(batch.column("size").to_pylist(), batch.column("block").to_pylist()):
            raw, at = pa.decompress(block, size, "zstd", asbytes=True), 0
            table = np.empty(size // RECORD.itemsize, RECORD)
            for f in RECORD.names:
                table[f] = np.frombuffer(raw, RECORD[f], len(table), at)
                at += len(table) * RECORD[f].itemsize
            tables.append(table)
    return np.concatenate(tables)


def candidates(threshold: float) -> Callable[[Batches], Batches]:
    """Blocks of one part to (x, y, met, need), x < y: pairs of ids that may be alike if they meet `need` times in all parts, and how often they do in this one."""

    def run(batches: Batches) -> Batches:
        r = unpacked(batches)
        key = r["token"].astype(U64) << U64(16) | r["n"]
        order = np.argsort(key, kind="stable")
        r, key = r[order], key[order]
        token, n, most, ids, lo, hi = (np.ascontiguousarray(r[f]) for f in RECORD.names)
        del r
        # of two sets the one that comes first is not larger, and its token must allow for the other's size
        last = np.searchsorted(key, token.astype(U64) << U64(16) | most, "right")
        many = np.maximum(last - np.arange(len(key)) - 1, 0)
        ends = np.cumsum(many)
        share = threshold / (1 + threshold)
        at = 0
        while at < len(key):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
            a = np.repeat(np.arange(at, stop), many[at:stop])
            b = np.arange(len(a)) - np.repeat(ends[at:stop] - many[at:stop] - base, many[at:stop]) + a + 1
            at = stop
            fit = most[b] >= n[a]
            a, b = a[fit], b[fit]
            total = n[a].astype(np.int32) + n[b]
            differ = total - 2 * np.ceil(share * total - 1e-6)
            apart = np.bitwise_count(hi[a] ^ hi[b]).astype(np.int32)
            for over in (np.bitwise_or, np.bitwise_and):  # classes of at least one token, and of three
                apart += np.bitwise_count(over(lo[a], hi[a]) ^ over(lo[b], hi[b]))
            fit = ((apart <= differ) | (n[b] == TOP)) & (ids[a] != ids[b])
            a, b = a[fit], b[fit]
            if len(a):
                x, y = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
                need = meetings(np.minimum(n[a], n[b]).astype(np.int64), threshold).astype(np.int32)
                order = np.lexsort((y, x))
                x, y, need = x[order], y[order], need[order]
                first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
                met = np.diff(np.append(first, len(x))).astype(np.int32)
                for i in range(0, len(first), 1 << 18):
                    f = first[i : i + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x[f], y[f], met[i : i + (1 << 18)], need[f])], names=["x", "y", "met", "need"])

    return run
