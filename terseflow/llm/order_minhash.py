"""Near-duplicate documents by Order MinHash (Marcais et al. 2019) and banded alignment.

Words are lower-cased runs of letters and digits. A sketch samples the few k-mers of words, labelled by their occurrence
number, that a seeded hash puts first, and keeps them in the order of the text, so that two documents agree in a sketch
with a probability that follows their edit similarity. Documents of at most SHORT words have few k-mers, so they also get
a key for each way to leave out as many words as the threshold lets differ; of two of them that are near, none is missed.
Documents that agree in any key are candidates; a pair is near when the word-level edit distance, computed bit-parallel inside the band that the threshold leaves, is at most
(1 - threshold) of the longer document. Groups are the connected components; one document of each, that of the lowest id,
stays.

Large groups need no quadratic work: copies with equal words are folded first and each bucket is compared with its lowest
member. What that leaves apart is compared pair by pair in small buckets; the members of large ones are cut into blocks by
length, and pairs of blocks whose lengths allow it are compared within a task, where counts of words rule out nearly all
pairs at little cost (see within_groups). So every candidate pair is verified, connected already, or shown to be too far
apart, in one round whatever the buckets hold.

Defined cases: texts without words (null, empty, punctuation) are in no group; documents of fewer than k words are one
short k-mer; a null doc_id is in no group and stays; rows that share a doc_id are one document, near to another if any of
the rows is; equal and repeated rows are folded; columns besides doc_id and text are never looked at, whatever their
names, and drop_near_duplicates() returns them as they are; an empty table gives no rows. Texts are read whole, their
length only bounds the band.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terseflow.llm.common import GOLD, NOT_ALNUM, U64, materialize, mix, named, neutral, remove, small_batches, text_chunks, tidy, words

K = 2
SAMPLED = 3
SKETCHES = 60
THRESHOLD = 0.8
SHORT = 14
LAST = U64(0xFFFFFFFFFFFFFFFF)


def labelled_kmers(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k-mers with their occurrence number in their row, bounds of the rows)."""
    length = np.diff(first)
    count = np.where(length >= k, length - k + 1, np.minimum(length, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(length)), count)
    at = np.repeat(first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    end = first[1:][row]
    kmer = np.zeros(len(at), U64)
    for i in range(k):
        inside = at + i < end
        kmer = mix(kmer * GOLD + np.where(inside, hashes[np.minimum(at + i, len(hashes) - 1)] if len(hashes) else U64(0), U64(i)))
    own = kmer + row.astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(own, kind="stable")
    sorted_own = own[order]
    new = np.ones(len(own), bool)
    new[1:] = sorted_own[1:] != sorted_own[:-1]
    begin = np.flatnonzero(new)
    number = np.empty(len(own), U64)
    number[order] = (np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))).astype(U64)
    return mix(kmer + number * U64(0x165667B19E3779F9)), bounds


def sketch(hashes: np.ndarray, first: np.ndarray, k: int = K, sampled: int = SAMPLED, sketches: int = SKETCHES) -> np.ndarray:
    """rows x sketches; rows without words have undefined keys."""
    x, bounds = labelled_kmers(hashes, first, k)
    rows = len(first) - 1
    out = np.zeros((rows, sketches), U64)
    filled = np.flatnonzero(np.diff(bounds))
    if not len(filled):
        return out
    starts = bounds[:-1][filled]
    sizes = np.diff(bounds)[filled]
    segment = np.repeat(np.arange(len(filled)), sizes)
    padded = np.append(x, U64(0))
    # nearly always the lowest few of a long row are under this bound, so only what is gets sorted
    bound = np.where(sizes <= 8 * sampled, LAST, LAST // sizes.astype(U64) * U64(5 * sampled))
    bound = np.repeat(bound, sizes)
    wanted = np.minimum(sizes, sampled)
    for j in range(sketches):
        h = (x ^ mix(np.array([j + 1], U64) * GOLD)) * U64(0x9FB21C651E98DF25)
        h ^= h >> U64(29)
        h *= U64(0xD6E8FEB86659FD93)
        h = np.minimum(h, LAST - U64(1))
        low = np.flatnonzero(h < bound)
        low = low[np.lexsort((h[low], segment[low]))]
        begin = np.searchsorted(segment[low], np.arange(len(filled) + 1))
        places = np.full((sampled, len(filled)), len(x), np.int64)
        for s in range(sampled):
            there = begin[:-1] + s < begin[1:]
            places[s, there] = low[begin[:-1][there] + s]
        for r in np.flatnonzero(np.diff(begin) < wanted):
            own = starts[r] + np.argsort(h[starts[r] : starts[r] + sizes[r]], kind="stable")[: wanted[r]]
            places[: len(own), r] = own
        places.sort(axis=0)
        key = np.full(len(filled), U64(j + 1))
        for s in range(sampled):
            key = mix(key * GOLD + padded[places[s]])
        out[filled, j] = key
    return out


def left_out(n: int, threshold: float) -> int:
    """How many words of a document of n two near documents of at most SHORT words can differ in."""
    return max((allowed(m, threshold) for m in range(n, SHORT + 1) if m - allowed(m, threshold) <= n), default=0)


def deletion_keys(x: np.ndarray, most: int) -> np.ndarray:
    """rows x keys, for rows of as many words: a key for each way to leave out up to `most` of them."""
    n = x.shape[1]
    found = []
    for r in range(min(most, n - 1) + 1):
        kept = np.array(list(combinations(range(n), n - r)))
        key = np.full((len(x), len(kept)), LAST)
        for i in range(n - r):
            key = mix(key * GOLD + x[:, kept[:, i]])
        found.append(key)
    return np.concatenate(found, axis=1)


def keys_of(hashes: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bounds of the rows): the sketches of each row, then the deletion keys of a short one."""
    sketches, size = sketch(hashes, first), np.diff(first)
    short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    count = np.full(len(size), SKETCHES)
    for n in range(1, SHORT + 1):
        rows, most = np.flatnonzero(size == n), left_out(n, threshold)
        if most and len(rows):
            short[n] = rows, deletion_keys(hashes[first[rows][:, None] + np.arange(n)], most)
            count[rows] += short[n][1].shape[1]
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(bounds[-1], U64)
    out[bounds[:-1, None] + np.arange(SKETCHES)] = sketches
    for rows, keys in short.values():
        out[bounds[rows][:, None] + SKETCHES + np.arange(keys.shape[1])] = keys
    return out, bounds


def sketches_of(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id, words, two fingerprints of the word sequence and the keys. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for a, b, raw, offsets in text_chunks(batch.column(1)):
                hashes, first = words(raw, offsets, NOT_ALNUM)
                keys, bounds = keys_of(hashes, first, threshold)
                prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(hashes[first[i] : first[i + 1]].tobytes()) for i in range(b - a)), np.int64).reshape(-1, 2)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), lists], names=["id", "n", "f1", "f2", "keys"]
                )

    source = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.lower("text").alias("text"))
    return source.mapInArrow(tidy(run), "id long, n long, f1 long, f2 long, keys array<long>").where("n > 0")


# -- banded alignment ----------------------------------------------------------------------------------------------

#: Bands of at most so many bits keep a mask for each symbol in the band; wider ones keep places and make most masks when asked.
DENSE_BITS = 8192


def _placed(a: Sequence, k: int) -> Callable[[object, int], int]:
    """(symbol, first place of the band) -> its mask, for wide bands: few places are set one by one, a mask of many is kept and moved."""
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    kept: dict = {}
    width = 2 * k + 1

    def match(x: object, low: int) -> int:
        own = places.get(x)
        if own is None:
            return 0
        begin, end = bisect_left(own, low), bisect_left(own, low + width)
        if end - begin <= 32:
            mask = 0
            for i in own[begin:end]:
                mask |= 1 << (i - low)
            return mask
        mask, then, upto = kept.get(x, (0, low, begin))
        mask >>= low - then
        if end - upto > 32:
            bits = np.zeros(width, np.uint8)
            bits[np.array(own[begin:end]) - low] = 1
            mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        else:
            for i in own[max(begin, upto) : end]:
                mask |= 1 << (i - low)
        if len(kept) * width > 1 << 28:  # 32 MB of masks
            kept.clear()
        kept[x] = mask, low, end
        return mask

    return match


def banded_distance(a: Sequence, b: Sequence, limit: int) -> int:
    """The edit distance of two sequences, or limit + 1 if it is larger: Hyyro's bit-parallel columns, 2 * limit + 1 bits wide, moving along the diagonal.

    Masks are those of the band, not of the sequence: a symbol's moves along with it and goes when it is empty.
    """
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > limit:
        return limit + 1
    if not n:
        return m
    k = min(limit, m)
    width = 2 * k + 1
    mask = (1 << width) - 1
    top = 1 << (width - 1)
    placed = _placed(a, k) if width > DENSE_BITS else None
    at: dict = {}  # symbol: (mask, column that it is for)
    if not placed:
        for i in range(k):
            at[a[i]] = at.get(a[i], (0, 1))[0] | 1 << (i + k), 1
    up = ((1 << (k + 1)) - 1) << k
    down = 0
    distance = k
    bound = k + (n - m + k)
    for j in range(1, n + 1):
        if placed:
            match = placed(b[j - 1], j - k - 1)
        else:
            i = j - 1 + k
            if i < m:
                x = a[i]
                old = at.get(x)
                at[x] = (old[0] >> (j - old[1]) | top, j) if old else (top, j)
            i = j - k - 2
            if i >= 0:
                x = a[i]
                old = at.get(x)
                if old and not old[0] >> (j - old[1]):
                    del at[x]
            old = at.get(b[j - 1])
            match = old[0] >> (j - old[1]) if old else 0
        d0 = (((match & up) + up) ^ up | match | down) & mask
        hp = (down | ~(d0 | up)) & mask
        hn = d0 & up
        if j + k <= m:
            distance += not d0 & top
            if distance > bound:
                return limit + 1
        else:
            bit = m - j + k
            distance += (hp >> bit & 1) - (hn >> bit & 1)
        up = (hn | ~(d0 >> 1 | hp)) & mask
        down = d0 >> 1 & hp
    return distance if distance <= limit else limit + 1


def allowed(n: int, threshold: float) -> int:
    return int((1 - threshold) * n + 1e-9)


def near(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two arrays of word hashes are within the threshold. Common ends are set aside first, then the band is widened step by step, so that close documents cost little."""
    limit = allowed(max(len(a), len(b)), threshold)
    if abs(len(a) - len(b)) > limit:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
        tail = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if max(len(a), len(b)) - common(a, b) > limit:  # no alignment can have fewer edits
        return False
    x, y, band = a.tolist(), b.tolist(), min(limit, 16)
    while banded_distance(x, y, band) > band:
        if band == limit:
            return False
        band = min(limit, 8 * band)
    return True


def numbered(x: np.ndarray) -> np.ndarray:
    """The sorted words of a document, each with its occurrence number."""
    if not len(x):
        return x
    x = np.sort(x)
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    number = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
    return np.sort(mix(x + number.astype(U64) * U64(0x165667B19E3779F9)))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two documents share, counted as often as both have them."""
    return len(np.intersect1d(numbered(a), numbered(b), assume_unique=True))


#: Partners that a document's text is sent along with; one of more partners goes to several tasks.
PARTNERS = 256
#: Members of a bucket that are compared with each other as they are; larger buckets are cut into blocks.
SMALL = 64


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__tf_id"), F.lower("text").alias("__tf_text"))


def compared(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) of ids whose documents are near.

    A document's text goes once to each PARTNERS partners. One join fetches all texts, never by broadcast.
    """
    counts = pairs.groupBy("u").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("chunks"))
    asked = pairs.join(counts, "u").select(F.col("v").alias("id"), "u", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int").alias("chunk"), "v")
    own = counts.select(F.col("u").alias("id"), "u", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("v"))
    texts = texts_of(docs)
    asked = own.unionByName(asked)
    sent = texts.hint("merge").join(asked, texts["__tf_id"] == asked["id"]).select("u", "chunk", "v", "__tf_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, []
        for batch in batches:
            us, chunks, vs = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            for a, b, raw, offsets in text_chunks(batch.column(3)):
                hashes, first = words(raw, offsets, NOT_ALNUM)
                for i in range(a, b):
                    x = hashes[first[i - a] : first[i - a + 1]]
                    if (us[i], chunks[i]) != key:
                        key, mine = (us[i], chunks[i]), []
                    if vs[i] is None:  # the document itself comes first
                        mine.append(x.copy())
                    elif len(x) > 0 and any(len(y) > 0 and near(y, x, threshold) for y in mine):
                        out.append((us[i], vs[i]))
            if out:
                yield id_pairs(out)

    placed = sent.repartition("u", "chunk").sortWithinPartitions("u", "chunk", F.col("v").asc_nulls_first())
    return placed.mapInArrow(tidy(run), "u long, v long")


def id_pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])


# -- large buckets -------------------------------------------------------------------------------------------------

#: Members and words of a block of a large bucket; a task compares two blocks.
BLOCK_MEMBERS = 512
BLOCK_WORDS = 1 << 20
#: Counters of a document's words, and the fewer that are looked at first.
COUNTERS, COARSE = 512, 64


def near_in_block(ids: np.ndarray, comps: np.ndarray, sides: np.ndarray, texts: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """The near pairs of ids, up to what connects them already; with two sides, the pairs across them.

    Near documents share all words of the longer one but for its allowed edits. The sum of the lower of two documents'
    counters is at least what they share, so a pair whose sum is less is never near.
    """
    size = np.array([len(x) for x in texts])
    order = np.argsort(size, kind="stable")
    ids, sides, size, texts = ids[order], sides[order], size[order], [texts[i] for i in order]
    label = np.unique(comps[order], return_inverse=True)[1]
    fine = np.array([np.bincount((x >> U64(40)).astype(np.int64) % COUNTERS, minlength=COUNTERS) for x in texts]).astype(np.uint16 if size[-1] < 1 << 16 else np.uint32)
    coarse = fine.reshape(len(texts), COUNTERS // COARSE, COARSE).sum(axis=1).astype(fine.dtype)
    across = sides.min() != sides.max()
    found: list[tuple[int, int]] = []
    for i in range(1, len(texts)):
        least = int(size[i]) - allowed(int(size[i]), threshold)  # shared words, and so the length of the shorter one
        other = np.arange(np.searchsorted(size, least), i)
        other = other[(label[other] != label[i]) & (sides[other] != sides[i])] if across else other[label[other] != label[i]]
        for counters in coarse, fine:
            other = other[np.minimum(counters[other], counters[i]).sum(axis=1, dtype=np.int64) >= least]
        for j in other:
            if label[i] != label[j] and near(texts[j], texts[i], threshold):
                found.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
                label[label == label[j]] = label[i]
    return found


def within_groups(docs: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """The near pairs (u, v) inside groups (g, id, comp, least, most) of ids with their component and lengths, up to what connects them already.

    A group is cut into blocks by length. Two blocks meet in one task if their lengths allow near documents; each text goes
    to as many tasks as its block has partners.
    """
    sorted_by_length = Window.partitionBy("g").orderBy("most", "id")
    cut = F.floor((F.row_number().over(sorted_by_length) - 1) / BLOCK_MEMBERS) + F.floor(F.sum("most").over(sorted_by_length.rowsBetween(Window.unboundedPreceding, 0)) / BLOCK_WORDS)
    groups = materialize(groups.withColumn("block", cut), "blocks")
    blocks = groups.groupBy("g", "block").agg(F.min("least").alias("lo"), F.max("most").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    a, b = (blocks.select("g", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "lo", "hi", "c0", "c1")]) for x in "ab")
    shorter, longer = F.least("hi_a", "hi_b"), F.greatest("lo_a", "lo_b")
    both = a.join(b, "g").where("block_a <= block_b and (c0_a <> c1_a or c0_b <> c1_b or c0_a <> c0_b)").where(longer - shorter <= F.floor(longer * (1 - threshold) + 1e-9))
    tasks = both.select("g", F.col("block_a").alias("a"), F.col("block_b").alias("b"), F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    asked = groups.join(tasks, ["g", "block"]).select("id", "g", "a", "b", "block", "comp")
    texts = texts_of(docs)
    sent = texts.hint("merge").join(asked, texts["__tf_id"] == asked["id"]).select("g", "a", "b", "id", "comp", "block", "__tf_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def pairs() -> list[tuple[int, int]]:
            ids, comps, sides, texts = zip(*held)
            return near_in_block(np.array(ids), np.array(comps), np.array(sides), list(texts), threshold)

        for batch in batches:
            gs, firsts, seconds, ids, comps, sides = (batch.column(i).to_pylist() for i in range(6))
            for a, b, raw, offsets in text_chunks(batch.column(6)):
                hashes, first = words(raw, offsets, NOT_ALNUM)
                for i in range(a, b):
                    if (gs[i], firsts[i], seconds[i]) != key:
                        if held and (out := pairs()):
                            yield id_pairs(out)
                        key, held = (gs[i], firsts[i], seconds[i]), []
                    if first[i - a] < first[i - a + 1]:
                        held.append((ids[i], comps[i], sides[i], hashes[first[i - a] : first[i - a + 1]].copy()))
        if held and (out := pairs()):
            yield id_pairs(out)

    return sent.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b").mapInArrow(tidy(run), "u long, v long")


# -- components ----------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """id and root, the lowest id of its component, for every id that has an edge (u, v): alternating large and small stars (Kiveris et al. 2014).

    The lowest neighbours come from an aggregate that combines before the shuffle and are joined back, so a hub is no window of one task.
    """
    e = materialize(edges.select("u", "v").where("u <> v"), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, materialize(small, "stars")
        remove(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
        before = now


def lengths_allow(x: str, y: str, threshold: float) -> Column:
    longer = F.greatest(x, y)
    return longer - F.least(x, y) <= F.floor(longer * (1 - threshold) + 1e-9)


def bucket_edges(docs: DataFrame, rows: DataFrame, threshold: float, small: int) -> DataFrame:
    """The near pairs (u, v) of documents that share a key, up to what connects them already.

    `rows` holds distinct (key, id, n). Each bucket is compared with its lowest member. What that leaves in different
    components is compared pair by pair in a bucket of up to `small` members; larger buckets of the same lowest member make
    a group, which within_groups() compares block by block.
    """
    pivots = rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("c")).where("c > 1")
    members = materialize(rows.join(pivots, "key").select("key", "id", "n", F.col("p.id").alias("pivot"), F.col("p.n").alias("pn"), (F.col("c") > small).alias("hot")), "buckets")
    star = members.where(F.col("id") != F.col("pivot")).where(lengths_allow("n", "pn", threshold)).select(F.col("pivot").alias("u"), F.col("id").alias("v")).distinct()
    edges = materialize(compared(docs, materialize(star, "pairs"), threshold).distinct(), "compared")
    roots = components(edges)
    comp = F.coalesce("root", "id").alias("comp")
    rest = members.where("id <> pivot").join(roots, "id", "left").select("key", "id", "n", "pivot", "hot", comp)
    cold = rest.where("not hot")
    mixed = cold.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    cold = cold.join(mixed, "key", "left_semi")
    other = cold.select("key", F.col("id").alias("v"), F.col("n").alias("nv"), F.col("comp").alias("cv"))
    close = cold.join(other, "key").where("id < v and comp <> cv").where(lengths_allow("n", "nv", threshold)).select(F.col("id").alias("u"), "v")
    close = materialize(close.distinct(), "open")
    groups = rest.where("hot").groupBy(F.col("pivot").alias("g"), "id", "comp").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return edges.unionByName(compared(docs, close, threshold)).unionByName(within_groups(docs, groups, threshold))


def duplicates(docs: DataFrame, threshold: float = THRESHOLD, small: int = SMALL) -> DataFrame:
    """(doc_id, duplicate_of): every document that does not stay, with the one of its group that does."""
    docs = named(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    found = materialize(sketches_of(docs, threshold), "sketches")
    folded = found.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    copies = found.select("id", "f1", "f2").join(folded.select("f1", "f2", "rep"), ["f1", "f2"]).where("id <> rep").select(F.col("id").alias("v"), F.col("rep").alias("u"))
    # one exchange by key serves the distinct rows, the pivots and their join
    rows = folded.select(F.explode(F.array_distinct("keys")).alias("key"), F.col("rep").alias("id"), "n").repartition("key").distinct()
    roots = components(copies.select("u", "v").unionByName(bucket_edges(docs, rows, threshold, small)))
    return roots.where("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns, one of each group."""
    plain, back = neutral(docs)
    gone = duplicates(plain.select(plain[back.of("doc_id")].alias("doc_id"), plain[back.of("text")].alias("text")), threshold).select(F.col("doc_id").alias("__tf_gone"))
    return back.restore(plain.join(gone, plain[back.of("doc_id")].cast("long") == F.col("__tf_gone"), "left_anti"))
