"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

There are as many lists as the square root of the rows. Coarse centroids and the codebooks of the residuals come from
Lloyd passes over a sample of PER_LIST rows a list (those of lowest hash), summed on the executors in fixed point so that
the order of the sums is no matter. Every row is indexed under its list. A query goes to the partitions that hold its
nearest lists, is compared with the members of these lists alone through asymmetric distance tables (query part by
codeword, looked up by code), and the RERANK best ids of each partition get their exact distance. How many lists are probed
is measured: the exact neighbours of CALIBRATION queries are found over the whole table, and the fewest nearest lists that
hold the share COVER of them are probed by all. That is a sample of queries, so tests and README state the recall reached.

A list that holds much of the table is cut into cells of bounded size in several partitions. What is broadcast are the
centroids: the square root of the rows times the dimension, 160 MB for 4e11 rows of 64 numbers (100 TB).

Defined cases: a null id, a null embedding or one that holds a null, NaN or infinity, or is not of the most frequent
length (of equally frequent ones the longest), is neither query nor neighbour; every finite float is allowed, as vectors
are scaled by the largest number of the table; rows that share an id are one item, whose nearest row counts, and no
neighbour of itself; equal distances are ranked by id; with fewer than `k` other items the list is shorter; repeated rows
change nothing; an empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terseflow.llm.common import materialize, named, shuffle_parts

NEIGHBOURS = 10
COVER = 0.97
CODEWORDS = 256
SUBSPACES = 16
RERANK = 100
ROUNDS = 4
CALIBRATION = 256
#: Training rows for each list.
PER_LIST = 64
#: Members of a cell, at least; beyond a share of the table that grows with it, a list is cut into several.
CELL = 4096
#: Of all rows, those whose id is divisible by this are the queries of op4_ivf_pq.
QUERY_EVERY = 100
FIXED = float(1 << 24)


def vectors(table: DataFrame) -> tuple[DataFrame, int, int, float]:
    """((id, x) of the usable rows, their number, their dimension, their largest number)."""
    x = F.col("x").cast("array<float>")
    good = F.col("id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    found = table.where(good).select(F.col("id").cast("long").alias("id"), x.alias("x"))
    largest = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))).cast("double")
    sizes = found.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(largest).alias("m")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return found, 0, 0, 1.0
    return found.where(F.size("x") == sizes["d"]), sizes["n"], sizes["d"], sizes["m"] or 1.0


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    return (x / np.float64(scale)).astype(np.float32)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centers**2).sum(axis=1) / 2
    for a in range(0, len(x), 2048):
        out[a : a + 2048] = np.argmax(x[a : a + 2048] @ centers.T - half, axis=1)
    return out


def lowest(rows: DataFrame, n: int, seed: int, dim: int) -> np.ndarray:
    """n rows of lowest seeded hash; n is the number of lists, CODEWORDS or CALIBRATION."""
    found = rows.select("x", F.xxhash64("id", F.lit(seed)).alias("h"), "id").orderBy("h", "id").limit(n).select("x").toArrow()
    return matrix(found.column(0).combine_chunks(), dim) if len(found) else np.empty((0, dim), np.float32)


def summed(partial: DataFrame, width: int) -> list:
    """Fixed-point sums and counts of each key, on the driver: as many rows as there are centroids."""
    sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]
    return partial.groupBy("key").agg(F.sum("n").alias("n"), *sums).collect()


def tally(keys: np.ndarray, x: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    fixed = np.rint(x.astype(np.float64) * FIXED).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    n = np.bincount(keys, minlength=cells)
    sums = np.zeros((cells, x.shape[1]), np.int64)
    filled = np.flatnonzero(n)
    if len(filled):
        sums[filled] = np.add.reduceat(fixed[order], np.concatenate([[0], np.cumsum(n)[:-1]])[filled], axis=0)
    return n, sums


def lloyd(rows: DataFrame, dim: int, scale: float, centers: np.ndarray, coarse: np.ndarray | None, rounds: int) -> np.ndarray:
    """`rounds` passes. centers: (lists, dim), or, with the coarse centroids of the residuals, (subspaces, codewords, dim / subspaces)."""
    spark = rows.sparkSession
    flat = centers if coarse is None else centers.reshape(-1, centers.shape[-1])
    width = flat.shape[1]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((centers, coarse))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, cells=len(flat), width=width) -> Iterator[pa.RecordBatch]:
            now, lists = shared.value
            n, sums = np.zeros(cells, np.int64), np.zeros((cells, width), np.int64)
            for batch in batches:
                x = scaled(matrix(batch.column(1), dim), scale)
                if lists is None:
                    keys, values = nearest(x, now), x
                else:
                    residual = (x - lists[nearest(x, lists)]).reshape(len(x), len(now), -1)
                    keys = np.concatenate([nearest(residual[:, m], now[m]) + m * now.shape[1] for m in range(len(now))])
                    values = np.concatenate([residual[:, m] for m in range(len(now))])
                one, many = tally(keys, values, cells)
                n += one
                sums += many
            at = np.flatnonzero(n)
            lists_of = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(sums[at].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), lists_of], names=["key", "n", "s"])

        flat = flat.copy()
        for r in summed(rows.mapInArrow(run, "key long, n long, s array<long>"), width):
            flat[r["key"]] = [r[f"s{i}"] / FIXED / r["n"] for i in range(width)]
        centers = flat if coarse is None else flat.reshape(centers.shape)
        shared.unpersist()
    return centers


def in_order(centers: np.ndarray) -> np.ndarray:
    """The centroids so that near ones are near in number: halved again and again along the widest direction."""
    stack, out = [np.arange(len(centers))], []
    while stack:
        ids = stack.pop()
        if len(ids) <= 2:
            out += ids.tolist()
            continue
        x = centers[ids] - centers[ids].mean(axis=0)
        axis = x[int(np.argmax((x**2).sum(axis=1)))]
        order = ids[np.argsort(x @ axis, kind="stable")]
        stack += [order[len(order) // 2 :], order[: len(order) // 2]]
    return centers[out]


def ranked_lists(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argsort((centers**2).sum(axis=1) - 2 * x @ centers.T, axis=1, kind="stable")


def probes_needed(rows: DataFrame, dim: int, scale: float, centers: np.ndarray, k: int, cover: float) -> int:
    """How many nearest lists hold the share `cover` of the exact neighbours of CALIBRATION queries, found over all rows."""
    spark = rows.sparkSession
    q = scaled(lowest(rows, CALIBRATION, 3, dim), scale)
    rank = np.argsort(ranked_lists(q, centers), axis=1)
    shared = spark.sparkContext.broadcast((q, rank.astype(np.int32), centers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, rank, centers = shared.value
        for batch in batches:
            x = scaled(matrix(batch.column(1), dim), scale)
            d = ((q**2).sum(axis=1)[:, None] - 2 * q @ x.T + (x**2).sum(axis=1)).astype(np.float64)
            own = nearest(x, centers)
            best = np.argsort(d, axis=1)[:, : k + 1]  # the query itself is among them
            at = np.repeat(np.arange(len(q)), best.shape[1])
            best = best.reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(d[at, best]), pa.array(rank[at, own[best]].astype(np.int64))], names=["q", "d", "r"])

    found = rows.mapInArrow(run, "q long, d double, r long")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("d", "r"))).where(F.col("place").between(2, k + 1))
    ranks = np.sort(np.array([r["r"] for r in found.select("r").collect()]))
    if not len(ranks):
        return len(centers)
    return int(ranks[min(len(ranks) - 1, int(np.ceil(cover * len(ranks))))]) + 1


def subspaces_of(dim: int) -> int:
    return max(m for m in range(1, SUBSPACES + 1) if dim % m == 0)


def cells_of(counts: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(first cell of each list and one more, partition of each cell). Cells of near lists stay together; partitions get equal shares of the rows."""
    most = max(CELL, -(-int(counts.sum()) // (4 * parts)))
    pieces = np.maximum(1, -(-counts // most))
    first = np.concatenate([[0], np.cumsum(pieces)])
    rows = np.repeat(counts / pieces, pieces)
    before = np.cumsum(rows) - rows
    return first, np.minimum(parts - 1, (before * parts / max(1.0, rows.sum())).astype(np.int32))


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all the half-open ranges, one after the other."""
    size = ends - starts
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def leading(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Which elements are among the n lowest of their group, with all that equal the n-th."""
    order = np.lexsort((values, groups))
    g, v = groups[order], values[order]
    begin = np.searchsorted(g, g)
    last = np.minimum(begin + n - 1, np.searchsorted(g, g, "right") - 1)
    keep = np.zeros(len(groups), bool)
    keep[order] = v <= v[last]
    return keep


def neighbours(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEIGHBOURS, cover: float = COVER, every: int = 1, probes: int | None = None) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): of each row whose id is divisible by `every` the k nearest other items of all rows, by Euclidean distance.

    `probes` sets the number of lists instead of the measured one.
    """
    spark = table.sparkSession
    rows, n, dim, scale = vectors(named(table, id_col, vec_col).toDF("id", "x"))
    schema = "vec_id long, rank int, neighbour_id long, distance double"
    if not n:
        return spark.createDataFrame([], schema)
    lists = max(1, round(n**0.5))
    share = min(1.0, PER_LIST * max(lists, CODEWORDS) / n)
    sample = materialize(rows.where(F.pmod(F.xxhash64("id", "x"), F.lit(1 << 30)) < int(share * (1 << 30))).distinct(), "sample")
    coarse = in_order(lloyd(sample, dim, scale, scaled(lowest(sample, lists, 1, dim), scale), None, ROUNDS))
    if not len(coarse):
        coarse = scaled(lowest(rows, 1, 1, dim), scale)
    m = subspaces_of(dim)
    seeds = scaled(lowest(sample, CODEWORDS, 2, dim), scale) if len(coarse) > 1 else coarse
    books = (seeds - coarse[nearest(seeds, coarse)]).reshape(len(seeds), m, -1).transpose(1, 0, 2).copy()
    books = lloyd(sample, dim, scale, books, coarse, ROUNDS)
    if probes is None:
        probes = probes_needed(rows, dim, scale, coarse, k, cover)
    shared = spark.sparkContext.broadcast((coarse, books))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, books = shared.value
        for batch in batches:
            raw = matrix(batch.column(1), dim)
            x = scaled(raw, scale)
            own = nearest(x, coarse)
            residual = (x - coarse[own]).reshape(len(x), m, -1)
            codes = np.stack([nearest(residual[:, i], books[i]) for i in range(m)], axis=1).astype(np.uint8)
            columns = [pa.array(own.astype(np.int32)), batch.column(0), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["list", "id", "x", "extra"])

    index = materialize(rows.mapInArrow(encode, "list int, id long, x binary, extra binary"), "index")
    counts = np.zeros(len(coarse), np.int64)
    for r in index.groupBy("list").count().collect():  # a row for each list
        counts[r["list"]] = r["count"]
    parts = shuffle_parts(spark)
    first_cell, home = cells_of(counts, parts)
    placed = spark.sparkContext.broadcast((first_cell, home))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_cell, home = placed.value
        for batch in batches:
            own, row = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            cell = (first_cell[own] + row % (first_cell[own + 1] - first_cell[own])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(home[cell]), pa.array(cell), *batch.columns[1:4]], names=["part", "cell", "id", "x", "extra"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each query and partition, with the cells it asks for there; a null cell tells queries from members and comes after them."""
        coarse, (first_cell, home) = shared.value[0], placed.value
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            for a in range(0, len(ids), 1024):
                nearest_lists = ranked_lists(scaled(raw[a : a + 1024], scale), coarse)[:, :probes]
                for i, wanted in zip(range(a, a + len(nearest_lists)), nearest_lists):
                    cells = np.sort(ranges(first_cell[wanted], first_cell[wanted + 1])).astype(np.int32)
                    to, at = np.unique(home[cells], return_index=True)
                    columns = [pa.array(to), pa.nulls(len(to), pa.int32()), pa.array(np.full(len(to), ids[i])), pa.array([raw[i].tobytes()] * len(to), pa.binary()), pa.array([c.tobytes() for c in np.split(cells, at[1:])], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "cell", "id", "x", "extra"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coarse, books = shared.value
        first_cell, _ = placed.value
        held: list[pa.RecordBatch] = []
        ready = False
        for batch in batches:
            split = batch.num_rows - batch.column(1).null_count
            if split:
                held.append(batch.slice(0, split))
            if split == batch.num_rows:
                continue
            if not ready:  # members come before queries
                if not held:
                    return
                cell, ids = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (1, 2))
                x = np.frombuffer(b"".join(v.as_buffer() for b in held for v in b.column(3)), np.float32).reshape(-1, dim)
                codes = np.frombuffer(b"".join(v.as_buffer() for b in held for v in b.column(4)), np.uint8).reshape(-1, m)
                held.clear()
                order = np.lexsort((ids, cell))
                cell, ids, x, codes = cell[order], ids[order], x[order], codes[order]
                own_list = np.searchsorted(first_cell, cell, "right") - 1
                # what the distance table adds for a member whatever the query is: 2 c·w + w·w by subspace
                centers = coarse[own_list].reshape(len(own_list), m, -1)
                fixed = np.zeros(len(own_list), np.float32)
                for i in range(m):
                    w = books[i][codes[:, i]]
                    fixed += 2 * (centers[:, i] * w).sum(axis=1) + (w**2).sum(axis=1)
                del centers
                there, starts = np.unique(cell, return_index=True)
                ends = np.append(starts[1:], len(cell))
                step = max(1, min(256, (1 << 22) // int((ends - starts).max())))
                ready = True
            queries = batch.slice(split)
            all_ids = queries.column(2).to_numpy()
            all_x = np.frombuffer(b"".join(v.as_buffer() for v in queries.column(3)), np.float32).reshape(-1, dim)
            all_cells = [np.frombuffer(v.as_buffer(), np.int32) for v in queries.column(4)]
            for a in range(0, len(all_ids), step):
                q_ids, raw = all_ids[a : a + step], all_x[a : a + step]
                q, asks = scaled(raw, scale), all_cells[a : a + step]
                asked, asker = np.concatenate(asks), np.repeat(np.arange(len(q)), [len(c) for c in asks])
                by = np.argsort(asked, kind="stable")
                asked, asker = asked[by], asker[by]
                tables = np.stack([-2 * books[i] @ q.reshape(len(q), m, -1)[:, i].T for i in range(m)])  # subspace, codeword, query
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for c in np.unique(asked):
                    j = int(np.searchsorted(there, c))
                    if j == len(there) or there[j] != c:
                        continue
                    b, e = starts[j], ends[j]
                    who = asker[np.searchsorted(asked, c) : np.searchsorted(asked, c, "right")]
                    center = coarse[own_list[b]]
                    adc = np.repeat(fixed[b:e, None], len(who), axis=1) + ((q[who] - center) ** 2).sum(axis=1)
                    for i in range(m):
                        adc += tables[i][:, who][codes[b:e, i]]
                    adc[ids[b:e, None] == q_ids[who]] = np.inf
                    lead = np.flatnonzero(np.concatenate([[True], ids[b + 1 : e] != ids[b : e - 1]]))  # rows of an id are neighbours
                    bound = np.minimum.reduceat(adc, lead, axis=0)
                    keep = np.isfinite(adc)
                    if len(bound) > RERANK:
                        keep &= adc <= np.partition(bound, RERANK - 1, axis=0)[RERANK - 1]
                    i, w = np.nonzero(keep)
                    found.append((who[w], b + i, adc[i, w]))
                if not found:
                    continue
                who, at, d = (np.concatenate(c) for c in zip(*found))
                if not len(who):
                    continue
                # the RERANK best ids of each query, by their nearest rows; ties stay
                order = np.lexsort((d, ids[at], who))
                who, at, d = who[order], at[order], d[order]
                lead = np.concatenate([[True], (who[1:] != who[:-1]) | (ids[at[1:]] != ids[at[:-1]])])
                number = np.cumsum(lead) - 1
                best = leading(who[lead], d[lead], RERANK)[number]
                who, at = who[best], at[best]
                exact = np.sqrt(((x[at].astype(np.float64) - raw[who]) ** 2).sum(axis=1))
                order = np.lexsort((exact, ids[at], who))
                who, v, exact = who[order], ids[at[order]], exact[order]
                lead = np.concatenate([[True], (who[1:] != who[:-1]) | (v[1:] != v[:-1])])
                who, v, exact = who[lead], v[lead], exact[lead]
                order = np.lexsort((v, exact, who))
                order = order[np.arange(len(order)) - np.searchsorted(who[order], who[order]) < k]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[who[order]]), pa.array(v[order]), pa.array(exact[order])], names=["q", "v", "d"])

    layout = "part int, cell int, id long, x binary, extra binary"
    members = index.withColumn("row", F.monotonically_increasing_id()).mapInArrow(place, layout)
    queries = rows.where(F.col("id") % every == 0).distinct().mapInArrow(ask, layout)
    sent = members.unionByName(queries).repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("cell").asc_nulls_last())
    found = sent.mapInArrow(search, "q long, v long, d double").groupBy("q", "v").agg(F.min("d").alias("d"))
    place_of: Column = F.row_number().over(Window.partitionBy("q").orderBy("d", "v"))  # at most k of each partition
    return found.withColumn("rank", place_of).where(F.col("rank") <= k).select(F.col("q").alias("vec_id"), "rank", F.col("v").alias("neighbour_id"), F.col("d").alias("distance"))
