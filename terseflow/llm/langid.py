"""Language identification by nearest centroids.

Documents become L2-normalised TF-IDF vectors of hashed byte 1- to 3-grams. Every language has several centroids, found
by spherical k-means over a bounded labelled sample; a document gets the language of the centroid of largest cosine and
is rejected where even that cosine is below what the sample shows for documents of its length.

Defined cases: null, empty or letterless text has no vector, so no language, similarity 0 and is rejected. Null labels
are not used for fitting; without any labelled text all documents are rejected. Ties go to the alphabetically first
language. Rows are handled one by one, so repeated rows get equal answers. A null doc_id is kept, but is not in the
sample. Texts are read whole. An empty table stays empty. Only doc_id, text and lang are looked at, whatever else there
is; keep_identified() returns all columns under their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terseflow.llm.common import named, neutral, small_batches, text_chunks, tidy

DIMENSIONS = 8192
SAMPLE_PER_LANGUAGE = 800
CENTROIDS_PER_LANGUAGE = 4
#: A document is rejected below this share of the lowest own-language cosine of the sample in its length class.
SLACK = 0.6
ROWS_AT_ONCE = 64

_LETTER = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def count_vectors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram counts, letter bytes) of each lower-cased row."""
    rows = len(offsets) - 1
    out = np.zeros((rows, DIMENSIONS), np.float32)
    if not len(raw):
        return out, np.zeros(rows, np.int64)
    x = _LETTER[raw].astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.uint32), np.diff(offsets))
    letter = x != 32
    letters = np.bincount(row[letter], minlength=rows)
    cells = [(row * np.uint32(DIMENSIONS) + x)[letter]]
    # the head of a two- and three-gram may be a blank, so that word starts count; two blanks in a row never do
    pair = (row[1:] == row[:-1]) & (letter[1:] | letter[:-1])
    code = x[:-1] | (x[1:] << np.uint32(8))
    hashed = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(DIMENSIONS - 256) + np.uint32(256)
    cells.append((row[1:] * np.uint32(DIMENSIONS) + hashed)[pair])
    if len(x) > 2:
        triple = pair[:-1] & pair[1:] & (row[2:] == row[:-2])
        code = code[:-1] | (x[2:] << np.uint32(16))
        hashed = ((code * np.uint32(0x85EBCA6B)) >> np.uint32(15)) % np.uint32(DIMENSIONS - 256) + np.uint32(256)
        cells.append((row[2:] * np.uint32(DIMENSIONS) + hashed)[triple])
    for c in cells:
        out += np.bincount(c, minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS)
    return out, letters


def row_groups(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for first, stop, raw, offsets in text_chunks(column):
        for a in range(0, stop - first, ROWS_AT_ONCE):
            b = min(a + ROWS_AT_ONCE, stop - first)
            yield raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # lowest accepted cosine by length class

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = counts.copy()
        for a in range(0, len(x), ROWS_AT_ONCE):  # in place, as the sample's matrix is large
            part = x[a : a + ROWS_AT_ONCE]
            filled = part > 0
            np.log(part, out=part, where=filled)
            part += filled
            part *= self.idf
            norm = np.linalg.norm(part, axis=1, keepdims=True)
            part /= np.where(norm > 0, norm, 1)
        return x

    def predict(self, counts: np.ndarray, letters: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        if not self.languages:
            return [None] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
        cosine = self.vectors(counts) @ self.centroids.T
        best = np.argmax(np.round(cosine, 6), axis=1)
        top = cosine[np.arange(len(best)), best].astype(float)
        empty = letters == 0
        top[empty] = 0
        rejected = empty | (top < self.floor[length_class(letters)])
        return [None if e else self.languages[b] for b, e in zip(best, empty)], top, rejected


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), 31)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit rows; seeds are picked farthest first, from the row nearest to the mean."""
    mean = x.mean(axis=0)
    seeds = [int(np.argmax(x @ mean))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    centers = x[seeds].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centers.T, axis=1)
        for c in range(len(centers)):
            if (own == c).any():
                v = x[own == c].mean(axis=0)
                centers[c] = v / max(np.linalg.norm(v), 1e-12)
    return centers


def train(languages: list[str], counts: np.ndarray, letters: np.ndarray, centroids: int = CENTROIDS_PER_LANGUAGE, slack: float = SLACK) -> Model:
    """A model of count vectors with their languages."""
    languages, used = np.asarray(languages, dtype=object), letters > 0
    if not used.all():
        languages, counts, letters = languages[used], counts[used], letters[used]
    if not len(languages):
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.zeros(32))
    idf = (1 + np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0)))).astype(np.float32)
    blank = Model([], np.zeros((0, DIMENSIONS), np.float32), idf, np.zeros(32))
    x = blank.vectors(counts)
    del counts
    names, centers = [], []
    own = np.zeros(len(x))
    for language in sorted(set(languages)):
        mine = np.flatnonzero(languages == language)
        c = spherical_kmeans(x[mine], centroids)
        own[mine] = (x[mine] @ c.T).max(axis=1)
        names += [language] * len(c)
        centers.append(c)
    floor = np.full(32, np.inf)
    for cls in range(31, -1, -1):
        inside = length_class(letters) == cls
        floor[cls] = min(floor[min(cls + 1, 31)], own[inside].min() * slack if inside.any() else np.inf)
    shortest = int(length_class(letters).min())
    floor[:shortest] = 0  # shorter than all that was seen: no ground to reject
    floor[np.isinf(floor)] = floor[np.isfinite(floor)].max()
    return Model(names, np.vstack(centers), idf, floor)


def sample_ids(docs: DataFrame, per_language: int, seed: int = 17) -> DataFrame:
    """The bounded training sample: for each label the `per_language` ids of lowest seeded hash."""
    rank = F.row_number().over(Window.partitionBy("__tf_lang").orderBy("__tf_h", "__tf_id"))
    return (
        docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("__tf_id"), F.col("lang").alias("__tf_lang"), F.xxhash64("doc_id", F.lit(seed)).alias("__tf_h"))
        .withColumn("__tf_rank", rank)
        .where(F.col("__tf_rank") <= per_language)
        .select("__tf_id", "__tf_lang")
        .distinct()
    )


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS_PER_LANGUAGE) -> Model:
    """Fit on at most `per_language` labelled documents of each language; their n-grams are counted on the executors."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, values, letters = [], [], []
            for raw, offsets in row_groups(batch.column(1)):
                counts, n = count_vectors(raw, offsets)
                for row, k in zip(counts, n):
                    at = np.flatnonzero(row)
                    cells.append(at.astype(np.uint16).tobytes())
                    values.append(row[at].tobytes())
                    letters.append(int(k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cells, pa.binary()), pa.array(values, pa.binary()), pa.array(letters, pa.int64())], names=["lang", "cells", "counts", "letters"]
            )

    docs = named(docs, "doc_id", "text", "lang")
    ids = sample_ids(docs, per_language)
    # at most per_language rows of each language: the broadcast cannot grow with the corpus
    sample = docs.select(F.col("doc_id").alias("__tf_id"), F.lower("text").alias("__tf_text")).join(F.broadcast(ids), "__tf_id").select("__tf_lang", "__tf_text")
    found = sample.mapInArrow(vectors, "lang string, cells binary, counts binary, letters long").toPandas()
    found = found.sort_values(["lang", "letters", "cells"], ignore_index=True)
    counts = np.zeros((len(found), DIMENSIONS), np.float32)
    for i, (cells, values) in enumerate(zip(found["cells"], found["counts"])):
        counts[i, np.frombuffer(cells, np.uint16)] = np.frombuffer(values, np.float32)
    languages, letters = list(found["lang"]), found["letters"].to_numpy()
    del found
    return train(languages, counts, letters, centroids)


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, which has __tf_text too, with __tf_lang, __tf_cos and __tf_rej."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids rows, whatever the corpus holds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str | None] = []
            cosines, rejects = [], []
            for raw, offsets in row_groups(batch.column(batch.num_columns - 1)):
                n, c, r = shared.value.predict(*count_vectors(raw, offsets))
                names += n
                cosines.append(c)
                rejects.append(r)
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.concatenate(cosines or [np.empty(0)])), pa.array(np.concatenate(rejects or [np.empty(0, bool)]))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "__tf_lang", "__tf_cos", "__tf_rej"])

    small_batches(docs.sparkSession)
    return docs.select(*keep, F.lower("__tf_text").alias("__tf_text")).mapInArrow(tidy(run), ", ".join([*fields, "__tf_lang string", "__tf_cos double", "__tf_rej boolean"]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, similarity, rejected), one row for each document. No shuffle."""
    return scored(named(docs, "doc_id", "text").withColumnRenamed("text", "__tf_text"), model, ["doc_id"]).withColumnsRenamed({"__tf_lang": "lang_pred", "__tf_cos": "similarity", "__tf_rej": "rejected"})


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, with all their columns, whatever these are called."""
    plain, names = neutral(docs)
    kept = scored(plain.withColumn("__tf_text", F.col(names.of("text"))), model, plain.columns).where(~F.col("__tf_rej"))
    return names.restore(kept)
