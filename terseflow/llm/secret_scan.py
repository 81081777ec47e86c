"""Secrets in texts by a battery of randomness tests.

Candidates are all runs of credential characters, of any length. The encoding is inferred from the characters: decimal,
hex, letters (one case), base36 (one case with digits), base64 or base64url. A candidate counts as random if three tests
in the alphabet of its encoding do not reject that at level RANDOM_LEVEL together (Sidak): chi-squared uniformity, the
runs test above and below the middle of the alphabet, and lag-one serial correlation.

That alone would let short words pass, in which the tests have no power. So a candidate is also held against ordinary
text: the frequencies of letters (of either case), digits and signs and, in encodings that mix classes of characters, how
often these follow each other there, counted over all documents in runs of fewer than ORDINARY characters. So neither
capitals nor numbers nor words with a digit behind are less ordinary than others. The likelihood ratio L of uniform to ordinary
gives 1 / L as a p-value of 'ordinary', which is valid at any length (Markov's inequality) and falls with the length: no
word is too short to be looked at, but few can be random enough. Benjamini-Hochberg at level FDR decides within each
class of encoding and length (powers of sqrt 2), over the candidates of all documents. p-values are rounded up to
hundredths of a decade for this, so the step-up needs only counts.

The texts are read three times, without any shuffle of them: for the chain, for the counts of p-values, and for the
secrets. What is broadcast are the chain and the cuts, of fixed size.

Defined cases: null and empty texts have no candidates; signs alone are none; hyphens and padding are set aside before
the tests (so UUIDs are hex), but in base64url a hyphen is a character; a run next to another letter or digit of any
script is part of a word; a null doc_id is kept; repeated rows report alike; columns besides doc_id and text are not
looked at, whatever their names. Texts are read whole; the secret itself is not in the result, only its place and hash.
An empty table gives no rows. Where there is no ordinary text at all, nothing can be told from it, so nothing is reported.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terseflow.llm.common import named, small_batches

RANDOM_LEVEL = 0.001
FDR = 0.05
#: Runs of fewer characters are what ordinary text is counted on.
ORDINARY = 16
#: Characters handled at once; a longer text is never cut, it is handled alone.
CHARS_AT_ONCE = 1 << 20
LAST_BIN = 30_000

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "letters": _LOWER,
    "LETTERS": _UPPER,
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
NAMES = list(ALPHABETS)
#: How many classes of characters each has.
_CLASSES_OF = np.array([1, 2, 2, 1, 1, 2, 2, 4, 4])
_SIZES = np.array([len(a) for a in ALPHABETS.values()])
_RANK = {}
for _name, _letters in ALPHABETS.items():
    _RANK[_name] = np.full(128, -1, np.int16)
    _RANK[_name][list(_letters.encode())] = np.arange(len(_letters))

#: Bits of a character; the first eight make a candidate.
DIGIT, LOW_HEX, LOW, UP_HEX, UP, SIGN, DASH, UNDER, PAD, WORD = (1 << i for i in range(10))
CANDIDATE, ALNUM = 255, DIGIT | LOW_HEX | LOW | UP_HEX | UP
_BITS = np.zeros(129, np.int16)
for _chars, _bit in ((_DIGITS, DIGIT), ("abcdef", LOW_HEX), (_LOWER[6:], LOW), ("ABCDEF", UP_HEX), (_UPPER[6:], UP), ("+/", SIGN), ("-", DASH), ("_", UNDER), ("=", PAD)):
    _BITS[list(_chars.encode())] = _bit
#: Classes of the chain: 0 the start of a run, 1 lower, 2 upper, 3 digit, 4 sign.
_CLASS = np.zeros(129, np.int8)
for _chars, _class in ((_LOWER, 1), (_UPPER, 2), (_DIGITS, 3), ("+/-_", 4)):
    _CLASS[list(_chars.encode())] = _class
_FOLDED = np.arange(128)
_FOLDED[list(_UPPER.encode())] = list(_LOWER.encode())
CLASSES = 5


def infer(bits: np.ndarray) -> np.ndarray:
    """The number of the encoding in NAMES by the union of a run's character bits; -1 for none."""
    digit, low, up = bits & DIGIT != 0, bits & (LOW_HEX | LOW) != 0, bits & (UP_HEX | UP) != 0
    out = np.full(len(bits), -1)
    out[bits & SIGN == 0] = NAMES.index("base64url")
    out[bits & (DASH | UNDER) == 0] = NAMES.index("base64")
    plain = bits & (SIGN | UNDER) == 0
    out[plain & low & ~up] = NAMES.index("letters")
    out[plain & up & ~low] = NAMES.index("LETTERS")
    out[plain & low & ~up & digit] = NAMES.index("base36")
    out[plain & up & ~low & digit] = NAMES.index("BASE36")
    out[plain & digit & low & ~up & (bits & LOW == 0)] = NAMES.index("hex")
    out[plain & digit & up & ~low & (bits & UP == 0)] = NAMES.index("HEX")
    out[plain & digit & ~low & ~up] = NAMES.index("decimal")
    out[bits & ALNUM == 0] = -1
    return out


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all the half-open ranges, one after the other."""
    size = ends - starts
    return np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Runs:
    """The candidates of some texts, side by side. A sign outside ASCII is symbol 128; what is in no run has class 0, the start of the next."""

    def __init__(self, texts: list[str]) -> None:
        whole = "\0".join(texts) + "\0\0\0"
        if whole.isascii():
            self.symbols = np.frombuffer(whole.encode(), np.uint8)
            bits = _BITS[self.symbols]
        else:
            chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
            self.symbols = np.minimum(chars, 128).astype(np.uint8)
            bits = _BITS[self.symbols]
            at = np.flatnonzero(self.symbols == 128)
            known, place = np.unique(chars[at], return_inverse=True)
            bits[at] = np.array([WORD if chr(c).isalnum() else 0 for c in known.tolist()], np.int16)[place]
        classes = _CLASS[self.symbols]
        inside = np.concatenate([[False], classes > 0])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        padding = (bits[ends] == PAD).astype(np.int64)
        padding += (padding == 1) & (bits[ends + padding] == PAD)
        before = np.where(starts > 0, bits[starts - 1], 0)
        free = (before & WORD == 0) & (bits[ends + padding] & (WORD | ALNUM | UNDER) == 0)
        self.all_starts, self.all_ends, self.free = starts, ends, free
        self.starts, self.ends, self.padding = starts[free], ends[free], padding[free]
        self.offsets = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        self.row = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.size = self.ends - self.starts
        bits &= CANDIDATE
        self.encoding = infer(np.bitwise_or.reduceat(bits, starts)[free] if len(starts) else np.empty(0, np.int16))
        self.plain = self.encoding < NAMES.index("base64")
        self.n = self.size - np.where(self.plain, self.in_runs(np.flatnonzero(self.symbols == 45)), 0).astype(np.int64)

    def in_runs(self, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """How many of these characters, all in runs, each candidate has, or the sum of their weights."""
        owner = np.searchsorted(self.all_starts, at, "right") - 1
        return np.bincount(owner, weights, minlength=len(self.all_starts))[self.free]

    def changes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(candidate, class before, class) of each character but the first of some candidates, without hyphens that don't count."""
        at, owner = ranges(self.starts[which] + 1, self.ends[which]), np.repeat(which, self.size[which] - 1)
        counts = (self.symbols[at] != 45) | ~self.plain[owner]
        at, owner = at[counts], owner[counts]
        return owner, _CLASS[self.symbols[at - 1]], _CLASS[self.symbols[at]]

    def ordinary(self) -> np.ndarray:
        """Counts of symbols, then of steps between classes by encoding, in candidates of fewer than ORDINARY characters."""
        left_out = ~self.free
        left_out[np.flatnonzero(self.free)[self.size >= ORDINARY]] = True
        symbols = np.bincount(self.symbols, minlength=129)
        symbols -= np.bincount(self.symbols[ranges(self.all_starts[left_out], self.all_ends[left_out])], minlength=129)
        mixed = np.flatnonzero((self.size < ORDINARY) & (self.encoding >= 0) & (_CLASSES_OF[self.encoding] > 1))
        owner, before, now = self.changes(mixed)
        cells = (self.encoding[owner] * CLASSES + before) * CLASSES + now
        return np.concatenate([symbols[:128] * (_CLASS[:128] > 0), np.bincount(cells, minlength=len(NAMES) * CLASSES * CLASSES)])

    def log_p(self, chain: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The logarithm of the p-value of 'ordinary' of each candidate, at most 0."""
        if not len(self.starts):
            return np.empty(0)
        within = chain[0][self.symbols]
        dashes = np.flatnonzero(self.symbols == 45)
        total = np.add.reduceat(within, self.all_starts)[self.free] - np.where(self.plain, self.in_runs(dashes, within[dashes]), 0.0)
        classes = _CLASSES_OF[self.encoding]
        mixed = np.flatnonzero((self.encoding >= 0) & (classes > 1))
        owner, before, now = self.changes(mixed)
        steps = np.bincount(owner, chain[1][self.encoding[owner], before, now], minlength=len(total))
        # all classes are as likely to begin with
        return np.minimum(0.0, total + np.where(classes > 1, steps - np.log(classes), 0.0) + self.n * np.log(_SIZES)[self.encoding])

    def length_class(self) -> np.ndarray:
        return np.floor(2 * np.log2(np.maximum(self.n, 1))).astype(np.int64)


def bins_of(log_p: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(-100 / math.log(10) * log_p), LAST_BIN).astype(np.int64)


def chain_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of the probabilities of each symbol within its class, and by encoding of each class after each class; 0 for what is in no run."""
    symbols, steps = counts[:128], counts[128:].reshape(len(NAMES), CLASSES, CLASSES).astype(float)
    steps = (steps + 1) / (steps.sum(axis=2, keepdims=True) + CLASSES)
    folded = np.bincount(_FOLDED, weights=symbols, minlength=128)
    within = np.ones(129)
    for letters in (_LOWER, _DIGITS, "+/-_"):
        at = list(letters.encode())
        within[at] = (folded[at] + 1) / (folded[at].sum() + len(at))
    within[:128] = within[_FOLDED]  # capitals have the frequencies of the small letters
    return np.log(within), np.log(steps)


def gamma_tails(shape: float, x: float) -> tuple[float, float]:
    """(lower, upper) regularised incomplete gamma functions, each accurate where it is small."""
    if x <= 0:
        return 0.0, 1.0
    front = math.exp(max(-700.0, -x + shape * math.log(x) - math.lgamma(shape)))
    if x < shape + 1:
        term = total = 1 / shape
        k = shape
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        low = min(1.0, total * front)
        return low, 1 - low
    b = x + 1 - shape
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - shape)
        b += 2
        d = 1 / ((a * d + b) or 1e-300)
        c = (b + a / c) or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-14:
            break
    high = min(1.0, front * h)
    return 1 - high, high


@lru_cache(maxsize=1 << 16)
def p_uniform(n: int, collisions: int, letters: int) -> float:
    """Upper tail of the chi-squared statistic under uniform letters; moments for n trials, so that it holds for short strings too."""
    if n < 2:
        return 1.0
    mean, var = letters - 1, 2 * (letters - 1) * (n - 1) / n
    x = letters / n * (collisions + n) - n
    return gamma_tails(mean * mean / var, x * mean / var)[1]


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(ranks: np.ndarray, letters: int) -> tuple[float, float, float]:
    """(p of uniformity, p of the runs test, p of the serial correlation) of a string of alphabet ranks."""
    n = len(ranks)
    counts = np.bincount(ranks, minlength=letters)
    collisions = int((counts.astype(np.int64) * (counts - 1)).sum())
    high = ranks >= letters // 2
    n1 = int(high.sum())
    n2 = n - n1
    if n1 and n2:
        runs = int((high[1:] != high[:-1]).sum()) + 1
        mean = 2 * n1 * n2 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = normal_two_sided(max(0.0, abs(runs - mean) - 0.5) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = max(2.0 ** (1 - n), 1e-300)
    x = ranks - ranks.mean()
    power = float((x * x).sum())
    r = float((x[1:] * x[:-1]).sum()) / power if power else 1.0
    p_serial = normal_two_sided((r + 1 / n) * math.sqrt(n))
    return p_uniform(n, collisions, letters), p_runs, p_serial


def groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about CHARS_AT_ONCE characters; nulls are empty."""
    texts: list[str] = []
    held = begin = 0
    for i, t in enumerate(batch.column(1)):
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held >= CHARS_AT_ONCE:
            yield begin, texts
            texts, held, begin = [], 0, i + 1
    if texts:
        yield begin, texts


_FOUND = "doc_id long, start long, length long, encoding string, p_uniform double, p_runs double, p_serial double, p_ordinary double, secret_hash string"


def scan(docs: DataFrame, fdr: float = FDR, random_level: float = RANDOM_LEVEL) -> DataFrame:
    """(doc_id, start, length, encoding, p_uniform, p_runs, p_serial, p_ordinary, secret_hash) of every secret; places in characters."""
    spark = docs.sparkSession
    small_batches(spark)
    source = named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    cells = 128 + len(NAMES) * CLASSES * CLASSES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        for batch in batches:
            for _, texts in groups(batch):
                counts += Runs(texts).ordinary()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(counts)], names=["cell", "n"])

    counts = np.zeros(cells, np.int64)
    for r in source.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # 353 rows
        counts[r["cell"]] = r["n"]
    if not counts.any():
        return spark.createDataFrame([], _FOUND)
    chain = spark.sparkContext.broadcast(chain_of(counts))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, int] = {}
        for batch in batches:
            for _, texts in groups(batch):
                runs = Runs(texts)
                known = runs.encoding >= 0
                cell = ((runs.encoding << 10) + runs.length_class() << 16) + bins_of(runs.log_p(chain.value))
                for c, n in zip(*(x.tolist() for x in np.unique(cell[known], return_counts=True))):
                    cells[c] = cells.get(c, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int64()), pa.array(list(cells.values()), pa.int64())], names=["cell", "n"])

    bins = source.mapInArrow(tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("c"))  # at most LAST_BIN + 1 for each class
    bins = bins.select(F.shiftright("cell", 16).alias("class"), F.col("cell").bitwiseAND(65535).alias("bin"), "c")
    whole = Window.partitionBy("class")
    bins = bins.withColumn("k", F.sum("c").over(whole.orderBy(F.desc("bin")))).withColumn("m", F.sum("c").over(whole))
    cut = bins.where(F.pow(F.lit(10.0), -F.col("bin") / 100) <= F.lit(fdr) * F.col("k") / F.col("m")).groupBy("class").agg(F.min("bin").alias("cut"))
    cuts = np.full(len(NAMES) << 10, LAST_BIN + 1, np.int64)
    for r in cut.collect():  # a row for each encoding and length class
        cuts[r["class"]] = r["cut"]
    shared = spark.sparkContext.broadcast(cuts)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for begin, texts in groups(batch):
                runs = Runs(texts)
                log_p = runs.log_p(chain.value)
                known = runs.encoding >= 0
                least = shared.value[np.where(known, (runs.encoding << 10) + runs.length_class(), 0)]
                for i in np.flatnonzero(known & (bins_of(log_p) >= least)).tolist():
                    name, row = NAMES[runs.encoding[i]], int(runs.row[i])
                    own = runs.symbols[runs.starts[i] : runs.ends[i]]
                    ranks = _RANK[name][own[own != 45] if runs.plain[i] else own].astype(np.int64)
                    tests = battery(ranks, len(ALPHABETS[name]))
                    start, length = int(runs.starts[i] - runs.offsets[row]), int(runs.size[i] + runs.padding[i])
                    digest = hashlib.sha256(texts[row][start : start + length].encode()).hexdigest()[:32]
                    if 1 - (1 - min(tests)) ** 3 >= random_level:
                        out.append((ids[begin + row], start, length, name.lower(), *tests, math.exp(max(-690.0, log_p[i])), digest))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * 4, pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return source.mapInArrow(find, _FOUND)
