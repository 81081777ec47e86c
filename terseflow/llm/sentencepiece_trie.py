"""SentencePiece encoding and decoding over a trie of distinct marked words with a shared forward table.

Texts are cut into marked words (a run of word marks and the characters up to the next one). The distinct words of a
batch are sorted, which lists the leaves of their trie in depth-first order; the forward table is kept on the stack, so
that a prefix common to neighbouring words is scored once.

The forward score of a prefix is the best sum of piece scores over its paths: the maximum, over all pieces that end where it
ends, of the score before the piece and the piece's own. For unigram models that is all (a character without a piece
scores as unknown, ten below the lowest piece). The public vocabulary is a merge (BPE) model: its scores are merge ranks,
and the plain best sum is not what the model encodes. There the same recursion admits a piece after another only if
merging their joined text gives the two pieces again; the maximum is then over the paths that merging can produce. For
both kinds the result equals the model's own encoder.

Defined cases: null text gives null ids, empty text none; characters outside the vocabulary become byte pieces; a word
of any length is one path in the trie, without recursion; equal texts and repeated rows get equal ids; of paths of equal
score that with the longer last piece wins; an empty table gives no rows; columns besides doc_id and text are not looked
at, whatever their names. Decoding joins the pieces, turns marks into blanks and drops the first blank, as the model's own
decoder does; malformed bytes become U+FFFD. A model of another kind, one without byte pieces, and one whose own encoding
of a probe differs (a normaliser that rewrites text) are refused with an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terseflow.llm.common import named, small_batches, tidy

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_UNIT = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
#: Distinct words whose ids a worker keeps between batches; beyond it only those that came more than once stay, two thirds as many at most.
KEPT_WORDS = 150_000
#: Rows encoded at once: bounded, so that a batch of long texts stays small in memory.
TEXTS_AT_ONCE = 2000
CHARS_AT_ONCE = 1 << 20


UNIGRAM, MERGE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = {1: lambda: (8, at), 5: lambda: (4, at), 2: lambda: varint(at)}[tag & 7]()
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def model_kind(data: bytes) -> int:
    """The model_type of the trainer_spec; unigram where none is given."""
    found = [v for n, spec in fields(data) if n == 2 for k, v in fields(spec) if k == 3]
    return found[-1] if found else UNIGRAM


class PieceTrie:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        with open(model_file, "rb") as f:
            kind = model_kind(f.read())
        if kind not in (UNIGRAM, MERGE):
            raise ValueError("only unigram and merge models are known")
        self.merges = kind == MERGE
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.size = size
        pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = [-1] * 256
        self.id_of: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i):
                self.bytes_of.append(b"")
            elif model.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.id_of[p] = i
                self.rank[p] = model.get_score(i)
                self.bytes_of.append(p.replace(MARK, " ").encode())
                if re.search(f"[^{MARK}]{MARK}", p) or ("\n" in p and len(p) > 1):
                    raise ValueError(f"piece {p!r} spans words, so words can't be encoded one by one")
        if min(self.byte_id) < 0:
            raise ValueError("the model has no byte pieces")
        # only pieces that merging their own text gives can be in a result of merging
        self.edges = {p: i for p, i in self.id_of.items() if not self.merges or len(p) == 1 or self.merged(p) == [p]}
        self.score = [0.0] * size
        self.suffixes: dict = {}  # a trie of the reversed pieces: character to [next characters, piece or -1]
        for p, i in self.edges.items():
            self.score[i] = self.rank[p]
            children = self.suffixes
            for c in reversed(p):
                node = children.setdefault(c, [{}, -1])
                children = node[0]
            node[1] = i
        self.unknown = min(self.rank.values()) - 10
        self.text_of = {i: p for p, i in self.edges.items()}
        self.follows: dict[int, bool] = {}
        self.newline = [self.id_of["\n"]] if "\n" in self.id_of else [self.byte_id[10]]
        self.slot_of: dict[str, int] = {}
        self.reset()
        probe = "ab the tokenization of wordings, 12 (x)"
        if self.encode([probe])[0].tolist() != model.encode(probe):
            raise ValueError("the model normalises text or has no word mark at the start")

    def reset(self) -> None:
        self.slot_of.clear()
        self.lengths = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)
        self.used = np.empty(0, np.int64)

    def forget(self) -> None:
        """Keep the words that were used most."""
        stay = np.argsort(-self.used, kind="stable")[: KEPT_WORDS * 2 // 3]
        stay = np.sort(stay[self.used[stay] > 1])
        words = list(self.slot_of)
        self.slot_of = {words[i]: n for n, i in enumerate(stay.tolist())}
        lengths, starts = self.lengths[stay].astype(np.int64), self.starts[stay]
        ends = np.cumsum(lengths)
        self.flat = self.flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        self.lengths, self.starts, self.used = lengths.astype(np.int32), ends - lengths, self.used[stay] // 2

    def merged(self, text: str) -> list[str]:
        """Merging as such: the adjacent pair of best rank, leftmost first, until none is a piece."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: int, right: int) -> bool:
        key = left << 22 | right
        known = self.follows.get(key)
        if known is None:
            a = self.text_of[left] if left < self.size else chr(left - self.size)
            b = self.text_of[right] if right < self.size else chr(right - self.size)
            known = self.merged(a + b) == [a, b]
            if len(self.follows) > 200_000:
                self.follows.clear()
            self.follows[key] = known
        return known

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the sorted distinct words."""
        out = []
        suffixes, follows, may_follow, size = self.suffixes, self.follows, self.may_follow, self.size
        merges, piece_score, unknown = self.merges, self.score, self.unknown
        # by prefix length, down the path of the trie: forward score, last piece of the best path and where it begins
        path: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        before = ""
        for word in words:
            n = len(word)
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, n + 1):
                children, at, ending = suffixes, end, []
                while at:
                    at -= 1
                    node = children.get(word[at])
                    if node is None:
                        break
                    children, piece = node
                    if piece >= 0:
                        ending.append((piece, at))
                if merges:
                    while ending:  # the longest first; when one is admitted, no shorter one is
                        piece, at = ending.pop()
                        total, left, _ = path[at]
                        if not at:
                            break
                        known = follows.get(left << 22 | piece)
                        if known or (known is None and may_follow(left, piece)):
                            break
                    else:
                        piece, at, total = 0, end - 1, None
                    path.append((path[at][0] + unknown, size + ord(word[at]), at) if total is None else (total + piece_score[piece], piece, at))
                else:
                    best = None if ending and ending[0][1] == end - 1 else (path[end - 1][0] + unknown, size + ord(word[end - 1]), end - 1)
                    for piece, at in ending:
                        value = path[at][0] + piece_score[piece]
                        if best is None or value >= best[0]:
                            best = value, piece, at
                    path.append(best)
            ids, at = [], n
            while at:
                _, p, at = path[at]
                if p < size:
                    ids.append(p)
                else:
                    ids += [self.byte_id[b] for b in reversed(chr(p - size).encode("utf-8", "replace"))]
            ids.reverse()
            out.append(ids)
            before = word
        return out

    def units(self, text: str) -> list[str]:
        """The marked words of a text; newlines are words of their own if no piece holds one."""
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return _UNIT.findall(MARK + text.replace(" ", MARK))
        if "\n" in text:
            return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
        return (MARK + text.replace(" ", " " + MARK)).split(" ")

    def learn(self, words: set[str]) -> None:
        fresh = sorted(w for w in words if w not in self.slot_of)
        if not fresh:
            return
        base = len(self.lengths)
        encoded = self.encode_words(fresh)
        self.slot_of.update(zip(fresh, range(base, base + len(fresh))))
        lengths = np.fromiter(map(len, encoded), np.int32, len(encoded))
        flat = np.fromiter((i for e in encoded for i in e), np.int32, int(lengths.sum()))
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])
        self.starts = np.concatenate([[0], np.cumsum(self.lengths[:-1], dtype=np.int64)])
        self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each)."""
        if len(self.slot_of) > KEPT_WORDS:
            self.forget()
        split = [self.units(t) for t in texts]
        self.learn({""}.union(*split))
        count = np.fromiter(map(len, split), np.int64, len(split))
        slot_of = self.slot_of
        slots = np.fromiter((slot_of[w] for s in split for w in s), np.int64, int(count.sum()))
        self.used += np.bincount(slots, minlength=len(self.used))
        lengths = self.lengths[slots].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[slots] - (ends - lengths), lengths) + np.arange(total)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])] if len(ends) else np.zeros(len(split) + 1, np.int64)
        return self.flat[at], bounds

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_TRIES: dict[str, PieceTrie] = {}


def trie(model_file: str) -> PieceTrie:
    """One for each worker process, kept between tasks."""
    if model_file not in _TRIES:
        _TRIES[model_file] = PieceTrie(model_file)
    return _TRIES[model_file]


def _groups(texts: pa.Array) -> Iterator[list[str | None]]:
    group: list[str | None] = []
    held = 0
    for t in texts:
        group.append(t.as_py())
        held += len(group[-1] or "")
        if held >= CHARS_AT_ONCE or len(group) >= TEXTS_AT_ONCE:
            yield group
            group, held = [], 0
    if group:
        yield group


def encode_documents(docs: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_tokens, token_ids, and round_trip: whether decoding gives the text again. One row for each document, no shuffle."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trie(model_file)
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1)):
                ids, bounds = model.encode([t or "" for t in group])
                flat, ends = ids.tolist(), bounds.tolist()
                same = [t is None or model.decode(flat[ends[i] : ends[i + 1]]) == t for i, t in enumerate(group)]
                null = pa.array([t is None for t in group])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()), mask=null)
                count = pa.array(np.diff(bounds), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), count, lists, pa.array(same)], names=["doc_id", "n_tokens", "token_ids", "round_trip"])
                at += len(group)
        model.reset()  # the worker lives on for other stages

    return named(docs, "doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and text of token_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trie(model_file)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return named(encoded, "doc_id", "token_ids").mapInArrow(tidy(run), "doc_id long, text string")
