import random
import struct

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from terseflow.llm import sentencepiece_trie as sp

MODEL = sentencepiece.SentencePieceProcessor(model_file=sp.DEFAULT_MODEL)


def own(texts):
    ids, bounds = sp.trie(sp.DEFAULT_MODEL).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_equals_the_models_encoder(vocabulary):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(vocabulary).capitalize() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(60)) for _ in range(30)]
    texts += ["", " ", "  two  blanks ", "line\nbreak\n\nend", "Étre über ñandú", "x" * 3000, "12.5% & more", "\U0001f600 smile", "tab\there", "▁mark"]
    assert own(texts) == MODEL.encode(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdetions THE.,éß\n", max_size=60))
def test_words_and_round_trip(text):
    ids = own([text])[0]
    assert ids == MODEL.encode(text)
    assert sp.trie(sp.DEFAULT_MODEL).decode(ids) == text


def test_documents(make):
    rows = [(1, None), (2, ""), (3, "the end"), (3, "the end"), (None, "a"), (4, "word " * 40_000)]
    docs = make(rows)
    found = sp.encode_documents(docs).collect()
    assert len(found) == 6 and all(r.round_trip for r in found)
    by = {r.doc_id: r for r in found}
    assert by[1].token_ids is None and by[1].n_tokens == 0 and by[2].token_ids == []
    assert by[4].token_ids == MODEL.encode(rows[-1][1])
    decoded = {r.doc_id: r.text for r in sp.decode_documents(sp.encode_documents(docs)).collect()}
    assert decoded[1] is None and decoded[3] == "the end" and decoded[4] == rows[-1][1]
    assert sp.encode_documents(make([])).count() == 0


def field(number, value):
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def written(path, pieces, kind, byte_pieces=True):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256 if byte_pieces else 0)], *pieces]
    body = b"".join(field(1, field(1, t.encode()) + field(2, score) + field(3, k)) for t, score, k in pieces)
    path.write_bytes(body + field(2, field(3, kind) + field(35, int(byte_pieces))) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)))
    return str(path)


def test_unigram_models_take_the_best_sum(tmp_path):
    """A hand-written unigram model: the same ids as its own encoder, or, where rounding decides between equal sums, the same sum."""
    rng = random.Random(1)
    texts = {*"abcde", sp.MARK} | {"".join(rng.choice("abcde") for _ in range(rng.randint(2, 4))) for _ in range(60)}
    texts |= {sp.MARK + t for t in sorted(texts)[:30] if t != sp.MARK}
    path = written(tmp_path / "unigram.model", [(t, -rng.uniform(2, 12), 1) for t in sorted(texts)], 1)
    model, trie = sentencepiece.SentencePieceProcessor(model_file=path), sp.PieceTrie(path)

    def total(ids):
        return sum(model.get_score(i) for i in ids)

    equal = 0
    for _ in range(500):
        text = "".join(rng.choice("aabbccdde  xé\n") for _ in range(rng.randint(0, 30)))
        ids, expected = trie.encode([text])[0].tolist(), model.encode(text)
        equal += ids == expected
        assert abs(total(ids) - total(expected)) < 1e-3 and sorted(i for i in ids if i < 259) == sorted(i for i in expected if i < 259)
        assert trie.decode(ids) == text
    assert equal > 490


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError):
        sp.PieceTrie(written(tmp_path / "word.model", [("a", -1.0, 1)], 3))
    with pytest.raises(ValueError):
        sp.PieceTrie(written(tmp_path / "plain.model", [("a", -1.0, 1)], 1, byte_pieces=False))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, [7], 8)], "doc_id long, text string, n_tokens int, token_ids array<int>, `a.b` int")
    found = sp.encode_documents(docs).collect()[0]
    assert found.token_ids == MODEL.encode("a b") and found.n_tokens == len(found.token_ids)
