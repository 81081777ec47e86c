import hashlib
import tarfile

import numpy as np
from pyspark.sql import functions as F

from terseflow.llm import media_shards as ms


def test_pack_and_describe_round_trip(spark, tmp_path):
    grey = np.arange(60, dtype=np.uint8).reshape(6, 10)
    payloads = [ms.png(grey), ms.wav(np.arange(100), 8000), ms.bmp(grey), b"", b"no media", None, ms.png(grey), b"\x89PNG\r\n\x1a\ncut", b"GIF89a\x05\x00\x07\x00\x00", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x09\x00\x0c\x03"]
    rows = [(i, p, "kept") for i, p in enumerate(payloads)]
    docs = spark.createDataFrame(rows, "id long, payload binary, media_name string")
    packed = ms.pack(docs, "payload", f"file://{tmp_path}/shards", shard_bytes=3000)
    found = {r.id: r for r in ms.describe(packed).collect()}
    assert len(found) == len(rows)
    for i, p in enumerate(payloads):
        r = found[i]
        if p is None:
            assert (r.digest, r.shard, r.media_type) == (None, None, None)
            continue
        assert r.digest == hashlib.sha256(p).hexdigest() and r.length == len(p) and r.media_name == "kept"
        assert ms.unpacked(r.shard, r.offset, r.length) == p
        assert r.header_bytes <= 128
    assert (found[0].shard, found[0].offset) == (found[6].shard, found[6].offset)
    what = {i: (r.media_type, r.width, r.height, r.channels, r.sample_rate) for i, r in found.items()}
    assert what[0] == ("image/png", 10, 6, 1, None) and what[2] == ("image/bmp", 10, 6, 3, None)
    assert what[1] == ("audio/wav", None, None, 1, 8000) and found[1].seconds == 100 / 8000
    assert what[3][0] == what[4][0] == "application/octet-stream" and what[7] == ("image/png", None, None, None, None)
    assert what[8] == ("image/gif", 5, 7, 3, None) and what[9] == ("image/jpeg", 12, 9, 3, None)
    members = {}
    for shard in {r.shard for r in found.values() if r.shard}:
        with tarfile.open(shard.removeprefix("file://")) as tar:
            for m in tar.getmembers():
                assert m.name not in members
                members[m.name] = tar.extractfile(m).read()
    assert members == {f"{hashlib.sha256(p).hexdigest()[:2]}/{hashlib.sha256(p).hexdigest()}": p for p in payloads if p is not None}


def test_writing_again_gives_the_same_shards(spark, tmp_path):
    docs = spark.range(50).select("id", F.encode(F.concat(F.lit("p"), F.col("id").cast("string")), "utf-8").alias("payload"))
    places = [{(r.digest, r.offset) for r in ms.pack(docs, "payload", f"{tmp_path}/s").collect()} for _ in range(2)]
    assert places[0] == places[1]
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.startswith(".")]


def test_empty_table_and_bad_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert ms.describe(ms.pack(ms.rendered(spark.createDataFrame([], schema)), "payload")).count() == 0
    rows = [(1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [float("nan")], 1), (None, [1.0, -1.0, 0.5], None)]
    found = {r.vec_id: r.media_type for r in ms.describe(ms.pack(ms.rendered(spark.createDataFrame(rows, schema)), "payload")).collect()}
    assert found == {1: None, 2: None, 3: None, 4: None, None: "image/png"}


def test_clashing_columns(spark, tmp_path):
    rows = [(1, b"one", 5, "w", 7, "s"), (2, None, 6, "x", 8, "t"), (2, None, 6, "x", 8, "t"), (3, b"one", 5, "y", 9, "u")]
    docs = spark.createDataFrame(rows, "id long, payload binary, length int, width string, `a.b` int, Digest string")
    packed = ms.pack(docs, "payload", f"{tmp_path}/s")
    assert packed.columns == ["id", "width", "a.b", "digest", "shard", "offset", "length"]
    found = sorted(ms.describe(packed).select("id", F.col("`a.b`").alias("ab"), "length", "media_type", "width").collect())
    assert [tuple(r) for r in found] == [(1, 7, 3, "application/octet-stream", None), (2, 8, None, None, None), (2, 8, None, None, None), (3, 9, 3, "application/octet-stream", None)]
