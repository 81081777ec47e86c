"""Media payloads in content-addressed tar shards, with metadata columns from header-only range reads.

pack() hashes every payload in the JVM, sends each to the shard range of its digest, and writes each distinct payload once,
in the order of digests, so that a task that runs again writes the very same shard; a shard appears under its name only
when it is whole. Rows then carry digest, shard, offset and length instead of bytes. describe() reads nothing but the
headers at these offsets: PNG, GIF, BMP, JPEG, WebP, WAV and FLAC give type, width, height, channels, sample rate and
duration.

Defined cases: a null payload has no digest, shard or metadata; an empty one is stored with length 0 and is of type
application/octet-stream, as is whatever no header matches; a broken or cut header keeps its type with null metadata;
equal payloads and repeated rows share one place, whatever rows they are in; the payload column is dropped, all others
stay under their names, but those called as a column of the result (digest, shard, offset, length; media_type and so on)
give way to it. An empty table gives no rows and no shard.
"""

from __future__ import annotations

import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terseflow.llm.common import Names, materialize, neutral, shared_path, shuffle_parts

SHARD_BYTES = 256 << 20
BLOCK = 512
#: What is read at first; formats whose header lies further on read more, chunk by chunk.
HEADER_BYTES = 64


def filesystem(uri: str):  # noqa: ANN201
    """(file system, path) of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def member_header(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.GNU_FORMAT)


def pack(rows: DataFrame, payload_col: str, target: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """`rows` without the payload, with digest (SHA-256), shard, offset and length. Shards are written to `target`, by default in the shared folder."""
    spark = rows.sparkSession
    target = target or shared_path(spark, "shards")
    parts = shuffle_parts(spark)
    plain, names = neutral(rows)
    payload = names.of(payload_col)
    # rendering or reading the payloads may be dear, and three stages need them
    hashed = materialize(plain.withColumn("digest", F.sha2(F.col(payload).cast("binary"), 256)), "payloads")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(target)
        out, final, temporary, at, number, last = None, "", "", 0, 0, None
        done: list[tuple] = []

        def finish() -> pa.RecordBatch:
            out.write(b"\0" * (2 * BLOCK))
            out.close()
            fs.move(temporary, final)
            found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["digest", "shard", "offset", "length"])
            done.clear()
            return found

        for batch in batches:
            for part, digest, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if digest == last:
                    continue
                last, data = digest, payload.as_buffer()
                if out is not None and at + data.size > shard_bytes:
                    yield finish()
                    out, number = None, number + 1
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    final = f"{folder}/shard-{part:06d}-{number:05d}.tar"
                    temporary = f"{folder}/.{uuid.uuid4().hex}.tmp"
                    out, at = fs.open_output_stream(temporary), 0
                head = member_header(f"{digest[:2]}/{digest}", data.size)
                out.write(head)
                out.write(data)
                out.write(b"\0" * (-data.size % BLOCK))
                done.append((digest, final.rpartition("/")[2], at + len(head), data.size))
                at += len(head) + data.size + -data.size % BLOCK
        if out is not None:
            yield finish()

    part = (F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * parts / F.lit(1 << 32)).cast("int")
    sent = hashed.where("digest is not null").select(part.alias("part"), "digest", F.col(payload).cast("binary").alias("payload"))
    placed = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("digest").mapInArrow(write, "digest string, shard string, offset long, length long")
    placed = materialize(placed, "shard-index").withColumn("shard", F.concat(F.lit(f"{target}/"), "shard"))
    left = Names([n for i, n in enumerate(names.names) if f"c{i}" != payload])
    rest = hashed.drop(payload).toDF(*[f"c{i}" for i in range(len(left.names))], "digest")
    with_place = rest.where("digest is not null").join(placed, "digest")
    # rows without a payload would all meet in one task of the join
    bare = rest.where("digest is null").withColumns({k: F.lit(None).cast(t) for k, t in (("shard", "string"), ("offset", "long"), ("length", "long"))})
    return left.restore(with_place.unionByName(bare), new={k: F.col(k) for k in ("digest", "shard", "offset", "length")})


# -- headers -------------------------------------------------------------------------------------------------------

Read = Callable[[int, int], bytes]
Meta = tuple[str, int | None, int | None, int | None, int | None, float | None]


def _jpeg(read: Read, length: int) -> tuple[int, int, int] | None:
    at = 2
    while at + 4 <= length:
        head = read(at, 10)
        if len(head) < 4 or head[0] != 0xFF:
            return None
        if head[1] == 0xFF:
            at += 1
        elif 0xC0 <= head[1] <= 0xCF and head[1] not in (0xC4, 0xC8, 0xCC):
            if len(head) < 10:
                return None
            height, width, channels = struct.unpack(">HHB", head[5:10])
            return width, height, channels
        elif 0xD0 <= head[1] <= 0xD8 or head[1] == 0x01:
            at += 2
        else:
            at += 2 + struct.unpack(">H", head[2:4])[0]
    return None


def _wav(read: Read, length: int) -> tuple[int, int, float | None] | None:
    at, form = 12, None
    while at + 8 <= length:
        head = read(at, 24)
        size = struct.unpack("<I", head[4:8])[0]
        if head[:4] == b"fmt " and len(head) >= 24:
            form = struct.unpack("<HHIIH", head[8:22])
        if head[:4] == b"data" and form:
            return form[1], form[2], size / form[3] if form[3] else None
        at += 8 + size + size % 2
    return (form[1], form[2], None) if form else None


def describe_payload(read: Read, length: int) -> Meta:
    """(media type, width, height, channels, sample rate, seconds) from as few header bytes as the format allows."""
    head = read(0, min(HEADER_BYTES, length))
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n":
            width, height, _, color = struct.unpack(">IIBB", head[16:26])
            return "image/png", width, height, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}.get(color), None, None
        if head[:6] in (b"GIF87a", b"GIF89a"):
            return "image/gif", *struct.unpack("<HH", head[6:10]), 3, None, None
        if head[:2] == b"BM" and len(head) >= 30:
            width, height, _, bits = struct.unpack("<iiHH", head[18:30])
            return "image/bmp", width, abs(height), max(1, bits // 8), None, None
        if head[:3] == b"\xff\xd8\xff":
            return "image/jpeg", *(_jpeg(read, length) or (None, None, None)), None, None
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            if head[12:16] == b"VP8X":
                return "image/webp", 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little"), 4 if head[20] & 16 else 3, None, None
            if head[12:16] == b"VP8L":
                bits = int.from_bytes(head[21:25], "little")
                return "image/webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 4, None, None
            width, height = struct.unpack("<HH", head[26:30])
            return "image/webp", width & 0x3FFF, height & 0x3FFF, 3, None, None
        if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
            channels, rate, seconds = _wav(read, length) or (None, None, None)
            return "audio/wav", None, None, channels, rate, seconds
        if head[:4] == b"fLaC":
            bits = int.from_bytes(head[18:26], "big")
            rate = bits >> 44
            return "audio/flac", None, None, (bits >> 41 & 7) + 1, rate, (bits & (1 << 36) - 1) / rate if rate and len(head) >= 26 else None
    except (struct.error, IndexError):
        kind = {b"\x89P": "image/png", b"GI": "image/gif", b"BM": "image/bmp", b"\xff\xd8": "image/jpeg"}.get(head[:2]) or ("image/webp" if head[8:12] == b"WEBP" else "audio/wav")
        return kind, None, None, None, None, None
    return "application/octet-stream", None, None, None, None, None


META = "media_type string, width int, height int, channels int, sample_rate int, seconds double, header_bytes int"


def describe(rows: DataFrame) -> DataFrame:
    """`rows` of pack() with metadata columns; distinct payloads are read once, header by header, shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            found = []
            for shard, offset, length in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if shard != name:
                    fs, path = filesystem(shard)
                    name, source = shard, fs.open_input_file(path)
                taken = [0]

                def read(at: int, n: int, offset=offset, length=length, taken=taken) -> bytes:
                    n = max(0, min(n, length - at))
                    taken[0] += n
                    return source.read_at(n, offset + at) if n else b""

                found.append((*describe_payload(read, length), taken[0]))
            types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
            columns = [pa.array(c, t) for c, t in zip(zip(*found), types)] if found else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["__tf_digest", "media_type", "width", "height", "channels", "sample_rate", "seconds", "header_bytes"])

    plain, names = neutral(rows)
    digest, shard, offset, length = (F.col(names.of(k)) for k in ("digest", "shard", "offset", "length"))
    places = plain.where(digest.isNotNull()).select(digest.alias("__tf_digest"), shard.alias("shard"), offset.alias("offset"), length.alias("length")).dropDuplicates(["__tf_digest"])
    places = places.repartition("shard").sortWithinPartitions("shard", "offset")
    meta = places.mapInArrow(run, "__tf_digest string, " + META)
    new = [c.split() for c in META.split(", ")]
    found = plain.where(digest.isNotNull()).join(meta, digest == F.col("__tf_digest")).drop("__tf_digest")
    bare = plain.where(digest.isNull()).withColumns({k: F.lit(None).cast(t) for k, t in new})
    return names.restore(found.unionByName(bare), new={k: F.col(k) for k, _ in new})


# -- payloads of the embeddings table ------------------------------------------------------------------------------


def png(grey: np.ndarray) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = b"".join(b"\0" + row.tobytes() for row in grey)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", grey.shape[1], grey.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def wav(samples: np.ndarray, rate: int) -> bytes:
    data = samples.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def bmp(grey: np.ndarray) -> bytes:
    height, width = grey.shape
    pad = b"\0" * (-3 * width % 4)
    data = b"".join(np.repeat(row, 3).tobytes() + pad for row in grey[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(data), 2835, 2835, 0, 0) + data


def rendered(embeddings: DataFrame) -> DataFrame:
    """Every vector as a small media file in `payload`: by vec_id a PNG, a WAV or a BMP; null without a usable vector."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec_id, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array([v for v in values or [] if v is not None], float)
                if not len(x) or len(x) != len(values) or not np.isfinite(x).all():
                    out.append(None)
                    continue
                x = x / max(float(np.abs(x).max()), 1e-30)
                width = int(np.ceil(len(x) ** 0.5))
                grey = np.zeros(width * -(-len(x) // width), np.uint8)
                grey[: len(x)] = np.rint(127.5 + 127.5 * x)
                grey = grey.reshape(-1, width)
                out.append((png(grey), wav(np.rint(x * 32767), 8000), bmp(grey))[(vec_id or 0) % 3])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], names=["vec_id", "label", "payload"])

    return embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), F.col("label").cast("int")).mapInArrow(render, "vec_id long, label int, payload binary")


def unpacked(shard: str, offset: int, length: int) -> bytes:
    """One payload by its place."""
    fs, path = filesystem(shard)
    with fs.open_input_file(path) as source:
        return source.read_at(length, offset)
