"""Media columns: payloads as FLAC streams, read back as checked PCM blocks.

``encode_media`` turns a text or binary column into FLAC bytes, ``store_media`` writes them to the shared folder and
gives the written table, ``decode_media`` reads streams back and computes features, ``pcm_blocks`` writes the samples as
blocks with sample and byte offsets, from which ``flac.read_from`` can start anywhere (by the streams' seek
tables).  Rows are mapped in place: no shuffle, memory bounded by one row and one batch.

Payload: the text's UTF-8 bytes (null: none) and bytes 255 up to a positive multiple of 576.  Equal
texts give equal values.  Repeated rows and other columns stay; columns of added names are replaced.
A null media value decodes to nulls.  An empty table gives an empty one.  Long texts are coded some thousand
frames at a time.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import flac
from .common import bounded_batches, fitted, frugal, materialize, size_of, table

L, S = T.LongType(), T.StringType()
FEATURES = [("payload_bytes", L), ("payload_sha256", S), ("tail_crc32", L), ("media_bytes", L), ("media_sha256", S), ("feature", S)]


def payload(text: str | bytes | None) -> bytes:
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // flac.BLOCK)) * flac.BLOCK - len(raw))


def feature(pcm: bytes) -> str:
    """Root mean square, zero crossings a thousand samples, and peak of the samples."""
    x = (np.frombuffer(pcm, np.uint8) ^ 128).view(np.int8).astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"rms={(int((x * x).sum()) / len(x)) ** 0.5:.4f};zc={crossings * 1000 / len(x):.3f};peak={int(np.abs(x).max())}"


def _groups(sizes: list[int]):
    """Runs of rows of a few MB."""
    lo, n = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and n + s > 4 * flac.SLICE:
            yield lo, i
            lo, n = i, 0
        n += s
    if sizes:
        yield lo, len(sizes)


def encode_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df and n_bytes (before padding) and the FLAC stream of its column ``text``, which goes."""
    bounded_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (text, media, "n_bytes")]
    schema = T.StructType([*kept, T.StructField("n_bytes", L), T.StructField(media, T.BinaryType())])
    names = [f.name for f in kept]
    spare = fitted(df.select(*names, text), 4 * size_of(df))

    def run(batches):
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            for lo, hi in _groups([len(t or "") for t in texts]):
                loads = [payload(t) for t in texts[lo:hi]]
                size = [0 if t is None else len(t) if isinstance(t, bytes) else len(t.encode("utf-8", "surrogatepass")) for t in texts[lo:hi]]
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(size, pa.int64()), pa.array(flac.encode_many(loads), pa.binary())], [*names, "n_bytes", media])

    return spare.mapInArrow(frugal(run), schema)


def decode_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df without the stream, with what its decoded samples give."""
    bounded_batches(df.sparkSession)
    new = [n for n, _ in FEATURES]
    kept = [f for f in df.schema.fields if f.name != media and f.name not in new]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in FEATURES)])

    def run(batches):
        for b in batches:
            streams = b.column(len(names)).to_pylist()
            for lo, hi in _groups([len(m or b"") for m in streams]):
                there = [m for m in streams[lo:hi] if m is not None]
                pcm = iter(flac.decode_many(there))
                rows = []
                for m in streams[lo:hi]:
                    if m is None:
                        rows.append((None,) * 6)
                        continue
                    p = next(pcm)
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(p)))
                cols = [pa.array(c, pa.int64() if t == L else pa.string()) for c, (_, t) in zip(zip(*rows), FEATURES)]
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[: len(names)], *cols], [*names, *new])

    return df.select(*names, media).mapInArrow(frugal(run), schema)


def pcm_blocks(df: DataFrame, key: str = "doc_id", media: str = "media", frames: int = flac.SEEK_EVERY) -> DataFrame:
    """Blocks of decoded samples: key, block, sample_offset, n_samples, byte_offset (in the stream), pcm."""
    bounded_batches(df.sparkSession)
    schema = T.StructType([df.schema[key], *(T.StructField(n, L) for n in ("block", "sample_offset", "n_samples", "byte_offset")), T.StructField("pcm", T.BinaryType())])
    names, span = schema.names, frames * flac.BLOCK

    def run(batches):
        for b in batches:
            for k, m in zip(b.column(0), b.column(1).to_pylist()):
                if m is None:
                    continue
                pcm, starts = flac.decode_with_offsets([m])[0]
                at = list(range(0, len(pcm), span))
                part = [pcm[a : a + span] for a in at]
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(at), b.schema.field(0).type), pa.array(list(range(len(at))), pa.int64()), pa.array(at, pa.int64()), pa.array([len(p) for p in part], pa.int64()), pa.array([int(starts[a // flac.BLOCK]) for a in at], pa.int64()), pa.array(part, pa.binary())], names)

    return df.select(key, media).mapInArrow(frugal(run), schema)


def store_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``encode_media``'s table, written to the shared folder, as it is read back from there.  Streams that repeat
    others near them take little room."""
    packed = {"compression": "zstd", "parquet.compression.codec.zstd.level": 9, "parquet.page.size": 8 << 20}
    return materialize(encode_media(df, text, media), "media", **packed)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return decode_media(stored).select("doc_id", "n_bytes", *(n for n, _ in FEATURES))
