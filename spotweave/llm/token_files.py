"""Token ids as flat files, read by memory map.

Each range of doc_ids becomes one set of files in the shared folder: ``ids`` (all ids of its
documents, unsigned 16-bit where the vocabulary allows, else 32-bit, little-endian), ``offsets`` (64-bit, one more
than documents: where each begins) and ``docs`` (each one's doc_id, 64-bit, and a byte that says whether it is
null).  Files get their names by rename, so a task that runs twice leaves one result.  Partition bases are prefix
sums over one count for each file; ``bases`` holds them (64-bit, one more than there are ranges).

There are more ranges the more data there are, and rows that share a doc_id (or have none) are dealt out by
their texts' hashes, in which order they stand.  Null texts are empty; an empty document has the end id
alone.  Null doc_ids come first.  Rows that share a doc_id are separate documents, and equal rows too.  An empty
table gives files without documents; long texts need no more than themselves and their ids.  Other columns,
whatever their names, are not stored.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, frugal, local_path, ranges, table

END = 1
PART = "part int, n_docs long, n_ids long"


def _open_out(uri: str):
    """A stream to a file of the shared folder, and what gives it its name when all is written."""
    path = local_path(uri)
    part = f"{uri}.{uuid.uuid4().hex}.tmp"
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = local_path(part)
        return open(own, "wb"), lambda: os.replace(own, path)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"

    def named():
        if store.get_file_info(path).type != fs.FileType.NotFound:
            store.delete_file(path)
        store.move(own, path)

    return store.open_output_stream(own), named


_DOC = np.dtype([("id", "<i8"), ("null", "u1")])


class Stored:
    """A file's numbers: by memory map, or where the folder isn't mounted by reading the range that is asked for."""

    def __init__(self, uri: str, dtype):
        self.kind, path = np.dtype(dtype), local_path(uri)
        if path is None:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            self.file, self.map = store.open_input_file(path), None
            self.size = self.file.size() // self.kind.itemsize
        else:
            self.size = os.path.getsize(path) // self.kind.itemsize
            self.map = np.memmap(path, self.kind, "r") if self.size else np.empty(0, self.kind)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.map is not None:
            return np.asarray(self.map[part])
        a, z, _ = part.indices(self.size)
        return np.frombuffer(self.file.read_at(max(0, z - a) * self.kind.itemsize, a * self.kind.itemsize), self.kind)


def write_token_files(df: DataFrame, tokenizer: str, folder: str, end: int = END, vocabulary: int = 1 << 16) -> DataFrame:
    """Write doc_id, text of df; gives part, n_docs, n_ids, base (ids in the parts before) for each file."""
    spark = df.sparkSession
    bounded_batches(spark)
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches):
        from .tokens import encoder

        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        names = [f"{folder}/{part:06d}.{x}" for x in ("ids", "offsets", "docs")]
        (ids_to, ids_done), (off_to, off_done), (doc_to, doc_done) = map(_open_out, names)
        n_docs = n_ids = 0
        off_to.write(np.zeros(1, "<u8").tobytes())
        for b in batches:
            if not b.num_rows:
                continue
            ids, ends = coder.encode(b.column("text"))
            if len(ids) and int(ids.max()) >= vocabulary:
                raise ValueError("an id does not fit the files' unit")
            rows = len(ends)
            with_end = np.full(len(ids) + rows, end, kind)
            keep = np.ones(len(with_end), bool)
            own = ends + np.arange(1, rows + 1)
            keep[own - 1] = False
            with_end[keep] = ids
            ids_to.write(with_end.tobytes())
            off_to.write((own + n_ids).astype("<u8").tobytes())
            docs = np.zeros(rows, _DOC)
            docs["id"] = np.asarray(b.column("doc_id").fill_null(0))
            docs["null"] = np.asarray(b.column("doc_id").is_null())
            doc_to.write(docs.tobytes())
            n_docs, n_ids = n_docs + rows, n_ids + len(with_end)
        for f in (ids_to, off_to, doc_to):
            f.close()
        for done in (ids_done, off_done, doc_done):
            done()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([n_docs]), "n_ids": pa.array([n_ids])})

    keyed = df.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    ordered = keyed.repartitionByRange(ranges(df), "doc_id", "tag").sortWithinPartitions("doc_id", "tag", "text").select("doc_id", "text")
    # one row for each file: its bases are the prefix sums
    made = sorted(tuple(r) for r in ordered.mapInArrow(frugal(run), PART).collect())
    base, rows = 0, []
    for part, docs, ids in made:
        rows.append((part, docs, ids, base))
        base += ids
    to, named = _open_out(f"{folder}/bases")
    to.write(np.array([*(r[3] for r in rows), base], "<u8").tobytes())
    to.close()
    named()
    spread = spark.createDataFrame(rows, PART + ", base long")
    return spread.repartition(max(1, len(rows)), "part")


def read_token_files(parts: DataFrame, folder: str, vocabulary: int = 1 << 16) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                at = f"{folder}/{row['part']:06d}"
                ids, off, docs = Stored(at + ".ids", kind), Stored(at + ".offsets", "<u8"), Stored(at + ".docs", _DOC)
                for lo in range(0, docs.size, 1024):
                    some = docs[lo : lo + 1024]
                    edge = off[lo : lo + len(some) + 1].astype(np.int64)
                    own = edge - edge[0]
                    raw = memoryview(ids[int(edge[0]) : int(edge[-1])].astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(own[:-1].tolist(), own[1:].tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(some["id"], pa.int64(), mask=some["null"] > 0),
                        "start": pa.array(edge[:-1] + row["base"]),
                        "n_tokens": pa.array(np.diff(edge)),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    })

    return parts.mapInArrow(frugal(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_path(spark, "token-files")
    docs = table(spark, sf_dir, "documents")
    parts = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_token_files(parts, folder)
