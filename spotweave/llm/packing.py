"""Order-preserving packing by dynamic programming.

Documents, in the order of their ids, form one stream of tokens.  A sequence is a window of at
most ``length`` of them; windows follow one another, so the packing is the choice of cuts.
Cuts stand at ends of documents (free) or, for a penalty, at ends of sentences; only in a sentence that is longer
than a sequence, a fixed grid of cuts is allowed too, at a higher penalty.  With f(j) the least cost
of all windows that end at cut j,

    f(j) = penalty(j) + SEQUENCE_COST + min over i of f(i) + padding(i, j),

where padding is ``length`` less the window's tokens, or nothing at a power of two.  The first
form needs the least f(i) + pos(i) over a sliding range of positions, which a monotone queue
keeps; cuts that lie a power of two apart are found by binary search for all cuts at once.

The stream is dealt out by ranges of doc_id (of the texts' hashes, where doc_ids are equal), more of them the more
data there are, and solved in blocks of BLOCK tokens, which bounds memory.  A block gives out its windows but for
the last few sequences' worth of tokens, which the next block begins with: no cut is made because a block ends, and
only each range may end in a part-filled sequence.  A long document goes through as many blocks as it needs.

Null and empty texts give the end id alone.  Null doc_ids come first; rows of one doc_id are separate
documents, and equal rows too.  An empty table gives no piece.  Columns other than doc_id and text are not kept.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, materialize, ranges, table

LENGTH = 1024
END = 0
BLOCK = 1 << 20
SENTENCE_PENALTY = 8.0
GRID = 64
GRID_PENALTY = 48.0
#: What a further sequence costs: short ones without padding are taken only where they save more than that.
SEQUENCE_COST = 256.0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, own_sequence long, offset long"


def best_cuts(pos: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Positions of the best windows' ends.  pos: the possible cuts, ascending, beginning with
    0, no two further apart than length; penalty: each one's cost.  The last cut is taken."""
    # pairs of cuts a power of two apart, by their second
    first, second = [], []
    for k in range(length.bit_length()):
        if 1 << k < length:  # a full window has no padding anyway
            i = np.searchsorted(pos, pos - (1 << k))
            i[i == len(pos)] = 0
            j = np.flatnonzero(pos[i] == pos - (1 << k))
            first.append(i[j])
            second.append(j)
    first, second = np.concatenate(first), np.concatenate(second)
    order = np.argsort(second, kind="stable")
    first = first[order].tolist()
    upto = np.searchsorted(second[order], np.arange(len(pos)), "right").tolist()
    oldest = np.searchsorted(pos, pos - length).tolist()
    at, cost = pos.tolist(), (penalty + SEQUENCE_COST).tolist()
    best, back = [0.0] * len(at), [0] * len(at)
    queue = [0] * len(at)  # cuts, by ascending key
    key = [0.0] * len(at)  # f(i) + pos(i)
    head, tail = 0, 1
    for j in range(1, len(at)):
        p, old = at[j], oldest[j]
        while queue[head] < old:
            head += 1
        i = queue[head]
        least = key[i] + length - p
        for k in first[upto[j - 1] : upto[j]]:
            if best[k] < least:
                least, i = best[k], k
        least += cost[j]
        best[j], back[j] = least, i
        least += p
        key[j] = least
        while tail > head and key[queue[tail - 1]] >= least:
            tail -= 1
        queue[tail] = j
        tail += 1
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def _candidates(ids: np.ndarray, sentence: np.ndarray, doc_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Possible cuts and their penalties; both ends of ids are among them."""
    n = len(ids)
    cost = np.full(n + 1, np.inf)
    ends = np.flatnonzero(sentence[ids]) + 1
    cost[ends] = SENTENCE_PENALTY
    cost[doc_ends] = 0
    cost[0] = cost[n] = 0
    known = np.flatnonzero(cost < np.inf)
    gap = np.diff(known)
    grid = min(GRID, length)
    for i in np.flatnonzero(gap > length).tolist():
        cost[known[i] + grid : known[i + 1] : grid] = GRID_PENALTY
    known = np.flatnonzero(cost < np.inf)
    return known, cost[known]


@lru_cache(maxsize=2)
def _sentence_ends(tokenizer: str) -> np.ndarray:
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(tokenizer).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, bool)
    for token, i in vocab.items():
        out[i] = token[-1:] == "Ċ" or token.rstrip("\"')]}")[-1:] in (".", "!", "?")  # Ċ: a line's end in byte-level vocabularies
    return out


def pack(df: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, block: int | None = None) -> DataFrame:
    """Pieces of the documents (doc_id, text) of df, with their places in sequences."""
    spark = df.sparkSession
    bounded_batches(spark)
    block = max(block or BLOCK, 16 * length)

    def run(batches):
        from .tokens import encoder

        coder, part, sentence = encoder(tokenizer), TaskContext.get().partitionId(), _sentence_ends(tokenizer)
        sequence = 0
        held: list[tuple] = []  # doc_id, start in the document, the document's tokens, ids, whether they end it
        n_held = 0

        def solve(last: bool):
            """The pieces of the windows that are settled; what is left stays held."""
            nonlocal sequence, n_held
            ids = np.concatenate([h[3] for h in held])
            size = np.array([len(h[3]) for h in held])
            edges = np.cumsum(size)
            pos, cost = _candidates(ids, sentence, edges[[h[4] for h in held]], length)
            cuts = np.array(best_cuts(pos, cost, length), np.int64)
            if not last:
                cuts = cuts[cuts <= len(ids) - 8 * length]
            used = int(cuts[-1])
            bounds = np.union1d(cuts, edges[edges < used])
            begins = np.concatenate([[0], bounds[:-1]])
            of_doc = np.searchsorted(edges, begins, "right")
            of_cut = np.searchsorted(cuts, begins, "right")
            doc_begin = edges - size
            seq_begin = np.concatenate([[0], cuts[:-1]])
            raw = memoryview(ids.astype("<u4").tobytes())
            out = pa.RecordBatch.from_pydict({
                "doc_id": pa.array([held[d][0] for d in of_doc.tolist()], pa.int64()),
                "start": pa.array(begins - doc_begin[of_doc] + np.array([h[1] for h in held], np.int64)[of_doc]),
                "length": pa.array(bounds - begins),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(begins.tolist(), bounds.tolist())], pa.int64()),
                "doc_tokens": pa.array(np.array([h[2] for h in held], np.int64)[of_doc]),
                "part": pa.array(np.full(len(begins), part, np.int32)),
                "own_sequence": pa.array(of_cut + sequence),
                "offset": pa.array(begins - seq_begin[of_cut]),
            })
            sequence += len(cuts)
            kept = int(np.searchsorted(edges, used, "right"))
            del held[:kept]
            if held:
                doc, lo, n, own, ends = held[0]
                gone = used - int(doc_begin[kept])
                held[0] = (doc, lo + gone, n, own[gone:].copy(), ends)
            n_held = len(ids) - used
            return out

        for b in batches:
            if not b.num_rows:
                continue
            ids, ends = coder.encode(b.column("text"))
            begin = 0
            for doc, stop in zip(b.column("doc_id").to_pylist(), ends.tolist()):
                n, lo = stop - begin + 1, 0
                while lo < n:
                    some = min(n - lo, block - n_held)
                    own = ids[begin + lo : min(begin + lo + some, stop)]
                    lo += some
                    held.append((doc, lo - some, n, np.append(own, np.uint32(end)) if lo == n else own.copy(), lo == n))
                    n_held += some
                    if n_held >= block:
                        yield solve(False)
                begin = stop
        if held:
            yield solve(True)

    # rows of one doc_id stand by their texts' hashes
    keyed = df.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    ordered = keyed.repartitionByRange(ranges(df), "doc_id", "tag").sortWithinPartitions("doc_id", "tag", "text").select("doc_id", "text")
    pieces = materialize(ordered.mapInArrow(frugal(run), PIECES), "packed")
    # one row for each range of doc_ids: sequences before it
    counts = sorted((r[0], r[1]) for r in pieces.groupBy("part").agg(F.max("own_sequence") + 1).collect())
    bases, total = [], 0
    for part, n in counts:
        bases.append((part, total))
        total += n
    base = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    return pieces.join(base, "part").withColumn("sequence_id", F.col("own_sequence") + F.col("base")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
