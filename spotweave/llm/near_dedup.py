"""Near-duplicates by improved consistent weighted sampling.

1. Documents are written in blocks, an Arrow batch each: their compressed texts, and each one's number, doc_id and
   128-bit digest of its folded words.  Exact copies (equal digests) are one node, named by its least number.
2. A document's features are its shingles of SHINGLE folded words (all its words, if fewer) with weight
   tf x idf.  Document frequencies are counted over all documents and all shingles: each block sends its distinct
   shingles with their counts (so a shingle of all documents is one entry a block), dealt out by their
   leading bits to as many groups as the corpus needs, 32 further bits naming a shingle in its group.  So two
   shingles are mixed up only if 32 bits + log2(groups) agree: with GROUP_BYTES a group holds 2 million
   entries at most, and a shingle meets a foreign one with a chance under 0.0005 at every size of the corpus.  The frequency
   goes back to the block as a byte, its logarithm in steps of 1/STEPS octave (6 % at most from the true one).
   What one of RARE documents or fewer has is rare, and all that is rare weighs the same.  Without that bound a
   group of copies made its own shingles lighter than the words in which a copy differs, the more so the larger
   the group and the corpus, and near copies were lost.
3. Every node is sampled BANDS x ROWS times (Ioffe's scheme: the chance that two samples agree is
   the weighted Jaccard similarity); ROWS samples make a band's key.
4. Nodes that share a band's key are candidates.  In each bucket all are compared with the least node, its hub; hubs
   of large buckets are salted.  Where that leaves a bucket in more than one component, small buckets
   compare all pairs of different components.  In large ones everything outside the hub's component is compared with
   all: members are dealt into blocks of bounded bytes, and an inverted index over a block's shingles gives a
   node's overlaps with all of it at once.  Links inside one component add nothing to the classes and
   are not made; no link between two components is left out.
5. Every candidate pair is verified by the weighted Jaccard similarity of its whole texts.
6. Components by large-star and small-star steps, cut by written tables.

The result has one row per document.  Documents without words (null, empty) are classes of their own.
Null doc_ids rank last.  Of rows with equal doc_id and text ``drop_near_duplicates`` keeps one.  Long texts
need no more than themselves; an empty table gives an empty one; other columns, whatever their names,
are kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop, fitted, frugal, materialize, row_tag, size_of, table
from .decontaminate import words_of
from .shingles import WordHashes, mix, runs

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
#: Steps of an octave in which document frequencies are told.
STEPS = 6
#: Bytes of entries in a group that counts document frequencies.
GROUP_BYTES = 8 << 20
#: A shingle that at most one of so many documents has is rare; rarer ones weigh no more.
RARE = 200
SMALL = 32
#: Nodes that meet one copy of their hub.
AT_HUB = 256
#: Compressed bytes of a block's members, and of those compared with it.
BLOCK_BYTES, QUERY_BYTES = 4 << 20, 4 << 20


def shingles_of(raw: bytes, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles' hashes, ascending, and how often each occurs."""
    words = hashes(words_of(raw))
    return np.unique(runs(words, min(SHINGLE, len(words))) if len(words) else words, return_counts=True)


def _gamma2(p: np.ndarray) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, by Newton's method."""
    x = np.where(p < 0.5, np.sqrt(2 * p), 1 - np.log1p(-p) + np.log(2 - np.log1p(-p)))
    for _ in range(60):
        step = (1 - (1 + x) * np.exp(-x) - p) / (x * np.exp(-x))
        x = np.maximum(x - np.clip(step, -1, 1), x / 4)
    return x


@lru_cache(maxsize=1)
def _quantiles() -> np.ndarray:
    return _gamma2((np.arange(1 << 16) + 0.5) / (1 << 16))


class Sampler:
    def __init__(self, n: int = BANDS * ROWS):
        g = _quantiles()
        self.r, self.inverse, self.ln_c = g.astype(np.float32), (1 / g).astype(np.float32), np.log(g).astype(np.float32)
        self.seeds = mix(np.arange(1, n + 1, dtype=np.uint64), 7)[:, None]

    def __call__(self, s: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The samples (their hashes) of the weighted set."""
        ln_w = np.log(weight).astype(np.float32)
        out = np.empty(len(self.seeds), np.uint64)
        step = max(1, (1 << 18) // max(1, len(s)))
        for lo in range(0, len(out), step):
            x = s[None, :] ^ self.seeds[lo : lo + step]  # both are well mixed: two multiplications are enough
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            a = (x & np.uint64(0xFFFF)).astype(np.int32)
            r, beta = self.r[a], (x >> np.uint64(32)).astype(np.float32) * np.float32(2.0**-32)
            t = np.floor(ln_w * self.inverse[a] + beta)
            ln_a = self.ln_c[(x >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int32)] - r * (t - beta + 1)
            at = ln_a.argmin(1)
            own = np.arange(len(at))
            out[lo : lo + step] = mix(s[at] ^ t[own, at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of (ascending hashes, weights)."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    low = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    top = float(a[1].sum() + b[1].sum()) - low
    return low / top if top else 0.0


_ROW = pa.struct([("rid", pa.int64()), ("nul", pa.bool_()), ("doc", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
_BLOCK = "block long, rows array<struct<rid:long,nul:boolean,doc:long,t1:long,t2:long,h1:long,h2:long>>, sizes binary, pressed binary"


def _blocks(docs: DataFrame) -> DataFrame:
    """A row for each block of documents; written."""

    def run(batches):
        press, part = zstandard.ZstdCompressor(3), TaskContext.get().partitionId()
        for i, b in enumerate(b for b in batches if b.num_rows):
            block = part << 24 | i
            rows, texts = [], []
            for j, (nul, doc, t1, t2, t) in enumerate(zip(*(b.column(c).to_pylist() for c in ("nul", "doc", "t1", "t2", "text")))):
                h1 = h2 = None
                raw = (t or "").encode("utf-8", "surrogatepass")
                words = words_of(raw)
                if words:
                    d = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), ">i8")
                    h1, h2 = int(d[0]), int(d[1])
                rows.append({"rid": block << 10 | j, "nul": nul, "doc": doc, "t1": t1, "t2": t2, "h1": h1, "h2": h2})
                texts.append(raw)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([rows], pa.list_(_ROW)), pa.array([sizes.tobytes()], pa.binary()), pa.array([press.compress(b"".join(texts))], pa.binary())], ["block", "rows", "sizes", "pressed"])

    t1, t2 = row_tag(F.col("text"))
    keyed = docs.select(F.col("doc_id").isNull().alias("nul"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc"), t1.alias("t1"), t2.alias("t2"), "text")
    return materialize(fitted(keyed, size_of(docs)).mapInArrow(frugal(run), _BLOCK), "blocks")  # fitted first: a task numbers its own blocks


def _texts(sizes: bytes, pressed: bytes) -> list[bytes]:
    raw, size = memoryview(zstandard.ZstdDecompressor().decompress(pressed)), np.frombuffer(sizes, np.int64)
    end = np.cumsum(size)
    return [bytes(raw[a:z]) for a, z in zip((end - size).tolist(), end.tolist())]


_NONE = np.empty(0, np.uint64)


def _shingled(sizes: bytes, pressed: bytes, hashes: WordHashes):
    """A block's texts; each one's distinct shingles and their counts; the block's distinct shingles, ascending, and
    where each document's shingles stand among them."""
    texts = _texts(sizes, pressed)
    sets = [shingles_of(t, hashes) for t in texts]
    distinct, inverse = np.unique(np.concatenate([s for s, _ in sets]) if sets else _NONE, return_inverse=True)
    ends = np.cumsum([len(s) for s, _ in sets])
    return texts, sets, distinct, inverse, ends


def _frequencies(blocks: DataFrame) -> DataFrame:
    """block, p, codes: for the block's distinct shingles of group p, ascending, the codes of their document frequencies."""
    bits = max(1, (2 * size_of(blocks) // GROUP_BYTES).bit_length())
    schema = "p int, block long, names binary, at binary, n binary"

    def emit(batches):
        hashes = WordHashes()
        for b in batches:
            for block, sizes, pressed in zip(*(b.column(c).to_pylist() for c in ("block", "sizes", "pressed"))):
                _, _, distinct, inverse, _ = _shingled(sizes, pressed, hashes)
                if not len(distinct):
                    continue
                n = np.bincount(inverse).astype(np.uint32)
                group = (distinct >> np.uint64(64 - bits)).astype(np.int32)
                names = (distinct >> np.uint64(32 - bits)).astype(np.uint32)
                edge = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [len(group)]
                cols = [[], [], [], []]
                for a, z in zip(edge[:-1], edge[1:]):
                    more = np.flatnonzero(n[a:z] > 1).astype(np.uint32)
                    for c, v in zip(cols, (int(group[a]), names[a:z].tobytes(), more.tobytes(), n[a:z][more].tobytes())):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([block] * len(cols[0]), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["p", "block", "names", "at", "n"])

    def count(t: pa.Table) -> pa.Table:
        names = [np.frombuffer(x, np.uint32) for x in t["names"].to_pylist()]
        end = np.cumsum([len(x) for x in names])
        flat = np.concatenate(names)
        weight = np.ones(len(flat))
        for z, x, at, n in zip(end.tolist(), names, t["at"].to_pylist(), t["n"].to_pylist()):
            weight[z - len(x) + np.frombuffer(at, np.uint32).astype(np.int64)] = np.frombuffer(n, np.uint32)
        _, inverse = np.unique(flat, return_inverse=True)
        df = np.bincount(inverse, weight)
        code = np.minimum(255, np.rint(STEPS * np.log2(df))).astype(np.uint8)[inverse]
        return pa.table({"block": t["block"], "p": t["p"], "codes": pa.array([code[z - len(x) : z].tobytes() for z, x in zip(end.tolist(), names)], pa.binary())})

    sent = blocks.select("block", "sizes", "pressed").mapInArrow(frugal(emit), schema)
    return sent.groupBy("p").applyInArrow(count, "block long, p int, codes binary")


def _idf(codes: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log1p(np.minimum(n_docs / np.exp2(codes.astype(np.float64) / STEPS), RARE))


def _signatures(blocks: DataFrame, nodes: DataFrame, n_docs: int) -> DataFrame:
    """rid, bands, size, pressed, codes of every node; written."""
    schema = "rid long, bands array<long>, size int, pressed binary, codes binary"

    def run(batches):
        hashes, sample, press = WordHashes(), Sampler(), zstandard.ZstdCompressor(3)
        for b in batches:
            for block, sizes, pressed, codes, own in zip(*(b.column(c).to_pylist() for c in ("block", "sizes", "pressed", "codes", "own"))):
                texts, sets, distinct, inverse, ends = _shingled(sizes, pressed, hashes)
                code = np.frombuffer(b"".join(x["codes"] for x in sorted(codes, key=lambda x: x["p"])), np.uint8)
                if len(code) != len(distinct):
                    raise AssertionError("a block's frequencies are not those of its shingles")
                cols: list[list] = [[] for _ in range(5)]
                for rid in own:
                    i = rid & 1023
                    s, tf = sets[i]
                    c = code[inverse[ends[i] - len(s) : ends[i]]]
                    got = sample(s, tf * _idf(c, n_docs)).reshape(BANDS, ROWS)
                    key = mix(np.arange(BANDS, dtype=np.uint64), 3)
                    for j in range(ROWS):
                        key = mix(key ^ got[:, j]) * np.uint64(0x9E3779B97F4A7C15)
                    packed = press.compress(texts[i])
                    for to, v in zip(cols, (rid, key.view(np.int64), len(packed), packed, press.compress(c.tobytes()))):
                        to.append(v)
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["rid", "bands", "size", "pressed", "codes"])

    codes = materialize(fitted(_frequencies(blocks), 2 * size_of(blocks)), "frequencies")
    told = codes.groupBy("block").agg(F.collect_list(F.struct("p", "codes")).alias("codes"))
    own = nodes.groupBy(F.shiftright("rid", 10).alias("block")).agg(F.collect_list("rid").alias("own"))  # of one block: 1024 at most
    met = blocks.select("block", "sizes", "pressed").join(told, "block").join(own, "block")
    found = materialize(met.select("block", "sizes", "pressed", "codes", "own").mapInArrow(frugal(run), schema), "signatures")
    drop(codes)
    return found


class _Weighted:
    """The weighted sets of stored nodes."""

    def __init__(self, n_docs: int):
        self.hashes, self.opened, self.n_docs = WordHashes(), zstandard.ZstdDecompressor(), n_docs

    def __call__(self, pressed: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
        s, tf = shingles_of(self.opened.decompress(pressed), self.hashes)
        return s, tf * _idf(np.frombuffer(self.opened.decompress(codes), np.uint8), self.n_docs)


def _verified(pairs: DataFrame, payloads: DataFrame, n_docs: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is large enough.  pairs: a, b, m (copies of b among which its
    pairs are dealt: a power of two); written."""

    def run(batches):
        weighted = _Weighted(n_docs)
        last: tuple = (None, None)
        for b in batches:
            keep = []
            for y, pa_, ca, pb, cb in zip(*(b.column(c).to_pylist() for c in ("b", "pa", "ca", "pb", "cb"))):
                if last[0] != y:
                    last = (y, weighted(pb, cb))
                keep.append(weighted_jaccard(weighted(pa_, ca), last[1]) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.col("m")).cast("int"))
    copies = pairs.select("b", "m").distinct().join(payloads.select(F.col("rid").alias("b"), F.col("pressed").alias("pb"), F.col("codes").alias("cb")), "b")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("int"))))
    one = dealt.join(payloads.select(F.col("rid").alias("a"), F.col("pressed").alias("pa"), F.col("codes").alias("ca")), "a")
    two = one.join(copies, ["b", "m", "salt"])
    return materialize(fitted(two.select("a", "b", "pa", "ca", "pb", "cb").mapInArrow(frugal(run), "a long, b long"), 8 * size_of(payloads)), "links")


def _block_links(groups: DataFrame, payloads: DataFrame, n_docs: int, similarity: float) -> DataFrame:
    """Links between the nodes of a group (hub, node, label, main) that lie outside its main component and all
    others of different labels; of the links found in a block, those that join components."""
    sized = materialize(groups.join(payloads.select(F.col("rid").alias("node"), "size", "pressed", "codes"), "node"), "groups")
    rest = F.col("label") != F.col("main")
    totals = sized.groupBy("hub").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("nb"), F.ceil(F.sum(F.when(rest, F.col("size"))) / QUERY_BYTES).cast("int").alias("nr")).where("nr > 0")
    # every group's sizes stand 16 times, so that no hub gathers its members in one task
    salts = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    dealt = sized.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(16)).cast("int")).join(salts, ["hub", "salt"])
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    others = dealt.withColumn("b", own("nb")).withColumn("r", every("nr")).withColumn("query", F.lit(False))
    queries = dealt.where(rest).withColumn("r", own("nr")).withColumn("b", every("nb")).withColumn("query", F.lit(True))
    cols = ["hub", "b", "r", "query", "node", "label", "pressed", "codes"]

    def compare(t: pa.Table) -> pa.Table:
        weighted = _Weighted(n_docs)
        t = t.sort_by([("query", "ascending"), ("node", "ascending")])  # what is found doesn't depend on the order of rows
        query, nodes, labels, raw, codes = (t.column(c).to_pylist() for c in ("query", "node", "label", "pressed", "codes"))
        members = [i for i, q in enumerate(query) if not q]
        sets = [weighted(raw[i], codes[i]) for i in members]
        flat = np.concatenate([s for s, _ in sets]) if sets else _NONE
        doc, w = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets]), np.concatenate([w for _, w in sets]) if sets else np.empty(0)
        order = np.argsort(flat, kind="stable")
        flat, doc, w = flat[order], doc[order], w[order]
        total = np.array([x.sum() for _, x in sets])
        parent: dict = {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        found = []
        for i, q in enumerate(query):
            if not q:
                continue
            s, sw = weighted(raw[i], codes[i])
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            common = np.bincount(doc[at], np.minimum(w[at], np.repeat(sw, n)), len(sets))
            for j in np.flatnonzero(common >= similarity * (sw.sum() + total - common)).tolist():
                ra, rb = root(labels[i]), root(labels[members[j]])
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
                    found.append((nodes[i], nodes[members[j]]))
        return pa.table({"a": pa.array([max(x) for x in found], pa.int64()), "b": pa.array([min(x) for x in found], pa.int64())})

    return others.select(cols).union(queries.select(cols)).groupBy("hub", "b", "r").applyInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of the nodes of links (a, b)."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = materialize(edges, "edges")
    before = None
    while True:
        size = 4 * size_of(edges)
        # large star: neighbours greater than u go to u's least neighbour (or u)
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = materialize(fitted(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), size), "edges")
        # small star: lesser neighbours and u go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(fitted(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), size), "edges")
        drop(edges, large)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    found.written_to = edges.written_to
    return found


def _distinct_pairs(df: DataFrame) -> DataFrame:
    """a, b, m of candidates x, y: b, the lesser, has pairs enough to stand m times."""
    return df.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), "m").groupBy("a", "b").agg(F.max("m").alias("m"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document: rid (its number), nul, doc (its doc_id, 0 where null), t1, t2 (its text's tag), label
    (the number of its class), n_copies (rows of equal words), first (nul, doc, t1, t2, rid of its class's first)."""
    bounded_batches(docs.sparkSession)
    blocks = _blocks(docs.select("doc_id", "text"))
    rows = materialize(fitted(blocks.select(F.inline("rows")), size_of(blocks) // 4), "rows")
    nodes = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("rid").alias("rid"), F.count("*").alias("n_copies"))
    nodes = materialize(fitted(nodes, size_of(rows)), "nodes")
    n_docs = nodes.agg(F.sum("n_copies")).first()[0] or 0
    sig = _signatures(blocks, nodes, n_docs)
    drop(blocks)
    member = sig.select(F.col("rid").alias("node"), F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    small = size_of(rows)
    member = materialize(fitted(member.join(shared, "key"), small), "members")
    candidates = member.select(F.col("node").alias("rid")).distinct()
    payloads = materialize(fitted(sig.select("rid", "size", "pressed", "codes").hint("merge").join(candidates, "rid", "left_semi"), size_of(sig)), "payloads")
    drop(sig)
    copies = F.greatest(F.lit(1), F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / AT_HUB)))).cast("int").alias("m")
    links = _verified(_distinct_pairs(member.select(F.col("node").alias("x"), F.col("hub").alias("y"), copies)), payloads, n_docs, similarity)
    labels = components(links)
    state = member.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # buckets of two were compared whole; of the others, those still in several components
    split = state.where("n > 2").groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.max(F.when(F.col("node") == F.col("hub"), F.col("label"))).alias("main")).where("least != most")
    state = materialize(fitted(state.join(split.select("key", "main"), "key").select("key", "hub", "node", "label", "n", "main"), small), "state")
    if not state.isEmpty():
        few = state.where(F.col("n") <= SMALL)
        one = few.select("key", F.col("node").alias("x"), F.col("label").alias("l1"))
        two = few.select("key", F.col("node").alias("y"), F.col("label").alias("l2"))
        pairs = one.join(two, "key").where("x > y AND l1 != l2").select("x", "y", F.lit(1).alias("m"))
        more = _verified(_distinct_pairs(pairs), payloads, n_docs, similarity)
        large = state.where(F.col("n") > SMALL).select("hub", "node", "label", "main").distinct()
        links = materialize(links.union(more).union(_block_links(large, payloads, n_docs, similarity)).distinct(), "links")
        labels = components(links)
    drop(payloads, member, state)
    of_node = nodes.join(labels, nodes["rid"] == labels["node"], "left").select("h1", "h2", F.coalesce("label", "rid").alias("label"), "n_copies")
    found = rows.join(of_node, ["h1", "h2"], "left").select("rid", "nul", "doc", "t1", "t2", F.coalesce("label", "rid").alias("label"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
    found = materialize(fitted(found, 4 * small), "classes")
    first = found.groupBy("label").agg(F.min(F.struct("nul", "doc", "t1", "t2", "rid")).alias("first"))
    return fitted(found.join(first, "label"), 4 * small)


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one of the least doc_id, in the columns of docs."""
    kept = near_duplicates(docs, similarity).where("rid = first.rid").select("nul", "doc", "t1", "t2").distinct()
    t1, t2 = row_tag(F.col("text"))
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(every, F.col("doc_id").isNull().alias("nul"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc"), t1.alias("t1"), t2.alias("t2"))
    return keyed.join(kept, ["nul", "doc", "t1", "t2"], "left_semi").dropDuplicates(["nul", "doc", "t1", "t2"]).select("row.*")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.when(~F.col("nul"), F.col("doc")).alias("doc_id"), F.when(~F.col("first.nul"), F.col("first.doc")).alias("class_id"), "n_copies", (F.col("rid") == F.col("first.rid")).alias("kept"))
