"""Substring dedup: suffix automata of reference shards, streamed for matching statistics.

A window is LENGTH words of one document.  A window goes if its words also start in a document of a
lesser doc_id; words that such a window covers are removed.

All documents are the reference of all later ones, so whole automata sent to all tasks would be
quadratic.  Shards are therefore cut by content.  A window's anchor is the least hash of its
ANCHOR-word runs; equal windows have equal anchors, so windows are dealt out by anchor.
1. Consecutive windows of one anchor form a unit.  Units of equal words (a 128-bit digest of the words
   themselves) are counted together: those that an earlier document has too go whole.  (Aggregated before
   the shuffle.)
2. Anchors with units of different words are the reference shards: edges of passages and places of
   edits.  Each distinct unit is sent once, by the first document that has it; in the order of
   documents it is streamed through the shard's suffix automaton for matching statistics, spans of
   LENGTH or more go, and what is new extends the automaton.  If that document has the unit more than
   once, what is found at the first place goes at the others too.
3. Shards of more than SHARD units (the borders of a passage that very many documents share) are split
   exactly: all units stand on their anchor, so each is compared with the shard's first unit by one
   join.  What they share goes; a window that reaches further holds the first word that differs,
   to the left or to the right, and only units with that same word in that place can share it.  So
   the pieces are dealt out anew by (shard, side, distance, word), until shards are small.  A window that
   reaches further on both sides goes with the left, so each window is in one piece and the rounds never
   make more windows than there were.  What is still large after LEVELS rounds has its windows hashed
   (128 bits) and counted in an aggregation, which no key can overload.
4. Spans return to their documents by one join.

The compressed rows are written once, each with a number of its own, by which all else refers to them: rows
that share a doc_id, or both doc_id and text, are never mixed up.  A task holds one text and the
automaton of one small shard at a time, so long texts need no more than themselves.

Null texts have no words.  Null doc_ids rank last, all equal.  Rows that share a doc_id are no
reference for one another.  Documents of fewer than LENGTH words stay as they are.  An empty table
gives an empty one.  Other columns, whatever their names, are kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drop, fitted, frugal, materialize, size_of, table
from .shingles import WordHashes, runs, sliding_min

LENGTH = 50
ANCHOR = 12
SHARD = 512
LEVELS = 8
UNIT = "anchor long, c1 long, c2 long, nul boolean, doc long, rid long, at int, n int"
SPAN = "rid long, at int, len int, unit int"  # unit: where its unit begins


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").split()  # bytes split at \x20 and \x09-\x0D only


class SuffixAutomaton:
    """Of word sequences added one after the other; states are arrays, transitions dicts."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def _clone(self, p: int, w, q: int) -> int:
        c = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.len[last] + 1 == self.len[q] else self._clone(last, w, q)
                continue
            cur, p = len(self.len), last
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[cur] = q if self.len[p] + 1 == self.len[q] else self._clone(p, w, q)
            last = cur

    def statistics(self, words: list) -> list[int]:
        """For each word, how many words that end with it are a substring of what was added."""
        out, state, n = [], 0, 0
        nexts, link, length = self.next, self.link, self.len
        for w in words:
            to = nexts[state].get(w)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nexts[state].get(w)
            if to is not None:
                state, n = to, n + 1
            out.append(n)
        return out


def _spans(covered: list[int], size: int) -> list[tuple[int, int]]:
    """Runs (begin, end) of words from the windows' last words."""
    out: list[list[int]] = []
    for i in covered:
        if out and i - size + 1 <= out[-1][1]:
            out[-1][1] = i + 1
        else:
            out.append([i - size + 1, i + 1])
    return [tuple(x) for x in out]


def _units(rows: DataFrame, length: int) -> DataFrame:
    anchor = min(ANCHOR, length)

    def run(batches):
        hashes, opened = WordHashes(), zstandard.ZstdDecompressor()
        held: list[list[np.ndarray]] = [[] for _ in range(8)]
        n_held = 0

        def flush():
            nonlocal n_held
            cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in held]
            for c in held:
                c.clear()
            n_held = 0
            return pa.RecordBatch.from_arrays([pa.array(c.astype(bool) if x.endswith("boolean") else c, pa.int32() if x.endswith(" int") else None) for c, x in zip(cols, UNIT.split(", "))], [x.split()[0] for x in UNIT.split(", ")])

        for b in batches:
            for nul, doc, rid, raw in zip(*(b.column(c).to_pylist() for c in ("nul", "doc", "rid", "pressed"))):
                words = words_of(None if raw is None else opened.decompress(raw))
                if len(words) < length:
                    continue
                key = sliding_min(runs(hashes(words), anchor), length - anchor + 1).view(np.int64)
                begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
                n = np.diff(begin, append=len(key))
                # the digest is of the words themselves
                text = memoryview(b" ".join(words))
                stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                lo, hi = np.concatenate([[0], stop])[begin].tolist(), (stop[begin + n + length - 2] - 1).tolist()
                d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[x:y]) for x, y in zip(lo, hi)]), ">i8").astype(np.int64)
                size = len(begin)
                for c, v in zip(held, (key[begin], d[::2], d[1::2], np.full(size, int(nul)), np.full(size, doc), np.full(size, rid), begin, n)):
                    c.append(v)
                n_held += size
                if n_held > 20_000:
                    yield flush()
        yield flush()

    return rows.select("nul", "doc", "rid", "pressed").mapInArrow(frugal(run), UNIT)


def _batch(cols: list[list], kinds: str, schema: str) -> pa.RecordBatch:
    kind = {"l": pa.int64(), "i": pa.int32(), "b": pa.binary(), "n": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind[k]) for c, k in zip(cols, kinds)], [x.split()[0] for x in schema.split(", ")])


CONTEXT = "anchor long, large int, nul boolean, doc long, rid long, at int, unit int, pos int, words binary"


def _contexts(rows: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """The words of units that need their shard's automaton."""

    anchor = min(ANCHOR, length)

    def run(batches):
        opened, hashes = zstandard.ZstdDecompressor(), WordHashes()
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for nul, doc, rid, raw, units in zip(*(b.column(c).to_pylist() for c in ("nul", "doc", "rid", "pressed", "units"))):
                words = words_of(opened.decompress(raw))
                for u in units:
                    own = words[u["at"] : u["at"] + u["n"] + length - 1]
                    for lo, hi, pos in _standing(np.flatnonzero(runs(hashes(own), anchor).view(np.int64) == u["anchor"]).tolist(), len(own), anchor, length) if u["large"] else [(0, len(own), 0)]:
                        for c, v in zip(cols, (u["anchor"], u["large"], nul, doc, rid, u["at"] + lo, u["at"], pos - lo, b" ".join(own[lo:hi]))):
                            c.append(v)
                if len(cols[0]) > 4000:
                    yield _batch(cols, "linlliiib", CONTEXT)
                    cols = [[] for _ in range(9)]
            yield _batch(cols, "linlliiib", CONTEXT)

    listed = places.groupBy("rid").agg(F.collect_list(F.struct("anchor", "large", "at", "n")).alias("units"))
    return rows.select("nul", "doc", "rid", "pressed").join(listed, "rid").mapInArrow(frugal(run), CONTEXT)


def _standing(places: list[int], n: int, anchor: int, length: int) -> list[tuple[int, int, int]]:
    """In large shards a unit (of n words) stands on its anchor, on each if there are several: (begin, end) of the windows
    whose first anchor stands at the place, and the place.  So each window is in one of them."""
    out = []
    for before, pos in zip([-1, *places], places):
        lo, hi = max(0, before + 1, pos + anchor - length), min(n, pos + length)
        if hi - lo >= length:
            out.append((lo, hi, pos))
    return out


def _shard_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Streams each shard's units, in the order of documents, through its automaton."""

    def run(batches):
        shard = automaton = held_doc = None
        pending: list[list[bytes]] = []
        for b in batches:
            cols: list[list] = [[] for _ in range(4)]
            for key, nul, doc, rid, at, unit, raw in zip(*(b.column(c).to_pylist() for c in ("anchor", "nul", "doc", "rid", "at", "unit", "words"))):
                if key != shard:
                    shard, automaton, held_doc, pending = key, SuffixAutomaton(), (nul, doc), []
                elif (nul, doc) != held_doc:
                    for w in pending:
                        automaton.add(w)
                    held_doc, pending = (nul, doc), []
                words = raw.split(b" ")
                ends = [i for i, n in enumerate(automaton.statistics(words)) if n >= length]
                for a, z in _spans(ends, length):
                    for c, v in zip(cols, (rid, at + a, z - a, unit)):
                        c.append(v)
                if ends:
                    gone = set(ends)
                    new = [i for i in range(length - 1, len(words)) if i not in gone]
                    pending += [words[a:z] for a, z in _runs(new, length)]
                else:
                    pending.append(words)
            yield _batch(cols, "liii", SPAN)

    return contexts.repartition("anchor").sortWithinPartitions("anchor", "nul", "doc", "rid", "at").mapInArrow(frugal(run), SPAN)


def _runs(ends: list[int], size: int) -> list[tuple[int, int]]:
    """Words of each run of consecutive windows."""
    out: list[list[int]] = []
    for i in ends:
        if out and i == out[-1][1]:
            out[-1][1] = i + 1
        else:
            out.append([i - size + 1, i + 1])
    return [tuple(x) for x in out]


PIECE = "kind int, anchor long, nul boolean, doc long, rid long, at int, unit int, pos int, len int, words binary"


def _compared(length: int):
    """Units against their shard's first unit r: shared spans (kind 0), and the pieces that reach beyond (kind 1)."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(10)]

            def put(*row):
                for c, v in zip(cols, row):
                    c.append(v)

            for key, nul, doc, rid, at, unit, pos, raw, later, r in zip(*(b.column(c).to_pylist() for c in ("anchor", "nul", "doc", "rid", "at", "unit", "pos", "words", "later", "r"))):
                own, first, q = raw.split(b" "), r["words"].split(b" "), r["pos"]
                left, right = 0, 0
                while left < pos and left < q and own[pos - left - 1] == first[q - left - 1]:
                    left += 1
                while pos + right < len(own) and q + right < len(first) and own[pos + right] == first[q + right]:
                    right += 1
                if later and left + right >= length:
                    put(0, 0, nul, doc, rid, at + pos - left, unit, 0, left + right, b"")
                if (rid, at, pos) == (r["rid"], r["at"], r["pos"]):
                    continue  # the first holder keeps its words
                far = pos - left - 1
                if far >= 0 and min(len(own), far + length) >= length:
                    new = xxhash.xxh64_intdigest(b"%d/l/%d/" % (key, left) + own[far]) - (1 << 63)
                    put(1, new, nul, doc, rid, at, unit, pos, 0, b" ".join(own[: far + length]))
                far = pos + right
                begin = max(0, pos - left, far - length + 1)  # windows that reach further on the left are in that piece
                if far < len(own) and len(own) - begin >= length:
                    new = xxhash.xxh64_intdigest(b"%d/r/%d/" % (key, right) + own[far]) - (1 << 63)
                    put(1, new, nul, doc, rid, at + begin, unit, pos - begin, 0, b" ".join(own[begin:]))
            yield _batch(cols, "ilnlliiiib", PIECE)

    return frugal(run)


#: Whether a row's document ranks behind another's: null doc_ids do, all equal.
_LATER = "(nul AND NOT {0}nul) OR (nul = {0}nul AND doc > {0}doc)"
_SEVERAL = "min(doc) < max(doc) OR min(nul) <> max(nul)"


def _split_large(contexts: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Spans found while large shards are split, the small shards that are left, and the tables that hold them."""
    spans, small, tables = [], [], []
    large = contexts.where("large = 1")
    for _ in range(LEVELS):
        if large.isEmpty():
            return spans, small, tables
        size = size_of(tables[-1] if tables else contexts)
        first = large.groupBy("anchor").agg(F.min(F.struct("nul", "doc", "rid", "at", "pos", "words")).alias("r"))
        met = large.join(first, "anchor").withColumn("later", F.expr(_LATER.format("r.")))
        found = met.select("anchor", "nul", "doc", "rid", "at", "unit", "pos", "words", "later", "r").mapInArrow(_compared(length), PIECE)
        found = materialize(fitted(found, 2 * size), "descent")
        spans.append(found.where("kind = 0").select("rid", "at", "len", "unit"))
        pieces = found.where("kind = 1")
        sizes = pieces.groupBy("anchor").agg(F.count("*").alias("n"), F.expr(_SEVERAL).alias("several")).where("n > 1 AND several")
        pieces = materialize(fitted(pieces.join(sizes.select("anchor", "n"), "anchor").select("anchor", "n", "nul", "doc", "rid", "at", "unit", "pos", "words"), size_of(found)), "pieces")
        tables += [found, pieces]
        small.append(pieces.where(F.col("n") <= SHARD).select("anchor", "nul", "doc", "rid", "at", "unit", "words"))
        large = pieces.where(F.col("n") > SHARD)
    return [*spans, _window_spans(large, length)], small, tables


WINDOW = "w1 long, w2 long, nul boolean, doc long, rid long, at int, unit int"


def _window_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Spans by every window's hash and the first document that has it."""

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for nul, doc, rid, at, unit, raw in zip(*(b.column(c).to_pylist() for c in ("nul", "doc", "rid", "at", "unit", "words"))):
                words = raw.split(b" ")
                for i in range(len(words) - length + 1):
                    d = xxhash.xxh3_128_intdigest(b" ".join(words[i : i + length]))
                    for c, v in zip(cols, ((d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), nul, doc, rid, at + i, unit)):
                        c.append(v)
                if len(cols[0]) > 50_000:
                    yield _batch(cols, "llnllii", WINDOW)
                    cols = [[] for _ in range(7)]
            yield _batch(cols, "llnllii", WINDOW)

    windows = contexts.mapInArrow(frugal(run), WINDOW)
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("nul", "doc")).alias("f"), F.expr(_SEVERAL).alias("several")).where("several")
    return windows.join(first, ["w1", "w2"]).where(_LATER.format("f.")).select("rid", "at", F.lit(length).alias("len"), "unit")


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans of words (rid, at, len) that lie in windows of earlier documents.  rows: as ``_rows`` gives them."""
    size = size_of(rows)
    units = materialize(fitted(_units(rows, length), size), "units")
    place = F.struct("nul", "doc", "rid", "at", "n")
    distinct = units.groupBy("c1", "c2").agg(F.min(place).alias("p"), (F.count("*") > 1).alias("again"), F.first("anchor").alias("anchor"))
    distinct = materialize(fitted(distinct.select("c1", "c2", "anchor", "p.*", "again"), size), "distinct-units")
    first = F.struct("nul", "doc").alias("f")
    again = distinct.where("again").select("c1", "c2", first, F.col("rid").alias("first_rid"), F.col("at").alias("first_at"))
    others = units.join(again, ["c1", "c2"]).where("rid <> first_rid OR at <> first_at")
    others = materialize(fitted(others.select("rid", "at", "n", F.expr(_LATER.format("f.")).alias("later"), "first_rid", "first_at"), size), "other-places")
    drop(units)
    whole = others.where("later").select("rid", "at", (F.col("n") + length - 1).cast("int").alias("len"))
    shards = distinct.groupBy("anchor").agg(F.count("*").alias("n_units"), F.expr(_SEVERAL).alias("several")).where("n_units > 1 AND several")
    places = distinct.join(shards, "anchor").select("rid", "anchor", (F.col("n_units") > SHARD).cast("int").alias("large"), "at", "n")
    contexts = materialize(fitted(_contexts(rows, places, length), size), "contexts")
    drop(distinct)
    found, small, tables = _split_large(contexts, length)
    shards = contexts.where("large = 0").select("anchor", "nul", "doc", "rid", "at", "unit", "words")
    for s in small:
        shards = shards.union(s)
    streamed = _shard_spans(shards, length)
    for f in found:
        streamed = streamed.union(f)
    streamed = materialize(fitted(streamed, 8 * size_of(contexts)), "streamed-spans")
    drop(contexts, *tables)
    return whole.union(streamed.drop("unit")).union(_at_other_places(streamed, others))


def _at_other_places(streamed: DataFrame, others: DataFrame) -> DataFrame:
    """Spans found at a unit's first place, at the unit's other places in that document."""
    first = streamed.select(F.col("rid").alias("first_rid"), F.col("unit").alias("first_at"), (F.col("at") - F.col("unit")).alias("off"), "len")
    same = others.where("NOT later").select("rid", "at", "first_rid", "first_at")
    return same.join(first, ["first_rid", "first_at"]).select("rid", (F.col("at") + F.col("off")).cast("int").alias("at"), "len")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(raw: bytes, mask: np.ndarray) -> bytes:
    """raw without the masked words; the white space before a kept word stays."""
    out, last = [], 0
    for gone, m in zip(mask.tolist(), _WORD.finditer(raw)):
        if not gone:
            out.append(raw[last : m.end()])
        last = m.end()
    return b"".join(out).lstrip(b" \t\n\r\x0b\x0c")


def _applied(rows: DataFrame, spans: DataFrame, others: list, want_text: bool) -> DataFrame:
    """Row by row: others, n_words, n_removed, kept_sha256 and, if wanted, the kept text."""
    add = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType([*others, *add, *([T.StructField("kept_text", T.StringType())] if want_text else [])])
    keep = [f.name for f in others]

    def run(batches):
        opened = zstandard.ZstdDecompressor()
        for b in batches:
            n, gone, sha, texts = [], [], [], []
            for raw, list_ in zip(b.column("pressed").to_pylist(), b.column("spans").to_pylist()):
                raw = None if raw is None else opened.decompress(raw)
                words = words_of(raw)
                kept, text = words, raw
                if list_:
                    mask = np.zeros(len(words), bool)
                    for s in list_:
                        mask[s["at"] : s["at"] + s["len"]] = True
                    kept = [w for w, m in zip(words, mask.tolist()) if not m]
                    text = _cut(raw, mask) if want_text else None
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                if want_text:
                    texts.append(None if text is None else text.decode("utf-8", "surrogatepass"))
            new = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), *([pa.array(texts, pa.string())] if want_text else [])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], schema.names)

    listed = spans.groupBy("rid").agg(F.collect_list(F.struct("at", "len")).alias("spans"))
    return fitted(rows.join(listed, "rid", "left").select(*keep, "pressed", "spans"), size_of(rows)).mapInArrow(frugal(run), schema)


def _rows(docs: DataFrame, others: list) -> DataFrame:
    """others, nul, doc (the doc_id, 0 where null), rid (the row's number, once written) and the compressed text; written."""
    keep = [*(f.name for f in others), "nul", "doc", "rid"]

    def run(batches):
        press = zstandard.ZstdCompressor(3)
        for b in batches:
            packed = pa.array([None if t is None else press.compress(t.encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), packed], [*keep, "pressed"])

    schema = T.StructType([*others, *(T.StructField(n, t) for n, t in (("nul", T.BooleanType()), ("doc", T.LongType()), ("rid", T.LongType()), ("pressed", T.BinaryType())))])
    numbered = docs.withColumn("rid", F.monotonically_increasing_id())
    return materialize(fitted(numbered.select(*keep, "text").mapInArrow(frugal(run), schema), size_of(docs)), "rows")


_RANK = ("doc_id IS NULL AS nul", "coalesce(CAST(doc_id AS long), 0L) AS doc")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated spans cut from their texts; n_chars follows, if it is there."""
    bounded_batches(docs.sparkSession)
    names = {f"_o{i}": f.name for i, f in enumerate(docs.schema.fields) if f.name != "text"}
    keyed = docs.select(*(F.col(f"`{n}`").alias(a) for a, n in names.items()), *map(F.expr, _RANK), "text")
    others = [T.StructField(a, docs.schema[n].dataType) for a, n in names.items()]
    rows = _rows(keyed, others)
    done = _applied(rows, repeated_spans(rows, length), others, True)
    back = {n: F.col(a) for a, n in names.items()} | {"text": F.col("kept_text")}
    if "n_chars" in back:
        back["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(back["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return done.select(*(back[n].alias(n) for n in docs.columns))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    others = [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
    rows = _rows(docs.select("doc_id", *map(F.expr, _RANK), "text"), others)
    return _applied(rows, repeated_spans(rows), others, False)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS h1, hash(array_to_string(w[i:i + 49], '/')) AS h2
  FROM (SELECT rid, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT h1, h2, min(coalesce(doc_id, 9223372036854775807)) AS f FROM win GROUP BY h1, h2),
gone AS (SELECT DISTINCT rid, unnest(generate_series(i, i + 49)) AS p FROM win JOIN first USING (h1, h2) WHERE coalesce(doc_id, 9223372036854775807) > f),
per AS (SELECT rid, list(p) AS ps FROM gone GROUP BY rid),
kept AS (SELECT doc_id, w, ps, CASE WHEN ps IS NULL THEN w ELSE list_transform(list_filter(generate_series(1, len(w)), lambda x: NOT list_contains(ps, x)), lambda x: w[x]) END AS k FROM d LEFT JOIN per USING (rid))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
