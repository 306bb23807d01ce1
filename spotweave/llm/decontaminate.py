"""Benchmark decontamination with suffix arrays of the training texts.

Every shard (an Arrow batch of documents) becomes one stream of word numbers, and its suffix
array is built by radix doubling up to the window's length.  All distinct windows at which test suffixes
begin are then binary-searched in it together.  What a window's range covers is hit, and its documents and items
meet; of the test suffixes that begin with the window, each place keeps the longest verbatim match, lengthened word
by word (places whose match can be lengthened to the left lie in a longer one; ties go to the least item and the
first place in it).  Pairs of suffixes and places are looked at PAIRS at a time and kept one a place, so text that
repeats itself takes no more memory.  No shuffle: the test set goes to the tasks in blocks of at most BLOCK_BYTES of text, LIVE
of them in one pass; beyond, the marks are written before the next pass.

Words are runs of letters and digits (ASCII letters lower-cased) or bytes beyond ASCII.  Items
with fewer words than a window match as a whole; items and documents without words (null, empty)
match nothing, and items without an id are not searched, as no list could name them.  Several items of one id are
one.  Ties and repeated rows are judged row by row; columns of the names that are added are replaced, all others
kept, whatever their names.  An empty table gives an empty one.
"""

from __future__ import annotations

import uuid
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fitted, frugal, materialize, size_of, table

WINDOW = 8
LEAST_ITEMS = 2
BLOCK_BYTES = 8 << 20
#: Blocks that one pass holds, and pairs of suffixes and places that are looked at together.
LIVE, PAIRS = 4, 1 << 20
#: Every byte that is no part of a word becomes a space, A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ADDED = ("n_words", "n_hit", "n_items", "items", "matches", "contaminated")
_MATCH = pa.struct([("item_id", pa.string()), ("item_at", pa.int32()), ("at", pa.int32()), ("length", pa.int32())])
MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_at", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("length", T.IntegerType())])


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    return raw.translate(_FOLD).split()


class TestSet:
    """The suffixes of a block of test items, as numbers of words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [str(i) for i, _ in items]
        number: dict[bytes, int] = {}
        rows = [[number.setdefault(w, len(number) + 1) for w in words_of(t)] for _, t in items]
        self.number = number
        # suffixes of at least a window's words; a short item has its whole self alone
        item, at, need = [], [], []
        for i, r in enumerate(rows):
            n = min(window, len(r))
            for a in range(len(r) - n + 1 if n else 0):
                item.append(i), at.append(a), need.append(n)
        self.item, self.at, self.need = (np.array(x, np.int64) for x in (item, at, need))
        self.words = np.array([w for r in rows for w in r] + [0] * window, np.int64)
        self.begin = np.cumsum([0] + [len(r) for r in rows])[:-1] if rows else np.zeros(0, np.int64)
        self.length = np.array([len(r) for r in rows], np.int64)
        first = self.begin[self.item] + self.at if len(item) else np.zeros(0, np.int64)
        self.first = first
        inside = np.arange(window) < self.need[:, None] if len(item) else np.zeros((0, window), bool)
        self.prefix = np.where(inside, self.words[first[:, None] + np.arange(window)] if len(item) else 0, -1)
        # distinct windows: one suffix that begins with each, and all suffixes and items by window
        if len(item):
            _, self.one, window_of = np.unique(self.prefix, axis=0, return_index=True, return_inverse=True)
            window_of = window_of.reshape(-1)
        else:
            self.one = window_of = np.zeros(0, np.int64)
        self.by_window = np.argsort(window_of, kind="stable")
        self.window_of = window_of[self.by_window]
        self.item_window, self.item_of = np.unique(np.stack([window_of, self.item]), axis=1) if len(item) else np.zeros((2, 0), np.int64)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes whose first word is a test word (not 0), sorted by their first ``depth`` words."""
    rank = words.astype(np.int64)
    size = 1
    padded = lambda x, by: np.concatenate([x[by:], np.zeros(min(by, len(x)), np.int64)])
    while size < depth:
        pair = rank * (int(rank.max(initial=0)) + 1) + padded(rank, size)
        pair[words == 0] = 0
        live = np.flatnonzero(pair)
        order = np.argsort(pair[live], kind="stable")
        ranked = pair[live][order]
        steps = np.concatenate([[1], (ranked[1:] != ranked[:-1]).astype(np.int64)]) if len(ranked) else ranked
        rank = np.zeros(len(words), np.int64)
        rank[live[order]] = np.cumsum(steps)
        size *= 2
    live = np.flatnonzero(rank)
    return live[np.argsort(rank[live], kind="stable")]


def _search(sa: np.ndarray, words: np.ndarray, prefix: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all prefixes at once: the first suffix that is not less (upper: greater)."""
    lo, hi = np.zeros(len(prefix), np.int64), np.full(len(prefix), len(sa), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        begin = sa[mid]
        sign = np.zeros(len(open_), np.int64)
        for k in range(prefix.shape[1]):
            want = prefix[open_, k]
            undone = (sign == 0) & (want >= 0)
            if not undone.any():
                break
            sign = np.where(undone, np.sign(words[begin + k] - want), sign)
        right = sign < 0 if not upper else sign <= 0
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]


def found_windows(tests: TestSet, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the shard's words (0: no test word): distinct windows (their numbers) and places where they stand, by window."""
    none = np.zeros(0, np.int64)
    if not len(tests.first) or not len(words):
        return none, none
    depth = tests.prefix.shape[1]
    padded = np.concatenate([words, np.zeros(depth + 1, np.int64)])
    sa = suffix_array(words, depth)
    prefix = tests.prefix[tests.one]
    lo, hi = _search(sa, padded, prefix, False), _search(sa, padded, prefix, True)
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    return of, sa[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _pairs(left: np.ndarray, right: np.ndarray, groups: int):
    """Indices of all pairs of left and right of one group, at most PAIRS or one left's at a time; both are ascending."""
    begin, end = np.searchsorted(right, np.arange(groups), "left"), np.searchsorted(right, np.arange(groups), "right")
    n = (end - begin)[left]
    upto, lo = np.cumsum(n), 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        some, k = left[lo:hi], n[lo:hi]
        i = np.repeat(np.arange(lo, hi), k)
        yield i, np.repeat(begin[some] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        lo = hi


def longest(tests: TestSet, words: np.ndarray, of: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose match cannot be lengthened to the left, the longest match's length, and its suffix."""
    padded = np.concatenate([words, np.zeros(1, np.int64)])
    best = np.zeros(len(padded), np.int64)
    suffix = np.full(len(padded), len(tests.first), np.int64)
    covered = np.zeros(len(padded), bool)
    for i, j in _pairs(of, tests.window_of, len(tests.one)):
        p, s = place[i], tests.by_window[j]
        inner = (tests.at[s] > 0) & (p > 0) & (tests.words[tests.first[s] - 1] == padded[p - 1]) & (tests.need[s] == tests.prefix.shape[1])
        covered[p[inner]] = True
        p, s = p[~inner], s[~inner]
        length = tests.need[s].copy()
        total = tests.length[tests.item[s]] - tests.at[s]
        grow = np.arange(len(s))
        while len(grow):
            grow = grow[length[grow] < total[grow]]
            at = p[grow] + length[grow]
            grow, at = grow[at < len(words)], at[at < len(words)]
            grow = grow[padded[at] == tests.words[tests.first[s[grow]] + length[grow]]]
            length[grow] += 1
        order = np.lexsort((s, -length, p))
        head = np.flatnonzero(np.diff(p[order], prepend=-1))
        p, s, length = p[order][head], s[order][head], length[order][head]
        better = (length > best[p]) | (length == best[p]) & (s < suffix[p])
        best[p[better]], suffix[p[better]] = length[better], s[better]
    there = np.flatnonzero(best)
    # a place that goes on from the one before counts only if it reaches further than that
    reach = np.maximum.accumulate(np.where(best > 0, np.arange(len(best)) + best, 0))
    before = np.concatenate([[0], reach[:-1]])
    there = there[~covered[there] | (there + best[there] > before[there])]
    return there, best[there], suffix[there]


def _blocks(benchmark: DataFrame):
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string"), "text").where("item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        held.append((r[0], r[1] or ""))
        size += len((r[1] or "").encode())
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, least_items: int = LEAST_ITEMS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted), matches (longest, with places) and contaminated."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = docs.drop(*(c for c in ADDED if c != text))
    hit = next(n for n in ("_hit" + "_" * k for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    own = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(MATCH)), T.StructField(hit, T.BinaryType())]
    schema = T.StructType([*kept.schema.fields, *own])
    blocks, state, first = _blocks(benchmark), fitted(kept, 4 * size_of(kept)), True
    while True:
        some = list(islice(blocks, LIVE))
        if not some and not first:
            break
        if not first:
            state = materialize(state, "marks")
        state = state.select(*kept.columns, *([] if first else [hit, "items", "matches"])).mapInArrow(frugal(_pass([spark.sparkContext.broadcast(b) for b in some], uuid.uuid4().hex, text, window, kept.columns, hit, first)), schema)
        first = False
    done = state.withColumn("n_items", F.size("items").cast("long"))
    return done.select(*kept.columns, "n_words", "n_hit", "n_items", "items", "matches", (F.size("items") >= least_items).alias("contaminated"))


_TESTS: dict = {}


def _pass(sent: list, name: str, text: str, window: int, keep: list[str], hit: str, first: bool):
    """Marks a batch's documents by the blocks of items in sent; name: the set's own, by which a worker knows it again."""

    def tests_of(k: int) -> TestSet:
        if (name, k) not in _TESTS:
            for old in [x for x in _TESTS if x[0] != name]:
                del _TESTS[old]
            _TESTS[name, k] = TestSet(sent[k].value, window)
        return _TESTS[name, k]

    def run(batches):
        for b in batches:
            words = [words_of(t) for t in b.column(text).to_pylist()]
            n = [len(w) for w in words]
            begin = np.cumsum([0, *(k + 1 for k in n)])[:-1] if n else np.zeros(0, np.int64)  # a 0 between documents
            size = sum(n) + len(n)
            mask = np.zeros(size, bool)
            items: dict[int, set] = {}
            matches: dict[int, list] = {}
            if not first:
                old = [b.column(c).to_pylist() for c in (hit, "items", "matches")]
                for d, (h, i, m) in enumerate(zip(*old)):
                    if i:
                        mask[begin[d] : begin[d] + n[d]] = np.unpackbits(np.frombuffer(h, np.uint8), count=n[d])
                        items[d], matches[d] = set(i), list(m)
            for k in range(len(sent)):
                _mark(tests_of(k), words, begin, mask, items, matches)
            bits = [np.packbits(mask[a : a + k]).tobytes() if d in items else b"" for d, (a, k) in enumerate(zip(begin.tolist(), n))]
            n_hit = [int(mask[a : a + k].sum()) if d in items else 0 for d, (a, k) in enumerate(zip(begin.tolist(), n))]
            new = [pa.array(n, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(items.get(d, ())) for d in range(len(n))], pa.list_(pa.string())), pa.array([matches.get(d, []) for d in range(len(n))], pa.list_(_MATCH)), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], [*keep, "n_words", "n_hit", "items", "matches", hit])

    return run


def _mark(tests: TestSet, words: list, begin: np.ndarray, mask: np.ndarray, items: dict, matches: dict) -> None:
    get, stream = tests.number.get, np.zeros(len(mask), np.int64)
    for a, w in zip(begin.tolist(), words):
        stream[a : a + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
    of, place = found_windows(tests, stream)
    if not len(of):
        return
    edge = np.zeros(len(mask) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + tests.need[tests.one][of], -1)
    mask |= np.cumsum(edge)[:-1] > 0
    doc = np.searchsorted(begin, place, "right") - 1
    met = np.unique(np.stack([of, doc]), axis=1)  # ascending by window
    for i, j in _pairs(met[0], tests.item_window, len(tests.one)):
        for d, x in np.unique(np.stack([met[1][i], tests.item_of[j]]), axis=1).T.tolist():
            items.setdefault(d, set()).add(tests.names[x])
    at, length, s = longest(tests, stream, of, place)
    doc = np.searchsorted(begin, at, "right") - 1
    for d, a, n, x in zip(doc.tolist(), (at - begin[doc]).tolist(), length.tolist(), s.tolist()):
        matches.setdefault(d, []).append({"item_id": tests.names[int(tests.item[x])], "item_at": int(tests.at[x]), "at": a, "length": n})


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without the contaminated ones, in their own columns."""
    own = docs.toDF(*(f"_o{i}" for i in range(len(docs.columns))))  # so that no column has a name that is added
    marked = mark_contaminated(own, benchmark, text=f"_o{docs.columns.index(how.pop('text', 'text'))}", **how)
    return marked.where(~F.col("contaminated")).select(*own.columns).toDF(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(8, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, g)),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
