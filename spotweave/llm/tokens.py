"""Exact tokenization by whole chunks.

A text is cut before each space that follows a character other than white space.  No
pre-token of a byte-level pattern crosses such a cut, and what stands before it cannot see
what follows, so the ids of a text are those of its chunks, one after the other.  Chunks
repeat, so a batch is cut and dictionary-encoded in Arrow, each distinct chunk is looked up
once, and the ids are gathered with numpy.  Texts for which the cut isn't proven (runs of
white space, unusual characters, the strings of special tokens) go to the library whole.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct chunks, and their characters, that a worker remembers; beyond, it starts anew.
REMEMBERED, REMEMBERED_CHARS = 500_000, 16 << 20
#: Characters on which all Unicode versions of the pattern's classes agree.
_SAFE = r"\x01-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20ac}"
_UNUSUAL = r"[^" + _SAFE + r"]|[\x09-\x0d \x{85}\x{a0}] |<\|"


class _Pool:
    """Ids of chunks, one array behind the other; grows by doubling."""

    def __init__(self, dtype=np.uint32):
        self.index: dict[str, int] = {}
        self.ids = np.empty(1 << 20, dtype)
        self.used = self.chars = 0
        self.starts = np.empty(1 << 18, np.int64)
        self.lens = np.empty(1 << 18, np.int32)

    def clear(self) -> None:
        self.index.clear()
        self.used = self.chars = 0

    def add(self, chunks: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        n, k = len(self.index), len(chunks)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + k > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.empty_like(self.lens)])
        self.ids[self.used : self.used + len(ids)] = ids
        ends = np.cumsum(lens)
        self.starts[n : n + k] = self.used + ends - lens
        self.lens[n : n + k] = lens
        self.used += len(ids)
        self.chars += sum(map(len, chunks))
        self.index.update(zip(chunks, range(n, n + k)))


class ChunkEncoder:
    """Ids of whole texts as the library gives them, without added special tokens."""

    UNUSUAL = _UNUSUAL

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.pool = _Pool()

    def prepare(self, texts: pa.Array) -> pa.Array:
        """Texts so changed that cutting at NUL gives the chunks."""
        return pc.replace_substring(texts, " ", "\x00 ")

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks behind one another, and how many each has."""
        found = [x.ids for x in self.library.encode_batch(chunks, add_special_tokens=False)]
        lens = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(lens.sum())), lens

    def _looked_up(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = chunks.dictionary_encode()
        words = coded.dictionary.to_pylist()
        known = self.pool.index
        where = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(where < 0)
        if len(missing):
            if (len(known) + len(missing) > REMEMBERED or self.pool.chars > REMEMBERED_CHARS) and len(known):
                self.pool.clear()
                missing, where = np.arange(len(words)), np.full(len(words), -1, np.int64)
            new = [words[i] for i in missing.tolist()]
            where[missing] = np.arange(len(known), len(known) + len(new))
            self.pool.add(new, *self.encode_chunks(new))
        if not len(words):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        of = where[coded.indices.to_numpy(zero_copy_only=False)]
        return self.pool.starts[of], self.pool.lens[of]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts behind one another (uint32), and ends: row i has ids[ends[i-1]:ends[i]]."""
        ids, counts = self._run(texts, True)
        return ids, np.cumsum(counts)

    def count(self, texts: pa.Array) -> np.ndarray:
        return self._run(texts, False)[1]

    def _run(self, texts: pa.Array, want_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        odd = pc.match_substring_regex(texts, self.UNUSUAL).to_numpy(zero_copy_only=False)
        usual = texts.filter(pa.array(~odd)) if odd.any() else texts
        parts = pc.split_pattern(self.prepare(usual), "\x00")
        offsets = parts.offsets.to_numpy() - (parts.offsets[0].as_py() if len(parts.offsets) else 0)
        starts, lens = self._looked_up(parts.flatten())
        ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        counts = np.zeros(n, np.int64)
        counts[~odd] = np.diff(ends[offsets])
        ids = np.empty(0, np.uint32)
        if want_ids:
            at = np.repeat(starts - ends[:-1], lens)
            at += np.arange(len(at))
            ids = self.pool.ids[at]
        if odd.any():
            rows = np.flatnonzero(odd)
            # one at a time: an encoding also holds offsets and strings
            slow = [np.array(self.library.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in rows]
            counts[rows] = [len(x) for x in slow]
            if want_ids:
                ends_all = np.cumsum(counts)
                out = np.empty(int(ends_all[-1]), np.uint32)
                keep = np.ones(len(out), bool)
                for i, x in zip(rows.tolist(), slow):
                    out[ends_all[i] - len(x) : ends_all[i]] = x
                    keep[ends_all[i] - len(x) : ends_all[i]] = False
                out[keep] = ids
                ids = out
        return ids, counts


class ByteBPE(ChunkEncoder):
    """Byte-level BPE.  A batch's distinct chunks are encoded together by the rank merger and told apart by
    their byte lengths; a token's id is its rank."""

    def __init__(self, path: str):
        import tiktoken

        super().__init__(path)
        ranks = _ranks(path)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for k, v in ranks.items():
            self.size[v] = len(k)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.ranked = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        whole = _whole_tokens(path)
        self.whole = pc.SetLookupOptions(pa.array(list(whole), pa.large_string()))
        self.token = np.fromiter(whole.values(), np.uint32, len(whole))

    def _looked_up(self, chunks):
        """All in Arrow and numpy: nothing is remembered between batches."""
        coded = chunks.dictionary_encode()
        words = coded.dictionary
        if not len(words):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        # A vocabulary string that is proven to stand alone needs no merging.
        alone = pc.fill_null(pc.index_in(words, options=self.whole), -1).to_numpy()
        rest = np.flatnonzero(alone < 0)
        merged = words.take(pa.array(rest))
        # Those that begin with a space and end in none can stand in one text: no token joins two.
        fits = pc.and_(pc.starts_with(merged, " "), pc.invert(pc.match_substring_regex(merged, r"[\s\x0b\x1c-\x1f\x{85}\x{a0}]\z"))).to_numpy(zero_copy_only=False)
        mass = merged.filter(pa.array(fits))
        flat, at = [self.token[alone[alone >= 0]]], np.flatnonzero(alone >= 0)
        starts, counts = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)
        starts[at] = np.arange(len(at))
        used = len(at)
        if len(mass):
            size = pc.binary_length(mass).to_numpy().astype(np.int64)
            joined = np.array(self.ranked.encode_ordinary("".join(mass.to_pylist())), np.uint32)
            borders = np.cumsum(size)
            upto = np.cumsum(self.size[joined])
            cut = np.searchsorted(upto, borders) + 1
            if cut[-1] != len(joined) or (upto[cut - 1] != borders).any():
                raise AssertionError("a token crosses a chunk's border")
            n = np.diff(cut, prepend=0)
            counts[rest[fits]], starts[rest[fits]] = n, used + cut - n
            used += len(joined)
            flat.append(joined)
        for i, c in zip(rest[~fits].tolist(), merged.filter(pa.array(~fits)).to_pylist()):
            own = np.array(self.ranked.encode_ordinary(c), np.uint32)
            starts[i], counts[i] = used, len(own)
            used += len(own)
            flat.append(own)
        self.pool.ids = np.concatenate(flat)
        of = coded.indices.to_numpy(zero_copy_only=False)
        return starts[of], counts[of]


class WordBPE(ChunkEncoder):
    """BPE with word ends: white space is dropped and letters are lower-cased.  Texts of characters whose class and
    lower case no Unicode version doubts are cut into pre-tokens in Arrow; each distinct one is merged once."""

    #: Latin letters once lower-cased, and what else no pre-token but a run of signs takes.
    _LETTER = r"a-z\x{df}-\x{f6}\x{f8}-\x{2af}\x{2c65}\x{2c66}"
    _PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^ \t\n\r0-9{_LETTER}]+"
    _PLAIN = r"\t\n\r\x20-\x7e\x{a1}-\x{a9}\x{ab}-\x{b1}\x{b4}\x{b6}-\x{b8}\x{bb}\x{bf}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20ac}"
    UNUSUAL = rf"[^{_PLAIN}]|<\|"

    def __init__(self, path: str):
        super().__init__(path)
        self.model = self.library.model
        self.byte_chars = _byte_chars()

    def prepare(self, texts):
        cut = pc.replace_substring_regex(pc.utf8_lower(texts), self._PIECE, "\x00\\0")
        for space in " \n\t\r":
            cut = pc.replace_substring(cut, space, "")
        return cut

    def encode_chunks(self, chunks):
        chars, tokenize = self.byte_chars, self.model.tokenize
        found = [[t.id for t in tokenize(c if c.isascii() else "".join([chars[b] for b in c.encode()]))] for c in chunks]
        lens = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lens.sum())), lens


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in chars):
        chars[b] = chr(256 + n)
    return [chars[b] for b in range(256)]


def _vocabulary(path: str) -> tuple[dict[str, int], list]:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return model["vocab"], model["merges"]


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    of = {c: b for b, c in enumerate(_byte_chars())}
    vocab, _ = _vocabulary(path)
    return {bytes(of[c] for c in k): v for k, v in vocab.items() if all(c in of for c in k)}


@lru_cache(maxsize=2)
def _whole_tokens(path: str) -> dict[str, int]:
    """Offline proof: the vocabulary strings that the library encodes alone as one token."""
    from tokenizers import Tokenizer

    strings = []
    for raw in _ranks(path):
        try:
            strings.append(raw.decode("utf-8"))
        except UnicodeDecodeError:
            continue
    library = Tokenizer.from_file(path)
    coded = library.encode_batch(strings, add_special_tokens=False)
    return {s: e.ids[0] for s, e in zip(strings, coded) if len(e.ids) == 1}


class Whole(ChunkEncoder):
    """Every text to the library: for files whose rules are none of those above."""

    def _run(self, texts, want_ids):
        found = [np.array(self.library.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
        return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)


def _is_plain(kind: dict) -> str | None:
    """Which of the encoders here a tokenizer's file is for: by its normalizer, pre-tokenizer, model and added tokens."""
    model, pre, norm = kind["model"], kind.get("pre_tokenizer") or {}, kind.get("normalizer")
    usual = model.get("type") in (None, "BPE") and not model.get("dropout") and not model.get("byte_fallback") and not model.get("unk_token")
    if any(not t["content"].startswith("<|") for t in kind.get("added_tokens", ())):
        return None
    if usual and norm is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("end_of_word_suffix"):
        # a token's id must be its merge's rank, or the rank merger would join in another order
        of = model["vocab"]
        joined = [of["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        return "bytes" if all(a < b for a, b in zip(joined, joined[1:])) and not model.get("ignore_merges") else None
    steps = [x["type"] for x in (norm or {}).get("normalizers", ())], [(x["type"], x.get("behavior")) for x in pre.get("pretokenizers", ())]
    words = (["NFC", "Replace", "Lowercase"], [("Split", "Removed"), ("ByteLevel", None)])
    return "words" if usual and model.get("end_of_word_suffix") == "</w>" and steps == words else None


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for each worker process and file."""
    with open(path, encoding="utf-8") as f:
        kind = _is_plain(json.load(f))
    return {"words": WordBPE, "bytes": ByteBPE, None: Whole}[kind](path)
