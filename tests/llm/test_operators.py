"""The training-data operators on small tables, against brute force."""

import hashlib
import json
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spotweave.llm import chat_format, decontaminate, flac, media, near_dedup, packing, quality, substring_dedup, token_counts, token_files, url_filter
from spotweave.llm.shingles import WordHashes, runs, sliding_min

P = pytest.importorskip("public_tokenizers")
ODD = [None, "", " ", "a", "  a  b\n\n c ", " x", "x ", "a\tb\r\nc", "it's<|endoftext|> ok <|x", "naïve ½ ² É ß İ ª", "日本 語", "a\u00a0b", "!!\n..", "don't 'S we'LL", "\n\n", "é \n", "word " * 3000, "x" * 5000]


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def corpus(seed=0, n=60, vocabulary=300):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[r.choice(words) for _ in range(r.choice([50, 60, 90]))] for _ in range(2)]
    docs = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 2)):
            p = list(r.choice(passages))
            if r.random() < 0.3:
                p[r.randrange(len(p))] = r.choice(words)
            k = r.randint(0, len(w))
            w[k:k] = p
        docs.append((i, " ".join(w)))
    return [*docs, (None, docs[3][1]), (7, docs[7][1]), (7, docs[9][1]), (200, None), (201, ""), (202, "a " * 70)]


# 1


def removed(docs, length=50):
    rank = lambda d: 2**63 - 1 if d is None else d
    first: dict = {}
    for d, t in docs:
        w = (t or "").split()
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, rank(d)), rank(d))
    out = []
    for d, t in docs:
        w = (t or "").split()
        gone = {j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < rank(d) for j in range(i, i + length)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,levels", [(512, 8), (2, 2)])
def test_substring_dedup(spark, tmp_path, monkeypatch, shard, levels):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    monkeypatch.setattr(substring_dedup, "LEVELS", levels)
    docs = corpus()
    d = write(spark, tmp_path, "documents", docs, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.op1_substring_dedup(spark, d).collect()), key=str) == removed(docs)


@pytest.mark.parametrize("shard,levels", [(512, 8), (2, 8), (2, 1), (1, 0)])
def test_passages_repeated_within_a_document(spark, tmp_path, monkeypatch, shard, levels):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    monkeypatch.setattr(substring_dedup, "LEVELS", levels)
    r = random.Random(5)
    some = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    a, b, c, d, e, x, y = (some(60) for _ in range(7))
    p, q = some(80), some(55)
    docs = [[*c, *p, *d], [*a, *p, *b, *e, *a, *p, *b], [*a, *q, *b, *x, *a, *q, *b], [*y, *q, *a], [*x, *p, *y], [*y, *x, *p, *y, *e[:50], *x, *p, *y], [*d, *q, *e]]
    rows = [(k, " ".join(w)) for k, w in zip([1, 2, 3, 4, 5, 5, 9], docs)]
    rows += [(10 + i, " ".join([*some(20), *p, *some(20)])) for i in range(4)] + [(None, " ".join([*some(9), *p, *c])), (None, " ".join([*c, *p, *c, *c, *p, *c]))]
    rows.append(rows[1])
    schema = "doc_id long, text string"
    d = write(spark, tmp_path, "documents", rows, schema)
    assert sorted(map(tuple, substring_dedup.op1_substring_dedup(spark, d).collect()), key=str) == removed(rows)


def test_large_shards_hold_each_window_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD", 2)
    r = random.Random(9)
    some = lambda n, of: [r.choice(of) for _ in range(n)]
    passage = some(60, "abcdefgh")
    docs = [(i, " ".join([*some(r.randint(0, 30), "st"), *("x y z".split()[: 1 + i % 3] * 150)[: 120 + i], *some(30, "uv"), *passage, *some(30, "uv")])) for i in range(24)]
    write_, held = substring_dedup.materialize, []

    def seen(df, what, **options):
        out = write_(df, what, **options)
        if what in ("contexts", "pieces"):
            held.append(out.selectExpr("sum(size(split(cast(words AS string), ' ')) - 49)").first()[0] or 0)
        return out

    monkeypatch.setattr(substring_dedup, "materialize", seen)
    d = write(spark, tmp_path, "documents", docs, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup.op1_substring_dedup(spark, d).collect()), key=str) == removed(docs)
    assert len(held) > 1 and max(held) <= sum(len(t.split()) - 49 for _, t in docs)


def test_cut_texts_keep_all_columns(spark):
    p = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"a\n{p} b", 9, "s", 5), (2, f"c  {p}\nd", 9, "t", 6)], "doc_id long, text string, n_chars long, doc string, spans int")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert got[1].text == f"a\n{p} b" and got[2].text == "c\nd" and got[2].n_chars == 3 and got[2].doc == "t" and got[2].spans == 6


def test_suffix_automaton():
    r = random.Random(1)
    for _ in range(50):
        texts = [[r.choice("ab") for _ in range(r.randint(0, 12))] for _ in range(3)]
        a = substring_dedup.SuffixAutomaton()
        for t in texts:
            a.add(t)
        joined = ["".join(t) for t in texts]
        q = "".join(r.choice("ab") for _ in range(15))
        want = [max((n for n in range(i + 2) if any(q[i + 1 - n : i + 1] in j for j in joined)), default=0) for i in range(len(q))]
        assert a.statistics(list(q)) == want


def test_runs_and_minima():
    h = WordHashes()([b"a", b"b", b"c", b"a", b"b", b"c", b"d"])
    for k in range(1, 7):
        assert (runs(h, k)[0] == runs(h, k)[3:4]).all() if k <= 3 else True
    x = np.random.default_rng(0).integers(0, 99, 50)
    assert all((sliding_min(x, w) == [x[i : i + w].min() for i in range(50 - w + 1)]).all() for w in range(1, 20))


# 2


def test_quality_on_held_out_documents(spark):
    r = random.Random(2)
    words = [f"word{i}" for i in range(400)]
    kinds = {2: lambda: " ".join(r.choices(words, k=80)), 1: lambda: " ".join([*r.choices(words, k=70), *r.choices(["vile", "nasty", "foul"], k=3)]), 0: lambda: " ".join(w.upper() + "!!" for w in r.choices(words, k=60))}
    rows = [(i, kinds[g](), g) for i in range(900) for g in [r.choices([0, 1, 2], [1, 1, 4])[0]]]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x")], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, 0 if g == 0 else 1, 1 if g == 1 else 0) for i, _, g in rows if i % 3] + [(None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [(g, got[i]) for i, _, g in rows if i % 3 == 0]
    assert np.mean([x.kept == (g == 2) for g, x in held]) > 0.95
    assert all(x.p_ge1 >= x.p_ge2 and abs(x.expected_grade - x.p_ge1 - x.p_ge2) < 1e-5 for _, x in held)
    assert got[5000].grade == got[5001].grade == 0 and not got[5000].kept
    assert quality.score(docs, quality.train(docs, labels.where("false"))).where("kept").count() == 900
    # repeated rows, several labels of one document and a very long text change nothing for the rest
    more = docs.union(docs.where("doc_id < 5")).union(spark.createDataFrame([(6000, "word1 " * 200_000, "x")], docs.schema))
    again = quality.score(more, quality.train(more, labels.union(labels.where("doc_id > 700"))))
    assert {tuple(r) for r in again.where("doc_id < 900").collect()} == {tuple(r) for i, r in got.items() if i < 900} and again.count() == more.count()
    assert quality.select_quality(docs.where("false"), labels).count() == 0


def test_fit_nears_the_best_likelihood():
    """The fitted thresholds and weights against plain gradient descent on the same likelihood."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    s = x @ [1.5, -1.0, 0.0] + rng.logistic(size=600)
    y = np.searchsorted([-1.0, 1.0], s)

    def loss(w, t1, t2):
        z = x @ w
        a, b = 1 / (1 + np.exp(t1 - z)), 1 / (1 + np.exp(t2 - z))
        return -np.log(np.clip(np.choose(y, [1 - a, a - b, b]), 1e-12, 1)).mean()

    p = np.array([0.0, 0.0, 0.0, -0.5, 0.5])
    for _ in range(3000):
        step = np.array([(loss((q := p + d)[:3], *q[3:]) - loss((q := p - d)[:3], *q[3:])) / 2e-5 for d in np.eye(5) * 1e-5])
        p -= 0.5 * step
    rows = [(int(g), np.arange(3, dtype=np.int32), v.astype(np.float32)) for g, v in zip(y, x)]
    w, t1, t2 = quality.fit(rows, epochs=30, l1=0.0, l2=0.0)
    assert t1 < t2 and loss(w[:3], t1, t2) < loss(p[:3], *p[3:]) + 0.02
    # a model's numbers for a text, by hand
    text = "Good words, good WORDS!"
    i, v = quality.Features()(text)
    known = (np.linspace(-1, 1, quality.DIMENSIONS), -0.3, 0.4)
    score = float((known[0][i] * v).sum())
    assert quality._sigmoid(score + 0.3) > quality._sigmoid(score - 0.4) and len(set(i.tolist())) == len(i)


# 3


def test_flac_round_trip():
    rng = np.random.default_rng(0)
    loads = [media.payload(t) for t in ODD] + [rng.integers(0, 256, 576 * 3, dtype=np.uint8).tobytes(), bytes(576), bytes(np.clip(128 + 100 * np.sin(np.arange(5760) / 9), 0, 255).astype(np.uint8))]
    coded = flac.encode_many(loads)
    assert flac.decode_many(coded) == loads
    assert flac.read_from(coded[-1], 1000, 2000) == loads[-1][1000:3000]
    broken = bytearray(coded[-1])
    broken[-30] ^= 8
    with pytest.raises(ValueError):
        flac.decode_many([bytes(broken)])


def test_media(spark, tmp_path):
    d = write(spark, tmp_path, "documents", list(enumerate(ODD)), "doc_id long, text string")
    got = {r.doc_id: r for r in media.op3_media(spark, d).collect()}
    for i, t in enumerate(ODD):
        p = media.payload(t)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert got[i].media_sha256 == hashlib.sha256(flac.encode_many([p])[0]).hexdigest() and got[i].feature == media.feature(p)
        assert got[i].media_bytes == len(flac.encode_many([p])[0])
    twice = spark.createDataFrame([(1, "x", 5, "f"), (1, "x", 5, "f"), (2, None, None, "g")], "doc_id long, text string, n_bytes int, feature string")
    again = [tuple(r) for r in media.decode_media(media.store_media(twice)).collect()]
    assert len(again) == 3 and again[0] == again[1] and media.decode_media(media.encode_media(twice.where("false"))).count() == 0
    coded = media.encode_media(spark.createDataFrame([(1, "x" * 90_000)], "doc_id long, text string"))
    blocks = media.pcm_blocks(coded).orderBy("block").collect()
    assert b"".join(b.pcm for b in blocks) == media.payload("x" * 90_000) and [b.sample_offset for b in blocks] == [36864 * i for i in range(len(blocks))]


# 4


def tf_idf(texts):
    """Every text's shingles and weights by true document frequencies."""
    sets, df = [], Counter()
    for t in texts:
        w = decontaminate.words_of(t)
        k = min(5, len(w))
        sets.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1) if k))
        df.update(sets[-1].keys())
    n = sum(map(bool, sets))
    return [{g: c * np.log1p(n / df[g]) for g, c in s.items()} for s in sets]


def similar(a, b):
    low = sum(min(x, b[g]) for g, x in a.items() if g in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if a and b else 0.0


@pytest.mark.parametrize("small", [32, 3])
def test_near_duplicates(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 8000)
    monkeypatch.setattr(near_dedup, "QUERY_BYTES", 3000)
    r = random.Random(3)
    words, docs = [f"w{i}" for i in range(2000)], []
    for size in (60, 150):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(30):
            w = list(base)
            for _ in range(r.randint(0, size // 40)):
                w[r.randrange(size)] = r.choice(words)
            docs += [" ".join(w)] * r.choice([1, 1, 2])
    rows = [*enumerate([*docs, "", "a b", "a b", None]), (None, docs[0]), (3, docs[3])]
    d = write(spark, tmp_path, "documents", rows, "doc_id long, text string")
    weighted = tf_idf([t for _, t in rows])
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similar(weighted[i], weighted[j]) >= 0.8:
                old = label[i]
                label = [label[j] if x == old else x for x in label]
    rank = lambda x: 2**63 - 1 if x is None else x
    want = sorted((str(rows[i][0]), str(min(rank(rows[j][0]) for j in range(len(rows)) if label[j] == label[i]))) for i in range(len(rows)))
    got = near_dedup.op4_near_dedup(spark, d).collect()
    assert sorted((str(x.doc_id), str(rank(x.class_id))) for x in got) == want
    kept = near_dedup.drop_near_duplicates(spark.read.parquet(f"{d}/documents.parquet"))
    assert kept.count() == len({c for _, c in want})


def test_near_copies_in_a_large_group(spark, tmp_path):
    """A group of copies doesn't make what its members share lighter than what each has alone."""
    r = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    docs = [" ".join(base)]
    for c in range(40):
        w = list(base)
        for i in range(r.randrange(10, 40), 190, 48):
            w[i] = f"e{c}x{i}"
        docs.append(" ".join(w))
    docs += [" ".join(f"f{k}x{i}" for i in range(7)) for k in range(6000)]
    framed = [f"c{i}" for i in range(60)]
    docs += [" ".join([*framed, *(f"g{k}x{i}" for i in range(20))]) for k in range(1500)]
    d = write(spark, tmp_path, "documents", list(enumerate(docs)), "doc_id long, text string")
    of = {x.doc_id: x.class_id for x in near_dedup.op4_near_dedup(spark, d).collect()}
    assert all(of[i] == (0 if i <= 40 else i) for i in range(len(docs)))


def test_document_frequencies(spark, monkeypatch):
    """The blocks' codes against true counts, with several groups."""
    monkeypatch.setattr(near_dedup, "GROUP_BYTES", 2000)
    docs = corpus(9, 80) + [(300, None), (301, "x y")]
    blocks = near_dedup._blocks(spark.createDataFrame(docs, "doc_id long, text string"))
    codes = near_dedup._frequencies(blocks).collect()
    assert len({r.p for r in codes}) > 3
    hashes, df = WordHashes(), Counter()
    for _, t in docs:
        df.update(near_dedup.shingles_of((t or "").encode(), hashes)[0].tolist())
    for r in blocks.collect():
        _, _, distinct, _, _ = near_dedup._shingled(r.sizes, r.pressed, hashes)
        got = np.frombuffer(b"".join(bytes(c.codes) for c in sorted(codes, key=lambda c: c.p) if c.block == r.block), np.uint8)
        assert got.tolist() == [round(near_dedup.STEPS * np.log2(df[x])) for x in distinct.tolist()]


def test_near_duplicates_of_odd_rows(spark):
    """Null ids, rows that share an id, the greatest and least ids, columns of the operator's own names."""
    big, t = 2**63 - 1, [" ".join(f"w{i}{k}" for i in range(30)) for k in "abc"]
    rows = [(None, t[0]), (None, t[1]), (big, t[0]), (-(2**63), t[2]), (7, t[1]), (7, t[2]), (7, None), (8, ""), (None, None), (7, t[1])]
    df = spark.createDataFrame([(i, x, "r", 1) for i, x in rows], "doc_id long, text string, row string, rid int")
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    kept = sorted(((r.doc_id, r.text, r.row, r.rid) for r in near_dedup.drop_near_duplicates(df).collect()), key=str)
    assert kept == sorted([(big, t[0], "r", 1), (7, t[1], "r", 1), (-(2**63), t[2], "r", 1), (7, None, "r", 1), (8, "", "r", 1), (None, None, "r", 1)], key=str)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables are absent")
def test_recall_on_the_table(spark):
    """Of all pairs at 0.8 or more of a document whose id is divisible by 50 and any other: how many are in one class."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    weights = tf_idf([t for _, t in rows])
    near = [(i, j) for i, (d, _) in enumerate(rows) if d % 50 == 0 for j in range(len(rows)) if i != j and similar(weights[i], weights[j]) >= 0.8]
    of = {r.doc_id: r.class_id for r in near_dedup.op4_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    hits = [of[rows[i][0]] == of[rows[j][0]] for i, j in near]
    assert len(hits) > 0 and sum(hits) >= 0.9 * len(hits)


def test_samples_agree_as_often_as_sets():
    rng = np.random.default_rng(0)
    s = np.unique(rng.integers(1, 2**62, 300, dtype=np.uint64))
    a, b = s[:240], s[60:]
    sample = near_dedup.Sampler(3000)
    share = (sample(a, np.full(len(a), 2.0)) == sample(b, np.full(len(b), 2.0))).mean()
    assert abs(share - len(np.intersect1d(a, b)) / len(s)) < 0.04


# 5, 6, 10


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


def ids_of(t, lib):
    return lib.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    from spotweave.llm.tokens import encoder

    chars = [chr(c) for c in range(1, 0x2100) if not 0xD800 <= c < 0xE000]
    texts = ODD + [f"a{c}b {c} 1{c}2 .{c}{c}x" for c in chars]
    ids, ends = encoder(P.path(name)).encode(pa.array(texts))
    lib, begin = library(name), 0
    for t, end in zip(texts, ends.tolist()):
        assert ids[begin:end].tolist() == ids_of(t, lib), repr(t)
        begin = end


def test_other_tokenizers_go_to_the_library(tmp_path):
    from spotweave.llm import tokens

    lib = json.loads(open(P.path("byte_bpe_50k.json"), encoding="utf-8").read())
    lib["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(lib), encoding="utf-8")
    coder, own = tokens.encoder(str(tmp_path / "other.json")), tokens.ChunkEncoder(str(tmp_path / "other.json")).library
    assert type(coder) is tokens.Whole and type(tokens.encoder(P.path("byte_bpe_50k.json"))) is tokens.ByteBPE and type(tokens.encoder(P.path("word_bpe_49k.json"))) is tokens.WordBPE
    assert coder.encode(pa.array(ODD))[0].tolist() == [i for t in ODD for i in ids_of(t, own)]


def test_token_counts(spark, tmp_path):
    d = write(spark, tmp_path, "documents", list(enumerate(ODD)), "doc_id long, text string")
    lib = library("byte_bpe_50k.json")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op5_token_counts(spark, d).collect()}
    assert got == {i: (len((t or "").encode()), n, n > 512) for i, t in enumerate(ODD) for n in [len(ids_of(t, lib))]}
    twice = spark.createDataFrame([(1, "a b c", 7, "x"), (1, "a b c", 7, "x")], "doc_id long, text string, n_tokens int, other string")
    assert [(r.n_tokens, r.other) for r in token_counts.count_tokens(twice, P.path("byte_bpe_50k.json")).collect()] == [(3, "x")] * 2
    assert token_counts.count_tokens(twice.where("false"), P.path("byte_bpe_50k.json")).count() == 0


def test_token_files(spark, tmp_path):
    rows = [(i * 7 % 18, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again"), (-(2**63), "least"), (2**63 - 1, "most")]
    d = write(spark, tmp_path, "documents", rows, "doc_id long, text string")
    lib, start, want = library("word_bpe_49k.json"), 0, []
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.xxhash64("text"))
    for i, t, _ in sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1] or "")):
        ids = [*ids_of(t, lib), 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.op6_token_files(spark, d).collect()), key=lambda r: r[1]) == want
    # columns of other names, an empty table, the file of bases, files that can only be read in parts
    folder = f"file://{tmp_path}/files"
    parts = token_files.write_token_files(df.withColumn("part", F.lit("x")), P.path("word_bpe_49k.json"), folder)
    made = sorted(parts.collect())
    assert np.fromfile(f"{tmp_path}/files/bases", "<u8").tolist() == [*(r.base for r in made), start]
    stored = token_files.Stored(f"{folder}/000000.offsets", "<u8")
    whole = stored[0 : stored.size].tolist()
    stored.map, stored.file = None, pa.OSFile(f"{tmp_path}/files/000000.offsets")
    assert stored[1:3].tolist() == whole[1:3]
    assert token_files.read_token_files(token_files.write_token_files(df.where("false"), P.path("word_bpe_49k.json"), folder + "0"), folder + "0").count() == 0


def check_packing(rows, pieces, lib):
    by_doc: dict = {}
    for p in sorted(pieces, key=lambda p: (str(p.doc_id), p.start)):
        by_doc.setdefault(p.doc_id, []).append(p)
    for i, t in rows:
        ids, at = np.array([*ids_of(t, lib), 0], "<u4"), 0
        for p in by_doc[i]:
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    fill: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values(), default=0) <= 1024 and set(fill) == set(range(len(fill)))
    used = sum(fill.values())
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in fill.values())  # none at a power of two
    return used / max(1, used + padding)


def prose(r, n):
    return ". ".join(" ".join(r.choices(["the", "quick", "foxes", "jump"], k=9)) for _ in range(n))


def check_ranges(rows, pieces, lib, least):
    """Pieces of rows that may share a doc_id: told apart by the order of their sequences."""
    ids = sorted(([*ids_of(t, lib), 0] for _, t in rows), key=len)
    ordered = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    docs: list = []
    for p in ordered:
        if p.start == 0:
            docs.append([])
        docs[-1].append(p)
    assert sorted((str(d[0].doc_id), d[0].doc_tokens) for d in docs) == sorted((str(i), len(ids_of(t, lib)) + 1) for i, t in rows)
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    whole = [[(p.start, p.length, p.ids_crc32) for p in d] for d in docs]
    left = list(ids)
    for parts in whole:
        assert [a for a, _, _ in parts] == list(np.cumsum([0] + [n for _, n, _ in parts])[:-1])
        hit = next(x for x in left if len(x) == sum(n for _, n, _ in parts) and all(crc(x[a : a + n]) == c for a, n, c in parts))
        left.remove(hit)
    assert not left
    fill: dict = {}
    for p in ordered:
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values()) <= 1024 and set(fill) == set(range(len(fill)))
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in fill.values()) <= (1 - least) * sum(fill.values())


def test_packing(spark, tmp_path):
    r = random.Random(4)
    rows = list(enumerate(ODD)) + [(100 + i, prose(r, r.randint(1, 90))) for i in range(150)]
    d = write(spark, tmp_path, "documents", rows, "doc_id long, text string")
    assert check_packing(rows, packing.op10_packing(spark, d).collect(), library("byte_bpe_50k.json")) > 0.93
    assert packing.pack(spark.read.parquet(f"{d}/documents.parquet").where("false"), P.path("byte_bpe_50k.json")).count() == 0


def test_packing_in_several_blocks(spark):
    """Small blocks, a document longer than a block, null and repeated ids, equal rows, names that the operator uses."""
    r = random.Random(8)
    rows = [(i // 2, prose(r, r.randint(1, 90))) for i in range(60)] + [(None, prose(r, 20)), (None, prose(r, 30)), (5, prose(r, 5000)), (None, None)]
    rows += [rows[0], rows[-2]]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, tag string").coalesce(1)
    pieces = packing.pack(df, P.path("byte_bpe_50k.json"), block=1 << 14).collect()
    check_ranges(rows, pieces, library("byte_bpe_50k.json"), 0.93)


def test_cuts_are_the_best():
    r = random.Random(5)
    for _ in range(60):
        pos = np.cumsum([0] + [r.randint(1, 30) for _ in range(25)])
        cost = np.array([0.0] + [r.choice([0.0, 2.0, 8.0]) for _ in range(25)])
        pad = lambda w: 0 if w & (w - 1) == 0 else 64 - w
        best = [0.0] + [np.inf] * 25
        for j in range(1, 26):
            best[j] = min(best[i] + pad(int(pos[j] - pos[i])) for i in range(j) if pos[j] - pos[i] <= 64) + cost[j] + packing.SEQUENCE_COST
        cuts = packing.best_cuts(pos, cost, 64)
        where = {int(p): i for i, p in enumerate(pos)}
        got = sum(pad(b - a) + cost[where[b]] + packing.SEQUENCE_COST for a, b in zip([0, *cuts[:-1]], cuts))
        assert cuts[-1] == pos[-1] and got == pytest.approx(best[-1])


# 7


def test_tool_calls(spark):
    call = lambda *c: json.dumps({"tool_calls": list(c)})
    one = lambda i, after=(), **a: {"id": i, "name": "f", "arguments": a, "after": list(after)}
    rows = [(1, 0, "assistant", call(one("a", n=1), one("b", ["a"], n=2))), (1, 1, "tool", '{"tool_call_id":"a","content":"é"}'), (1, 2, "assistant", call(one("c", ["a", "b"], n="x"), one("d", ["c"], n=1), one("a", n=9)))]
    rows += [(1, 3, "tool", '{"tool_call_id":"zz","content":1}'), (1, 4, "assistant", None), (1, 5, "tool", "no json"), (2, 0, "assistant", call(one("p", ["q"], n=1), one("q", ["p"], n=1), one("r", ["gone"], n=1), one("s", ["r", "q"], n=1))), (None, 0, "assistant", call({"id": "u", "name": "g"}))]
    rows += [(3, 2 * i, "assistant", call(one(f"k{i}", [f"k{i - 1}"] if i else [], n=i))) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r for r in chat_format.link_tool_calls(df, {"f": {"n": ("integer", True)}}).collect()}
    assert [got[1, i].level for i in "abcd"] == [0, 1, 2, 3] and got[1, "a"].n_repeats == 1 and got[1, "a"].valid and got[1, "a"].result_turn == 1
    assert got[1, "c"].errors == "n: not integer; no result" and got[1, "zz"].errors == "result without a call"
    assert got[2, "p"].level is None and got[2, "s"].level is None and got[2, "r"].level == 0 and "no call gone" in got[2, "r"].errors
    assert got[None, "u"].errors.startswith("unknown tool") and [got[3, f"k{i}"].level for i in range(40)] == list(range(40))
    assert json.loads(got[1, "a"].json)["result"] == "é" and got[1, "a"].json.startswith('{"after":[],"arguments":{"n":1}')
    assert chat_format.link_tool_calls(df.where("false"), {}).count() == 0


def test_odd_tool_messages(spark):
    """What a user may send to break it: names that are no strings, depth, lone surrogates, NaN, huge numbers, long texts."""
    deep = '{"tool_calls":[{"id":"d","name":"f","arguments":' + '{"a":' * 100_000 + "1" + "}" * 100_000 + "}]}"
    texts = ['{"tool_calls":[{"id":1,"name":{}}]}', deep, '{"tool_calls":[{"id":"\\ud800","name":"f","arguments":{"n":"\\udfff"}}]}', '{"tool_calls":[{"id":"nan","name":"f","arguments":{"n":NaN}}]}', '{"tool_calls":[{"id":"inf","name":"f","arguments":{"n":1e999}}]}', '{"tool_calls":[{"id":[1],"name":"f","arguments":{"n":"' + "x" * 3_000_000 + '"}},{"id":true,"name":"f"}]}', '{"tool_calls":[{"id":"s","name":"f","arguments":' + '{"a":' * 150 + "1" + "}" * 150 + "}]}", "{" * 1000]
    df = spark.createDataFrame([(1, i, "assistant", t, "c") for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string, v string")
    got = {r.call_id: r for r in chat_format.link_tool_calls(df, {"f": {"n": ("string", False)}}).collect()}
    assert set(got) == {"1", "\\ud800", "[1]", "true", "s"}
    assert got["1"].errors == "unknown tool; no result" and json.loads(got["\\ud800"].json)["arguments"] == {"n": "\udfff"}
    assert len(json.loads(got["[1]"].json)["arguments"]["n"]) == 3_000_000 and "a: unknown" in got["s"].errors


# 8


def test_url_rules(spark):
    urls = ["http://a.NET/x", "https://example.net/en/1?q", "http://sub.example.com/de/", "http://x.org/fr/a#t", "http://net", "ftp://y.net?x", None, "no scheme", "http://anet/", "http://example.net/en", "a://b://c.net/", ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect()), key=str)
    want = [(0, "net/", "block"), (0, "net/", "block"), (1, "example.net/en/", "allow"), (2, "example.com/de/", "block"), (3, "org/fr/", "allow"), *((i, None, "allow") for i in (4, 5, 6, 7, 8)), (9, "net/", "block"), (10, None, "allow"), (11, None, "allow")]
    assert got == sorted(want, key=str)
    none = url_filter.filter_urls(df, rules.where("false")).collect()
    assert len(none) == len(got) and all(r.rule is None and r.verdict == "allow" for r in none)
    assert url_filter.filter_urls(df.where("false"), rules).count() == 0
    wide = spark.createDataFrame([(1, "http://a.net/" + "x" * 2_000_000, "h", "p", "d")], "page_id long, url string, host string, path string, digest string")
    assert [(r.rule, len(r.path)) for r in url_filter.filter_urls(wide, rules).collect()] == [("net/", 2_000_001)]


# 9


def test_decontamination(spark, monkeypatch):
    r = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    items = [(str(i), " ".join(r.choices(words, k=r.choice([3, 8, 15])))) for i in range(12)] + [("n", None), ("e", "")]
    docs = []
    for i in range(60):
        w = r.choices(words, k=r.randint(0, 30))
        if i % 2:
            w += items[r.randrange(12)][1].upper().split() + items[r.randrange(12)][1].split()
        docs.append((i, ", ".join(w)))
    docs += [(100, None), (101, ""), (3, docs[3][1])]
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = []
    for i, t in docs:
        w, hit, found = decontaminate.words_of(t), set(), set()
        for name, text in items:
            b = decontaminate.words_of(text)
            n = min(8, len(b))
            for a in range(len(b) - n + 1 if n else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == b[a : a + n]:
                        hit |= set(range(k, k + n))
                        found.add(name)
        want.append((i, len(w), len(hit), sorted(found)))
    for block, pairs in ((8 << 20, 1 << 20), (60, 7)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        got = decontaminate.mark_contaminated(df, bench)
        assert sorted((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got.collect()) == sorted(want)
    assert decontaminate.decontaminate(df, bench).count() == sum(len(x[3]) < 2 for x in want)
    assert decontaminate.mark_contaminated(df.where("false"), bench).count() == 0
    assert decontaminate.mark_contaminated(df, bench.where("false")).where("n_hit > 0").count() == 0


def test_longest_matches(spark):
    """Places, lengths and items; long texts of one word; user's columns of the operator's names; items without an id."""
    r = random.Random(7)
    w = [f"u{i}" for i in range(200)]
    bench = spark.createDataFrame([("a", " ".join(w[:20])), ("b", " ".join(w[10:40])), ("c", "same " * 1000), ("short", "one two"), (None, " ".join(w[100:120]))], "item_id string, text string")
    docs = [(1, " ".join(["x", *w[5:30], "y", *w[12:20]]), 3), (2, "same " * 40_000, 4), (3, "one two " * 3, None), (4, " ".join(w[100:120]), 5), (5, " ".join(r.choices(w, k=300_000)), 6)]
    got = {d.doc_id: d for d in decontaminate.mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string, _hit int"), bench).collect()}
    assert [(m.item_id, m.item_at, m["at"], m["length"]) for m in got[1].matches] == [("a", 5, 1, 15), ("b", 0, 6, 20), ("a", 12, 27, 8)]
    assert got[1].n_hit == 33 and got[1]["items"] == ["a", "b"] and got[1]._hit == 3
    assert got[2].n_hit == 40_000 and got[2]["items"] == ["c"] and (got[2].matches[0]["at"], got[2].matches[0]["length"]) == (0, 1000)
    assert got[3].n_hit == 6 and got[3]["items"] == ["short"] and len(got[3].matches) == 3
    assert got[4].n_hit == 0 and got[5].n_words == 300_000


def test_flac_frames_that_hold_the_next_header():
    """A frame of verbatim samples that hold frame 1's whole header, CRC-8 included."""
    rng = np.random.default_rng(3)
    head = flac._header_of(1)
    raw = rng.integers(0, 256, 576 * 80, dtype=np.uint8)
    raw[100 : 100 + len(head)] = np.frombuffer(head, np.uint8) ^ 128  # samples are stored with their sign turned
    coded = flac.encode_many([raw.tobytes()])[0]
    assert coded.count(head) == 2
    assert flac.decode_many([coded, coded]) == [raw.tobytes()] * 2
    for at in (0, 600, 576 * 70 + 5):
        assert flac.read_from(coded, at, 1000) == raw.tobytes()[at : at + 1000]


def plain_flac(media):
    """A decoder of its own, bit by bit, of the streams written here."""
    bits, at, out = "".join(f"{b:08b}" for b in media), 32, []
    last = "0"
    while last == "0":
        last, size = bits[at], int(bits[at + 8 : at + 32], 2)
        at += 32 + 8 * size

    def take(n):
        nonlocal at
        at += n
        return int(bits[at - n : at], 2) if n else 0

    signed = lambda v, n: v - (1 << n) if v >> (n - 1) else v
    while at < len(bits):
        assert take(15) == 0b111111111111100 and take(1) == 0 and take(4) == 2 and take(4) == 4 and take(4) == 0 and take(4) == 2
        lead = take(8)
        while lead & 64 and lead & 128:
            take(8)
            lead = lead << 1 & 255
        take(8)
        assert take(1) == 0
        kind, _, x = take(6), take(1), []
        if kind == 0:
            x = [signed(take(8), 8)] * 576
        elif kind == 1:
            x = [signed(take(8), 8) for _ in range(576)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [signed(take(8), 8) for _ in range(order)]
            shift, c = 0, [[], [1], [2, -1]][order] if kind < 32 else None
            if kind >= 32:
                width, shift = take(4) + 1, take(5)
                c = [signed(take(width), width) for _ in range(order)]
            assert take(2) == 0 and take(4) == 0
            k = take(4)
            while len(x) < 576:
                q = bits.index("1", at) - at
                at += q + 1
                u = q << k | take(k)
                x.append((u >> 1 ^ -(u & 1)) + (sum(a * b for a, b in zip(c, x[::-1])) >> shift))
        at += -at % 8 + 16
        out += x
    return bytes(v & 255 ^ 128 for v in out)


def test_streams_by_a_plain_decoder():
    rng = np.random.default_rng(1)
    loads = [media.payload(t) for t in ODD if len(t or "") < 3000] + [rng.integers(0, 256, 576, dtype=np.uint8).tobytes(), bytes(np.clip(128 + 90 * np.sin(np.arange(1152) / 7), 0, 255).astype(np.uint8))]
    for p, m in zip(loads, flac.encode_many(loads)):
        assert plain_flac(m) == p
        x = np.frombuffer(p, np.uint8).astype(int) - 128
        rms, zc = (sum(int(v) ** 2 for v in x) / len(x)) ** 0.5, sum((a < 0) != (b < 0) for a, b in zip(x, x[1:])) * 1000 / len(x)
        assert media.feature(p) == f"rms={rms:.4f};zc={zc:.3f};peak={max(abs(int(v)) for v in x)}"
