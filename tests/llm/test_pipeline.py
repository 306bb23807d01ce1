"""Every stage of the pipeline on its own input, against a brute-force version."""

import os
import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def kept_by_quality(spark, rows):
    """Each text's features, scored one by one with the fitted model."""
    from spotweave.llm import quality

    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    w, t1, t2 = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    out = []
    for i, t in rows:
        idx, val = quality.Features()(t)
        tail = 1 / (1 + np.exp(t2 - sum(float(w[k]) * float(v) for k, v in zip(idx, val)))) if len(idx) else 0.0
        if tail >= 0.5:
            out.append(i)
    return out


def firsts_of_classes(rows):
    from .test_operators import similar, tf_idf

    weights, label = tf_idf([t for _, t in rows]), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similar(weights[i], weights[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    return [min(rows[j][0] for j in range(len(rows)) if label[j] == c) for c in set(label)]


def without_benchmark(spark, rows):
    from spotweave.llm import decontaminate

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = decontaminate.words_of(r.text)
        n = min(8, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    out = []
    for i, t in rows:
        w = decontaminate.words_of(t)
        if not any(tuple(w[a : a + n]) in windows for n in {len(x) for x in windows} for a in range(len(w) - n + 1)):
            out.append(i)
    return out


def test_stages(spark):
    from spotweave.llm.common import materialize

    from .test_operators import check_packing, library, removed

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), "stage")
        after = {r.doc_id: r for r in docs.collect()}
        rows = [(d, r.text) for d, r in before.items()]
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == len(after)
        if name == "substring_dedup":
            want = {d: (n, gone) for d, n, gone, _ in removed(rows)}
            assert {d: (len(before[d].text.split()), len(before[d].text.split()) - len(after[d].text.split())) for d in before} == want
            continue
        assert all(after[d] == before[d] for d in after)
        want = {"quality": lambda: kept_by_quality(spark, rows), "near_dedup": lambda: firsts_of_classes(rows), "decontaminate": lambda: without_benchmark(spark, rows)}[name]()
        assert sorted(after) == sorted(want), name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert check_packing([(d, r.text) for d, r in after.items()], pieces, library("byte_bpe_50k.json")) > 0.95


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, a very long text, and columns that clash with the operators' own names."""
    r = random.Random(1)
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()
    long = " ".join(f"w{r.randrange(10**6)}." for _ in range(300_000))
    rows = [(x.doc_id, x.text) for x in base] + [(None, base[0].text), (None, "some few words"), (None, None), (7, None), (8, ""), (9, "  "), (10_000, long), (base[1].doc_id, base[1].text)]
    names = "pressed string, rid int, nul string, label string, kept int, tag string, _hit int, items string, grade int, rows int, row int, size int"
    every = spark.createDataFrame([(*x, "p", 1, "n", "l", 2, "t", 3, "i", 4, 5, 6, 7) for x in rows], "doc_id long, text string, " + names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, every, SF)
        assert out.columns == every.columns, name
        assert out.count() > 0 and set(map(tuple, out.drop("doc_id", "text").collect())) == {("p", 1, "n", "l", 2, "t", 3, "i", 4, 5, 6, 7)}, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, every, SF)
    assert sum(p.length == p.doc_tokens for p in pieces.collect()) >= 6 and pieces.select("doc_id").where("doc_id IS NULL").count() >= 3
