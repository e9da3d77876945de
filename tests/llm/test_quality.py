import zlib

import numpy as np
from pyspark.sql import functions as F

from creditline.llm import queries
from creditline.llm.quality import BUCKETS, DIM, Buckets, add_contexts, index_vectors, quality_scores, word_vectors
from tests.conftest import MEDIUM

LABELS = "doc_id bigint, quality int, toxic int, lang string"


def test_query_held_out_accuracy(spark):
    rows = queries.op5_quality(spark, MEDIUM).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    # probabilities are calibrated: their mean is near the share of ones
    assert abs(np.mean([r.score for r in held]) - np.mean([labels[r.doc_id] for r in held])) < 0.06


def test_contexts_by_definition(spark, make):
    texts = ["A b, c b", "", "b b b", None]
    places, signs = index_vectors()
    want, known = np.zeros((BUCKETS, DIM)), Buckets()
    for t in texts:
        ids = known.of(t or "").astype(int).tolist()
        for i, x in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i:
                    for p, s in zip(places[ids[j]], signs[ids[j]], strict=True):
                        want[x, p] += s
    total = np.zeros(BUCKETS * DIM, np.int64)
    add_contexts(total, [known.of(t or "") for t in texts], places, signs)
    assert (total.reshape(BUCKETS, DIM) == want).all()
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    got = word_vectors(make([(i, t) for i, t in enumerate(texts)]))
    assert np.allclose(got, want / np.maximum(norm, 1e-12), atol=1e-6)
    assert len(known.of("Ab cd!! EF")) == 6  # ab <capital> cd !! ef <upper>


def test_training_folds_only_and_edge_rows(spark, make):
    rng = np.random.default_rng(2)
    good = [(i, " ".join(rng.choice(["the", "cat", "sat", "on", "mats"], 40))) for i in range(200)]
    bad = [(1000 + i, " ".join(rng.choice(["$$$", "##", "THE", "cat"], 40))) for i in range(100)]
    rows = good + bad + [(5000, None), (5001, ""), (None, "the cat"), (5002, "the cat " * 50_000), (3, good[3][1])]
    marks = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 0), (5001, None), (0, 1), (0, 0)]
    frame = spark.createDataFrame([(i, q, 0, "x") for i, q in marks], LABELS)
    odd = F.col("doc_id") % 2 == 1
    got = quality_scores(make(rows), frame, odd).collect()
    assert len(got) == len(rows)
    score = {r.doc_id: r.score for r in got}
    assert all(score[i] > 0.5 for i, _ in good) and all(score[i] < 0.5 for i, _ in bad)
    assert score[5000] == score[5001] and all(0 <= s <= 1 for s in score.values())
    assert len([r for r in got if r.doc_id == 3]) == 2
    # labels outside the fold change nothing
    flipped = spark.createDataFrame([(i, q if i is None or q is None or i % 2 else 1 - q, 0, "x") for i, q in marks], LABELS)
    assert {r.doc_id: r.score for r in quality_scores(make(rows), flipped, odd).collect()} == score


def test_one_class_no_labels_empty(spark, make):
    ones = spark.createDataFrame([(1, 1, 0, ""), (2, 1, 0, "")], LABELS)
    docs = make([(1, "a"), (2, "b"), (3, None)])
    assert {round(r.score, 6) for r in quality_scores(docs, ones, F.lit(True)).collect()} == {0.75}
    assert {r.score for r in quality_scores(docs, ones.limit(0), F.lit(True)).collect()} == {0.5}
    assert quality_scores(make([]), ones, F.lit(True)).collect() == []
