import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality as Q

ROOT = "/root/testdata/sf0.01"


def test_log_count_ratios():
    rows = [np.array([0, 1]), np.array([1]), np.array([2])]
    got = Q.log_count_ratios(rows, np.array([1, 1, 0]), 3)
    want = [np.log((x / 6) / (y / 4)) for x, y in ((2, 1), (3, 1), (1, 2))]
    assert got == pytest.approx(want)


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(80)]
    labels = np.array([int(3 in r or rng.random() < 0.2) for r in rows])
    ratios = Q.log_count_ratios(rows, labels, 30)
    w, b = Q.dual_descent(rows, labels, ratios, 0.3, 3000)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r]
    x[:, 30] = 1
    y, c = np.where(labels == 1, 1, -1), np.where(labels == 1, 1, (labels == 1).sum() / (labels == 0).sum()) * 0.3
    loss = lambda v: v @ v / 2 + (c * np.maximum(0, 1 - y * (x @ v))).sum()
    best = loss(np.append(w, b))
    for _ in range(300):
        assert loss(np.append(w, b) + rng.normal(0, 0.01, 31)) >= best - 1e-6


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/labels.parquet")
    held = Q.crc_of(F.col("doc_id")) % 3 == 1
    model = Q.train(docs, labels, ~held)
    got = Q.score(docs, model).join(labels, "doc_id").where(held).select("score", "quality").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.quality) for r in got]) > 0.95
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and 0.8 < kept.count() / docs.count() < 0.99


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "good text", "x"), (1, "good text", "x"), (2, None, None), (None, "", "y"), (3, "b" * 200_000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, None), (9, 1, 1), (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels, F.lit(True))
    rows = Q.score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert Q.train(docs, labels.where("quality = 1"), F.lit(True)).constant == 1.0
    assert Q.train(docs, labels.limit(0), F.lit(True)).constant == 0.5
    assert Q.score(docs.limit(0), model).collect() == []


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "good text", 5, 6, 7)], "doc_id long, text string, _t int, _quality int, c0 int")
    model = Q.Model(np.zeros(1 << Q.BITS, np.float32), 0.0, constant=1.0)
    assert Q.keep_good(docs, model).collect() == docs.collect()
    assert Q.score(docs, model).columns == [*docs.columns, "score"]


def test_packed_features_are_bounded():
    rng = np.random.default_rng(1)
    for n in (0, 1, 8191, 8192, 8193, 100_000, 1 << Q.BITS):
        columns = np.sort(rng.permutation(1 << Q.BITS)[:n]).astype(np.int32)
        assert len(Q.packed(columns)) <= (1 << Q.BITS) // 8 + 1
        assert Q.unpacked(Q.packed(columns)).tolist() == columns.tolist()
