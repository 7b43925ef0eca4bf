"""Hard negatives, centroid clustering and the quality classifier against brute force, and on awkward rows."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from thermoload.llm import bisector_clusters, hard_negatives, quality_qda
from thermoload.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id bigint, embedding array<float>, label int, score string, rank string, cluster string, `key` string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], VECTORS).repartition(3)


# --- hard negatives ------------------------------------------------------------------------

@pytest.mark.parametrize("big", [1, 1 << 20])
@pytest.mark.parametrize("d", [0, 3, 8, 29])
def test_threshold_join_finds_every_pair(d, big):
    rng = np.random.default_rng(d)
    x = (rng.normal(size=(300, d)) * rng.exponential(40, (1, d)) * rng.exponential(1, (300, 1))).astype(np.int64) * big
    q = x[:40]
    x, q = hard_negatives._exact(x, q)
    assert (x.dtype == object) == (big > 1 and d > 0)
    index, exact = hard_negatives.Index(x), (x @ q.T)
    for share in (0.9, 0.5, 0.2, 0.0, -0.5, -np.inf):
        t = np.full(len(q), share if share == -np.inf else share * index.most(q).max()) if d == 0 else share * np.maximum(index.most(q), 1)
        a, r, p = index.above(q, t)
        want = {(int(i), int(j)) for j, i in zip(*np.nonzero(exact >= t[None, :]))}
        assert len(a) == len(want) and set(zip(a.tolist(), r.tolist())) == want
        assert all(exact[j, i] == s for i, j, s in zip(a, r, p.tolist()))


def brute_negatives(rows, n=5, percent=80):
    rows = {(i, lab, tuple(math.floor(256 * float(np.float32(v))) for v in vec)) for i, vec, lab in rows
            if i is not None and lab is not None and vec is not None
            and all(v is not None and math.isfinite(v) for v in vec)}
    out = []
    for i, lab, vec in rows:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(vec, v)), j, other) for j, other, v in rows if len(v) == len(vec)]
        for s, j, _ in sorted(x for x in scored if x[2] == lab and x[1] != i)[:n]:
            hard = sorted(x for x in scored if x[2] != lab and percent * -s <= 100 * -x[0] <= 100 * -s)[:n]
            out += [(i, j, k, h[1], -s, -h[0]) for k, h in enumerate(hard, 1)]
    return sorted(out)


def mined(df, **kw):
    got = hard_negatives.mine(hard_negatives.prepare(df), F.col("id") % 100 == 0, **kw)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, 10))
    return [(int(i * 25), [float(np.float32(v)) for v in centre[i % 4] + rng.normal(size=10) * rng.choice([0.01, 1])], int(rng.integers(3)))
            for i in range(n)]


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    rows = vectors(1, 400)
    rows += rows[:30] * 3                                      # repeated rows
    rows += [(100, [0.5] * 10, 1), (100, [0.5] * 10, 2), (100, [-0.25] * 10, 1)]  # an id with several contents
    rows += [(10_000 + i, rows[4][1], 2) for i in range(40)]   # ties
    rows += [(20_000, None, 1), (20_100, [1.0] * 9 + [None], 1), (20_200, [math.nan] * 10, 1), (20_300, [math.inf] * 10, 0),
             (20_400, [1.0] * 10, None), (None, [1.0] * 10, 1), (20_500, [], 1), (20_501, [], 1), (20_502, [], 2),
             (20_600, [1.0, 2.0], 1), (20_601, [1.0, 2.0], 1), (20_602, [1.0, 1.5], 0), (20_700, [0.0] * 10, 2)]
    want = brute_negatives(rows)
    df = table(spark, rows)
    assert len(want) > 200 and mined(df) == want
    monkeypatch.setattr(hard_negatives, "ROWS", 60)   # many chunks and groups
    monkeypatch.setattr(hard_negatives, "ANCHORS", 25)
    monkeypatch.setattr(hard_negatives, "TOGETHER", 7)
    assert mined(df) == want
    assert mined(df, n_negatives=2, percent=50) == [r for r in brute_negatives(rows, 5, 50) if r[2] <= 2]


def test_hard_negatives_of_large_numbers(spark):
    rows = [(i, [v * 2.0 ** 18 for v in vec], lab) for i, vec, lab in vectors(2, 60)]
    assert mined(table(spark, rows)) == brute_negatives(rows) != []


def test_hard_negatives_of_nothing(spark):
    assert mined(table(spark, [])) == [] and mined(table(spark, vectors(3, 1))) == []
    assert mined(table(spark, [(7, [1.0], 1), (8, [1.0], 1)])) == []  # no anchor


# --- clusters -----------------------------------------------------------------------------------

@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
@pytest.mark.parametrize("wide", [3, 1 << 30])
def test_tournament_is_the_nearest_centroid(k, wide):
    rng = np.random.default_rng(k)
    x = rng.integers(-wide, wide + 1, (500, 4))
    c = rng.integers(-wide, wide + 1, (k, 4)).tolist()
    c[-1] = c[0]  # a repeated centroid: the smaller number wins
    b = bisector_clusters.bisectors(c)
    x = x.astype(object) if wide > bisector_clusters.SAFE else x
    far = np.array([[sum((int(p) - q) ** 2 for p, q in zip(row, m)) for m in c] for row in x], dtype=object)
    won = bisector_clusters.nearest(x, b)
    assert won.tolist() == [min(range(k), key=lambda j, r=r: (r[j], j)) for r in far]
    assert bisector_clusters.distances(x, won, b).tolist() == [min(r) for r in far]


def brute_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * float(np.float32(v))) for v in vec]) for i, vec, _ in rows
            if vec is not None and len(vec) == size and all(v is not None and math.isfinite(v) for v in vec)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [list(v) for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    def put(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(put(v)[1], []).append(v)
        for j, vs in members.items():
            centroids[j] = [sum(col) // len(vs) for col in zip(*vs)]
    return sorted(((i, *reversed(put(v))) for i, v in kept), key=str), centroids


@pytest.mark.parametrize("k", [1, 6, 500])
def test_clusters_match_brute_force(spark, k):
    rows = vectors(4, 150) + vectors(4, 150)[:20] * 4 + [(3, None, 1), (4, [1.0] * 9, 1), (5, [1.0] * 9 + [None], 1),
                                                          (6, [math.nan] * 10, 1), (7, [-math.inf] * 10, 1), (None, [0.1] * 10, None)]
    got, centroids = bisector_clusters.cluster(table(spark, rows), k=k, rounds=3, size=10)
    want, means = brute_clusters(rows, k, 3, 10)
    assert centroids == means
    assert sorted(((r.id, r.cluster, r.distance) for r in got.collect()), key=str) == want
    full = bisector_clusters.with_inertia(got, centroids).collect()
    for r in full:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, means[r.cluster])).encode()).hexdigest()


def test_clusters_of_nothing(spark):
    got, centroids = bisector_clusters.cluster(table(spark, [(1, [1.0], 1)]))
    assert centroids == [] and bisector_clusters.with_inertia(got, centroids).count() == 0


# --- quality classifier -------------------------------------------------------------------------

def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality_scores_match_a_plain_discriminant(spark):
    rows = duckdb.sql(f"""SELECT doc_id, text, quality FROM '{SF}/documents.parquet'
                          LEFT JOIN '{SF}/labels.parquet' USING (doc_id)""").fetchall()
    x = np.array([quality_qda.statistics(t) for _, t, _ in rows])
    y = np.array([-1 if q is None else q for *_, q in rows])
    learn = np.array([not held_out(i) for i, *_ in rows]) & (y >= 0)
    unit = x[learn].std(0) + 1e-6
    z = x / unit
    density, inside = [], [np.cov(z[learn & (y == c)].T, bias=True) for c in (0, 1)]
    n = [(learn & (y == c)).sum() for c in (0, 1)]
    pooled = (inside[0] * n[0] + inside[1] * n[1]) / sum(n)
    for c in (0, 1):
        a, b = quality_qda.TO_POOLED, quality_qda.TO_IDENTITY
        cov = (1 - b) * ((1 - a) * inside[c] + a * pooled) + b * np.eye(len(unit))
        off = z - z[learn & (y == c)].mean(0)
        density.append(math.log(n[c] / sum(n)) - np.linalg.slogdet(cov)[1] / 2
                       - np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off) / 2)
    want = 1 / (1 + np.exp(-(density[1] - density[0]) / quality_qda.TEMPERATURE))
    got = {r.doc_id: r for r in QUERIES["op12_quality_discriminant"](spark, SF).collect()}
    assert len(got) == len(rows)
    for (i, *_), w in zip(rows, want):
        assert abs(got[i].score - w) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == held_out(i)


def test_quality_of_documents_not_learned_from(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op12_quality_discriminant"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r for r in got if labels[r.doc_id] == v] for v in (1, 0))
    assert len(good) > 600 and len(bad) > 100
    assert sum(r.predicted for r in good) > 0.98 * len(good) and sum(r.predicted for r in bad) < 0.02 * len(bad)


def test_quality_on_awkward_rows(spark):
    long = " ".join(f"w{i % 3000}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "same"), (5, "same"), (None, "no id"), (6, "%%% " * 50),
             (7, "Ünïcode — ſtraße 🎉"), (8, "\0"), *[(i, f"plain words number {i} stand here.") for i in range(10, 30)],
             *[(i, f"%%% {i} ### $$$") for i in range(30, 50)]]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in texts], "doc_id long, text string, stats string, bad string").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(10, 50)] + [(10, 0, 0), (10, None, 0), (11, 7, 0), (None, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    every = F.lit(True)
    got = {(r.id, r.score) for r in quality_qda.classify(docs, labels, every).collect()}
    score = dict(got)
    assert all(0 <= s <= 1 for _, s in got) and len(got) == len(texts) - 1  # the repeated row scores alike
    assert score[1] == score[2] and score[12] > 0.3 > score[40] and score[None] == score[None]
    assert {r.score for r in quality_qda.classify(docs, labels.filter("quality = 1"), every).collect()} == {1.0}
    assert {r.score for r in quality_qda.classify(docs, labels.filter("quality = 0"), every).collect()} == {0.0}
    assert {r.score for r in quality_qda.classify(docs, labels.limit(0), every).collect()} == {0.5}
    assert quality_qda.classify(docs.limit(0), labels, every).count() == 0
