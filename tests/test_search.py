import math
import struct

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nearplane import catalog
from nearplane.functions import quantization as Q
from nearplane.functions import vector as V
from nearplane.operators import evaluate, pca, search, topk
from nearplane.plans import sweep, theory
from nearplane.sources import hdf5, vecs
from nearplane.streaming import serve

RNG = np.random.default_rng(3)
X, QS = RNG.normal(size=(90, 12)), RNG.normal(size=(5, 12))


@pytest.fixture(scope="module")
def data(spark):
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    return base, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(QS)], "qid long, q array<double>")


def answers(df):
    return [tuple(r) for r in df.orderBy("qid", "rank").select("qid", "rank", "id").collect()]


def test_exact_paths_agree_with_numpy(data):
    d = ((QS[:, None, :] - X[None]) ** 2).sum(2)
    want = [(q, r + 1, int(i)) for q in range(5) for r, i in enumerate(np.argsort(d[q])[:7])]
    assert answers(search.knn_exact(*data, 7)) == want
    assert answers(search.knn_arrow(*data, 7)) == want


def test_search_without_loss_is_exact(data):
    _, rot = pca.fit(data[0])
    assert np.allclose(rot.T @ rot, np.eye(12), atol=1e-9)
    assert answers(search.search(*data, rot, 12, 5, 1, 20)) == answers(search.knn_exact(*data, 5))


def test_quantised_refine_is_near(data):
    _, rot = pca.fit(data[0])
    out = search.search(*data, rot, 6, 5, 1, 60, "quantized")
    assert evaluate.recall(out, search.knn_exact(*data, 5), 5, 5).first()[0] > 0.8


def test_bad_parameters(data):
    with pytest.raises(ValueError):
        search.search(*data, None, 6, 5, 40, 10)
    with pytest.raises(ValueError):
        search.search(*data, None, 6, 50, 1, 10)


def test_pair_scores_are_summed_in_order(data):
    # to the last bit, so equal rows tie whatever tile they are in
    pairs = search.all_pairs(*data).select("qid", "id", (V.norm_squared(F.col("v")) - 2.0 * V.inner_product(F.col("q"), F.col("v"))).alias("want"))
    both = search.pair_scores(*data).join(pairs, ["qid", "id"])
    assert both.count() == 450 and both.where("score <> want").count() == 0


def test_strategies_equal_sql_where_rows_share_a_place(spark, tmp_path):
    # 280 rows: seven are sent to each place of the shuffled order; each vector stands twice
    duckdb = pytest.importorskip("duckdb")
    v = RNG.normal(size=(150, catalog.DIM)).astype(np.float32).tolist()
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame([(i, v[i % 150]) for i in range(300)], "vec_id long, embedding array<float>").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as from '{path}/*.parquet'")
    want = con.sql("select strategy, qid, rank, id from (" + catalog.oracle_sql()["strategy_compare"] + ")").fetchall()
    got = catalog.queries()["strategy_compare"](spark, str(tmp_path)).select("strategy", "qid", "rank", "id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_grouping_rules(spark):
    s = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate([5, 1, 1, 7, 3, 2, 9, 0, 4, 4])], "qid long, id long, score double")
    got = {r["grp"]: r["id"] for r in topk.group_min(s, topk.fixed_groups(4)).collect()}
    assert got == {0: 1, 1: 7, 2: 8}
    got = {r["grp"]: r["id"] for r in topk.group_min(s, topk.even_sections(10, 3)).collect()}
    assert got == {0: 1, 1: 5, 2: 7}


def test_quantisation_edges(spark):
    v = spark.createDataFrame([([2.0, 2.0],), ([-3.0, -1.0],)], "v array<double>")
    rows = v.select(Q.sq_encode(F.col("v")).alias("c"), Q.comp_round(F.col("v"), F.col("v"), 4).alias("s"), V.norm_squared(F.col("v")).alias("n")).collect()
    assert rows[0]["c"] == [0, 0] and rows[1]["c"] == [0, 255]
    assert rows[0]["s"] == -8.0 and rows[1]["s"] == -10.0


def test_rank_and_theory(spark):
    val = np.array([4.0, 3, 2, 1])
    assert pca.rank_for(val, 0.7) == 2 and pca.rank_for(val, 0.71) == 3 and pca.rank_for(np.zeros(3), 0.9) == 0
    assert theory.occupancy_probability(3, 2, 1) == 1 and abs(theory.occupancy_probability(3, 2, 2) - 2 / 3) < 1e-12
    assert abs(sum(theory.occupancy(20, 6)) - 1) < 1e-12


def test_permutation_and_recall(spark, data):
    m = evaluate.permutation(data[0], 1).collect()
    assert sorted(r["new_id"] for r in m) == list(range(90)) == sorted(r["id"] for r in m)
    truth = spark.createDataFrame([(0, 1, 5), (0, 2, 6)], "qid long, rank int, id long")
    got = spark.createDataFrame([(0, 5), (0, 5), (0, 9)], "qid long, id long")
    assert evaluate.recall(got, truth, 2, 1).first()[0] == 0.5


def test_unusable_vectors_are_dropped_and_other_dimensions_raise(spark, data):
    nan, inf = float("nan"), float("inf")
    hard = [(900, None), (901, [None] + [0.0] * 11), (902, [nan] + [0.0] * 11), (903, [inf] + [0.0] * 11), (None, [0.0] * 12)]
    base = data[0].union(spark.createDataFrame(hard, "id long, v array<double>"))
    asked = data[1].union(spark.createDataFrame([(90, None), (91, [nan] * 12), (None, [0.0] * 12)], "qid long, q array<double>"))
    want = answers(search.knn_exact(*data, 7))
    assert answers(search.knn_exact(base, asked, 7)) == want == answers(search.knn_arrow(base, asked, 7))
    assert answers(search.search(base, asked, None, 12, 5, 1, 20, n=90)) == answers(search.knn_exact(*data, 5))
    assert np.allclose(pca.covariance_matrix(base.where("id is not null")), np.cov(X.T))
    for wrong in ([1.0], [0.0] * 13):
        odd = data[0].union(spark.createDataFrame([(904, wrong)], "id long, v array<double>"))
        for made in (lambda b: search.knn_exact(b, data[1], 3), lambda b: search.knn_arrow(b, data[1], 3), pca.summed):
            with pytest.raises(PySparkException):
                made(odd).collect()
    with pytest.raises(ValueError):
        search.knn_arrow(data[0], data[1].union(spark.createDataFrame([(9, [1.0])], "qid long, q array<double>")), 3)


def test_empty_tables(spark, data):
    base, asked = data[0].limit(0), data[1].limit(0)
    assert not search.knn_arrow(base, data[1], 3).count() and not search.knn_arrow(data[0], asked, 3).count()
    assert not search.knn_exact(base, data[1], 3).count() and not search.phase1(base, data[1], None, 4, 2, 3).count()
    with pytest.raises(ValueError):
        pca.fit(base)


def test_ties_go_to_the_smaller_id(spark, data):
    base = spark.createDataFrame([(i, X[i % 9].tolist()) for i in range(45)], "id long, v array<double>").repartition(5)
    assert answers(search.knn_arrow(base, data[1], 12)) == answers(search.knn_exact(base, data[1], 12))


def test_blocks_of_queries_that_are_not_broadcast(data, monkeypatch):
    want, near = answers(search.knn_arrow(*data, 7)), answers(search.search(*data, None, 6, 5, 4, 12, "quantized"))
    monkeypatch.setattr(search, "QUERY_BYTES", 100)
    monkeypatch.setattr(search, "BLOCK_BYTES", 300)
    monkeypatch.setattr(search, "TILE_BYTES", 160)
    monkeypatch.setattr(search, "CANDIDATE_BYTES", 0)
    assert answers(search.knn_arrow(*data, 7)) == want == answers(search.knn_exact(*data, 7))
    assert answers(search.search(*data, None, 6, 5, 4, 12, "quantized")) == near


@pytest.mark.parametrize("group", [1, 3, 4, 7])
def test_phase1_against_numpy(data, group, monkeypatch):
    """Groups lie across tiles and tasks, and the last is short."""
    monkeypatch.setattr(search, "TILE_BYTES", 5 * 8 * 11)
    _, rot = pca.fit(data[0])
    d, keep = 5, 9
    y, q = X @ rot[:, :d], QS @ rot[:, :d]
    score = (y * y).sum(1)[None] - 2 * q @ y.T
    want = set()
    for i in range(len(QS)):
        best = sorted(min((score[i, j], j) for j in range(g, min(g + group, 90))) for g in range(0, 90, group))
        want |= {(i, j, round(float(x), 9)) for x, j in best[:keep]}
    got = search.phase1(data[0].repartition(4), data[1], rot, d, group, keep).collect()
    assert {(r["qid"], r["id"], round(r["score"], 9)) for r in got} == want


def test_best_groups_over_many_tiles(monkeypatch):
    monkeypatch.setattr(search, "TILE_BYTES", 5 * 8 * 7)
    ids = RNG.permutation(90)
    for group, keep in ((1, 6), (4, 9), (7, 13)):
        best = search.Best(len(QS), keep, group)
        for part in np.array_split(ids, 4):  # groups lie in several tiles and batches
            search._head_scores(best, QS, part, X[part], False)
        score = (X * X).sum(1)[None] - 2 * QS @ X.T
        got = best.rows(np.arange(len(QS))).to_pylist()
        for q in range(len(QS)):
            want = sorted(min((score[q, j], j) for j in range(g, min(g + group, 90))) for g in range(0, 90, group))[:keep]
            assert [(r["id"], round(r["score"], 9)) for r in got if r["qid"] == q] == [(j, round(float(x), 9)) for x, j in want]


def test_half_precision_scores(data):
    q, y = QS.astype(np.float16).astype(np.float32), X.astype(np.float16).astype(np.float32)
    norms = (X * X).sum(1)
    want = (norms.astype(np.float16).astype(np.float32)[None] - 2 * q @ y.T).astype(np.float16)
    assert np.allclose(search.half_scores(QS, X, norms), want, atol=0.05)
    exact, half = (evaluate.recall(search.search(*data, None, 12, 5, 1, 20, half=h), search.knn_exact(*data, 5), 5, 5).first()[0] for h in (False, True))
    assert exact == 1.0 and half == 1.0
    assert search.half_scores(np.full((1, 2), 3.0), np.full((1, 2), 300.0), np.array([1e6]))[0, 0] == np.inf  # beyond the format


def test_products_as_the_gemm_check_has_them(spark):
    rows = spark.createDataFrame([(i, [3.0] * 4) for i in range(5)], "id long, v array<double>")
    asked = spark.createDataFrame([(i, [2.0] * 4) for i in range(2)], "qid long, q array<double>")
    assert {r["score"] for r in search.pair_scores(rows, asked).collect()} == {36.0 - 48.0}


def test_index_round_trip_and_search(spark, data, tmp_path):
    path = str(tmp_path / "index")
    val, rot = pca.fit(data[0])
    pca.save_index(data[0], path, d=6)
    index = pca.load_index(spark, path)
    assert (index.head, index.dim, index.n, index.bits) == (6, 12, 90, 8) and abs(index.ratio - val[:6].sum() / val.sum()) < 1e-9
    assert np.allclose(index.rotation.T @ index.rotation, np.eye(12)) and index.coded.count() == 90
    for refine in ("exact", "quantized"):
        found = search.search_index(index, data[1], 5, 2, 15, refine, data[0])
        assert answers(found) == answers(search.search(*data, index.rotation, 6, 5, 2, 15, refine))
    pca.save_index(data[0], str(tmp_path / "by_ratio"), ratio=0.5)
    assert pca.load_index(spark, str(tmp_path / "by_ratio")).head == pca.rank_for(val, 0.5)
    for column, value in (("head", 0), ("head", 13), ("ratio", 0.0), ("ratio", 1.5)):
        meta = spark.read.parquet(f"{path}/meta").withColumn(column, F.lit(value).cast(dict(spark.read.parquet(f"{path}/meta").dtypes)[column]))
        meta.toPandas()
        spark.createDataFrame(meta.collect(), meta.schema).write.mode("overwrite").parquet(str(tmp_path / "bad/meta"))
        with pytest.raises(ValueError):
            pca.load_index(spark, str(tmp_path / "bad"))


def test_fit_on_a_prefix_and_with_many_partitions(spark, data):
    val, rot = pca.fit(data[0], cap=40)
    assert np.allclose(rot * val @ rot.T, np.cov(X[:40].T))
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        assert np.allclose(pca.covariance_matrix(data[0].repartition(30)), np.cov(X.T))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = {r["id"]: r["v"] for r in pca.centred(data[0]).collect()}
    assert np.allclose([got[i] for i in range(90)], X - X.mean(0))


def test_projection(data):
    _, rot = pca.fit(data[0])
    y = {r["id"]: r["y"] for r in pca.project(data[0], "v", rot).collect()}
    assert np.allclose([y[i] for i in range(90)], X @ rot)
    turn = pca.cosine_rotation(12)
    assert np.allclose(turn.T @ turn, np.eye(12))


def test_vecs_files(spark, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(vecs.to_vecs(X.astype("<f4")))
    rows = vecs.load(spark, str(tmp_path / "a.fvecs"), 12).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(90)) and np.allclose([r["v"] for r in rows], X, atol=1e-6)
    near = RNG.integers(0, 1 << 31, (7, 5)).astype("<i4")
    (tmp_path / "t.ivecs").write_bytes(vecs.to_vecs(near))
    assert np.array_equal([r["v"] for r in vecs.load(spark, str(tmp_path / "t.ivecs"), 5).orderBy("id").collect()], near)
    truth = vecs.truth_of(vecs.load(spark, str(tmp_path / "t.ivecs"), 5)).where("qid = 3").orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in truth] == [(i + 1, int(x)) for i, x in enumerate(near[3])]
    with pytest.raises((PySparkException, Py4JJavaError)):
        vecs.load(spark, str(tmp_path / "a.fvecs"), 25).collect()
    with pytest.raises(ValueError):
        vecs.load(spark, str(tmp_path / "a.fvecs"))


def hdf5_bytes(named):
    """A file of the classic layout by its specification: superblock, heap of names, one node of names, a header and the data of each matrix."""
    heap, where = bytearray(8), {}
    for name in sorted(named):
        where[name] = len(heap)
        heap += name.encode() + b"\0" * (8 - len(name) % 8)
    tree_at, heap_at, names_at = 96, 96 + 24 + 8 * 33, 96 + 24 + 8 * 33 + 32
    node_at = names_at + len(heap)
    headers_at = node_at + 8 + 40 * 8
    headers, data_at, body = b"", headers_at + 512 * len(named), b""
    entries = b""
    for i, name in enumerate(sorted(named)):
        x, layout = named[name] if isinstance(named[name], tuple) else (named[name], 1)
        f = x.dtype.kind == "f"
        space = struct.pack("<BBBB4x2Q", 1, 2, 0, 0, *x.shape)
        kind = struct.pack("<BBBBI", 0x10 | f, 0x20 if f else 8 * (x.dtype.kind == "i"), 0x1F if f else 0, 0, x.dtype.itemsize) + (struct.pack("<HHBBBBI4x", 0, 32, 23, 8, 0, 23, 127) if f else struct.pack("<HH4x", 0, 32))
        place = struct.pack("<BBQQ6x", 3, layout, data_at + len(body), x.nbytes)
        first, rest = [(0x01, space), (0x03, kind)], struct.pack("<HHB3x", 0x08, len(place), 0) + place
        at = headers_at + 512 * i
        first.append((0x10, struct.pack("<QQ", at + 256, len(rest))))  # the layout stands in a further block
        said = b"".join(struct.pack("<HHB3x", k, len(d), 0) + d for k, d in first)
        headers += (struct.pack("<BBHII4x", 1, 0, 4, 1, len(said)) + said).ljust(256, b"\0") + rest.ljust(256, b"\0")
        entries += struct.pack("<QQII16x", where[name], at, 0, 0)
        body += x.tobytes()
    top = hdf5.SIGNATURE + struct.pack("<BBBBBBBBHHI4Q", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, 0, (1 << 64) - 1, data_at + len(body), (1 << 64) - 1) + struct.pack("<QQII2Q", 0, 0, 1, 0, tree_at, heap_at)
    tree = (b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, (1 << 64) - 1, (1 << 64) - 1) + struct.pack("<QQQ", 0, node_at, 0)).ljust(24 + 8 * 33, b"\0")
    names = b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, names_at)
    node = (b"SNOD" + struct.pack("<BBH", 1, 0, len(named)) + entries).ljust(8 + 40 * 8, b"\0")
    return top + tree + names + bytes(heap) + node + headers + body


def test_hdf5_files(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(hdf5, "SLICE_BYTES", 700)
    far = ((QS[:, None] - X[None]) ** 2).sum(2) ** 0.5
    near = np.argsort(far, 1)[:, :6].astype("<u4")
    file = {"train": X.astype("<f4"), "test": QS.astype("<f4"), "neighbors": near, "distances": np.sort(far, 1)[:, :6].astype("<f4")}
    (tmp_path / "a.hdf5").write_bytes(hdf5_bytes(file))
    got = hdf5.load_dataset(spark, str(tmp_path / "a.hdf5"))
    assert np.allclose([r["v"] for r in got.base.orderBy("id").collect()], X, atol=1e-6) and got.base.rdd.getNumPartitions() > 1
    assert answers(search.knn_exact(got.base, got.queries, 6)) == answers(got.truth)
    assert np.allclose([r["distance"] for r in got.truth.orderBy("qid", "rank").collect()], np.sort(far, 1)[:, :6].ravel(), atol=1e-5)
    assert vecs.load(spark, str(tmp_path / "a.hdf5")).count() == 90
    (tmp_path / "b.h5").write_bytes(hdf5_bytes({"train": X, "test": QS, "neighbor_indices": near.astype("<i8"), "chunked": (X, 2)}))
    got = hdf5.load_dataset(spark, str(tmp_path / "b.h5"))
    assert answers(got.truth) == answers(search.knn_exact(*data, 6)) and got.truth.columns == ["qid", "rank", "id"]
    assert set(hdf5.matrices(str(tmp_path / "b.h5"))) == {"train", "test", "neighbor_indices"}
    (tmp_path / "c.h5").write_bytes(b"no such file" * 20)
    with pytest.raises((hdf5.Unsupported, ImportError)):
        hdf5.load_dataset(spark, str(tmp_path / "c.h5"))


def test_streamed_queries(spark, data, tmp_path):
    seen = []
    data[1].coalesce(1).write.parquet(str(tmp_path / "asked"))
    stream = spark.readStream.schema(data[1].schema).parquet(str(tmp_path / "asked"))
    running = serve.serve(stream, data[0], 4, lambda df, number: seen.extend((number, *r) for r in answers(df)))
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    assert seen == [(0, *r) for r in answers(search.knn_exact(*data, 4))]


def test_sweep_and_summary(spark, data, tmp_path):
    truth = search.knn_exact(*data, 5)
    out = sweep.sweep(*data, truth, 5, [sweep.Config(12, 1, 20), sweep.Config(6, 2, 20, "quantized")])
    rows = out.collect()
    assert rows[0]["recall"] == 1.0 and 0 < rows[1]["recall"] <= 1.0 and all(r["qps"] > 0 for r in rows)
    sweep.save_summary(out, str(tmp_path / "summary"))
    assert {(r["head"], r["refine"], r["phase1_topk"]) for r in spark.read.csv(str(tmp_path / "summary"), header=True, inferSchema=True).collect()} == {(12, "exact", 20), (6, "quantized", 20)}
    assert sweep.queries_per_second(7, 0.0021) == 3500 and sweep.queries_per_second(7, 0.0001) == 0


def test_shuffled_base_with_its_truth(spark, data, tmp_path):
    truth = search.knn_exact(*data, 5)
    evaluate.save_shuffled(evaluate.shuffled(data[0], truth, 3), str(tmp_path / "s"))
    s = evaluate.load_shuffled(spark, str(tmp_path / "s"))
    assert answers(search.knn_exact(s.base, data[1], 5)) == answers(s.truth) != answers(truth)
    assert answers(evaluate.unshuffled(s)) == answers(truth)
    assert [r["new_id"] for r in evaluate.permutation(data[0], 3).orderBy("id").collect()] == [r["new_id"] for r in evaluate.permutation(data[0].repartition(3), 3).orderBy("id").collect()]


def test_sorts_of_random_pairs_are_stable_by_id(spark):
    score = RNG.integers(0, 12, 150).astype(float)
    s = spark.createDataFrame([(i % 2, i, float(x)) for i, x in enumerate(score)], "qid long, id long, score double").repartition(4)
    for q in (0, 1):
        ids = [i for i in range(150) if i % 2 == q]
        want = [ids[j] for j in np.argsort(score[ids], kind="stable")]
        assert [r["id"] for r in topk.top_k(s, 1 << 30).where(F.col("qid") == q).orderBy("rank").collect()] == want


def test_incomplete_gamma():
    for a, x in ((1, 0.3), (3, 2.0), (3, 9.0), (40, 20.0), (40, 60.0)):
        assert abs(theory.gamma_below(a, x) - (1 - sum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(a)))) < 1e-12
    for x in (0.01, 0.7, 3.0, 30.0):
        assert abs(theory.gamma_below(0.5, x) - math.erf(math.sqrt(x))) < 1e-12
    for a, p in ((0.3, 0.2), (2.5, 0.99), (80, 0.5)):
        assert abs(theory.gamma_below(a, theory.gamma_quantile(a, p)) - p) < 1e-9


def test_lower_bound_box_and_maximum():
    lam = np.exp(-np.arange(64) / 6)
    b = theory.Bound.of(100_000, 10, 5, 32, lam)
    y0, y1, d0, d1 = b.box(0.3)
    for factor_at in ((y0, d0), (y0, d1), (y1, d1)):
        assert b.at(*factor_at) >= 0
    # a factor meets the target at the edge that it sets
    reach = b.mu_r + y0 * b.sd_r
    assert abs(theory.gamma_below((b.mu_r / b.sd_r) ** 2, reach * b.mu_r / b.sd_r**2) ** 10 - 0.3) < 1e-9
    target, y, delta, best = b.best(0.95)
    grid = max(b.at(u, v) for u in np.linspace(y0, y1, 80) for v in np.linspace(d0, d1, 80))
    assert best >= b.at(y, delta) - 1e-15 and (target < 0.95 or best > 0)
    assert theory.Bound.of(100_000, 10, 5, 32, lam).best(0.3)[3] >= grid - 1e-9
    assert b.at(b.least_y - 1, 0) == 0 == b.at(0, b.least_delta - 1)
    wider = theory.Bound.of(100_000, 10, 50, 32, lam).best(0.95)
    assert wider[3] > best  # more candidates, a larger bound
    for bad in ((10, 0, 2, 3), (10, 2, 9, 3), (10, 2, 1, 3), (10, 2, 2, 64)):
        with pytest.raises(ValueError):
            theory.Bound.of(*bad, lam)


def test_covariance_and_fit_over_all_dimensions(spark, tmp_path):
    x = RNG.normal(size=(150, 64)) * np.linspace(3, 1, 64)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    q, cov = catalog.queries(), np.cov(x[catalog.N_QUERIES :].T)
    got = {(r["i"], r["j"]): r["cov"] for r in q["covariance"](spark, str(tmp_path)).collect()}
    assert len(got) == 64 * 65 // 2 and all(abs(c - cov[k]) < 2e-6 for k, c in got.items())
    rows = q["pca_fit"](spark, str(tmp_path)).orderBy("component").collect()
    val, axes = np.array([r["eigenvalue"] for r in rows]), np.array([r["axis"] for r in rows])
    assert np.allclose(axes @ axes.T, np.eye(64), atol=1e-9) and np.allclose(axes.T * val @ axes, cov, atol=1e-8)


def test_scan_spectrum(spark, tmp_path):
    (tmp_path / "e.csv").write_text("n,eig\n1,0.5\n2,\n3,2\n4,-1\n")
    got = pca.scan_spectrum(spark, str(tmp_path / "e.csv"), "eig").collect()
    assert [tuple(r) for r in got] == [(1, 2.0), (2, 0.5), (3, 1e-12)]
    with pytest.raises(ValueError):
        pca.scan_spectrum(spark, str(tmp_path / "e.csv"), "other")
