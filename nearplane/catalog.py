"""Queries over the test tables, and the same in SQL.

Queries are vec_id < 20; the base is the rest with ids from 0; truth is the exact top 10, ties by id. Where a
rotation must stand in SQL it is the fixed cosine rotation, `turned` below; fitted axes have no SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearplane.functions import quantization as Q
from nearplane.functions import vector as V
from nearplane.operators import evaluate, pca, search, topk
from nearplane.plans import sweep, theory
from nearplane.sources import store

N_QUERIES, K, HEAD, GROUP, KEEP, DIM = 20, 10, 48, 4, 50, 64
SCALE, ZERO, LEVELS, INTERVALS, SHUFFLE_SEED = 0.01, 128.0, 256, 16, 5
THEORY_N, THEORY_HEAD, WIDER = 10_000, 60, 8  # rows, head and candidates a neighbour of the theory's bound
GRID_Y, GRID_DELTA = [-1.0, 0.0, 1.0, 2.0, 3.0], [-2.0, -1.0, 0.0, 1.0]
SWEEP = [(16, 2, 100), (32, 4, 50), (48, 4, 50), (48, 8, 20)]  # head, group, phase-1 top k
Query = Callable[[SparkSession, str], DataFrame]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def base_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("id") >= N_QUERIES).select((F.col("id") - N_QUERIES).alias("id"), "v")


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("id") < N_QUERIES).select(F.col("id").alias("qid"), F.col("v").alias("q"))


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _pairs(s, d):
    return search.all_pairs(base_of(s, d), queries_of(s, d))


def _ranked(df: DataFrame, value: str) -> DataFrame:
    return df.select("qid", F.col("rank").cast("long").alias("rank"), "id", _r(value).alias(value))


def _pair_value(expr) -> Query:
    return lambda s, d: _pairs(s, d).select("qid", "id", _r(expr(F.col("v"), F.col("q"))).alias("value"))


def _rotation() -> np.ndarray:
    return pca.cosine_rotation(DIM)


def _split(s, d):
    return search.split(base_of(s, d).withColumn("y", F.col("v")), "y", HEAD), search.split(queries_of(s, d).withColumn("y", F.col("q")), "y", HEAD)


def _scores(s, d):
    return search.brute_force(base_of(s, d), queries_of(s, d))


def _truth(s, d):
    return search.knn_exact(base_of(s, d), queries_of(s, d), K)


def _search(s, d, rotation, refine):
    out = search.search(base_of(s, d), queries_of(s, d), rotation, HEAD, K, GROUP, KEEP, refine)
    return _ranked(out, "dist" if refine == "exact" else "score")


def _axis(s, d, refine):
    return search.search(base_of(s, d), queries_of(s, d), None, HEAD, K, GROUP, KEEP, refine)


def _indexed(s, d, refine):
    base, path = base_of(s, d), store.scratch(s, "index")
    pca.save_index(base, path, d=HEAD, rotation=_rotation())
    out = search.search_index(pca.load_index(s, path), queries_of(s, d), K, GROUP, KEEP, refine, base)
    return _ranked(out, "dist" if refine == "exact" else "score")


def _given(s, d):
    """A fixed set of candidates, a ninth of all pairs, with their head scores."""
    px, pq = _split(s, d)
    head = search.pair_scores(px.select("id", F.col("head").alias("v")), pq.select("qid", F.col("head").alias("q")))
    return head.where((F.col("qid") + F.col("id")) % 9 == 0)


def _section_topk(s, d):
    n = base_of(s, d).count()
    return _ranked(topk.top_k(topk.group_min(_scores(s, d), topk.even_sections(n, 7)), 5), "score")


def _phase1_topk(s, d):
    return _ranked(topk.top_k(search.phase1(base_of(s, d), queries_of(s, d), None, HEAD, GROUP, KEEP), KEEP), "score")


def _sq_info(s, d):
    x = base_of(s, d).select("id", Q.sq_info(F.col("v"), 8, 32).alias("x"))
    return x.select("id", _r("x.xx").alias("xx"), _r("x.min_val").alias("min_val"), _r("x.max_val").alias("max_val"), _r("x.scale", 9).alias("scale"), "x.sum_code", F.col("x.sum_code_part")[0].alias("part0"), F.col("x.sum_code_part")[1].alias("part1"))


def _sq_score(s, d):
    coded = _pairs(s, d).select("qid", "id", Q.sq_info(F.col("v")).alias("x"), Q.sq_info(F.col("q")).alias("y"), F.size("q").alias("dim"))
    return coded.select("qid", "id", _r(Q.sq_score(F.col("x"), F.col("y"), F.col("dim"))).alias("value"))


def _remap(s, d):
    base = base_of(s, d)
    n = base.count()
    mapping = base.select("id", ((F.col("id") * 7 + 3) % n).alias("new_id"))
    return evaluate.renumber(_truth(s, d), mapping).select("qid", F.col("rank").cast("long").alias("rank"), "id")


def _pca_fit(s, d):
    val, rot = pca.fit(base_of(s, d))
    rot = rot * np.sign(rot[np.abs(rot).argmax(0), np.arange(len(val))])  # an axis has no sign of its own
    return s.createDataFrame([(i + 1, float(x), rot[:, i].tolist()) for i, x in enumerate(val)], "component int, eigenvalue double, axis array<double>")


def _pca_residuals(s, d):
    """How far each fitted axis is from an eigenvector of the covariance, as Spark's own aggregate gives it, and from unit length."""
    base = base_of(s, d)
    val, rot = pca.fit(base)
    one = base.select("v", F.posexplode("v").alias("i", "x")).select("i", "x", F.posexplode("v").alias("j", "y"))
    cov = one.groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))
    axes = s.createDataFrame([(c + 1, j, float(rot[j, c]), float(val[c])) for c in range(len(val)) for j in range(len(val))], "component int, j int, a double, eigenvalue double")
    turned = cov.join(axes, "j").groupBy("component", "i").agg(F.sum(F.col("cov") * F.col("a")).alias("ca"))
    own = axes.withColumnRenamed("j", "i")
    off = turned.join(own, ["component", "i"]).groupBy("component").agg(F.max(F.abs(F.col("ca") - F.col("eigenvalue") * F.col("a"))).alias("residual"), F.sum(F.col("a") * F.col("a")).alias("norm2"))
    return off.select("component", (_r("residual", 9) + 0.0).alias("residual"), _r("norm2", 9).alias("norm2"))


def _eigen(s, d):
    """Power sums of the spectrum, in units of 1 / dimension."""
    val, _ = pca.fit(base_of(s, d))
    x = val * len(val)
    return s.createDataFrame([(len(val), *(float(round((x**p).sum(), 5)) for p in (1, 2, 3, 4)))], "dim int, total double, total2 double, total3 double, total4 double")


def _projected(df: DataFrame, column: str, key: str) -> DataFrame:
    return pca.project(df, column, _rotation()).select(key, F.posexplode("y").alias("pos", "y")).select(key, "pos", _r("y").alias("y"))


def _project_norms(s, d):
    y = search.split(pca.project(base_of(s, d), "v", _rotation()), "y", HEAD)
    return y.select("id", _r("head_norm2").alias("head_norm2"), _r(V.norm_squared(F.col("tail"))).alias("tail_norm2"))


def _fitted_norms(s, d):
    base = base_of(s, d)
    y = search.split(pca.project(base, "v", pca.fit(base)[1]), "y", HEAD)
    return y.select("id", _r(F.col("head_norm2") + V.norm_squared(F.col("tail"))).alias("norm2"))


def _shuffle(s, d):
    return evaluate.permutation(base_of(s, d), SHUFFLE_SEED)


def _strategies(s, d):
    """Answers of one phase 1 over sections, re-ranked in every way; `shuffled` groups other rows together."""
    base, queries = base_of(s, d), queries_of(s, d)
    n = base.count()
    asked = queries.select("qid", "q")

    def found(place):
        # several rows may share a place; the row that is kept is known by its own id
        scores = search.pair_scores(base.select("id", F.slice("v", 1, HEAD).alias("v")), queries.select("qid", F.slice("q", 1, HEAD).alias("q")))
        placed = scores.select("qid", place.alias("id"), F.col("id").alias("own"), "score")
        best = topk.top_k(topk.group_min(placed, topk.even_sections(n, n // GROUP), "own"), KEEP).select("qid", "id", "own", "score")
        return best.join(base.select(F.col("id").alias("own"), "v"), "own").join(asked, "qid")

    rest = lambda c: F.slice(c, HEAD + 1, DIM - HEAD)
    v, q = rest("v"), rest("q")
    forms = {
        "basic": F.col("score"),
        "exact": V.l2_squared(F.col("v"), F.col("q")),
        "quantized": F.col("score") + Q.sq_score(Q.sq_info(v), Q.sq_info(q), F.lit(DIM - HEAD)),
        "floor": F.col("score") + Q.comp_floor(q, v, INTERVALS),
        "int": F.col("score") + Q.comp_fixed(q, v, INTERVALS, 1e5),
        "long": F.col("score") + Q.comp_fixed(q, v, INTERVALS, 1e7),
        "round": F.col("score") + Q.comp_round(q, v, INTERVALS),
        "codes": Q.comp_codes(Q.affine_quantize(F.col("v"), SCALE, ZERO, LEVELS), F.col("q"), SCALE, ZERO, LEVELS),
    }
    cand = found(F.col("id"))
    tagged = lambda df, name: df.select(F.lit(name).alias("strategy"), "qid", F.col("rank").cast("long").alias("rank"), F.col("own").alias("id"))
    out = tagged(topk.top_k(found((F.col("id") * 7 + 3) % n).select("qid", "id", "own", forms["exact"].alias("score")), K), "shuffled")
    for name, form in forms.items():
        # rounded, as equal codes give equal scores
        out = out.union(tagged(topk.top_k(cand.select("qid", "id", "own", _r(form, 9).alias("score")), K), name))
    return out


def _candidate_exact(s, d):
    px, pq = _split(s, d)
    cand = search.phase1(base_of(s, d), queries_of(s, d), None, HEAD, GROUP, KEEP)
    both = cand.join(base_of(s, d), "id").join(queries_of(s, d), "qid")
    return both.select("qid", "id", _r(V.l2_squared(F.col("v"), F.col("q"))).alias("value"))


def _occupancy(s, d):
    bins = -(-base_of(s, d).count() // GROUP)
    return s.createDataFrame([(y, round(theory.occupancy_probability(bins, K, y), 6)) for y in range(1, K + 1)], "least int, p double")


def _lower_bound(s, d):
    base = base_of(s, d)
    got = theory.bound_grid(pca.axis_spectrum(base), THEORY_N, K, WIDER, THEORY_HEAD, GRID_Y, GRID_DELTA)
    return got.select("y", "delta", _r("bound").alias("bound"))


def _best_bound(s, d):
    base = base_of(s, d)
    return theory.best_bound(pca.axis_spectrum(base), THEORY_N, K, WIDER, THEORY_HEAD, 0.9)


def _sweep(s, d):
    got = sweep.sweep(base_of(s, d), queries_of(s, d), _truth(s, d), K, [sweep.Config(h, g, p, r) for h, g, p in SWEEP for r in ("exact", "quantized")], _rotation())
    return got.select("head", "group_size", "phase1_topk", "refine", _r("recall").alias("recall"))


def queries() -> dict[str, Query]:
    half = lambda s, d: (_axis(s, d, "quantized"), _truth(s, d))
    return {
        "scan_base": lambda s, d: base_of(s, d).select("id", F.size("v").alias("dim"), _r(V.total(F.col("v"))).alias("total")),
        "truth_with_distance": lambda s, d: _truth(s, d).select("qid", F.col("rank").cast("long").alias("rank"), "id", _r(F.sqrt("d2")).alias("distance")),
        "trim8": lambda s, d: evaluate.trim(base_of(s, d), base_of(s, d).count()).select("id"),
        "sample_prefix": lambda s, d: base_of(s, d).where("id < 100").select("id"),
        "center": lambda s, d: pca.centred(base_of(s, d)).select("id", F.posexplode("v").alias("pos", "x")).select("id", "pos", _r("x").alias("x")),
        "vec_add": lambda s, d: _pairs(s, d).select("qid", "id", _r(V.total(V.add(F.col("v"), F.col("q")))).alias("value")),
        "l2_squared": _pair_value(lambda v, q: V.l2_squared(v, q)),
        "l2_distance": _pair_value(lambda v, q: V.l2_distance(v, q)),
        "inner_product": _pair_value(lambda v, q: V.inner_product(v, q)),
        "brute_force_distances": lambda s, d: _scores(s, d).select("qid", "id", _r("score").alias("value")),
        "l2_scores": lambda s, d: search.pair_scores(base_of(s, d), queries_of(s, d)).select("qid", "id", _r("score").alias("value")),
        "dot_codes": lambda s, d: _pairs(s, d).select("qid", "id", V.dot_codes(Q.affine_quantize(F.col("v"), SCALE, ZERO, LEVELS), Q.affine_quantize(F.col("q"), SCALE, ZERO, LEVELS)).alias("value")),
        "norms": lambda s, d: base_of(s, d).select("id", _r(V.norm_squared(F.col("v"))).alias("norm2")),
        "sq_encode": lambda s, d: base_of(s, d).select("id", F.posexplode(Q.sq_encode(F.col("v"))).alias("pos", "code")).select("id", "pos", F.col("code").cast("int").alias("code")),
        "sq_decode_error": lambda s, d: base_of(s, d).select("id", _r(F.array_max(F.zip_with(F.col("v"), Q.sq_decode(Q.sq_encode(F.col("v")), F.array_min(F.col("v")), Q.sq_scale(F.col("v"))), lambda a, b: F.abs(a - b)))).alias("worst")),
        "affine_quantize": lambda s, d: base_of(s, d).select("id", F.posexplode(Q.affine_quantize(F.col("v"), SCALE, ZERO, LEVELS)).alias("pos", "code")),
        "affine_dequantize": lambda s, d: base_of(s, d).select("id", F.posexplode(Q.affine_dequantize(Q.affine_quantize(F.col("v"), SCALE, ZERO, LEVELS), SCALE, ZERO)).alias("pos", "x")).select("id", "pos", _r("x").alias("x")),
        "comp_floor": _pair_value(lambda v, q: Q.comp_floor(q, v, 16)),
        "comp_int": _pair_value(lambda v, q: Q.comp_fixed(q, v, 16, 1e5)),
        "comp_long": _pair_value(lambda v, q: Q.comp_fixed(q, v, 16, 1e7)),
        "comp_round": _pair_value(lambda v, q: Q.comp_round(q, v, 16)),
        "comp_codes": _pair_value(lambda v, q: Q.comp_codes(Q.affine_quantize(v, SCALE, ZERO, LEVELS), q, SCALE, ZERO, LEVELS)),
        "sq_info": _sq_info,
        "sq_score": _sq_score,
        "dim_means": lambda s, d: pca.dim_means(base_of(s, d)).select("pos", _r("mean").alias("mean")),
        "covariance": lambda s, d: pca.covariance(base_of(s, d)).select("i", "j", _r("cov").alias("cov")),
        "dequant_l2": lambda s, d: _pairs(s, d).select("qid", "id", _r(Q.dequant_l2(V.l2_codes(Q.affine_quantize(F.col("v"), SCALE, ZERO, LEVELS), Q.affine_quantize(F.col("q"), SCALE, ZERO, LEVELS)), SCALE)).alias("value")),
        "pca_fit": _pca_fit,
        "pca_residuals": _pca_residuals,
        "rank_selection": lambda s, d: pca.rank_selection(pca.axis_spectrum(base_of(s, d)), 0.71),
        "bound_constants": lambda s, d: theory.bound_constants(pca.axis_spectrum(base_of(s, d)), HEAD).select(*(_r(c, 9).alias(c) for c in ("mu_r", "var_r", "z_offset", "mu_z", "var_z"))),
        "lower_bound": _lower_bound,
        "best_bound": _best_bound,
        "occupancy_probability": _occupancy,
        "group_min": lambda s, d: topk.group_min(_scores(s, d), topk.fixed_groups(GROUP)).select("qid", "grp", _r("score").alias("score"), "id"),
        "section_topk": _section_topk,
        "topk": lambda s, d: _ranked(topk.top_k(_scores(s, d), K), "score"),
        "segmented_sort": lambda s, d: _ranked(topk.top_k(_scores(s, d), 1 << 30), "score"),
        "phase1_topk": _phase1_topk,
        "topk_global": lambda s, d: _scores(s, d).where("qid = 0").orderBy("score", "id").limit(K).select("id", _r("score").alias("score")),
        "candidate_exact": _candidate_exact,
        "knn_exact": lambda s, d: _ranked(_truth(s, d), "d2"),
        "refine_exact": lambda s, d: _ranked(search.refine_exact(_given(s, d), base_of(s, d), queries_of(s, d), K), "dist"),
        "refine_quantized": lambda s, d: _ranked(search.refine_quantized(_given(s, d), _split(s, d)[0], _split(s, d)[1], K), "score"),
        "ann_axis_exact": lambda s, d: _search(s, d, None, "exact"),
        "ann_axis_quantized": lambda s, d: _search(s, d, None, "quantized"),
        "ann_rotated_exact": lambda s, d: _search(s, d, _rotation(), "exact"),
        "ann_rotated_quantized": lambda s, d: _search(s, d, _rotation(), "quantized"),
        "ann_index_exact": lambda s, d: _indexed(s, d, "exact"),
        "ann_index_quantized": lambda s, d: _indexed(s, d, "quantized"),
        "recall_hits": lambda s, d: evaluate.recall_hits(*half(s, d), K),
        "recall_at_k": lambda s, d: evaluate.recall(*half(s, d), K, N_QUERIES).select(_r("recall").alias("recall")),
        "recall_strict": lambda s, d: evaluate.recall_strict(*half(s, d), K).select(_r("recall").alias("recall")),
        "query_batches": lambda s, d: evaluate.query_batches(queries_of(s, d), N_QUERIES, 64, 16).select("slot", "batch_id", "qid"),
        "shuffle_remap": _remap,
        "shuffle_ids": _shuffle,
        "eigenvalue_sum": _eigen,
        "pca_project_norms": _fitted_norms,
        "project_norms": _project_norms,
        "project": lambda s, d: _projected(base_of(s, d), "v", "id"),
        "query_project": lambda s, d: _projected(queries_of(s, d), "q", "qid"),
        "phase1_scores": lambda s, d: search.pair_scores(base_of(s, d), queries_of(s, d), _rotation(), HEAD).select("qid", "id", _r("score").alias("value")),
        "ann_search_exact": lambda s, d: _search(s, d, pca.fit(base_of(s, d))[1], "exact"),
        "ann_search_quantized": lambda s, d: _search(s, d, pca.fit(base_of(s, d))[1], "quantized"),
        "knn_arrow": lambda s, d: _ranked(search.knn_arrow(base_of(s, d), queries_of(s, d), K), "d2"),
        "strategy_compare": _strategies,
        "sweep": _sweep,
        "shuffled_truth": lambda s, d: evaluate.unshuffled(evaluate.shuffled(base_of(s, d), _truth(s, d), SHUFFLE_SEED)).select("qid", F.col("rank").cast("long").alias("rank"), "id"),
    }


_BASE = f"""base as (select vec_id - {N_QUERIES} id, embedding::double[] v from embeddings where vec_id >= {N_QUERIES}),
 qry as (select vec_id qid, embedding::double[] q from embeddings where vec_id < {N_QUERIES}), pair as (select * from base, qry)"""


def _sum(f: str, *lists: str) -> str:
    names = "xyz"
    body = f
    for i, n in enumerate(names[: len(lists)], 1):
        body = body.replace(f"${n}", f"t[{i}]")
    return f"list_sum(list_transform(list_zip({', '.join(lists)}), lambda t: {body}))"


def _sql_lower_bound(axis: str, moments: str) -> str:
    """The bound at each point of the grid; incomplete gamma functions as power series, the normal's by that of shape 1 / 2."""
    # only what the normal quantiles give, which SQL has not, is taken from here
    quantiles = theory.Bound.of(THEORY_N, K, WIDER, THEORY_HEAD, np.ones(DIM))
    gap, gap_sd, root = quantiles.gap, quantiles.gap_sd, THEORY_N**0.5
    below = lambda a, x: f"sum(case when {x} > 0 then exp(({a} + t) * ln(greatest({x}, 1e-300)) - {x} - lgamma({a} + t + 1)) else 0 end)"
    grid = lambda c, values: f"(values {', '.join(f'({x}::double)' for x in values)}) {c}({c})"
    return f"""{axis}, m as (select {moments} from ax),
 pt as (select y, delta, sqrt(var_r) sd, mu_r, var_r, z_offset, mu_z, var_z, greatest(mu_r + y * sqrt(var_r), 0) reach, {gap}::double + delta * {gap_sd}::double / {root}::double width from m, {grid('y', GRID_Y)}, {grid('delta', GRID_DELTA)}),
 arg as (select y, delta, y >= -mu_r / sd and delta > -{gap * root / gap_sd}::double and width > 0 ok, mu_r * mu_r / var_r a1, reach * mu_r / var_r x1, delta * delta / 2 x2, mu_z * mu_z / var_z a3, greatest((reach / width) * (reach / width) - z_offset, 0) * mu_z / var_z x3 from pt),
 p as (select y, delta, ok, {below('a1', 'x1')} p1, {below('0.5::double', 'x2')} p2, {below('a3', 'x3')} p3 from arg, (select unnest(range(0, 1500))::double t) group by y, delta, ok)
 select y, delta, round(case when ok then power(p1, {K}) * (0.5 - sign(delta) * 0.5 * p2) * (1 - p3) else 0 end, 6) bound from p"""


def oracle_sql() -> dict[str, str]:
    w = f"with {_BASE}"
    l2 = _sum("($x - $y) * ($x - $y)", "v", "q")
    dot = _sum("$x * $y", "v", "q")
    n2 = "list_sum(list_transform(v, lambda x: x * x))"
    aff = lambda a: f"list_transform({a}, lambda x: trunc(least(greatest(x / {SCALE}::double + {ZERO}::double, 0.0), {LEVELS - 1}.0))::int)"
    enc = lambda a: f"list_transform({a}, lambda x: case when list_max({a}) = list_min({a}) then 0 else floor((x - list_min({a})) / ((list_max({a}) - list_min({a})) / 255.0) + 0.5) end::int)"
    pair = lambda e: f"{w} select qid, id, round({e}, 6) as value from pair"
    near = f"{w}, sc as (select qid, id, {l2} score from pair), top as (select *, row_number() over (partition by qid order by score, id) rank from sc)"
    quant = lambda add: f"list_transform(v, lambda x: list_min(v) + floor((x - list_min(v)) / ((list_max(v) - list_min(v)) / 16.0) + {add}) * ((list_max(v) - list_min(v)) / 16.0))"

    def fixed(u: str) -> str:
        return f"""{w}, w as (select qid, id, v, list_transform(v, lambda x: trunc(x * {u})::bigint) vv, list_transform(q, lambda x: trunc(x * {u})::bigint) qq from pair),
 st as (select *, list_min(vv) lo, greatest((list_max(vv) - list_min(vv)) // 16, 1) st from w)
 select qid, id, round({n2} - 2.0 * list_sum(list_transform(list_zip(vv, qq), lambda t: (lo + (t[1] - lo) // st * st + st // 2) * t[2]))::double / ({u}::double * {u}), 6) as value from st"""

    info = lambda a, p: f"list_min({a}) mn{p}, (list_max({a}) - list_min({a})) / 255.0 s{p}, {enc(a)} c{p}"
    cross = "sx * sy * list_sum(list_transform(list_zip(cx, cy), lambda t: t[1] * t[2]))::double + sy * mnx * list_sum(cy) + sx * mny * list_sum(cx) + mnx * mny * len(cx)"
    turn = lambda a: f"list_transform(range({DIM}), lambda c: list_sum(list_transform(range({DIM}), lambda j: {a}[j + 1] * cos(pi() * (2 * j + 1) * c / {2 * DIM}.0::double))) * (case when c = 0 then sqrt(1.0::double / {DIM}) else sqrt(2.0::double / {DIM}) end))"
    stays = f"{w}, rot as (select qid, id, v, q, v rv, q rq from pair)"
    turned = f"{w}, tb as materialized (select id, {turn('v')} rv from base), tq as materialized (select qid, {turn('q')} rq from qry), rot as (select qid, id, v, q, rv, rq from pair join tb using (id) join tq using (qid))"
    inner = lambda a, b: _sum("$x * $y", a, b)
    head_score = lambda h: f"{inner(f'rv[1:{h}]', f'rv[1:{h}]')} - 2.0 * {inner(f'rq[1:{h}]', f'rv[1:{h}]')}"

    def chosen(rot: str, head: int = HEAD, group: str = f"id // {GROUP}", keep: int = KEEP) -> str:
        return f"{rot}, hd as materialized (select qid, id, {head_score(head)} score from rot), gm as (select qid, {group} grp, min(row(score, id)) m from hd group by all), cd as (select qid, m[1] score, m[2] id, row_number() over (partition by qid order by m[1], m[2]) rank from gm qualify rank <= {keep})"

    ex = f", ex as (select qid, id, {l2} score from cd join base using (id) join qry using (qid)), res as (select *, row_number() over (partition by qid order by score, id) rank from ex qualify rank <= {K})"

    def qt(head: int = HEAD) -> str:
        return f""", tl as (select qid, id, cd.score, {inner(f'rv[{head + 1}:]', f'rv[{head + 1}:]')} xx, {info(f'rv[{head + 1}:]', 'x')}, {info(f'rq[{head + 1}:]', 'y')} from cd join rot using (qid, id)),
 qs as (select qid, id, score + xx - 2.0 * ({cross}) score from tl), res as (select *, row_number() over (partition by qid order by score, id) rank from qs qualify rank <= {K})"""

    cand, exact, qres = chosen(stays), chosen(stays) + ex, chosen(stays) + qt()
    given = f"{stays}, cd as (select qid, id, {head_score(HEAD)} score from rot where (qid + id) % 9 = 0)"
    true = f", tr as (select qid, id from (select qid, id, row_number() over (partition by qid order by {l2}, id) r from pair) where r <= {K})"
    hits = f"{qres}{true}, hit as (select distinct qid, id from res semi join tr using (qid, id))"
    ranked = lambda c, e: f"{c} select qid, rank, id, round({e}, 6) as"
    tail = lambda a: f"{a}[{HEAD + 1}:]"

    def compensated(add: str) -> str:
        v = tail("v")
        level = f"list_transform({v}, lambda x: list_min({v}) + floor((x - list_min({v})) / ((list_max({v}) - list_min({v})) / {INTERVALS}.0::double) + {add}) * ((list_max({v}) - list_min({v})) / {INTERVALS}.0::double))"
        return f"score + {inner(v, v)} - 2.0 * {inner(tail('q'), level)}"

    def whole(u: str) -> str:
        ints = lambda a: f"list_transform({a}, lambda x: trunc(x * {u})::bigint)"
        v, step = ints(tail("v")), f"greatest((list_max({ints(tail('v'))}) - list_min({ints(tail('v'))})) // {INTERVALS}, 1)"
        return f"score + {inner(tail('v'), tail('v'))} - 2.0 * list_sum(list_transform(list_zip({v}, {ints(tail('q'))}), lambda t: (list_min({v}) + (t[1] - list_min({v})) // {step} * {step} + {step} // 2) * t[2]))::double / ({u}::double * {u})"

    coded = f"list_sum(list_transform(list_zip({aff('v')}, {aff('q')}), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::double * ({SCALE}::double * {SCALE}::double)"
    n_base = "(select count(*) from base)"
    section = lambda i: f"least({i} // ({n_base} // ({n_base} // {GROUP})), {n_base} // {GROUP} - 1)"
    few = chosen(stays, group=section("id"))
    forms = {"basic": "score", "exact": l2, "floor": compensated("0"), "round": compensated("0.5"), "int": whole("1e5"), "long": whole("1e7"), "codes": coded}
    form = lambda name, e: f"select '{name}' strategy, qid, row_number() over (partition by qid order by round({e}, 9), id) rank, id from (select qid, id, score from cd) join base using (id) join qry using (qid) qualify rank <= {K}"
    strategies = few + qt().replace("qs as (select qid, id, score", "qs as (select qid, id, round(score").replace(") score from tl)", "), 9) score from tl)") + f""", other as (select qid, own, id, {head_score(HEAD)} score, {l2} d2 from (select qid, id own, (id * 7 + 3) % {n_base} id, v, q, rv, rq from rot)),
 om as (select qid, {section('id')} grp, min(row(score, id, own, d2)) m from other group by all), oc as (select qid, m[2] id, m[3] own, m[4] d2 from om qualify row_number() over (partition by qid order by m[1], m[2]) <= {KEEP})
 select 'quantized' strategy, qid, rank, id from res union all select 'shuffled' strategy, qid, row_number() over (partition by qid order by d2, id) rank, own id from oc qualify rank <= {K} union all """ + " union all ".join(f"from ({form(n, e)})" for n, e in forms.items())
    swept = lambda h, g, p, r: f"select {h}::int head, {g}::int group_size, {p}::int phase1_topk, '{r}' refine, round(count(*) / {K * N_QUERIES}.0::double, 6) recall from ({chosen(turned, h, f'id // {g}', p)}{ex if r == 'exact' else qt(h)}{true} select distinct qid, id from res semi join tr using (qid, id))"
    axis = f"{w}, fl as (select id, unnest(range(len(v)))::int pos, unnest(v) x from base), ax as (select row_number() over (order by e desc) c, e from (select var_samp(x) e from fl group by pos))"
    cov = f"{w}, fl as (select id, unnest(range(len(v)))::int pos, unnest(v) x from base), cv as materialized (select a.pos i, b.pos j, covar_samp(a.x, b.x) * {DIM} c from fl a join fl b on a.id = b.id group by all), sq as (select a.i, b.j, sum(a.c * b.c) c from cv a join cv b on a.j = b.i group by all)"
    def moments(head: int) -> str:
        tail_sum, head_sum = (lambda e: f"sum(case when c > {head} then {e} else 0 end)"), (lambda e: f"sum(case when c <= {head} then {e} else 0 end)")
        return f"{tail_sum('2 * e')} mu_r, {tail_sum('8 * e * e')} var_r, {head_sum('2 * e * e')} z_offset, {head_sum('4 * e * e')} mu_z, {head_sum('32 * e * e * e * e')} var_z"

    flat = f"{w}, fl as (select id, unnest(range(len(v)))::int pos, unnest(v) x from base)"
    return {
        "scan_base": f"{w} select id, len(v)::int dim, round(list_sum(v), 6) total from base",
        "truth_with_distance": f"{near} select qid, rank, id, round(sqrt(score), 6) distance from top where rank <= {K}",
        "trim8": f"{w} select id from base where id < (select count(*) - count(*) % 8 from base)",
        "sample_prefix": f"{w} select id from base where id < 100",
        "center": f"{flat} select id, pos, round(x - avg(x) over (partition by pos), 6) x from fl",
        "vec_add": pair(_sum("$x + $y", "v", "q")),
        "l2_squared": pair(l2),
        "l2_distance": pair(f"sqrt({l2})"),
        "inner_product": pair(dot),
        "brute_force_distances": pair(l2),
        "l2_scores": pair(f"{n2} - 2.0 * {dot}"),
        "dot_codes": f"{w} select qid, id, list_sum(list_transform(list_zip({aff('v')}, {aff('q')}), lambda t: t[1] * t[2]))::bigint as value from pair",
        "norms": f"{w} select id, round({n2}, 6) norm2 from base",
        "sq_encode": f"{w} select id, unnest(range(len(v)))::int pos, unnest({enc('v')}) code from base",
        "sq_decode_error": f"{w} select id, round(list_max(list_transform(list_zip(v, {enc('v')}), lambda t: abs(t[1] - (t[2] * ((list_max(v) - list_min(v)) / 255.0) + list_min(v))))), 6) worst from base",
        "affine_quantize": f"{w} select id, unnest(range(len(v)))::int pos, unnest({aff('v')}) code from base",
        "affine_dequantize": f"{w} select id, unnest(range(len(v)))::int pos, round((unnest({aff('v')}) - {ZERO}::double) * {SCALE}::double, 6) x from base",
        "comp_floor": pair(f"{n2} - 2.0 * {_sum('$x * $y', 'q', quant('0'))}"),
        "comp_round": pair(f"{n2} - 2.0 * {_sum('$x * $y', 'q', quant('0.5'))}"),
        "comp_int": fixed("1e5"),
        "comp_long": fixed("1e7"),
        "comp_codes": pair(f"list_sum(list_transform(list_zip({aff('v')}, {aff('q')}), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::double * ({SCALE}::double * {SCALE}::double)"),
        "sq_info": f"{w}, e as (select id, v, {enc('v')} c from base) select id, round({n2}, 6) xx, round(list_min(v), 6) min_val, round(list_max(v), 6) max_val, round((list_max(v) - list_min(v)) / 255.0, 9) scale, list_sum(c)::bigint sum_code, list_sum(c[1:32])::bigint part0, list_sum(c[33:])::bigint part1 from e",
        "sq_score": f"{w}, e as (select qid, id, {n2} xx, {info('v', 'x')}, {info('q', 'y')} from pair) select qid, id, round(xx - 2.0 * ({cross}), 6) as value from e",
        "dim_means": f"{flat} select pos, round(avg(x), 6) mean from fl group by pos",
        "covariance": f"{flat} select a.pos i, b.pos j, round(covar_samp(a.x, b.x), 6) cov from fl a join fl b on a.id = b.id and a.pos <= b.pos group by all",
        "rank_selection": f"{axis} select min(d) d from (select c d, sum(e) over (order by c) / sum(e) over () r from ax) where r >= 0.71 - 1e-12",
        "bound_constants": f"{axis} select round(mu_r, 9) mu_r, round(var_r, 9) var_r, round(z_offset, 9) z_offset, round(mu_z, 9) mu_z, round(var_z, 9) var_z from (select {moments(HEAD)} from ax)",
        "lower_bound": _sql_lower_bound(axis, moments(THEORY_HEAD)),
        # the bins in use by inclusion and exclusion; whole numbers up to the last product
        "occupancy_probability": f"""{w}, b as (select ((select count(*) from base) + {GROUP - 1}) // {GROUP} n),
 onto as (select x, sum((case when i % 2 = 0 then 1 else -1 end) * (factorial(x) // (factorial(i) * factorial(x - i))) * (x - i)::hugeint ** 1 * ((x - i)::hugeint ** {K - 1}))::double s from (select unnest(range(1, {K + 1}))::int x) a, (select unnest(range(0, {K + 1}))::int i) c where i <= x group by x),
 p as (select x, s * (select exp(sum(ln(n - t) - ln(t + 1))) from b, (select unnest(range(0, {K})) t) where t < x) / (select n::double ** {K} from b) p from onto)
 select y::int least, round(sum(p), 6) p from (select unnest(range(1, {K + 1})) y) z join p on x >= y group by y""",
        "group_min": f"{near} select qid, id // {GROUP} grp, round(min(score), 6) score, arg_min(id, row(score, id)) id from sc group by qid, grp",
        "section_topk": f"{near}, g as (select qid, min(row(score, id)) m from sc group by qid, least(id // ((select count(*) from base) // 7), 6)) select qid, row_number() over (partition by qid order by m[1], m[2]) rank, m[2] id, round(m[1], 6) score from g qualify rank <= 5",
        "topk": f"{near} select qid, rank, id, round(score, 6) score from top where rank <= {K}",
        "segmented_sort": f"{near} select qid, rank, id, round(score, 6) score from top",
        "phase1_topk": f"{cand} select qid, rank, id, round(score, 6) score from cd",
        "topk_global": f"{near} select id, round(score, 6) score from top where qid = 0 and rank <= {K}",
        "candidate_exact": f"{exact} select qid, id, round(score, 6) as value from ex",
        "knn_exact": f"{near} select qid, rank, id, round(score, 6) d2 from top where rank <= {K}",
        "knn_arrow": f"{near} select qid, rank, id, round(score, 6) d2 from top where rank <= {K}",
        "refine_exact": ranked(given + ex, "sqrt(score)") + " dist from res",
        "refine_quantized": ranked(given + qt(), "score") + " score from res",
        "ann_axis_exact": ranked(exact, "sqrt(score)") + " dist from res",
        "ann_axis_quantized": ranked(qres, "score") + " score from res",
        **{n: ranked(chosen(turned) + ex, "sqrt(score)") + " dist from res" for n in ("ann_rotated_exact", "ann_index_exact")},
        **{n: ranked(chosen(turned) + qt(), "score") + " score from res" for n in ("ann_rotated_quantized", "ann_index_quantized")},
        "strategy_compare": strategies,
        "sweep": " union all ".join(swept(h, g, p, r) for h, g, p in SWEEP for r in ("exact", "quantized")),
        "shuffled_truth": f"{near} select qid, rank, id from top where rank <= {K}",
        "shuffle_ids": f"{w} select id, row_number() over (order by md5(id || ':{SHUFFLE_SEED}'), id) - 1 new_id from base",
        "dequant_l2": pair(coded),
        "project": f"{turned} select id, unnest(range({DIM}))::int pos, round(unnest(rv), 6) y from tb",
        "project_norms": f"{turned} select id, round({inner(f'rv[1:{HEAD}]', f'rv[1:{HEAD}]')}, 6) head_norm2, round({inner(tail('rv'), tail('rv'))}, 6) tail_norm2 from tb",
        "pca_residuals": f"select unnest(range(1, {DIM + 1}))::int component, 0.0::double residual, 1.0::double norm2",
        "recall_hits": f"{hits} select qid, id from hit",
        "recall_at_k": f"{hits} select round(count(*) / {K * N_QUERIES}.0::double, 6) recall from hit",
        "recall_strict": f"{hits} select round(avg(coalesce(c, 0) / {K}.0::double), 6) recall from qry left join (select qid, count(*) c from hit group by qid) using (qid)",
        "query_batches": "select range slot, range // 16 batch_id, range % 20 qid from range(64)",
        "shuffle_remap": f"{near} select qid, rank, (id * 7 + 3) % (select count(*) from base) id from top where rank <= {K}",
        "pca_project_norms": f"{w} select id, round({n2}, 6) norm2 from base",
        "query_project": f"{turned} select qid, unnest(range({DIM}))::int pos, round(unnest(rq), 6) y from tq",
        "eigenvalue_sum": f"{cov} select {DIM}::int dim, round((select sum(c) from cv where i = j), 5) total, round((select sum(c * c) from cv), 5) total2, round((select sum(sq.c * cv.c) from sq join cv using (i, j)), 5) total3, round((select sum(c * c) from sq), 5) total4",
        "phase1_scores": f"{turned} select qid, id, round({head_score(HEAD)}, 6) as value from rot",
    }
