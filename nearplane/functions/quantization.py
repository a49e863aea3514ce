"""Scalar quantisation and approximate distances as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearplane.functions import vector as V


def sq_scale(v: Column, bits: int = 8) -> Column:
    if not 1 <= bits <= 8:
        raise ValueError("bits must be from 1 to 8")
    return (F.array_max(v) - F.array_min(v)) / float(2**bits - 1)


def sq_encode(v: Column, bits: int = 8) -> Column:
    """Nearest of 2**bits levels between the vector's least and greatest element; all 0 for a constant vector."""
    return V.let({"v": v, "low": F.array_min(v), "scale": sq_scale(v, bits)}, _coded)


def _coded(t: Column) -> Column:
    return F.transform(t["v"], lambda x: F.when(t["scale"] == 0, F.lit(0)).otherwise(F.floor((x - t["low"]) / t["scale"] + 0.5)).cast("smallint"))


def sq_decode(code: Column, low: Column, scale: Column) -> Column:
    return F.transform(code, lambda c: c * scale + low)


def affine_quantize(v: Column, scale: float, zero: float, levels: int) -> Column:
    return F.transform(v, lambda x: F.least(F.greatest(x / scale + zero, F.lit(0.0)), F.lit(float(levels - 1))).cast("int"))


def affine_dequantize(code: Column, scale: float, zero: float) -> Column:
    return F.transform(code, lambda c: (c - F.lit(zero)) * scale)


def dequant_l2(d2: Column, scale: float) -> Column:
    """A squared distance in code space on the scale of the vectors."""
    return d2 * (scale * scale)


def _rounded(q: Column, v: Column, intervals: int, add: float) -> Column:
    if not intervals:
        return V.norm_squared(v)
    low = F.array_min(v)

    def score(t: Column) -> Column:
        level = F.transform(t["v"], lambda x: F.when(t["step"] == 0, x).otherwise(t["low"] + F.floor((x - t["low"]) / t["step"] + add) * t["step"]))
        return V.norm_squared(t["v"]) - 2.0 * V.inner_product(t["q"], level)

    return V.let({"v": v, "q": q, "low": low, "step": (F.array_max(v) - low) / float(intervals)}, score)


def comp_floor(q: Column, v: Column, intervals: int) -> Column:
    """Squared norm less twice the product with v rounded down to a level; the norm alone without levels."""
    return _rounded(q, v, intervals, 0.0)


def comp_round(q: Column, v: Column, intervals: int) -> Column:
    """comp_floor with rounding to the nearest level."""
    return _rounded(q, v, intervals, 0.5)


def comp_fixed(q: Column, v: Column, intervals: int, unit_scale: float) -> Column:
    """The same in fixed-point integers, each level stood for by its middle."""
    if not intervals:
        return V.norm_squared(v)
    whole = lambda a: F.transform(a, lambda x: (x * unit_scale).cast("long"))
    div = lambda c, d: F.floor(c / d).cast("long")

    def score(t: Column) -> Column:
        level = F.transform(t["v"], lambda x: t["low"] + div(x - t["low"], t["step"]) * t["step"] + div(t["step"], F.lit(2)))
        return V.dot_codes(t["q"], level)

    def stepped(t: Column) -> Column:
        low = F.array_min(t["v"])
        step = F.greatest(div(F.array_max(t["v"]) - low, F.lit(intervals)), F.lit(1).cast("long"))
        return V.let({"v": t["v"], "q": t["q"], "low": low, "step": step}, score)

    return V.norm_squared(v) - 2.0 * V.let({"v": whole(v), "q": whole(q)}, stepped) / (unit_scale * unit_scale)


def comp_codes(code: Column, q: Column, scale: float, zero: float, levels: int) -> Column:
    """Squared distance of a coded vector to a query coded alike, in code space."""
    return dequant_l2(V.l2_codes(code, affine_quantize(q, scale, zero, levels)), scale)


def sq_score(x: Column, q: Column, dim: Column) -> Column:
    """Squared norm less twice the product of two quantised vectors, from their codes and precomputed sums."""
    return V.let({"x": x, "q": q, "dim": dim}, lambda t: _sq_score(t["x"], t["q"], t["dim"]))


def _sq_score(x: Column, q: Column, dim: Column) -> Column:
    cc = V.dot_codes(x["code"], q["code"])
    cross = x["scale"] * q["scale"] * cc + q["scale"] * x["min_val"] * q["sum_code"] + x["scale"] * q["min_val"] * x["sum_code"] + q["min_val"] * x["min_val"] * dim
    return x["xx"] - 2.0 * cross


def sq_info(v: Column, bits: int = 8, cut: int | None = None) -> Column:
    """struct(xx, min_val, max_val, scale, code, sum_code, xx_part, sum_code_part) of a vector, parts split at cut."""
    parts = lambda a, f: F.array(f(a)) if cut is None else F.array(f(F.slice(a, 1, cut)), f(F.slice(a, F.lit(cut + 1), F.greatest(F.size(a) - cut, F.lit(0)))))

    def of(t: Column) -> Column:
        return V.let({"v": t["v"], "low": t["low"], "high": t["high"], "scale": t["scale"], "code": _coded(t)}, summed)

    def summed(t: Column) -> Column:
        return F.struct(V.norm_squared(t["v"]).alias("xx"), t["low"].alias("min_val"), t["high"].alias("max_val"), t["scale"].alias("scale"), t["code"].alias("code"), V.code_sum(t["code"]).alias("sum_code"), parts(t["v"], V.norm_squared).alias("xx_part"), parts(t["code"], V.code_sum).alias("sum_code_part"))

    return V.let({"v": v, "low": F.array_min(v), "high": F.array_max(v), "scale": sq_scale(v, bits)}, of)
