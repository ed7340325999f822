"""Per-row vector arithmetic as Column expressions (all accumulate in DOUBLE).

Nulls: a null vector gives a null result. Empty vectors have norm 0 and dot 0.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("nearfield")

LEVELS = ("f8", "f16", "f32", "f64")
METHODS = ("scalar", "simd", "auto")
#: Smallest norm that the strict query normalisation accepts: 2 ** -23.
STRICT_EPS = float(np.finfo(np.float32).eps)
CLAMP = 1e-12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products of two arrays of equal length."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    squares = F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.sqrt(squares)


def normalize_lenient(v: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    v, n = _col(v), norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>"))


def normalize_clamped(v: Column | str) -> Column:
    """Divide by max(norm, 1e-12); a zero vector stays zero."""
    v = _col(v)
    n = F.greatest(norm(v), F.lit(CLAMP))
    return F.transform(v, lambda x: x.cast("double") / n)


def quantize(v: Column | str, level: str) -> Column:
    """All levels hold the same float32 values; the level is a label only."""
    check_level(level)
    return _col(v)


def check_level(level: str) -> None:
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}, not {level!r}")


def check_method(method: str) -> None:
    """The method is a hint about speed only, so it is checked and then ignored."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}, not {method!r}")


def normalize_query(q: np.ndarray, policy: str) -> np.ndarray:
    """One query vector on the driver. Policies: strict (norm up to 2**-23 is an error), lenient (zero stays), facade (zero is an error)."""
    q = np.asarray(q, dtype=np.float64)
    n = float(np.sqrt((q * q).sum()))
    if policy == "strict" and n <= STRICT_EPS or policy == "facade" and n == 0:
        raise ValueError("the query vector has no length")
    if n == 0:
        log.warning("zero query vector left as it is")
        return q
    return q / n


def register_sql_functions(spark: SparkSession) -> None:
    """nf_dot, nf_norm and nf_normalize for SQL text, as SQL functions that Catalyst inlines."""
    fold = "aggregate({}, 0D, (s, x) -> s + x)"
    length = "sqrt(" + fold.format("transform(v, x -> CAST(x AS DOUBLE) * CAST(x AS DOUBLE))") + ")"
    product = fold.format("zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE))")
    unit = f"CASE WHEN {length} > 0 THEN transform(v, y -> CAST(y AS DOUBLE) / {length}) ELSE CAST(v AS ARRAY<DOUBLE>) END"
    for name, args, kind, body in (
        ("nf_dot", "a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", product),
        ("nf_norm", "v ARRAY<FLOAT>", "DOUBLE", length),
        ("nf_normalize", "v ARRAY<FLOAT>", "ARRAY<DOUBLE>", unit),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
