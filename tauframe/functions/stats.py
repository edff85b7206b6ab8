"""Test statistics as Column expressions over aggregated rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published Chebyshev fit of the complementary error function,
# constant term first.
ERFC_COEFFICIENTS = [
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
]


def erfc(z: Column) -> Column:
    """Complementary error function for ``z >= 0`` (relative error near 1e-7)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-z * z + poly)


def erfc_sql(z: str) -> str:
    """The same expression as SQL text."""
    t = f"(1.0::double / (1.0::double + 0.5::double * ({z})))"
    poly = f"({ERFC_COEFFICIENTS[-1]})::double"
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = f"(({c})::double + {t} * {poly})"
    return f"({t} * exp(-({z}) * ({z}) + {poly}))"


def two_sided_normal_p(stat: Column) -> Column:
    return erfc(F.abs(stat) / F.lit(math.sqrt(2.0)))


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def pooled_sd(n1: Column, v1: Column, n0: Column, v0: Column) -> Column:
    return F.sqrt(safe_divide((n1 - 1) * v1 + (n0 - 1) * v0, n1 + n0 - 2))


def standardized_difference(m1, v1, n1, m0, v0, n0) -> Column:
    """(mean1 - mean0) over the pooled sample deviation."""
    return safe_divide(m1 - m0, pooled_sd(n1, v1, n0, v0))


def pooled_t(m0, v0, n0, m1, v1, n1) -> Column:
    """Equal-variance two-sample t of group 0 minus group 1."""
    spread = pooled_sd(n1, v1, n0, v0) * F.sqrt(
        F.try_divide(F.lit(1.0), n0.cast("double")) + F.try_divide(F.lit(1.0), n1.cast("double"))
    )
    return safe_divide(m0 - m1, spread)


def z_p_value(p0, n0, p1, n1, v0=None, v1=None) -> Column:
    """Two-sided normal p of two proportions, or of two means when variances are given."""
    var1 = p1 * (1 - p1) if v1 is None else v1
    var0 = p0 * (1 - p0) if v0 is None else v0
    spread = F.sqrt(safe_divide(var1, n1) + safe_divide(var0, n0))
    return two_sided_normal_p(safe_divide(F.abs(p0 - p1), spread))


#: Two-sided Student p: depth of the continued fraction, and the degrees of freedom from
#: which the normal transform below is closer than the fraction's rounding.
FRACTION_DEPTH = 600
LARGE_DOF = 1000.0
GAMMA_STEPS = 20

# The asymptotic series of gamma(z + 1/2) / (gamma(z) sqrt(z)) in 1/z.
HALF_STEP = [1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304]


def _student_text(t: str, v: str, fold, log1p) -> str:
    """Two-sided p of ``t`` with ``v`` degrees of freedom, both SQL text of doubles, as SQL text.

    Up to ``LARGE_DOF`` degrees of freedom it is the regularised incomplete beta function
    by its continued fraction, evaluated from its end in a fold; beyond, a normal
    deviate with the same tail (Hill's expansion in 1/v). ``fold(start, body)`` runs
    ``body`` in ``f`` and ``k`` for k from ``FRACTION_DEPTH`` to 1.
    """
    a = f"({v} / 2e0)"
    shifted = f"({a} + {GAMMA_STEPS}e0)"
    series = " + ".join(f"({c:.17e}) / pow({shifted}, {i})" for i, c in enumerate(HALF_STEP))
    steps = " * ".join(f"({a} + {i}e0) / ({a} + {i}.5e0)" for i in range(GAMMA_STEPS))
    ratio = f"(sqrt({shifted}) * ({series}) * {steps})"
    x, y = f"({v} / ({v} + {t} * {t}))", f"({t} * {t} / ({v} + {t} * {t}))"
    log = log1p(f"({t} * {t} / {v})")
    front = f"(exp(-{a} * {log}) * sqrt({y}) * {ratio} / {math.sqrt(math.pi)!r}e0)"
    # I_x(a, 1/2) directly in the tail, else 1 - I_y(1/2, a).
    tail = f"{x} < ({a} + 1e0) / ({a} + 2.5e0)"
    p, q, z = (f"(CASE WHEN {tail} THEN {u} ELSE {w} END)" for u, w in ((a, "0.5e0"), ("0.5e0", a), (x, y)))
    m = "floor(k / 2e0)"
    odd = f"-({p} + {m}) * ({p} + {q} + {m}) * {z} / (({p} + 2e0 * {m}) * ({p} + 2e0 * {m} + 1e0))"
    even = f"{m} * ({q} - {m}) * {z} / (({p} + 2e0 * {m} - 1e0) * ({p} + 2e0 * {m}))"
    body = f"(CASE WHEN k % 2e0 = 1e0 THEN {odd} ELSE {even} END) / nullif(1e0 + f, 0e0)"
    fraction = f"({front} / (1e0 + {fold('0e0', body)}))"
    exact = f"(CASE WHEN {t} = 0e0 THEN 1e0 WHEN {tail} THEN {fraction} / {a} ELSE 1e0 - {fraction} / 0.5e0 END)"
    b = f"(48e0 * ({v} - 0.5e0) * ({v} - 0.5e0))"
    w = f"(({v} - 0.5e0) * {log})"
    # The coefficients of Hill's expansion.
    bend = f"(((-0.4e0 * {w} - 3.3e0) * {w} - 24e0) * {w} - 85.5e0) / (0.8e0 * {w} * {w} + 100e0 + {b})"
    normal = f"((({bend} + {w} + 3e0) / {b} + 1e0) * sqrt({w}))"
    wide = f"least(1e0, {erfc_sql(f'{normal} / {math.sqrt(2.0)!r}e0')})"
    return f"CASE WHEN {v} <= {LARGE_DOF!r}e0 THEN {exact} ELSE {wide} END"


def t_p_sql(t: str, dof: str) -> str:
    """SQL twin of :func:`t_p_value`."""
    t, v = f"({t})::double", f"({dof})::double"
    steps = f"list_reverse(range(1, {FRACTION_DEPTH + 1}))::double[]"
    text = _student_text(
        t, v, lambda start, body: f"list_reduce(list_prepend({start}, {steps}), lambda f, k: {body})",
        lambda u: f"ln(1e0 + {u})")
    return f"CASE WHEN isfinite({t}) AND {v} > 0 THEN {text} END"


def t_p_value(t: str, dof: str) -> Column:
    """Two-sided Student p of two columns; meant for aggregated rows.

    Null unless t is finite and the degrees of freedom are positive.
    """
    t, v = f"double({t})", f"double({dof})"
    steps = f"transform(sequence({FRACTION_DEPTH}, 1, -1), k -> double(k))"
    text = _student_text(
        t, v, lambda start, body: f"aggregate({steps}, {start}, (f, k) -> {body})", lambda u: f"log1p({u})")
    return F.expr(f"CASE WHEN abs({t}) < double('Infinity') AND {v} > 0 THEN {text} END")
