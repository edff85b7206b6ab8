"""Split scores and gains as Spark SQL text over named arm statistics.

Uplift criteria follow Rzepakowski & Jaroszewicz (2012) and the contextual
treatment selection literature; causal criteria follow Athey & Imbens (2016).

The formulas are text because a level evaluates many of them and each is parsed
once. Columns are named by side, ``l``eft, ``r``ight or ``a`` for the whole
node, and arm: ``n_l0`` rows, ``s_l0`` outcome sum, ``p_l0`` rate, ``slope_l``.
"""

from __future__ import annotations

UPLIFT_CRITERIA = ("KL", "ED", "Chi", "DDP", "CTS", "CAPE")
PROBABILITY_FLOOR = "1e-6D"


def total(name: str, arms) -> str:
    return "(" + " + ".join(f"{name}{k}" for k in arms) + ")"


def bernoulli_divergence(p: str, q: str) -> str:
    """KL divergence of two Bernoulli rates, the second kept off 0 and 1."""
    q = f"greatest({PROBABILITY_FLOOR}, least(1 - {PROBABILITY_FLOOR}, {q}))"
    return (
        f"(CASE WHEN {p} = 0 THEN -ln(1 - {q}) WHEN {p} = 1 THEN -ln({q}) "
        f"ELSE {p} * ln({p} / {q}) + (1 - {p}) * ln((1 - {p}) / (1 - {q})) END)"
    )


def _entropy_term(p: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN -({p}) * ln({p}) ELSE 0D END)"


def slope(side: str, arms) -> str:
    """Sample covariance of arm index and outcome over the variance of the index."""
    n = total(f"n_{side}", arms)
    st = "(" + " + ".join(f"{k} * n_{side}{k}" for k in arms) + ")"
    stt = "(" + " + ".join(f"{k * k} * n_{side}{k}" for k in arms) + ")"
    sy = total(f"s_{side}", arms)
    sty = "(" + " + ".join(f"{k} * s_{side}{k}" for k in arms) + ")"
    cov = f"try_divide({sty} - try_divide({st} * {sy}, {n}), {n} - 1)"
    var = f"(try_divide({stt}, {n}) - try_divide({st}, {n}) * try_divide({st}, {n}))"
    return f"try_divide({cov}, {var})"


def smoothed(side: str, k: int, parent: str, min_rows: int, weight: float) -> str:
    """A child's rate pulled toward its parent's, or the parent's if it is small."""
    return (
        f"CASE WHEN n_{side}{k} > {min_rows} THEN (s_{side}{k} + {parent} * {weight}D) / "
        f"(n_{side}{k} + {weight}D) ELSE {parent} END"
    )


def node_score(criterion: str, side: str, arms) -> str:
    """Divergence between the treated arms and control inside one node."""
    p = [f"p_{side}{k}" for k in arms]
    control, treated = p[0], p[1:]
    if criterion == "CAPE":
        return f"slope_{side}"
    if criterion == "CTS":
        return f"-greatest({', '.join(p)})" if len(p) > 1 else f"-{p[0]}"
    if criterion == "ED":
        parts = [f"2 * ({t} - {control}) * ({t} - {control})" for t in treated]
    elif criterion == "Chi":
        parts = [
            f"(({t} - {control}) * ({t} - {control}) / greatest({PROBABILITY_FLOOR}, {control})"
            f" + ({t} - {control}) * ({t} - {control}) / greatest({PROBABILITY_FLOOR}, 1 - {control}))"
            for t in treated
        ]
    elif criterion == "DDP":
        parts = [f"({t} - {control})" for t in treated]
    else:
        parts = [bernoulli_divergence(t, control) for t in treated]
    return "(" + (" + ".join(parts) or "0D") + ")"


def split_shares(arms) -> dict[str, str]:
    """How much of each arm goes left: columns the normaliser reads."""
    out = {f"share{k}": f"n_l{k} / (n_a{k} + 0.1D)" for k in arms}
    treated = list(arms)[1:]
    out["share_t"] = f"{total('n_l', treated)} / ({total('n_a', treated)} + 0.1D)"
    return out


def split_normalizer(arms, alpha: float = 0.9) -> str:
    """Penalty on splits that separate the arms or are lopsided."""
    treated = list(arms)[1:]
    n_t = total("n_a", treated)
    everyone = f"({n_t} + n_a0)"
    out = (
        f"{alpha}D * ({_entropy_term(f'{n_t} / {everyone}')} + {_entropy_term(f'n_a0 / {everyone}')})"
        f" * {bernoulli_divergence('share_t', 'share0')}"
    )
    for k in treated:
        pair = f"(n_a{k} + n_a0)"
        out += (
            f" + {1 - alpha}D * ({_entropy_term(f'n_a{k} / {pair}')} + {_entropy_term(f'n_a0 / {pair}')})"
            f" * {bernoulli_divergence('share0', f'share{k}')}"
            f" + n_a{k} / {everyone} * {_entropy_term(f'share{k}')}"
        )
    return f"({out} + n_a0 / {everyone} * {_entropy_term('share0')} + 0.5D)"


def uplift_gain(criterion: str, normalizer: str | None) -> tuple[str, str]:
    """(gain deciding the split, gain credited to the feature).

    Reads ``score`` of the node, ``score_l``, ``score_r`` and ``rows_l``, ``rows_r``.
    """
    n = "(rows_l + rows_r)"
    weighted = f"(rows_l * score_l + rows_r * score_r - {n} * score)"
    if criterion == "CTS":
        return f"score - rows_l / {n} * score_l - rows_r / {n} * score_r", f"-{weighted}"
    if criterion == "DDP":
        return "abs(score_l - score_r)", "abs(rows_l * score_l - rows_r * score_r)"
    if criterion == "CAPE":
        square = "(score_l - score_r) * (score_l - score_r)"
        return f"rows_l * rows_r / ({n} * {n}) * {square}", weighted
    gain = f"(rows_l / {n} * score_l + rows_r / {n} * score_r - score)"
    return (gain if normalizer is None else f"{gain} / {normalizer}"), weighted
