"""Log-likelihoods of regression models with their derivatives in closed form.

A model maps (theta, x, y) of a block of rows to ``Parts``: each row's
log-likelihood, and its first and second derivatives by a few indices, numbers such
as a linear predictor or the log of a scale, each of which is a row of a design times theta.  What
a Newton step needs are sums X'WX of the block.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np

_erfc = np.vectorize(math.erfc, otypes=[float])
_each_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function, once for each distinct value: counts have few."""
    own, at = np.unique(x, return_inverse=True)
    return _each_lgamma(own)[at].reshape(np.shape(x)) if len(own) else np.zeros(np.shape(x))


class Parts(NamedTuple):
    """``designs[i]`` is the derivative of index i by theta, [rows, parameters]; ``first[i]``, ``second[i][j]`` are those of the
    log-likelihood by the indices; ``bend`` has, for each row, first derivatives times second ones of the indices by theta, which are zero off the diagonal."""

    value: np.ndarray
    designs: list[np.ndarray]
    first: list[np.ndarray]
    second: list[list[np.ndarray]]
    bend: np.ndarray | None = None


Model = Callable[[np.ndarray, np.ndarray, np.ndarray], Parts]


def block_sums(parts: Parts, times: np.ndarray | None = None) -> np.ndarray:
    """(log-likelihood, score, negative curvature, outer products of scores), flat; a row counts ``times`` times (none given: once)."""
    times = np.ones(len(parts.value)) if times is None else times
    scores = sum(z * g[:, None] for z, g in zip(parts.designs, parts.first, strict=True))
    curve = np.zeros((scores.shape[1],) * 2)
    for i, a in enumerate(parts.designs):
        for j, b in enumerate(parts.designs[: i + 1]):
            part = a.T @ ((times * parts.second[i][j])[:, None] * b)
            curve -= part if i == j else part + part.T
    if parts.bend is not None:
        curve -= np.diag(times @ parts.bend)
    return np.concatenate([[times @ parts.value], times @ scores, curve.ravel(), (scores.T @ (times[:, None] * scores)).ravel()])


def log_cdf(z: np.ndarray) -> np.ndarray:
    """Log of the normal distribution function; far left by its expansion."""
    z = np.asarray(z, float)
    near = np.log(np.maximum(0.5 * _erfc(-np.maximum(z, -30) / math.sqrt(2)), 1e-300))
    return np.where(z < -20, -(z * z) / 2 - np.log(np.maximum(-z, 1)) - 0.5 * math.log(2 * math.pi), near)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def logistic(x: np.ndarray) -> np.ndarray:
    return np.exp(-softplus(-x))


def hazard(z: np.ndarray) -> np.ndarray:
    """Normal density over distribution function, the derivative of the latter's log."""
    return np.exp(-0.5 * z * z - 0.5 * math.log(2 * math.pi) - log_cdf(z))


def digamma(x: np.ndarray | float) -> np.ndarray:
    """By recurrence to twelve and more, then the asymptotic series."""
    x = np.asarray(x, float)
    low = sum(1 / (x + i) for i in range(12))
    x = x + 12
    q = 1 / (x * x)
    return np.log(x) - 0.5 / x - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132)))) - low


def trigamma(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, float)
    low = sum(1 / (x + i) ** 2 for i in range(12))
    x = x + 12
    q = 1 / (x * x)
    return 1 / x + q / 2 + q / x * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q * (1 / 30 - q * 5 / 66)))) + low


def _one(n: int, k: int, at: int) -> np.ndarray:
    """The design of a single parameter."""
    z = np.zeros((n, k))
    z[:, at] = 1
    return z


def _wide(x: np.ndarray, k: int, at: int) -> np.ndarray:
    """``x`` as the columns from ``at`` on of a design of k."""
    z = np.zeros((len(x), k))
    z[:, at : at + x.shape[1]] = x
    return z


def ll_logit(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> Parts:
    eta = x @ theta
    p = logistic(eta)
    return Parts(y * eta - softplus(eta), [x], [y - p], [[-p * (1 - p)]])


def ll_probit(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> Parts:
    sign = 2 * y - 1
    z = sign * (x @ theta)
    h = hazard(z)
    return Parts(log_cdf(z), [x], [sign * h], [[-h * (z + h)]])


class _Count(NamedTuple):
    """A count distribution at given rows: value and derivatives by the linear predictor and, if there is one, the log of alpha."""

    value: np.ndarray
    first: list[np.ndarray]
    second: list[list[np.ndarray]]


def _poisson(eta: np.ndarray, y: np.ndarray, _: float) -> _Count:
    mu = np.exp(eta)
    return _Count(y * eta - mu - _lgamma(y + 1), [y - mu], [[-mu]])


def _negative_binomial(eta: np.ndarray, y: np.ndarray, log_alpha: float) -> _Count:
    """NB2: variance mu + alpha mu^2; r is 1 / alpha."""
    r = math.exp(-float(np.clip(log_alpha, -20, 20)))
    total = np.logaddexp(math.log(r), eta)  # log of r + mu
    share, rest = np.exp(eta - total), np.exp(math.log(r) - total)
    value = _lgamma(y + r) - math.lgamma(r) - _lgamma(y + 1) + r * math.log(r) + y * eta - (y + r) * total
    by_r = digamma(y + r) - digamma(r) + math.log(r) + 1 - total - (y + r) * np.exp(-total)
    twice_r = trigamma(y + r) - trigamma(r) + 1 / r - np.exp(-total) - (np.exp(eta) - y) * np.exp(-2 * total)
    cross = share * (y - np.exp(eta)) * np.exp(-total)
    first = [y - (y + r) * share, -r * by_r]
    return _Count(value, first, [[-(y + r) * share * rest, -r * cross], [-r * cross, r * r * twice_r + r * by_r]])


def _count(kind: str) -> tuple[Callable[[np.ndarray, np.ndarray, float], _Count], int]:
    """The distribution and its number of extra parameters."""
    return (_negative_binomial, 1) if kind.startswith("n") else (_poisson, 0)


def extra_parameters(kind: str) -> int:
    return _count(kind)[1]


def _split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns without the offset, which is the second, and the offset."""
    return np.delete(x, 1, axis=1), x[:, 1]


def _counted(kind: str, theta: np.ndarray, z: np.ndarray, off: np.ndarray, y: np.ndarray, width: int) -> tuple[_Count, list[np.ndarray]]:
    count, extra = _count(kind)
    k = z.shape[1]
    eta = np.clip(z @ theta[:k] + off, -700, 700)
    designs = [_wide(z, width, 0), *([_one(len(y), width, k)] if extra else [])]
    return count(eta, y, float(theta[k]) if extra else 0.0), designs


def ll_poisson(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> Parts:
    z, off = _split(x)
    c, designs = _counted("poisson", theta, z, off, y, len(theta))
    return Parts(c.value, designs, c.first, c.second)


def ll_negative_binomial(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> Parts:
    """The last parameter is the log of alpha."""
    z, off = _split(x)
    c, designs = _counted("negative_binomial", theta, z, off, y, len(theta))
    return Parts(c.value, designs, c.first, c.second)


def ll_zero_inflated(kind: str, k: int) -> Model:
    """Zeros with a logit share on top of a count distribution; parameters: counts, then zeros."""

    def f(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> Parts:
        z, off = _split(x)
        cut = k + extra_parameters(kind)
        c, designs = _counted(kind, theta[:cut], z, off, y, len(theta))
        zero = z @ theta[cut:]
        none, p = y == 0, logistic(zero)
        # w: how likely a zero is one of the zeros on top
        w = np.where(none, logistic(zero - c.value), 0.0)
        value = np.where(none, np.logaddexp(zero, c.value), c.value) - softplus(zero)
        first = [*[(1 - w) * g for g in c.first], w - p]
        m = len(c.first)
        second = [[(1 - w) * c.second[i][j] + w * (1 - w) * c.first[i] * c.first[j] for j in range(m)] + [-w * (1 - w) * c.first[i]] for i in range(m)]
        second.append([*[-w * (1 - w) * g for g in c.first], w * (1 - w) - p * (1 - p)])
        return Parts(value, [*designs, _wide(z, len(theta), cut)], first, second)

    return f


def ll_hurdle(kind: str, k: int) -> Model:
    """A logit for any count at all, a truncated count distribution above; parameters: counts, then the logit."""

    def f(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> Parts:
        z, off = _split(x)
        cut = k + extra_parameters(kind)
        c, designs = _counted(kind, theta[:cut], z, off, y, len(theta))
        at_none, _ = _counted(kind, theta[:cut], z, off, np.zeros(len(y)), len(theta))
        some, any_ = z @ theta[cut:], y > 0
        p = logistic(some)
        # odds of none: the derivative of -log(1 - P(0)) by log P(0)
        odds = 1 / np.maximum(np.expm1(-at_none.value), 1e-300)
        value = np.where(any_, some + c.value - np.log(np.maximum(-np.expm1(at_none.value), 1e-300)), 0.0) - softplus(some)
        first = [np.where(any_, g + odds * g0, 0.0) for g, g0 in zip(c.first, at_none.first, strict=True)]
        m, zero = len(first), np.zeros(len(y))
        second = [[np.where(any_, c.second[i][j] + odds * at_none.second[i][j] + odds * (1 + odds) * at_none.first[i] * at_none.first[j], 0.0) for j in range(m)] + [zero] for i in range(m)]
        second.append([zero] * m + [-p * (1 - p)])
        return Parts(value, [*designs, _wide(z, len(theta), cut)], [*first, any_ - p], second)

    return f


def ll_tobit(limit: float, right: bool) -> Model:
    """Normal errors, observations at the limit only known to lie beyond; the last parameter is log sigma."""
    sign = -1.0 if right else 1.0

    def f(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> Parts:
        k = len(theta)
        s, line = math.exp(np.clip(theta[-1], -30, 30)), x @ theta[:-1]
        z, u = (y - line) / s, sign * (limit - line) / s
        beyond = sign * (y - limit) <= 0
        h = hazard(u)
        bend = -h * (u + h)
        value = np.where(beyond, log_cdf(u), -0.5 * z * z - math.log(s) - 0.5 * math.log(2 * math.pi))
        first = [np.where(beyond, -sign * h / s, z / s), np.where(beyond, -u * h, z * z - 1)]
        cross = np.where(beyond, sign / s * (bend * u + h), -2 * z / s)
        second = [[np.where(beyond, bend / (s * s), -1 / (s * s)), cross], [cross, np.where(beyond, bend * u * u + h * u, -2 * z * z)]]
        return Parts(value, [_wide(x, k, 0), _one(len(y), k, k - 1)], first, second)

    return f


def ll_ordinal() -> Model:
    """Proportional odds; parameters: slopes, first cut, logs of the steps to the others.  x has no leading 1."""

    def f(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> Parts:
        k, n = x.shape[1], len(y)
        steps = np.exp(np.clip(theta[k + 1 :], -20, 20))
        cuts = np.concatenate([[-np.inf], theta[k] + np.concatenate([[0.0], np.cumsum(steps)]), [np.inf]])
        level, line = y.astype(int), x @ theta[:k]
        top = len(cuts) - 2
        upper, lower = cuts[level + 1] - line, cuts[level] - line
        f_up, f_low = logistic(upper), logistic(lower)
        p = np.maximum(f_up - f_low, 1e-300)
        d_up, d_low = f_up * (1 - f_up), f_low * (1 - f_low)
        first = [d_up / p, -d_low / p]
        cross = -first[0] * first[1]
        second = [[d_up * (1 - 2 * f_up) / p - first[0] ** 2, cross], [cross, -d_low * (1 - 2 * f_low) / p - first[1] ** 2]]
        # a cut is the first plus the steps up to it; those at infinity do not move
        designs, bend = [], np.zeros((n, len(theta)))
        for at, moves, g in ((level, level < top, first[0]), (level - 1, level > 0, first[1])):
            z = np.zeros((n, len(theta)))
            z[:, :k] = -x
            z[:, k] = moves
            z[:, k + 1 :] = (at[:, None] > np.arange(len(steps))) * moves[:, None] * steps
            z[~moves] = 0
            designs.append(z)
            bend[:, k + 1 :] += g[:, None] * z[:, k + 1 :]
        return Parts(np.log(p), designs, first, second, bend)

    return f
