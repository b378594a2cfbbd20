"""NumPy kernels. Each runs inside Spark tasks on blocks of bounded size."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


# --- sufficient statistics: [1, x, y] outer products, upper triangle packed ----------


def pack(block: np.ndarray) -> np.ndarray:
    return block[_triangle(block.shape[0])]


@lru_cache(maxsize=16)
def _triangle(width: int):
    return np.triu_indices(width)


def unpack(flat, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    rows, cols = _triangle(width)
    out[rows, cols] = flat
    out[cols, rows] = flat
    return out


def symmetric(flat, width: int) -> np.ndarray:
    """A symmetric matrix given whole or as its packed upper triangle."""
    flat = np.asarray(flat, float)
    return flat.reshape(width, width) if len(flat) == width * width else unpack(flat, width)


def augmented(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x, y])


# --- Bayesian linear regression from sufficient statistics ---------------------------


#: Bounds of the learned noise precision and of prior over noise precision.
NOISE_BOUNDS, RATIO_BOUNDS = (1e-4, 1e6), (1e-10, 1e13)


def bayes_ridge(gram, rhs, y_sq: float, n: float, ratio: float | None = 10.0):
    """Mean, covariance, prior and noise precision and log evidence of a Bayesian regression.

    Given the ratio r of prior to noise precision the coefficients are those of a ridge with
    penalty r: rhs / (r + eigenvalue) in the eigenbasis. Neither they nor what they leave
    unexplained nor the number of determined directions depends on the noise, whose most likely
    precision is then a quotient. So a given ratio needs no iteration, and a learned one is the
    fixed point of one scalar.
    """
    values, axes = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    along = axes.T @ rhs

    def fit(r):
        shrunk = along / (r + values)
        left = max(y_sq - shrunk @ ((2.0 * r + values) * shrunk), 1e-12)
        return shrunk, left, float(np.sum(values / (r + values)))

    if ratio is None:
        ratio = 0.25
        for _ in range(500):
            shrunk, left, known = fit(ratio)
            wanted = known * left / (max(n - known, 1e-6) * max(shrunk @ shrunk, 1e-12))
            last, ratio = ratio, float(np.clip(wanted, *RATIO_BOUNDS))
            if abs(ratio - last) <= 1e-10 * last:
                break
    shrunk, left, known = fit(ratio)
    noise = float(np.clip(max(n - known, 1e-6) / left, *NOISE_BOUNDS))
    spread = 1.0 / (noise * (ratio + values))
    evidence = 0.5 * (np.log(ratio / (ratio + values)).sum() + n * np.log(noise / (2.0 * np.pi)) - noise * (left + ratio * (shrunk @ shrunk)))
    return axes @ shrunk, (axes * spread) @ axes.T, ratio * noise, noise, float(evidence)


def posterior(moment: np.ndarray, n: float, penalty: float | None = 10.0):
    """Posterior from the weighted moments of [1, x, y]; weights are scaled to mean 1
    and the rewards centred on their weighted mean, both by algebra on the moments."""
    total = moment[0, 0]
    y_mean = moment[0, -1] / total
    s = n / total
    phi = moment[:-1, :-1]
    rhs = s * (moment[:-1, -1] - y_mean * phi[0])
    y_sq = s * (moment[-1, -1] - y_mean * y_mean * total)
    return (*bayes_ridge(s * phi, rhs, y_sq, n, penalty), float(y_mean))


def centred_moments(moment: np.ndarray):
    """(total weight, mean of [x, y], weighted centred second moments)."""
    total = moment[0, 0]
    mean = moment[0, 1:] / total
    return total, mean, moment[1:, 1:] - total * np.outer(mean, mean)


def loo_errors(moment: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, alphas, sign=1.0) -> np.ndarray:
    """Summed squared weighted leave-one-out errors of given rows, one per alpha; rows of ``sign`` -1 are taken out."""
    total, mean, cov = centred_moments(moment)
    xc, yc = x - mean[:-1], y - mean[-1]
    # One eigenbasis serves every alpha.
    values, axes = np.linalg.eigh(cov[:-1, :-1])
    z, along = xc @ axes, axes.T @ cov[:-1, -1]
    squares, out = z * z, []
    for alpha in alphas:
        hat = w * (1.0 / total + squares @ (1.0 / (values + alpha)))
        out.append(float((sign * w * ((yc - z @ (along / (values + alpha))) / (1.0 - hat)) ** 2).sum()))
    return np.array(out)


def ridge_from_moments(moment: np.ndarray, alpha: float):
    """Ridge coefficients and intercept of the last column on the others."""
    _, mean, cov = centred_moments(moment)
    coef = np.linalg.solve(cov[:-1, :-1] + alpha * np.eye(len(mean) - 1), cov[:-1, -1])
    return coef, float(mean[-1] - mean[:-1] @ coef)


def fourier_basis(dim: int, width: int, gamma: float, seed: int = 0):
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2.0 * gamma), size=(dim, width)), rng.uniform(0.0, 2.0 * np.pi, size=width)


def lift(x: np.ndarray, width: int, gamma: float, seed: int = 0) -> np.ndarray:
    """``x`` with random Fourier features appended; width 0 leaves it alone."""
    if not width:
        return x
    freq, phase = fourier_basis(x.shape[1], width, gamma, seed)
    return np.hstack([x, np.sqrt(2.0 / width) * np.cos(x @ freq + phase)])


def quadratic(phi: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return ((phi @ matrix) * phi).sum(axis=1)


def forms(triangles: np.ndarray, width: int) -> np.ndarray:
    """Packed symmetric matrices, one a row, such that their products with ``squares`` are quadratic forms."""
    rows, cols = _triangle(width)
    return triangles * np.where(rows == cols, 1.0, 2.0)


def squares(phi: np.ndarray) -> np.ndarray:
    """Products of each row's entries in the order of a packed triangle, one column a row."""
    rows, cols = _triangle(phi.shape[1])
    turned = np.ascontiguousarray(phi.T)
    return turned[rows] * turned[cols]


# --- greedy selections on bounded pools ----------------------------------------------


def best_indices(score: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, ties in input order."""
    if len(score) > 4 * k > 0:
        # Everything at or above the k-th value, so ties at the edge stay in input order.
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return near[np.argsort(-score[near], kind="stable")[:k]]
    return np.argsort(-score, kind="stable")[:k]


#: Candidates brought up to date together.
FRESH = 512


def diverse_greedy(value: np.ndarray, unit: np.ndarray, k: int, weight: float, either_way: bool = False) -> list[int]:
    """Greedy picks by value less ``weight`` times the similarity to the closest pick so far.

    Closeness only grows, so a candidate's last known net value bounds it from above. The
    candidates with the largest outdated bounds are brought up to date, many in one product, until the
    largest bound of all is a current one. Ties go to the earlier row. With ``either_way`` opposite
    vectors count as similar.
    """
    value = np.asarray(value, float)
    bound, close, seen = value.copy(), np.zeros(len(value)), np.zeros(len(value), int)
    picks: list[int] = []
    while len(picks) < min(k, len(value)):
        top = int(bound.argmax())
        if bound[top] == -np.inf:
            break
        if seen[top] == len(picks):
            picks.append(top)
            bound[top] = -np.inf
            continue
        old = np.flatnonzero((seen < len(picks)) & np.isfinite(bound))
        if len(old) > FRESH:
            old = old[np.argpartition(-bound[old], FRESH)[:FRESH]]
        alike = unit[old] @ unit[picks[int(seen[old].min()):]].T
        close[old] = np.maximum(close[old], (np.abs(alike) if either_way else alike).max(axis=1))
        bound[old] = value[old] - weight * close[old]
        seen[old] = len(picks)
    return picks


def rough_greedy(rough: np.ndarray, slack: np.ndarray, exact, unit: np.ndarray, turned: np.ndarray, k: int, weight: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """As ``diverse_greedy`` with ``either_way``, for several lists of the same rows whose values are known in single
    precision to within ``slack``: (picks, their values) of each. Rows that could be the best by these numbers are weighed
    by ``exact(list, rows)``; equal ones go to the earlier row. ``turned`` is ``unit`` in single precision, rows as columns.
    Overwrites ``rough``."""
    longest = float((unit * unit).sum(axis=1).max(initial=0.0))
    slack = slack + weight * (unit.shape[1] + 3) * 2.0**-23 * longest
    close, net, picks, values = None, rough, [[] for _ in rough], [[] for _ in rough]
    for _ in range(min(k, unit.shape[0])):
        top = net.max(axis=1)
        new = [i for i in range(len(rough)) if np.isfinite(top[i])]
        if not new:
            break
        for i in new:
            room = 2.0 * slack[i] + 2.0**-20 * abs(float(top[i]))
            some = np.flatnonzero(net[i] >= np.float32(float(top[i]) - room))
            value = exact(i, some)
            worth = value - weight * np.abs(unit[some] @ unit[picks[i]].T).max(axis=1) if picks[i] else value
            best = worth.max()
            first = int(np.argmax(worth >= best - 1e-13 * max(abs(best), 1e-3)))
            picks[i].append(int(some[first]))
            values[i].append(float(value[first]))
            rough[i, some[first]] = -np.inf
        last = np.array([p[-1] if p else 0 for p in picks])
        alike = turned[:, last].T @ turned
        np.abs(alike, out=alike)
        close = alike if close is None else np.maximum(close, alike, out=close)
        net = np.multiply(close, np.float32(-weight))
        net += rough
    return [(np.array(p, int), np.array(v, float)) for p, v in zip(picks, values)]


#: Lists up to so long are picked from together, in groups of lists of about one length.
SHORT_LIST = 64


def diverse_lists(value: np.ndarray, unit: np.ndarray, sizes: np.ndarray, k: int, weight: float) -> list[np.ndarray]:
    """Rows that ``diverse_greedy`` picks from each of many lists that stand one after another."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    picks: list = [None] * len(sizes)
    for i in np.flatnonzero(sizes > SHORT_LIST):
        picks[i] = starts[i] + np.array(diverse_greedy(value[starts[i]:ends[i]], unit[starts[i]:ends[i]], k, weight), int)
    for n in np.unique(sizes[sizes <= SHORT_LIST]):
        lists = np.flatnonzero(sizes == n)
        at = starts[lists][:, None] + np.arange(n)
        worth, vectors = value[at], unit[at]
        bound, close, rows = worth.copy(), np.zeros(at.shape), np.arange(len(lists))
        found = np.zeros((len(lists), min(k, n)), int)
        for turn in range(found.shape[1]):
            found[:, turn] = top = bound.argmax(axis=1)
            worth[rows, top] = -np.inf
            close = np.maximum(close, (vectors @ vectors[rows, top][:, :, None])[:, :, 0])
            bound = worth - weight * close
        for i, row in zip(lists, starts[lists][:, None] + found):
            picks[i] = row
    return picks


def volume_greedy(unit: np.ndarray, quality: np.ndarray, k: int, epsilon: float = 1e-9) -> list[int]:
    """Greedy largest-volume subset of a quality-weighted cosine kernel.

    Rows are scaled by quality and each pick's direction is projected out of the rest
    (Gram-Schmidt), so a row's remaining squared length is the volume it would add.
    """
    if not len(unit):
        return []
    rest = unit.astype(float) * quality[:, None]
    # A row's own squared length is taken as its quality squared, its vector being a unit one.
    left = quality.astype(float) ** 2
    picks: list[int] = []
    for _ in range(min(k, len(unit))):
        i = int(np.argmax(left))
        if picks and left[i] < epsilon:
            break
        picks.append(i)
        direction = rest[i] / np.sqrt(max(left[i], epsilon))
        along = rest @ direction
        rest = rest - along[:, None] * direction
        left = left - along * along
        left[picks] = -np.inf
    return picks
