"""Numerical helpers for one series at a time; small, and only called from tasks.  X: points by columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def robust_principal(x: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """Principal component pursuit: x as a low-rank and a sparse part; the sum of the differences between the low-rank part and its principal components.

    Columns of zeros only are dropped; a component's largest loading is positive.
    """
    x = x.reshape(len(x), -1)
    x = x[:, (x != 0).any(axis=0)]
    if not x.size:
        return np.zeros(len(x))
    lam, mu = 1 / np.sqrt(max(x.shape)), x.size / (4 * max(np.abs(x).sum(axis=0).max(), 1e-12))
    low, sparse, dual = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    for _ in range(rounds):
        u, s, v = np.linalg.svd(x - sparse + dual / mu, full_matrices=False)
        low = (u * np.maximum(s - 1 / mu, 0)) @ v
        rest = x - low + dual / mu
        sparse = np.sign(rest) * np.maximum(np.abs(rest) - lam / mu, 0)
        dual = dual + mu * (x - low - sparse)
        if np.linalg.norm(x - low - sparse) <= 1e-7 * np.linalg.norm(x):
            break
    centred = low - low.mean(axis=0)
    v = np.linalg.svd(centred, full_matrices=False)[2]
    v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]
    return np.abs(low - centred @ v.T).sum(axis=1)


def kernel_of(name: str, width: int, spread: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The kernel matrix of two sets of points, with gamma = 1 / (columns * variance): rbf, linear, poly (of the third power) or sigmoid."""
    gamma = 1 / (width * max(spread, 1e-12))
    kinds = {
        "rbf": lambda a, b: np.exp(-gamma * np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)),
        "linear": lambda a, b: a @ b.T,
        "poly": lambda a, b: (gamma * a @ b.T) ** 3,
        "sigmoid": lambda a, b: np.tanh(gamma * a @ b.T),
    }
    if name not in kinds:
        raise ValueError(f"no kernel {name!r}: {', '.join(kinds)}")
    return kinds[name]


def one_class(x: np.ndarray, train: np.ndarray | None = None, nu: float = 0.5, kernel: str = "rbf", tol: float = 1e-3) -> np.ndarray:
    """One-class support vectors, fitted on all rows of ``train`` (or all points); score = rho - f(x).

    The dual is solved by steps on the pair of weights that gains most, until no pair violates its conditions by ``tol``
    (or after 1,000 steps for each point, as the sigmoid is no kernel in the strict sense); rows of the kernel are made
    when they are needed.
    """
    own = x if train is None else x[train]
    n, both = len(own), kernel_of(kernel, x.shape[1], own.var())
    itself = np.concatenate([np.diagonal(both(own[i : i + 64], own[i : i + 64])) for i in range(0, n, 64)])
    alpha = np.clip(nu * n - np.arange(n), 0, 1)  # sums to nu * n
    step = max(1, 4_000_000 // n)
    f = np.concatenate([both(own[i : i + step], own) @ alpha for i in range(0, n, step)])
    for _ in range(1_000 * n):
        up, down = alpha < 1, alpha > 0
        if not up.any():
            break
        i = int(np.where(up, f, np.inf).argmin())
        gap = np.where(down, f - f[i], 0)
        if gap.max() <= tol:
            break
        row = both(own[[i]], own)[0]
        curve = np.maximum(itself[i] + itself - 2 * row, 1e-12)
        j = int(np.where(gap > 0, gap * gap / curve, -1).argmax())
        move = min(gap[j] / curve[j], 1 - alpha[i], alpha[j])
        alpha[i] = 1.0 if move == 1 - alpha[i] else alpha[i] + move
        alpha[j] = 0.0 if move == alpha[j] else alpha[j] - move
        f += move * (row - both(own[[j]], own)[0])
    margin = (alpha > 0) & (alpha < 1)
    if margin.any():
        rho = f[margin].mean()
    else:
        rho = (f[alpha > 0].max() + f[alpha < 1].min()) / 2 if (alpha < 1).any() else f.max()
    return np.concatenate([rho - both(x[i : i + step], own) @ alpha for i in range(0, len(x), step)])


def spectral_residual(v: np.ndarray, taps: int = 100) -> np.ndarray:
    """Magnitude of the inverse transform of the log spectrum less its moving average.

    The average is that of the lower half of the frequencies, with the first and last values beyond its ends, and the
    upper half mirrors it; the mean keeps nothing.
    """
    v = (v - v.min()) / max(v.max() - v.min(), 1e-12)
    freq, half, before = np.fft.fft(v), len(v) // 2, (taps - 1) // 2
    log = np.log(np.maximum(np.abs(freq), 1e-8))
    smooth = np.convolve(np.concatenate([np.full(before, v[0]), log[1 : half + 1], np.full(taps - 1 - before, v[-1])]), np.full(taps, 1 / taps), "valid")
    smooth = smooth[:half]  # a series of one point has no other frequency
    mean = np.concatenate([log[:1], smooth, smooth[: len(v) - 1 - half][::-1]])
    return np.abs(np.fft.ifft(np.exp(log - mean + 1j * np.angle(freq))))


def shape_correlation(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greatest normalised cross-correlation of each row of a with b, and the shift that gives it."""
    m = len(b)
    size = 1 << (2 * m - 1).bit_length()
    cc = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    cc = np.concatenate([cc[:, -(m - 1) :], cc[:, :m]], axis=1) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b), 1e-12)[:, None]
    return cc.max(axis=1), cc.argmax(axis=1) - (m - 1)


def shapes(x: np.ndarray, k: int, seed: int = 0, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """k-shape: assignment by shape distance; a centre is the main direction of its aligned, normalised members."""
    rng = np.random.default_rng(seed)
    n, m = x.shape
    x = (x - x.mean(axis=1, keepdims=True)) / np.maximum(x.std(axis=1, keepdims=True), 1e-12)
    of, c = rng.integers(k, size=n), np.zeros((k, m))
    centre = np.eye(m) - 1 / m
    for _ in range(rounds):
        for i in range(k):
            own = x[of == i]
            if not len(own):
                own = x[rng.integers(n)][None]
            if c[i].any():
                shift = shape_correlation(own, c[i])[1]
                own = np.stack([np.roll(r, -s) for r, s in zip(own, shift)])
            c[i] = np.linalg.eigh(centre @ (own.T @ own) @ centre)[1][:, -1]
            if ((own[0] - c[i]) ** 2).sum() > ((own[0] + c[i]) ** 2).sum():
                c[i] = -c[i]
            c[i] = (c[i] - c[i].mean()) / max(c[i].std(), 1e-12)
        now = np.stack([shape_correlation(x, c[i])[0] for i in range(k)], axis=1).argmax(axis=1)
        if np.array_equal(now, of):
            break
        of = now
    return of, c


def nearest_in(v: np.ndarray, long: np.ndarray, width: int) -> np.ndarray:
    """For each window of v the z-normalised distance to the nearest window of ``long``."""
    norm = lambda w: (w - w.mean(axis=1, keepdims=True)) / np.maximum(w.std(axis=1, keepdims=True), 1e-12)
    a, b = (norm(np.lib.stride_tricks.sliding_window_view(s, width)) for s in (v, long))
    return np.concatenate([np.sqrt(np.maximum(2 * width - 2 * (a[i : i + 4_096] @ b.T), 0)).min(axis=1) for i in range(0, len(a), 4_096)])


def aligned(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Each row of x moved to where it correlates best with c, with zeros where nothing is left."""
    out = np.zeros_like(x)
    for row, r, s in zip(out, x, shape_correlation(x, c)[1]):
        row[max(-s, 0) : len(r) - max(s, 0)] = r[max(s, 0) : len(r) + min(s, 0)]
    return out


def shape_scores(v: np.ndarray, width: int, k: int = 6, seed: int = 0, start: int | None = None, batch: int = 0, alpha: float = 0.5) -> np.ndarray:
    """Distances to the centres of k-shape clusters of sub-sequences (length 4 * width, one every 1.5 * width), weighted by frequency, centrality and age, as a running mean.

    Without ``batch`` all sub-sequences are clustered at once.  With it the first ``start`` points are, then so many
    points at a time: a batch's clusters are merged with those nearer than their own mean distance, or added; weights,
    mean and deviation of the scores follow with ``alpha``, and each batch is scored by the clusters known by then.
    """
    n, length, stride = len(v), 4 * width, max(int(1.5 * width), 1)
    scale = lambda a: (a - a.min()) / (a.max() - a.min() + 1e-7) + 1
    far = lambda starts, c: 1 - shape_correlation(np.stack([v[i : i + length] for i in starts]), c)[0]
    # Of each cluster: centre, starts of members, sum of outer products of aligned members, mean distance, weight.
    centres, members, outer, mean_far, weight = [], [], [], [], np.zeros(0)
    level = spread = None
    scores, now = [], 0
    while not scores or now < n - length:
        size = (start or n) if not scores else batch
        starts = np.arange(now, min(now + size, n - length), stride)
        if not len(starts):
            raise ValueError(f"no sub-sequence of {length} points in {n}")
        of, found = shapes(np.stack([v[i : i + length] for i in starts]), min(k, len(starts)), seed)
        merge, known = {}, len(centres)
        for i in range(len(found)):
            own = starts[of == i].tolist()
            if not own:
                continue
            near = 1 - shape_correlation(np.stack(centres[:known]), found[i])[0] if known else np.zeros(0)
            if known and near.min() < mean_far[int(near.argmin())]:
                merge.setdefault(int(near.argmin()), []).extend(own)
                continue
            moved = aligned(np.stack([v[j : j + length] for j in own]), found[i])
            centres.append(found[i])
            members.append(own)
            outer.append(moved.T @ moved)
            mean_far.append(float(far(own, found[i]).mean()))
        for i, new in merge.items():
            moved = aligned(np.stack([v[j : j + length] for j in new]), centres[i])
            outer[i] = outer[i] + moved.T @ moved
            members[i] = members[i] + new
            mean_far[i] = (mean_far[i] + float(far(members[i], centres[i]).mean())) / 2
            centre = np.eye(length) - 1 / length
            c = np.linalg.eigh(centre @ outer[i] @ centre)[1][:, -1]
            if np.linalg.norm(moved + c, axis=1).sum() < np.linalg.norm(moved - c, axis=1).sum():
                c = -c
            centres[i] = (c - c.mean()) / max(c.std(ddof=1), 1e-12)
        begin, now = now, now + size
        own = v[begin:] if now >= n - length else v[begin:now]

        all_centres = np.stack(centres)
        central = np.array([(1 - shape_correlation(all_centres, c)[0]).sum() for c in centres])
        fresh = scale(np.array([float(len(m)) for m in members])) ** 2 / scale(central)
        weight = np.concatenate([weight, fresh[len(weight) :]])
        age = np.array([float(now - m[-1]) for m in members])
        weight = (1 - alpha) * weight + alpha * fresh / (1 + np.maximum(age - batch, 0))
        join = sum(w * nearest_in(own, c, width) for w, c in zip(weight, centres)) / weight.sum()
        mean = np.convolve(np.pad(join, (0, width - 1), "edge"), np.full(width, 1 / width), "valid")
        mean = np.pad(mean, (width - 1, 0), "edge")
        level = mean.mean() if level is None else (1 - alpha) * level + alpha * mean.mean()
        spread = mean.std() if spread is None else (1 - alpha) * spread + alpha * mean.std()
        scores.append((mean - level) / max(spread, 1e-12))
    return np.concatenate(scores)


def autoencoder(x: np.ndarray, hidden: tuple[int, ...] = (16, 4, 16), epochs: int = 30, seed: int = 0, rate: float = 1e-3, train: np.ndarray | None = None) -> np.ndarray:
    """Reconstruction errors (mean square) of a small network with Adam, trained on ``train`` or all points."""
    rng, t = np.random.default_rng(seed), x if train is None else train
    sizes = [x.shape[1], *hidden, x.shape[1]]
    w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
    b = [np.zeros(n) for n in sizes[1:]]
    params = [*w, *b]
    m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def forward(z: np.ndarray) -> list[np.ndarray]:
        acts = [z]
        for i in range(len(w)):
            z = z @ w[i] + b[i]
            z = np.maximum(z, 0) if i + 1 < len(w) else z
            acts.append(z)
        return acts

    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(t)), max(1, len(t) // 128)):
            acts = forward(t[rows])
            delta, gw, gb = 2 * (acts[-1] - t[rows]) / len(rows), [], []
            for i in reversed(range(len(w))):
                gw.append(acts[i].T @ delta)
                gb.append(delta.sum(axis=0))
                delta = delta @ w[i].T * (acts[i] > 0)
            step += 1
            for p, g, mi, si in zip(params, [*gw[::-1], *gb[::-1]], m, s):
                mi += 0.1 * (g - mi)
                si += 0.001 * (g * g - si)
                p -= rate * mi / (1 - 0.9**step) / (np.sqrt(si / (1 - 0.999**step)) + 1e-8)
    return ((forward(x)[-1] - x) ** 2).mean(axis=1)


def sample_entropy(v: np.ndarray, m: int = 2, tol: float = 0.2) -> float:
    """-ln of the share of pairs alike over m values that stay alike over m + 1."""
    r = tol * v.std()

    def alike(k: int) -> int:
        w = np.lib.stride_tricks.sliding_window_view(v, k)[: len(v) - m]
        return int((np.abs(w[:, None] - w[None]).max(axis=2) <= r).sum()) - len(w)

    a, b = alike(m + 1), alike(m)
    return float(-np.log(a / b)) if a and b else float("nan")


def hurst(v: np.ndarray) -> float:
    """Slope of the log rescaled range over the log size of parts."""
    sizes, means = [], []
    n = 8
    while n <= len(v) // 2:
        parts = v[: len(v) // n * n].reshape(-1, n)
        dev = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
        std = parts.std(axis=1)
        if (std > 0).any():
            sizes.append(np.log(n))
            means.append(np.log(((dev.max(axis=1) - dev.min(axis=1))[std > 0] / std[std > 0]).mean()))
        n *= 2
    return float(np.polyfit(sizes, means, 1)[0]) if len(sizes) > 1 else float("nan")


def ar_coefficient(v: np.ndarray, k: int = 1) -> float:
    """The last coefficient of an autoregression of order k, by least squares."""
    a = np.column_stack([v[k - i - 1 : len(v) - i - 1] for i in range(k)] + [np.ones(len(v) - k)])
    return float(np.linalg.lstsq(a, v[k:], rcond=None)[0][k - 1])
