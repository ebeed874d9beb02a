"""Clustering of the members of a node, as NumPy kernels in grouped maps.

One call handles one node; a node over ``MOST_MEMBERS`` members is refused, as
its distances grow with their square: split it by its group path first.
"""

from __future__ import annotations

import math

import numpy as np

MOST_MEMBERS = 4000


def distances(x: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "cosine":
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        u = x / np.where(norm > 0, norm, 1)
        d = 1 - u @ u.T
    else:
        squares = (x * x).sum(axis=1)
        d = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


def agglomerate(d: np.ndarray, linkage: str = "average") -> list[tuple[int, int]]:
    """Merges (kept, gone) in order, by Lance and Williams' recurrence; of equal distances the lowest pair. d is Euclidean for ward."""
    n = len(d)
    if n > MOST_MEMBERS:
        raise ValueError(f"{n} members; the most is {MOST_MEMBERS}")
    d = (d * d if linkage == "ward" else d).astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, merges = np.ones(n), np.ones(n, bool), []
    for _ in range(n - 1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        merges.append((i, j))
        if linkage == "ward":
            k = size
            new = ((size[i] + k) * d[i] + (size[j] + k) * d[j] - k * d[i, j]) / (size[i] + size[j] + k)
        else:
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        alive[j] = False
        new[~alive] = np.inf
        new[i] = np.inf
        d[i, :], d[:, i] = new, new
        d[j, :], d[:, j] = np.inf, np.inf
        size[i] += size[j]
    return merges


def cut_at(merges: list[tuple[int, int]], n: int, k: int) -> np.ndarray:
    """Cluster numbers after n - k merges, numbered by their smallest row."""
    root = np.arange(n)
    for i, j in merges[: n - k]:
        root[root == j] = i
    return np.unique(root, return_inverse=True)[1]


def silhouette(d: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None) -> float:
    """Exact; members of clusters of one score 0. times tells how often each member stands in the table."""
    k = int(labels.max()) + 1
    times = np.ones(len(labels)) if times is None else times
    if k < 2 or k >= times.sum():
        return 0.0
    member = np.eye(k)[labels] * times[:, None]
    counts = member.sum(axis=0)
    sums = d @ member
    own = counts[labels]
    a = sums[np.arange(len(labels)), labels] / np.maximum(own - 1, 1)
    means = sums / counts
    means[np.arange(len(labels)), labels] = np.inf
    b = means.min(axis=1)
    s = np.where(own > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0)
    return float((s * times).sum() / times.sum())


def best_ward(x: np.ndarray, k_min: int, k_max: int) -> np.ndarray:
    """M3: the cut of k_min to k_max clusters with the best silhouette, the first of equals."""
    d = distances(x)
    merges, best = agglomerate(d, "ward"), (-2.0, np.zeros(len(x), int))
    for k in range(max(2, k_min), min(k_max, len(x) - 1) + 1):
        labels = cut_at(merges, len(x), k)
        score = silhouette(d, labels)
        if score > best[0] + 1e-12:
            best = (score, labels)
    return best[1]


def split_limits(n: int, depth: int, max_depth: int, min_size: int, branch: int) -> tuple[int, int]:
    """M4: least and most clusters of a node of n members."""
    remaining = max(1, max_depth - depth)
    cap = min(branch, n - 1)
    floor = max(2, min(math.ceil((n / max(min_size, 1)) ** (1 / remaining)), cap))
    return floor, cap


def ward_paths(x: np.ndarray, max_depth: int = 3, min_size: int = 6, branch: int = 8, depth: int = 0) -> list[tuple[int, ...]]:
    """M4, H1: the path of cluster numbers of each member, one number per level; depth is that of the members' node."""
    paths: list[tuple[int, ...]] = [()] * len(x)
    work = [(np.arange(len(x)), depth)]
    while work:
        own, depth = work.pop()
        if len(own) <= min_size or depth >= max_depth:
            continue
        floor, cap = split_limits(len(own), depth, max_depth, min_size, branch)
        labels = best_ward(x[own], floor, cap)
        if labels.max() < 1:
            labels = cut_at(agglomerate(distances(x[own]), "ward"), len(own), min(floor, cap))
        for c in range(int(labels.max()) + 1):
            part = own[labels == c]
            if len(part) > 1:
                for i in part:
                    paths[i] = (*paths[i], c)
                work.append((part, depth + 1))
    return paths


def diagonal_mixture(x: np.ndarray, k_max: int, turns: int = 80, floor: float = 1e-3, seed: int = 42) -> np.ndarray:
    """Clusters of the diagonal Gaussian mixture of lowest BIC, of 2 to k_max parts."""
    best = (np.inf, np.zeros(len(x), int))
    n, d = x.shape
    for k in range(2, min(k_max, n - 1) + 1):
        rng = np.random.default_rng(seed)
        mean, var, share = x[rng.choice(n, k, replace=False)], np.tile(x.var(axis=0) + floor, (k, 1)), np.full(k, 1 / k)
        for _ in range(turns):
            log_p = np.log(share) - 0.5 * (np.log(2 * np.pi * var).sum(axis=1) + (((x[:, None] - mean) ** 2) / var).sum(axis=2))
            top = log_p.max(axis=1, keepdims=True)
            total = top + np.log(np.exp(log_p - top).sum(axis=1, keepdims=True))
            r = np.exp(log_p - total)
            weight = r.sum(axis=0) + 1e-12
            mean, share = (r.T @ x) / weight[:, None], weight / n
            var = (r.T @ (x * x)) / weight[:, None] - mean**2 + floor
        bic = -2 * float(total.sum()) + (2 * k * d + k - 1) * math.log(n)
        if bic < best[0]:
            best = (bic, np.unique(log_p.argmax(axis=1), return_inverse=True)[1])
    return best[1]


def kmeans(x: np.ndarray, k: int, starts: int = 3, turns: int = 100, seed: int = 42, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of the best of some starts, whose first centres are drawn by their squared distance.

    order tells which row of x each row of the table is, where rows stand in it more than once; they are drawn from the table.
    """
    order = np.arange(len(x)) if order is None else order
    times = np.bincount(order, minlength=len(x)).astype(float)
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(x), int), x[:1])
    for _ in range(starts):
        centres = x[[order[int(rng.integers(len(order)))]]]
        while len(centres) < k:
            far = nearest_centre(x, centres)[1][order]
            centres = np.vstack([centres, x[order[int(rng.choice(len(order), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(order)))]]])
        for _ in range(turns):
            labels, far = nearest_centre(x, centres)
            counts = np.bincount(labels, times, minlength=k)
            new = np.where(counts[:, None] > 0, (np.eye(k)[labels] * times[:, None]).T @ x / np.maximum(counts, 1)[:, None], centres)
            if np.abs(new - centres).max() < 1e-9:
                break
            centres = new
        labels, far = nearest_centre(x, centres)
        if (far * times).sum() < best[0] - 1e-12:
            best = (float((far * times).sum()), labels, centres)
    return best[1], best[2]


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (the first of equals), and its squared distance."""
    far = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)
    labels = far.argmin(axis=1)
    return labels, far[np.arange(len(x)), labels]


def reduced(x: np.ndarray, most: int = 20, times: np.ndarray | None = None) -> np.ndarray:
    """Coordinates along the largest singular vectors, min(most, columns, rows - 1) of them; times tells how often each row stands in the table."""
    k = min(most, x.shape[1], (len(x) if times is None else int(times.sum())) - 1)
    if x.shape[1] <= k:
        return x
    if x.shape[1] < len(x):
        return x @ np.linalg.eigh(x.T @ (x if times is None else x * times[:, None]))[1][:, ::-1][:, :k]
    root = np.ones((len(x), 1)) if times is None else np.sqrt(times)[:, None]
    values, vectors = np.linalg.eigh((x * root) @ (x * root).T)
    return vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0)) / root


def points(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of x, to nine digits, in their order, and which of them each row is."""
    first, number = np.unique(np.round(x, 9) + 0.0, axis=0, return_index=True, return_inverse=True)[1:]
    return x[first], number.reshape(-1)


def mixtures(y: np.ndarray, times: np.ndarray, order: np.ndarray, k_max: int, dims: int, turns: int = 80, floor: float = 1e-3, seed: int = 42) -> np.ndarray:
    """As diagonal_mixture() of the table y[order], where times tells how often each point stands in it: all numbers of parts in the same turns, each until it stands still.

    dims is the number of the table's columns, of which y may lack some that are constant. First means that are
    drawn from rows of one point are moved apart a little, as parts that begin as one stay one but for rounding errors.
    """
    n, ks = len(order), np.arange(2, min(k_max, len(order) - 1) + 1)
    if not len(ks):
        return np.zeros(len(y), int)
    width, none = ks[-1], np.arange(ks[-1])[None, :] >= ks[:, None]
    mean = np.zeros((len(ks), width, y.shape[1]))
    for i, k in enumerate(ks):
        mean[i, :k] = y[order[np.random.default_rng(seed).choice(n, k, replace=False)]]
        mean[i, :k] += 1e-6 * np.random.default_rng(seed).normal(size=(k, y.shape[1]))
    spread = (times @ (y - times @ y / n) ** 2) / n
    var = np.tile(spread + floor, (len(ks), width, 1))
    share = np.where(none, 0.0, 1 / ks[:, None])
    told, fit, going = np.zeros((len(ks), len(y)), int), np.zeros(len(ks)), np.arange(len(ks))
    for turn in range(turns):
        with np.errstate(divide="ignore"):
            front = np.log(share) - 0.5 * np.log(2 * np.pi * var).sum(axis=2)
        log_p = front[:, None, :] - 0.5 * ((y[None, :, None] - mean[:, None]) ** 2 / var[:, None]).sum(axis=3)
        top = log_p.max(axis=2, keepdims=True)
        r = np.exp(log_p - top)
        whole = r.sum(axis=2, keepdims=True)
        r *= times[:, None] / whole
        told[going], fit[going] = log_p.argmax(axis=2), (top + np.log(whole))[:, :, 0] @ times
        weight = r.sum(axis=1) + 1e-12
        back = r.transpose(0, 2, 1)
        new = (back @ y) / weight[:, :, None]
        wide = np.maximum((back @ (y * y)) / weight[:, :, None] - new**2, 0) + floor
        part = np.where(none[going], 0.0, weight / n)
        moved = np.maximum(np.maximum(np.abs(new - mean), np.abs(wide - var)).max(axis=(1, 2)), np.abs(part - share).max(axis=1))
        mean, var, share, left = new, wide, part, moved > 1e-12
        if not left.any():
            break
        if not left.all():
            mean, var, share, going = mean[left], var[left], share[left], going[left]
    bic = -2 * fit + (2 * ks * dims + ks - 1) * math.log(n)
    return np.unique(told[bic.argmin()], return_inverse=True)[1]


def drawn(far: np.ndarray, number: np.ndarray, order: np.ndarray, ks: list[int], starts: int, seed: int = 42) -> np.ndarray:
    """Points that kmeans() draws as first centres, for each k and start; far holds squared distances of points, number tells the point of each row."""
    out = np.zeros((len(ks), starts, max(ks)), int)
    # Rows of one text that follow each other are drawn as one with their number.
    sorted_rows = bool((np.diff(order) >= 0).all())
    held = np.bincount(order, minlength=len(number)).astype(float)
    each = number if sorted_rows else number[order]
    for i, k in enumerate(ks):
        rng = np.random.default_rng(seed)
        for s in range(starts):
            out[i, s, 0] = number[order[int(rng.integers(len(order)))]]
            near = far[out[i, s, 0]]
            for c in range(1, k):
                total = np.cumsum(near[each] * held if sorted_rows else near[each])
                out[i, s, c] = each[min(int(total.searchsorted(rng.random() * total[-1], side="right")), len(each) - 1)]
                near = np.minimum(near, far[out[i, s, c]])
    return out


def many_kmeans(y: np.ndarray, times: np.ndarray, first: np.ndarray, ks: list[int], turns: int = 100) -> list[np.ndarray]:
    """As kmeans(), of all numbers of clusters and starts in the same turns; y holds different points, first the numbers of their first centres."""
    starts, width = first.shape[1:]
    of = np.repeat(ks, starts)
    centres, none = y[first.reshape(-1, width)], np.arange(width)[None, :] >= of[:, None]
    squares, kinds = (y * y).sum(axis=1)[None, :, None], np.arange(width)
    labels, cost, going = np.full((len(of), len(y)), -1), np.zeros(len(of)), np.arange(len(of))
    for _ in range(turns + 1):
        far = np.maximum(squares - 2 * (y @ centres.transpose(0, 2, 1)) + (centres * centres).sum(axis=2)[:, None, :], 0)
        far = np.where(none[going][:, None, :], np.inf, far)
        own = far.argmin(axis=2)
        left = (own != labels[going]).any(axis=1)
        labels[going], cost[going] = own, np.take_along_axis(far, own[:, :, None], 2)[:, :, 0] @ times
        if not left.any():
            break
        own, centres, going = own[left], centres[left], going[left]
        member = (own[:, :, None] == kinds) * times[:, None]
        counts = member.sum(axis=1)[:, :, None]
        centres = np.where(counts > 0, (member.transpose(0, 2, 1) @ y) / np.maximum(counts, 1), centres)
    out = []
    for i in range(len(ks)):
        best = i * starts
        for s in range(best + 1, (i + 1) * starts):
            if cost[s] < cost[best] - 1e-12:
                best = s
        out.append(labels[best])
    return out


def aspect_clusters(x: np.ndarray, most: int, few: int = 30, order: np.ndarray | None = None, starts: int = 3) -> tuple[np.ndarray, float]:
    """Labels and silhouette of the rows of one aspect: up to ``few`` rows by a diagonal mixture of lowest BIC, more by k-means of the best silhouette.

    order is as in kmeans(); ``few`` counts the table's rows. Rows of one aspect are often the same, so each different one is worked on once.
    """
    order = np.arange(len(x)) if order is None else order
    none = np.zeros(len(x), int)
    if len(order) <= 2 or most < 2:
        return none, 0.0
    own, number = points(x)
    if len(own) == 1:
        return none, 0.0
    times = np.bincount(number[order], minlength=len(own)).astype(float)
    y = reduced(own, times=times)
    d = distances(y)
    if len(order) <= few:
        labels = mixtures(y, times, number[order], most, min(20, x.shape[1], len(order) - 1))
        return labels[number], silhouette(d, labels, times) if labels.max() > 0 else 0.0
    # As many clusters as points are the points themselves; more are no better.
    ks = list(range(2, min(most, len(own)) + 1))
    first = drawn(d * d, number, order, ks, starts)
    found = many_kmeans(y, times, first, ks, 100)
    best = (-2.0, np.zeros(len(own), int))
    for labels in found:
        labels = np.unique(labels, return_inverse=True)[1]
        score = silhouette(d, labels, times)
        if labels.max() > 0 and score > best[0] + 1e-12:
            best = (score, labels)
    return best[1][number], max(best[0], 0.0) if best[1].max() == 0 else best[0]


def good_split(labels: np.ndarray, largest: float = 0.85) -> bool:
    """no cluster over 85 %, not more than half of them singletons."""
    sizes = np.bincount(labels)
    return len(sizes) > 1 and sizes.max() <= largest * len(labels) and (sizes == 1).sum() <= len(sizes) / 2
