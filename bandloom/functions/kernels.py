"""Small numeric kernels on one bands x bands matrix or one pair of sampled bands; Spark runs one for each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EULER_GAMMA = 0.5772156649015329


# ---- subspaces ------------------------------------------------------------------------------------------------------


def check_count(k: int, low: int, high: int) -> None:
    if not low <= k <= high:
        raise ValueError(f"the number of subspaces must be from {low} to {high}, not {k}")


def uniform_sizes(bands: int, k: int, seed: int = 42) -> list[int]:
    """Sizes of k contiguous parts; which of them take a band more is drawn by the seed."""
    check_count(k, 1, bands)
    sizes = np.full(k, bands // k)
    if bands % k:
        sizes[np.random.RandomState(seed).choice(k, bands % k, replace=False)] += 1
    return sizes.tolist()


def parts(cuts: list[int]) -> list[list[int]]:
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:])]


def uniform_parts(bands: int, k: int, seed: int = 42) -> list[list[int]]:
    return parts([0, *np.cumsum(uniform_sizes(bands, k, seed)).tolist()])


def association(similarity: np.ndarray) -> np.ndarray:
    """Score of each range of bands (first, end): similarity within it over similarity of its bands to all."""
    n = len(similarity)
    area = np.zeros((n + 1, n + 1))
    area[1:, 1:] = similarity.cumsum(0).cumsum(1)
    lo, hi = np.arange(n + 1)[:, None], np.arange(n + 1)[None, :]
    inner = area[hi, hi] - area[lo, hi] - area[hi, lo] + area[lo, lo]
    whole = area[hi, n] - area[lo, n]
    return np.where(np.abs(whole) < 1e-12, 0.0, inner / np.where(np.abs(whole) < 1e-12, 1.0, whole))


def best_cuts(similarity: np.ndarray, k: int) -> list[list[int]]:
    """The k contiguous parts with the greatest sum of ``association``; of equals, the earliest last cut wins."""
    n = len(similarity)
    check_count(k, 1, n)
    score = association(similarity)
    best, back = score[0].copy(), []
    best[0] = -np.inf
    for _ in range(k - 1):
        options = best[:, None] + np.where(np.arange(n + 1)[:, None] < np.arange(n + 1)[None, :], score, -np.inf)
        back.append(options.argmax(axis=0))
        best = options.max(axis=0)
    cuts = [n]
    for step in reversed(back):
        cuts.append(int(step[cuts[-1]]))
    return parts([0, *reversed(cuts)])


def adaptive_cuts(distance: np.ndarray, k: int) -> list[list[int]]:
    """Equal parts whose cuts move, from left to right, to where the greatest distance across is largest against the mean within."""
    n = len(distance)
    check_count(k, 1, n)
    sizes = [n // k + (p < n % k) for p in range(k)]
    cuts = [0, *np.cumsum(sizes).tolist()]
    for p in range(k - 1):
        lo, hi = cuts[p], cuts[p + 2]
        best = -np.inf
        for cut in range(lo + 2, hi - 1):
            a, b = distance[lo:cut, lo:cut], distance[cut:hi, cut:hi]
            within = a.sum() / (len(a) * (len(a) - 1)) + b.sum() / (len(b) * (len(b) - 1))
            across = distance[lo:cut, cut:hi].max()
            score = across / within if within >= 1e-12 else (np.inf if across > 0 else 0.0)
            if score > best:
                best, cuts[p + 1] = score, cut
    return parts(cuts)


def peak_scores(similarity: np.ndarray) -> np.ndarray:
    """Score of each band: mean of its high similarities times dissimilarity to bands that have a higher mean, both scaled."""
    n = len(similarity)
    upper = np.sort(similarity[np.triu_indices(n, 1)])[::-1]
    high = upper[int(len(upper) * 0.05) - 1 : int(len(upper) * 0.1) - 1]
    level = high.mean() if len(high) else np.nan
    above = similarity > level
    alpha = np.where(above.any(axis=1), (similarity * above).sum(axis=1) / np.maximum(above.sum(axis=1), 1), 0.0)
    order = np.argsort(-alpha, kind="stable")
    phi = np.zeros(n)
    for place in range(1, n):
        phi[order[place]] = max(0.0, similarity[order[place], order[:place]].max())
    phi[order[0]] = min(phi[order[1:]].min() if n > 1 else 1.0, 1.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        theta = np.sqrt(1 - phi**2)
        scaled = [(x - x.min()) / (x.max() - x.min()) for x in (alpha, theta)]
    return scaled[0] * scaled[1]


def _split_costs(weights: np.ndarray, lo: int, hi: int, options: range) -> int | None:
    """The cut of [lo, hi) with the least similarity across over the product of those within; the first of equals."""
    best, found = np.inf, None
    triangle = np.triu(weights)
    for cut in options:
        across = weights[lo:cut, cut:hi].sum()
        with np.errstate(invalid="ignore", divide="ignore"):
            cost = across / (triangle[lo:cut, lo:cut].sum() * triangle[cut:hi, cut:hi].sum())
        if cost < best:
            best, found = cost, cut
    return found


def coarse_cuts(weights: np.ndarray, peaks: list[int]) -> list[int]:
    """A cut between each two neighbouring peaks, with 0 and the number of bands around."""
    cuts = [0]
    for a, b in zip(peaks, peaks[1:]):
        if b - a <= 2:
            cuts.append(a + 1)
        elif b - a == 3:
            cuts.append(a + 2)
        else:
            cuts.append(_split_costs(weights, a, b + 1, range(a + 2, b)) or (a + b) // 2)
    return [*cuts, len(weights)]


def peak_cuts(similarity: np.ndarray, weights: np.ndarray, k: int) -> list[list[int]]:
    """Parts around the k bands of the best ``peak_scores``: coarse cuts, then sweeps that move each cut between its neighbours,
    until the cuts rest or are some that were met before.
    """
    n = len(similarity)
    check_count(k, 1, n)
    weights = np.abs(weights)
    score = peak_scores(similarity)
    peaks = np.sort(np.argsort(-np.nan_to_num(score, nan=-np.inf), kind="stable")[:k]).tolist()
    cuts = coarse_cuts(weights, peaks)
    met = set()
    while tuple(cuts) not in met:
        met.add(tuple(cuts))
        for p in range(1, len(cuts) - 2):
            if peaks[p] - peaks[p - 1] > 1:
                options = range(max(cuts[p - 1] + 2, peaks[p - 1] + 1), min(peaks[p] + 1, cuts[p + 1] - 1))
                moved = _split_costs(weights, cuts[p - 1], cuts[p + 1], options)
                cuts[p] = cuts[p] if moved is None else moved
    return parts(cuts)


def ward_clusters(distance: np.ndarray, k: int) -> list[list[int]]:
    """k clusters by Ward linkage, each in band order, by their first band."""
    n = len(distance)
    check_count(k, 1, n - 1)
    square = distance.astype(np.float64) ** 2
    np.fill_diagonal(square, np.inf)
    size, members = np.ones(n), {b: [b] for b in range(n)}
    while len(members) > k:
        u, v = divmod(int(square.argmin()), n)
        others = [w for w in members if w not in (u, v)]
        total = size[u] + size[v] + size[others]
        merged = ((size[u] + size[others]) * square[u, others] + (size[v] + size[others]) * square[v, others] - size[others] * square[u, v]) / total
        square[u, others] = square[others, u] = merged
        square[v, :] = square[:, v] = np.inf
        size[u] += size[v]
        members[u] = members[u] + members.pop(v)
    return sorted(sorted(m) for m in members.values())


# ---- selection ------------------------------------------------------------------------------------------------------


def _determinant(cov: np.ndarray, chosen: list[int]) -> float:
    return abs(float(np.linalg.det(cov[np.ix_(chosen, chosen)])))


def max_determinant(cov: np.ndarray, chosen: list[int], options: list[list[int]]) -> list[int]:
    """Swaps, slot by slot, to the band that makes the determinant of the covariance greatest, for at most ten sweeps.

    With the other slots fixed, the determinant is a constant times the variance that they leave of a band, so one solve
    rates all bands of a slot.
    """
    chosen = list(chosen)
    for _ in range(10):
        old = new = _determinant(cov, chosen)
        for slot, bands in enumerate(options):
            others = chosen[:slot] + chosen[slot + 1 :]
            bands = [b for b in bands if b not in others]
            left = np.diag(cov)[bands]
            if others:
                cross = cov[np.ix_(others, bands)]
                left = left - (cross * np.linalg.lstsq(cov[np.ix_(others, others)], cross, rcond=None)[0]).sum(axis=0)
            best = chosen[:slot] + [bands[int(left.argmax())]] + chosen[slot + 1 :]
            if best != chosen and (found := _determinant(cov, best)) > new:
                chosen, new = best, found
        if abs(new - old) / abs(old + 1e-10) < 1e-6:
            break
    return chosen


def mcd(cov: np.ndarray, k: int, subsets: list[list[int]] | None = None) -> list[int]:
    """Maximum determinant from a start drawn by seed 42; with subsets, one band of each, in band order."""
    bands = len(cov)
    random = np.random.RandomState(42)
    if subsets is None:
        start = np.sort(random.choice(bands, k, replace=False)).tolist()
        return max_determinant(cov, start, [list(range(bands))] * k)
    if len(subsets) != k or not all(subsets):
        raise ValueError("needs a non-empty subset for each band")
    start = [int(random.choice(s, size=1)[0]) for s in subsets]
    return sorted(max_determinant(cov, start, subsets))


def self_representation(gram: np.ndarray, variance: np.ndarray, k: int, subsets: list[list[int]] | None = None) -> list[int]:
    """Greedy choice of the bands that leave the least of all bands unexplained; the first has the greatest variance.

    What is left is kept as a matrix that each choice lowers by rank one. With subsets, a choice closes its subset.
    """
    left = gram.astype(np.float64).copy()
    owner = {b: s for s, bands in enumerate(subsets or []) for b in bands}
    open_ = set(range(len(gram)))
    scale = float(np.diag(gram).max()) if len(gram) else 1.0
    chosen: list[int] = []
    while len(chosen) < k and open_:
        bands = np.array(sorted(open_))
        if not chosen:
            pick = int(bands[variance[bands].argmax()])
        else:
            own = np.diag(left)[bands]
            gain = np.where(own > 1e-12 * scale, (left[:, bands] ** 2).sum(axis=0) / np.where(own > 1e-12 * scale, own, 1.0), -np.inf)
            if not np.isfinite(gain).any():
                raise ValueError("the bands that are left are combinations of those chosen")
            pick = int(bands[gain.argmax()])
        chosen.append(pick)
        if left[pick, pick] > 0:
            left -= np.outer(left[:, pick], left[pick]) / left[pick, pick]
        open_ -= set(subsets[owner[pick]]) if subsets and pick in owner else {pick}
    return chosen


# ---- dependence -----------------------------------------------------------------------------------------------------


def digamma(n: np.ndarray) -> np.ndarray:
    """Digamma of positive whole numbers."""
    table = np.concatenate(([0.0, -EULER_GAMMA], -EULER_GAMMA + np.cumsum(1 / np.arange(1.0, max(2, int(np.max(n)))))))
    return table[n]


def _gaps(values: tuple[np.ndarray, ...], seed: int) -> Iterator[np.ndarray]:
    """Distances of all rows in each value, scaled to unit deviation, with a little noise that tells ties apart."""
    random = np.random.RandomState(seed)
    for v in values:
        std = v.std()
        v = v / std if std > 0 else v
        v = v + 1e-10 * max(1.0, np.abs(v).mean()) * random.standard_normal(len(v))
        yield np.abs(v[:, None] - v[None, :])


def ksg(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 0) -> float:
    """Mutual information in nats by k nearest neighbours (Kraskov et al. 2004, first estimator), at least 0."""
    n = len(x)
    dx, dy = _gaps((x, y), seed)
    joint = np.maximum(dx, dy)
    np.fill_diagonal(joint, np.inf)
    radius = np.nextafter(np.partition(joint, k - 1, axis=1)[:, k - 1], 0)[:, None]
    nx, ny = ((d <= radius).sum(axis=1) - 1 for d in (dx, dy))
    value = digamma(np.array([n]))[0] + digamma(np.array([k]))[0] - digamma(nx + 1).mean() - digamma(ny + 1).mean()
    return max(0.0, float(value))


def conditional_ksg(x: np.ndarray, y: np.ndarray, z: np.ndarray, k: int = 3, seed: int = 0) -> float:
    """Information of x and y given z in nats, at least 0, by k nearest neighbours in all three together (Frenzel and Pompe 2007).

    The distance to the k-th of them bounds the neighbours that are counted in (x, z), in (y, z) and in z.
    """
    if len(x) <= k:
        return 0.0
    dx, dy, dz = _gaps((x, y, z), seed)
    joint = np.maximum(np.maximum(dx, dy), dz)
    np.fill_diagonal(joint, np.inf)
    radius = np.partition(joint, k - 1, axis=1)[:, k - 1][:, None]
    near_x, near_y, near_z = dx < radius, dy < radius, dz < radius  # each with the row itself
    nxz, nyz, nz = (v.sum(axis=1) for v in (near_x & near_z, near_y & near_z, near_z))
    return max(0.0, float(digamma(np.array([k]))[0] - (digamma(nxz) + digamma(nyz) - digamma(nz)).mean()))


def _equal_rows(v: np.ndarray, bins: int) -> np.ndarray:
    """Row of each value when values, ties together, are dealt by rank to rows of equal size."""
    order = np.argsort(v, kind="stable")
    s = v[order]
    edges = np.flatnonzero(np.diff(s)) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(v)]))
    out, row, held, target = np.empty(len(v), np.int64), 0, 0, len(v) / bins
    for a, b in zip(starts.tolist(), ends.tolist()):
        if held and abs(held + b - a - target) >= abs(held - target):
            row, held = row + 1, 0
            target = (len(v) - a) / max(bins - row, 1)
        out[order[a:b]] = row
        held += b - a
    return out


def _clumps(x: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Ends of runs along x that a grid doesn't need to cut, joined into at most ``most``."""
    n = len(x)
    first = np.concatenate(([True], x[1:] != x[:-1]))
    group = np.cumsum(first) - 1
    low = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    high = np.full(group[-1] + 1, -1)
    np.minimum.at(low, group, rows)
    np.maximum.at(high, group, rows)
    row = np.where(low == high, low, -1 - np.arange(len(low)))
    ends = np.concatenate((np.flatnonzero(first)[1:], [n]))
    ends = ends[np.concatenate((row[1:] != row[:-1], [True]))]
    if len(ends) > most:
        label = np.searchsorted(ends, np.arange(n), side="right")
        super_ = _equal_rows(label.astype(float), most)
        ends = np.concatenate((np.flatnonzero(np.diff(super_)) + 1, [n]))
    return ends


def _grid_information(x: np.ndarray, y: np.ndarray, size: float, clumps: int) -> dict[tuple[int, int], float]:
    """Best mutual information (nats) by (columns, rows), rows of equal size, columns optimal."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n, out = len(x), {}
    counts = np.arange(n + 1.0)
    weighted = counts * np.log(np.maximum(counts, 1))  # c log c of every count that a cell can have
    for r in range(2, int(size // 2) + 1):
        columns = int(size // r)
        if columns < 2:
            break
        rows = _equal_rows(y, r)
        count = int(rows.max()) + 1
        ends = _clumps(x, rows, clumps * columns)
        m = len(ends)
        cum = np.zeros((m + 1, count), np.int64)
        cum[1:] = np.cumsum(np.eye(count, dtype=np.int64)[rows], axis=0)[ends - 1]
        total = cum.sum(axis=1)
        # counts below the diagonal are negative and index from the end; those entries are masked
        inner = -weighted[total[None, :] - total[:, None]]
        for of_row in cum.T:
            inner += weighted[of_row[None, :] - of_row[:, None]]
        cost = np.where(np.arange(m + 1)[:, None] < np.arange(m + 1)[None, :], inner / n, -np.inf)  # minus the entropy of rows given the column
        p = cum[-1] / n
        own = -(p[p > 0] * np.log(p[p > 0])).sum()
        best, sums = cost[0].copy(), np.empty_like(cost)
        for c in range(2, columns + 1):
            best = np.maximum(best, np.add(best[:, None], cost, out=sums).max(axis=0))
            out[c, r] = max(own + best[-1], 0.0)
    return out


def mic(x: np.ndarray, y: np.ndarray, alpha: float = 0.6, clumps: int = 20) -> float:
    """Maximal information coefficient (Reshef et al. 2011) with grids of fewer than n^alpha cells."""
    size = max(len(x) ** alpha, 4.0)
    found = [v / np.log(min(c, r)) for a, b in ((x, y), (y, x)) for (c, r), v in _grid_information(a, b, size, clumps).items()]
    return float(min(1.0, max(found, default=0.0)))
