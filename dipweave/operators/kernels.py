"""Numerical kernels over arrays of one block of a series or one event: filters, splines, event geometry, profile fits, periodogram sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

#: Narrowest width of a profile, in days.
MIN_WIDTH = 1e-4


def rolling_median(x: np.ndarray, size: int) -> np.ndarray:
    """Centred running median over an odd number of readings, fewer at the ends."""
    return pd.Series(x).rolling(size, center=True, min_periods=1).median().to_numpy()


def local_medians(x: np.ndarray, size: int, there: np.ndarray) -> np.ndarray:
    """Medians of each row of x over each of its runs of `size` places, an odd number, of what is there; what isn't must be infinite. NaN where nothing is.

    Runs of a group of `g` places share all but g - 1 readings on either side. What they share is sorted once, by ranks, which small integers hold; the middle of a run is among
    the middle ones of these and the others. Runs too long or too short for that take a running median.
    """
    b, w = x.shape
    p, g = w - size + 1, 8 if size < 600 else 16 if size < 2000 else 32
    if size > 8000 or size < 2 * g:
        return np.stack([rolling_median(row, size)[size // 2 : size // 2 + p] for row in np.where(there, x, np.nan)])
    groups = -(-p // g)
    kind = np.int16 if w + g < 1 << 15 else np.int32
    most = np.iinfo(kind).max
    order = np.argsort(x, axis=1)
    rank = np.full((b, groups * g + size - 1), most, kind)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(w, dtype=kind), (b, w)), 1)
    x, full = np.take_along_axis(x, order, 1), bool(there.all())
    if not full:
        sums = np.zeros((b, w + 1), np.int32)
        np.cumsum(there, axis=1, out=sums[:, 1:])
        count = np.full((b, groups * g), size, np.int32)
        count[:, :p] = sums[:, size:] - sums[:, :-size]
    out, some, t = np.empty((b, p)), max((1 << 18) // (groups * (size + 2 * g * g)), 1), size // 2
    for a in range(0, b, some):
        own = rank[a : a + some]
        k = len(own)
        rows = np.arange(a, a + k)[:, None]
        shared = np.sort(np.lib.stride_tricks.sliding_window_view(own, size - g + 1, axis=1)[:, g - 1 :: g][:, :groups], axis=2)
        others = []
        for e in range(g - 1):  # a place of a group lacks the first ones, and has as many beyond the end
            both = np.empty((k, groups, g), kind)
            both[:, :, : e + 1], both[:, :, e + 1 :] = own[:, e::g][:, :groups, None], own[:, size + e :: g][:, :groups, None]
            others.append(both)
        others = _in_order(others)
        low = _least_of(g, [shared[:, :, t - g + 1 + i, None] for i in range(g)], others).reshape(k, -1)
        n = size if full else count[a : a + some]
        part = None if full else (n != size).reshape(k, groups, g).any(axis=2)
        if full or not part.any():
            out[a : a + k] = x[rows, low[:, :p]]
            continue
        few = n.reshape(k, groups, g)[part]  # where readings are missing the middle is elsewhere, and may be two
        m = len(few)
        padded = np.concatenate([np.full((m, g - 1), -1, kind), shared[part], np.full((m, g + 1), most, kind)], axis=1)
        first, others = np.maximum(few - 1, 0) // 2, [v[part] for v in others]
        near = [padded[np.arange(m)[:, None], first + i] for i in range(g + 1)]
        one, two = _least_of(g, near[:g], others), _least_of(g + 1, near, others)
        high = low.copy()
        low.reshape(k, groups, g)[part] = np.where(few > 0, one, 0)
        high.reshape(k, groups, g)[part] = np.where(few > 0, np.where(few % 2 == 0, two, one), 0)
        out[a : a + k] = np.where(n[:, :p] > 0, (x[rows, low[:, :p]] + x[rows, high[:, :p]]) / 2, np.nan)
    return out


def _in_order(x: list[np.ndarray]) -> list[np.ndarray]:
    """The least of some arrays place by place, the next, and so on: a network of exchanges (Batcher)."""
    x, n = list(x), len(x)
    top = p = 1 << max((n - 1).bit_length() - 1, 0)
    while p:
        q, r, d = top, 0, p
        while True:
            for i in range(n - d):
                if i & p == r:
                    x[i], x[i + d] = np.minimum(x[i], x[i + d]), np.maximum(x[i], x[i + d])
            if q == p:
                break
            d, q, r = q - p, q >> 1, p
        p >>= 1
    return x


def _least_of(k: int, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The k-th least of two lists of arrays, each in order, place by place; k is the length of a and more than that of b."""
    out = a[k - 1]
    for i in range(max(k - len(b), 1), k):
        out = np.minimum(out, np.maximum(a[i - 1], b[k - i - 1]))
    return out


def spans(at: np.ndarray, apart: int) -> list[tuple[int, int]]:
    """Places in order as ranges (first, last + 1); places at most `apart` from one another share one."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > apart)
    return [(int(a), int(b) + 1) for a, b in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)])]


def medians_again(x: np.ndarray, x0: np.ndarray, medians: np.ndarray, size: int) -> np.ndarray:
    """rolling_median of each row of x, where that of x0 is known: worked out only within reach of readings that differ from x0. Missing readings keep the pieces apart, as they aren't counted."""
    half, n, out = size // 2, len(x0), np.repeat(medians[None], len(x), axis=0)
    pieces, places = [], []
    for r, row in enumerate(x):
        for a, b in spans(np.flatnonzero(row != x0), 2 * half):
            a, b = max(a - half, 0), min(b + half, n)
            first = max(a - half, 0)
            pieces += [row[first : min(b + half, n)], np.full(half, np.nan)]
            places.append((r, a, b, a - first))
    if pieces:
        new, at = rolling_median(np.concatenate(pieces), size), 0
        for (r, a, b, skip), piece in zip(places, pieces[::2]):
            out[r, a:b] = new[at + skip : at + skip + b - a]
            at += len(piece) + half
    return out


def savgol_again(x: np.ndarray, x0: np.ndarray, trend: np.ndarray, size: int, order: int) -> np.ndarray:
    """savgol of each row of x, whole series, where that of x0 is `trend`: worked out only within reach of readings that differ from x0."""
    half, n, out = size // 2, len(x0), np.repeat(trend[None], len(x), axis=0)
    basis = np.vander(np.arange(-half, half + 1) / max(half, 1), order + 1, increasing=True)
    weights = np.linalg.pinv(basis)
    for r, row in enumerate(x):
        for a, b in spans(np.flatnonzero(row != x0), 2 * half):
            low, high = max(a - half, half), min(b + half, n - half)
            if low < high:
                out[r, low:high] = np.convolve(row[low - half : high + half], weights[0][::-1], "valid")
            if a < size:
                out[r, :half] = basis[:half] @ (weights @ row[:size])
            if b > n - size:
                out[r, n - half :] = basis[half + 1 :] @ (weights @ row[-size:])
    return out


def savgol(x: np.ndarray, size: int, order: int, at_start: bool, at_end: bool) -> np.ndarray:
    """Savitzky-Golay smoothing; at a true end of the series, the polynomial of the last full window. Elsewhere the first and last half windows are left as they are."""
    half = size // 2
    j = np.arange(-half, half + 1) / max(half, 1)
    basis = np.vander(j, order + 1, increasing=True)
    weights = np.linalg.pinv(basis)
    out = x.copy()
    if len(x) >= size:
        out[half : len(x) - half] = np.convolve(x, weights[0][::-1], "valid")
        if at_start:
            out[:half] = basis[:half] @ (weights @ x[:size])
        if at_end:
            out[len(x) - half :] = basis[half + 1 :] @ (weights @ x[-size:])
    return out


def spline_trend(t: np.ndarray, x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Least-squares cubic spline with the given interior knots."""
    inner = knots[(knots > t[0]) & (knots < t[-1])]
    full = np.concatenate([[t[0]] * 4, inner, [t[-1]] * 4])
    span = np.clip(np.searchsorted(full, t, "right") - 1, 3, len(full) - 5)
    values = np.zeros((len(t), 4))
    values[:, 0] = 1
    for d in range(1, 4):  # the de Boor triangle, all readings at once
        saved = np.zeros(len(t))
        for k in range(d):
            right, left = full[span + k + 1] - t, t - full[span + k + 1 - d]
            share = values[:, k] / (right + left)
            values[:, k] = saved + right * share
            saved = left * share
        values[:, d] = saved
    m, at = len(full) - 4, span - 3
    # the normal equations have four diagonals on either side of the main one at most
    band = np.zeros((4, m))
    for j in range(4):
        for k in range(j + 1):
            band[j - k] += np.bincount(at + k, values[:, j] * values[:, k], m)
    right = sum(np.bincount(at + k, values[:, k] * x, m) for k in range(4))
    band[0] += 1e-12 * max(1.0, band[0].max())  # knots without readings between them
    factors = solve_banded(band, right)
    return sum(values[:, k] * factors[at + k] for k in range(4))


def solve_banded(band: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves a symmetric positive system given by its main diagonal and those below it: band[d, j] stands at row j + d, column j."""
    reach, m = len(band) - 1, band.shape[1]
    low, y = band.copy(), right.astype(float).copy()
    for j in range(m):
        low[0, j] = math.sqrt(max(low[0, j], 1e-300))
        n = min(reach, m - 1 - j)
        low[1 : n + 1, j] /= low[0, j]
        for d in range(1, n + 1):
            low[: n + 1 - d, j + d] -= low[d, j] * low[d : n + 1, j]
        y[j] /= low[0, j]
        y[j + 1 : j + n + 1] -= low[1 : n + 1, j] * y[j]
    for j in range(m - 1, -1, -1):
        n = min(reach, m - 1 - j)
        y[j] = (y[j] - low[1 : n + 1, j] @ y[j + 1 : j + n + 1]) / low[0, j]
    return y


def measure(t: np.ndarray, flux: np.ndarray, level: float | np.ndarray, window: tuple, bounds: tuple, half: float, least: int, slopes: bool = True) -> dict[str, np.ndarray]:
    """Geometry of an event in each row of flux (draws x readings): minimum, depth, and duration and slope of either side.

    Rows may be events of their own: with times, a level, a window and bounds each, the last of which is the place of the last reading. Places count within the arrays. The deepest reading of the window is refined by a parabola through its neighbours where these exist and the vertex is within a reading of
    it. A side lasts from the minimum to where the flux first regains the level less `half` the depth, between two readings by interpolation, no
    farther out than the bounds; its slope is fitted over the readings within, at least `least` of them if the bounds allow. NaN is what can't be measured. Without slopes, the rest is the same.
    """
    rows, cols = np.arange(len(flux)), np.arange(flux.shape[1])
    start, end = window
    if t.ndim == 1:
        i = start + np.argmin(flux[:, start : end + 1], axis=1)
        last_place, when = len(t) - 1, lambda k: t[k]
    else:
        i = np.argmin(np.where((cols >= start[:, None]) & (cols <= end[:, None]), flux, np.inf), axis=1)
        bounds = (bounds[0], bounds[1][:, None])
        last_place, when = bounds[1][:, 0], lambda k: t[rows, k]
    here = flux[rows, i]
    inside = (i > 0) & (i < last_place)
    before, after = flux[rows, np.maximum(i - 1, 0)], flux[rows, np.minimum(i + 1, last_place)]
    with np.errstate(all="ignore"):
        bend = before - 2 * here + after
        shift = 0.5 * (before - after) / bend
        good = inside & (bend > 0) & (np.abs(shift) < 1)
        step = 0.5 * (when(np.minimum(i + 1, last_place)) - when(np.maximum(i - 1, 0)))
        t_min = np.where(good, when(i) + shift * step, when(i))
        f_min = np.where(good, here - 0.25 * (before - after) * shift, here)
        depth = level - f_min
        target = (level - half * depth)[:, None]
        last_bound = bounds[1] if t.ndim == 1 else bounds[1][:, 0]
        out = {"index": i, "t_min": t_min, "f_min": f_min, "depth": depth}
        for side in ("ingress", "egress"):
            if side == "egress":
                found = (cols > i[:, None]) & (cols <= bounds[1]) & (flux >= target)
                j = np.argmax(found, axis=1)
                last = j - 1
                low, high = i, np.maximum(last, np.minimum(i + least - 1, last_bound))
            else:
                found = (cols < i[:, None]) & (cols >= bounds[0]) & (flux >= target)
                j = len(cols) - 1 - np.argmax(found[:, ::-1], axis=1)
                last = np.minimum(j + 1, last_place)
                low, high = np.minimum(last, np.maximum(i - least + 1, bounds[0])), i
            ok = found.any(axis=1) & (depth > 0) & (high - low + 1 >= least)
            f_in, f_out = flux[rows, last], flux[rows, j]
            t_half = np.where(f_out == f_in, when(j), when(last) + (target[:, 0] - f_in) / (f_out - f_in) * (when(j) - when(last)))
            duration = np.abs(t_min - t_half)
            if not slopes:  # a line through two readings or more has one
                out[f"{side}_duration"] = np.where(ok & (high > low) & (duration > 0), duration, np.nan)
                continue
            used = ((cols >= low[:, None]) & (cols <= high[:, None])).astype(float)
            n = used.sum(axis=1)
            x, y = (t - when(i)[:, None]) * used, flux * used
            dx = (x - (x.sum(axis=1) / n)[:, None]) * used
            dy = (y - (y.sum(axis=1) / n)[:, None]) * used
            sxx, sxy, syy = (dx * dx).sum(axis=1), (dx * dy).sum(axis=1), (dy * dy).sum(axis=1)
            slope = np.where(sxx > 0, sxy / sxx, np.nan)
            error = np.sqrt(np.maximum(syy - slope * sxy, 0) / (n - 2) / sxx)
            ok &= np.isfinite(slope) & (duration > 0)
            out |= {f"{side}_duration": np.where(ok, duration, np.nan), f"{side}_slope": np.where(ok, slope, np.nan), f"{side}_slope_err": np.where(ok, error, np.nan), f"{side}_points": np.where(ok, n, 0)}
        e, g = out["egress_duration"], out["ingress_duration"]
        if not slopes:
            return out | {"a_dur": np.where(e + g > 0, (e - g) / (e + g), 0 * (e + g))}
        s, r = np.abs(out["ingress_slope"]), np.abs(out["egress_slope"])
        out["a_dur"] = np.where(e + g > 0, (e - g) / (e + g), 0 * (e + g))
        out["a_slope"] = np.where(s + r > 0, (s - r) / (s + r), 0 * (s + r))
    return out


def dip(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Gaussian dip; p: time of the minimum, depth, width, level."""
    return p[3] - p[1] * np.exp(-0.5 * ((t - p[0]) / max(p[2], MIN_WIDTH)) ** 2)


def tailed_dip(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Gaussian fall and exponential recovery; p: time of the minimum, depth, width of the fall, time scale of the recovery, level."""
    dt = t - p[0]
    return p[4] - p[1] * np.where(dt <= 0, np.exp(-0.5 * (np.minimum(dt, 0) / max(p[2], MIN_WIDTH)) ** 2), np.exp(-np.maximum(dt, 0) / max(p[3], MIN_WIDTH)))


def bounded_fit(model, t: np.ndarray, y: np.ndarray, err: np.ndarray, start: list[float], low: list[float], high: list[float], rounds: int = 120) -> tuple[np.ndarray, float, bool]:
    """Levenberg-Marquardt within a box: parameters, chi squared, and whether it converged. A start outside the box doesn't converge."""
    p, lo, hi = (np.array(v, float) for v in (start, low, high))
    if ((p < lo) | (p > hi) | (lo >= hi)).any():
        return p, math.inf, False
    scale = np.maximum(np.abs(hi - lo), 1e-12)
    r = (model(t, p.tolist()) - y) / err
    chi, damping = float(r @ r), 1e-3
    for _ in range(rounds):
        step = np.maximum(1e-7 * scale, 1e-10)
        step = np.where(p + step > hi, -step, step)
        jacobian = np.empty((len(t), len(p)))
        for k in range(len(p)):
            q = p.copy()
            q[k] += step[k]
            jacobian[:, k] = ((model(t, q.tolist()) - y) / err - r) / step[k]
        jacobian = jacobian * scale
        gradient, normal = jacobian.T @ r, jacobian.T @ jacobian
        free = ~(((p <= lo) & (gradient > 0)) | ((p >= hi) & (gradient < 0)))
        if not free.any() or np.max(np.abs(gradient[free])) < 1e-10 * max(chi, 1e-12):
            return p, chi, True
        inner, falling, wide = (normal, -gradient, scale) if free.all() else (normal[np.ix_(free, free)], -gradient[free], scale[free])
        diagonal, m = np.maximum(inner.diagonal(), 1e-12), len(inner) + 1
        while True:
            a = inner.copy()
            a.reshape(-1)[::m] += damping * diagonal
            try:
                move = np.linalg.solve(a, falling) * wide
            except np.linalg.LinAlgError:
                return p, chi, False
            q = p.copy()
            q[free] += move
            q = np.minimum(np.maximum(q, lo), hi)
            s = (model(t, q.tolist()) - y) / err
            new = float(s @ s)
            if new < chi:
                done = chi - new < 1e-8 * chi
                p, r, chi, damping = q, s, new, max(damping / 5, 1e-12)
                if done:
                    return p, chi, True
                break
            damping *= 4
            if damping > 1e10:
                return p, chi, math.isfinite(chi)
    return p, chi, False


def compare_profiles(t: np.ndarray, y: np.ndarray, err: np.ndarray, t_min: float, depth: float, level: float, begin: float, end: float, widen: float = 0.25) -> dict[str, float]:
    """Both profiles fitted to one event over its window, widened by a part of it on either side: delta_bic (how much the tailed dip is preferred; -inf if a fit failed), tau_over_sigma and the depth of the tailed dip; NaN with fewer than 8 readings."""
    span = max(end - begin, 1e-6)
    lo, hi = begin - widen * span, end + widen * span
    within = (t >= lo) & (t <= hi)
    t, y, err = t[within], y[within], err[within]
    if len(t) < 8:
        return {"delta_bic": math.nan, "tau_over_sigma": math.nan, "fitted_depth": math.nan}
    err = np.where(err > 0, err, 1.0)
    # fixed values: where the fits start, and how far the parameters may go
    d, w = max(depth, 1e-9), max(span / 4, 10 * MIN_WIDTH)
    levels = (level - 10 * d, level + 10 * d)
    a, chi_a, ok_a = bounded_fit(dip, t, y, err, [t_min, d, w, level], [lo, 0, MIN_WIDTH, levels[0]], [hi, 10 * d, span, levels[1]])
    b, chi_b, ok_b = bounded_fit(tailed_dip, t, y, err, [t_min, d, w, w, level], [lo, 0, MIN_WIDTH, MIN_WIDTH, levels[0]], [hi, 10 * d, span, 10 * span, levels[1]])
    delta = chi_a + 4 * math.log(len(t)) - chi_b - 5 * math.log(len(t)) if ok_a and ok_b else -math.inf
    return {"delta_bic": delta if math.isfinite(delta) else -math.inf, "tau_over_sigma": float(b[3] / b[2]) if b[2] > 0 else math.nan, "fitted_depth": float(b[1]) if ok_b else math.nan}


def _dips(t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, None]:
    """dip() of each row with level 0 and depth -1, the distance from its minimum in widths, and None."""
    z = (t - p[:, :1]) * (1 / np.maximum(p[:, 2:3], MIN_WIDTH))
    return np.exp(-0.5 * z * z), z, None


def _tailed_dips(t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tailed_dip() of each row likewise, and where it falls."""
    dt = t - p[:, :1]
    falls = dt <= 0
    z = dt * np.where(falls, 1 / np.maximum(p[:, 2:3], MIN_WIDTH), 1 / np.maximum(p[:, 3:4], MIN_WIDTH))
    return np.exp(np.where(falls, -0.5 * z * z, -z)), z, falls


def bounded_fits(shape, t: np.ndarray, y: np.ndarray, err: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 120, items: int = 1 << 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bounded_fit of each row, many at once, with slopes by formula; readings with an infinite error have no part. shape: _dips or _tailed_dips. Some `items` readings are at work at a time; others take
    the places of rows that are done."""
    n, k = start.shape
    out, chi, good, every = start.astype(float), np.full(n, np.inf), np.zeros(n, bool), np.arange(k)
    waiting = np.flatnonzero(~((out < low) | (out > high) | (low >= high)).any(axis=1))
    ids, weight, all_t, all_y = waiting[:0], 1 / err, t, y
    reach = np.maximum(np.where(weight > 0, np.arange(1, t.shape[1] + 1), 0).max(axis=1, initial=0), 1)  # rows by length share no more places than the longest at work has
    places = 0
    while len(ids) or len(waiting):
        if len(waiting) and len(ids) <= places * 3 // 4:
            some = max(int(np.searchsorted((np.arange(len(ids), len(ids) + len(waiting)) + 1) * np.maximum.accumulate(reach[waiting]), items)), 64 - len(ids), 1)
            more, waiting, places = waiting[:some], waiting[some:], len(ids) + some
            wide = max(int(reach[more].max(initial=1)), t.shape[1] if len(ids) else 0)
            given = [v[more, :wide] for v in (all_t, all_y, weight)] + [v[more] for v in (out, low, high)]
            if len(ids) and wide > t.shape[1]:
                longer = lambda v: np.pad(v, ((0, 0), (0, wide - v.shape[1])))  # noqa: E731, B023
                t, y, w, g0, z0, r0 = (longer(v) for v in (t, y, w, g0, z0, r0))
                falls0 = None if falls0 is None else longer(falls0)
            size, p = np.maximum(np.abs(given[5] - given[4]), 1e-12), given[3]
            g, z, falls = shape(given[0], p)
            r = (p[:, -1:] - p[:, 1:2] * g - given[1]) * given[2]
            m = len(more)
            new = [more, *given, size, g, z, g[:, :0] if falls is None else falls, r, np.einsum("ij,ij->i", r, r), np.full(m, 1e-3), np.zeros(m, int), np.ones(m, bool), np.zeros((m, k, k)), np.zeros((m, k)), np.ones((m, k), bool)]
            if len(ids):
                new = [np.concatenate(v) for v in zip((ids, t, y, w, q, lo, hi, scale, g0, z0, g0[:, :0] if falls0 is None else falls0, r0, c, damping, count, fresh, normal, fall, free), new)]
            ids, t, y, w, q, lo, hi, scale, g, z, falls, r, c, damping, count, fresh, normal, fall, free = new
            falls = falls if falls.shape[1] else None
        stop, fine = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        f = slice(None) if fresh.all() else np.flatnonzero(fresh)
        qf, wf, zf, sf = q[f], w[f], z[f], scale[f]
        if len(qf):
            jacobian = np.empty((len(qf), k, t.shape[1]))
            gw = g[f] * wf
            deep, width = qf[:, 1:2], np.maximum(qf[:, 2:3], MIN_WIDTH)
            np.multiply(gw, -sf[:, 1:2], out=jacobian[:, 1])
            np.multiply(wf, sf[:, -1:], out=jacobian[:, k - 1])
            if k == 4:
                gz = gw * zf
                np.multiply(gz, -deep / width * sf[:, :1], out=jacobian[:, 0])
                np.multiply(gz * zf, -deep / width * sf[:, 2:3], out=jacobian[:, 2])
            else:
                left, tail = falls[f], np.maximum(qf[:, 3:4], MIN_WIDTH)
                gz = gw * zf
                np.multiply(np.where(left, gz, gw), np.where(left, -deep / width * sf[:, :1], -deep / tail * sf[:, :1]), out=jacobian[:, 0])
                np.multiply(np.where(left, gz * zf, 0.0), -deep / width * sf[:, 2:3], out=jacobian[:, 2])
                np.multiply(np.where(left, 0.0, gz), -deep / tail * sf[:, 3:4], out=jacobian[:, 3])
            gradient = (jacobian @ r[f][:, :, None])[:, :, 0]
            normal[f], fall[f] = jacobian @ jacobian.transpose(0, 2, 1), -gradient
            free[f] = ~(((qf <= lo[f]) & (gradient > 0)) | ((qf >= hi[f]) & (gradient < 0)))
            count[f] += 1
            fine[f] = np.where(free[f], np.abs(gradient), 0.0).max(axis=1) < 1e-10 * np.maximum(c[f], 1e-12)
            stop |= fine
        diagonal = normal[:, every, every]
        a = np.where(free[:, :, None] & free[:, None, :], normal, 0.0)
        a[:, every, every] = np.where(free, diagonal + damping[:, None] * np.maximum(diagonal, 1e-12), 1.0)
        right = np.where(free, fall, 0.0)
        try:
            move = np.linalg.solve(a, right[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            move = np.zeros(right.shape)
            for i in range(len(ids)):
                try:
                    move[i] = np.linalg.solve(a[i], right[i])
                except np.linalg.LinAlgError:
                    stop[i] = True
        new = np.minimum(np.maximum(q + move * scale, lo), hi)
        g1, z1, falls1 = shape(t, new)
        s = (new[:, -1:] - new[:, 1:2] * g1 - y) * w
        value = np.einsum("ij,ij->i", s, s)
        taken = ~stop & (value < c)
        close = taken & (c - value < 1e-8 * c)
        if taken.all():
            q, r, c, g, z, falls = new, s, value, g1, z1, falls1
        else:
            q[taken], r[taken], c[taken], g[taken], z[taken] = new[taken], s[taken], value[taken], g1[taken], z1[taken]
            if falls is not None:
                falls[taken] = falls1[taken]
        damping = np.where(taken, np.maximum(damping / 5, 1e-12), damping * 4)
        stuck = ~stop & ~taken & (damping > 1e10)
        fine |= close | (stuck & np.isfinite(c))
        fresh = taken
        stop |= close | stuck | (taken & (count >= rounds))
        if stop.any():
            i, own = ids[stop], ~stop
            out[i], chi[i], good[i] = q[stop], c[stop], fine[stop]
            falls = falls if falls is None else falls[own]
            ids, t, y, w, q, lo, hi, scale, r, c, g, z, damping, count, fresh, normal, fall, free = (v[own] for v in (ids, t, y, w, q, lo, hi, scale, r, c, g, z, damping, count, fresh, normal, fall, free))
        g0, z0, r0, falls0 = g, z, r, falls
    return out, chi, good


def compare_many(events: list[dict], widen: float = 0.25, items: int = 1 << 18) -> list[tuple[float, float]]:
    """(delta_bic, tau_over_sigma) of compare_profiles for events (time, flux, err, t_min, depth, level, start_time, end_time), fitted many at once."""
    out: list[tuple[float, float]] = [(math.nan, math.nan)] * len(events)
    given = []
    for k, e in enumerate(events):
        span = max(e["end_time"] - e["start_time"], 1e-6)
        lo, hi = e["start_time"] - widen * span, e["end_time"] + widen * span
        a, b = np.searchsorted(e["time"], lo, "left"), np.searchsorted(e["time"], hi, "right")
        if b - a >= 8:
            given.append((b - a, k, a, b, span, lo, hi))
    given.sort()
    done = 0
    while done < len(given):
        last = done + 1
        while last < len(given) and (last - done + 1) * given[last][0] <= items:
            last += 1
        some, done = given[done:last], last
        n = np.array([g[0] for g in some])
        t, y, err = np.zeros((len(some), n.max())), np.zeros((len(some), n.max())), np.full((len(some), n.max()), np.inf)
        for row, (m, k, a, b, *_) in enumerate(some):
            e = events[k]
            t[row, :m], y[row, :m] = e["time"][a:b], e["flux"][a:b]
            t[row, m:] = t[row, m - 1]
            own = e["err"][a:b]
            err[row, :m] = np.where(own > 0, own, 1.0)
        span, lo, hi = (np.array([g[i] for g in some]) for i in (4, 5, 6))
        t_min, depth, level = (np.array([events[g[1]][name] for g in some], float) for name in ("t_min", "depth", "level"))
        d, w, zero, least = np.maximum(depth, 1e-9), np.maximum(span / 4, 10 * MIN_WIDTH), np.zeros(len(some)), np.full(len(some), MIN_WIDTH)
        _, chi_a, ok_a = bounded_fits(_dips, t, y, err, np.stack([t_min, d, w, level], 1), np.stack([lo, zero, least, level - 10 * d], 1), np.stack([hi, 10 * d, span, level + 10 * d], 1))
        b, chi_b, ok_b = bounded_fits(_tailed_dips, t, y, err, np.stack([t_min, d, w, w, level], 1), np.stack([lo, zero, least, least, level - 10 * d], 1), np.stack([hi, 10 * d, span, 10 * span, level + 10 * d], 1))
        with np.errstate(all="ignore"):
            delta = chi_a + 4 * np.log(n) - chi_b - 5 * np.log(n)
        delta = np.where(ok_a & ok_b & np.isfinite(delta), delta, -np.inf)
        ratio = np.where(b[:, 2] > 0, b[:, 3] / np.where(b[:, 2] > 0, b[:, 2], 1.0), np.nan)
        for g, x, z in zip(some, delta.tolist(), ratio.tolist()):
            out[g[1]] = (x, z)
    return out


def periodogram_sums(t: np.ndarray, y: np.ndarray, weight: np.ndarray, low: float, step: float, count: int, width: int = 32) -> np.ndarray:
    """What a block adds to a periodogram with floating mean: for each of `count` frequencies from low by step the weighted sums of cos, sin, y cos, y sin, cos cos, cos sin.

    The phases of a frequency are those of the start of its row of `width` frequencies turned by those of its place in it, so only a few phases need a sine; double angles give the squares.
    """
    out = np.empty((6, -(-count // width) * width))
    turn = np.exp(2j * np.pi * step * np.arange(width)[:, None] * t)
    start = np.exp(2j * np.pi * low * t)
    row = np.exp(2j * np.pi * step * width * t)
    both, total = np.stack([weight, weight * y], axis=1), weight.sum()
    for a in range(0, count, width):
        z = turn * start
        single, double = z @ both, (z * z) @ weight
        out[:, a : a + width] = [single[:, 0].real, single[:, 0].imag, single[:, 1].real, single[:, 1].imag, (total + double.real) / 2, double.imag / 2]
        start = start * row
    return out[:, :count]


def best_powers(t: np.ndarray, y: np.ndarray, weight: np.ndarray, low: float, step: float, count: int, width: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The greatest power of the periodogram of each row of y, and the first place of it among the frequencies from low by step: periodogram_sums for rows that share times and weights (of sum 1)."""
    turn = np.exp(2j * np.pi * step * np.arange(width)[:, None] * t)
    start, row = np.exp(2j * np.pi * low * t), np.exp(2j * np.pi * step * width * t)
    weighted, yy = (y * weight).T, (y * y) @ weight
    power, place = np.full(len(y), -np.inf), np.zeros(len(y), np.int64)
    for a in range(0, count, width):
        z = (turn * start)[: count - a]
        single, double, one = z @ weighted, (z * z) @ weight, z @ weight
        c, s, cc, cs = one.real, one.imag, (1 + double.real) / 2, double.imag / 2
        cc, cs, ss = (cc - c * c)[:, None], (cs - c * s)[:, None], (1 - cc - s * s)[:, None]
        d = cc * ss - cs * cs
        yc, ys = single.real, single.imag
        with np.errstate(all="ignore"):
            p = np.where((d > 0) & (yy > 0), np.minimum((ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * d), 1.0), 1.0)
        k = p.argmax(axis=0)
        top = p[k, np.arange(len(y))]
        better = top > power
        power, place = np.where(better, top, power), np.where(better, a + k, place)
        start = start * row
    return power, place
