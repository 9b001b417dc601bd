"""Events near the dips that are put into one series in many trials, worked out around each dip only.

A trial's filters are linear or medians, so its level and noise at a place depend on readings within reach of it: the trend's change is summed over the dip's readings, and medians are taken
over the places that windows near the dip can hold. A stretch of calm readings on either side of these makes sure that nothing beyond has a part in them; where there is none, more places are taken.
Where the noise may be at its least value, which belongs to the whole series, the trial is smoothed as a whole.
"""

from __future__ import annotations

import math

import numpy as np

from ..config import Config
from . import series as se
from .events import Event, windows_of
from .kernels import local_medians, measure

#: Places on either side of a dip's neighbourhood that are looked at first, and items of a batch.
PAD, ITEMS = 12, 1 << 18


class Dips:
    """One whole series and its trials: dips at t0 that fall by depth within ingress and recover within egress."""

    def __init__(self, time: np.ndarray, flux: np.ndarray, err: np.ndarray, cadence: float | None, t0: np.ndarray, depth: np.ndarray, ingress: float, egress: float, tolerance: float, c: Config, detrend: str) -> None:
        self.time, self.flux, self.err, self.cadence, self.c, self.detrend, self.tolerance = time, flux, err, cadence, c, detrend, tolerance
        self.t0, self.depth, self.n = t0, depth, len(time)
        self.smoother = se._Smoother(c, detrend)
        self.w_trend, self.w_base, self.w_noise = self.smoother._sizes(self.n, cadence)
        self.base = self.smoother(time, flux, self.n, cadence, (True, True), None)
        self.first, last = np.searchsorted(time, t0 - ingress, "left"), np.searchsorted(time, t0 + egress, "right")
        self.count = last - self.first
        most = max(int(self.count.max(initial=0)), 1)
        self.cols = np.minimum(self.first[:, None] + np.arange(most), self.n - 1)
        self.valid = np.arange(most) < self.count[:, None]
        dt = time[self.cols] - t0[:, None]
        self.new = flux[self.cols] - np.where(self.valid, np.maximum(depth[:, None] * (1 - np.where(dt <= 0, -dt / ingress, dt / egress)), 0.0), 0.0)
        #: Trials whose series has to be smoothed as a whole.
        self.whole = np.full(len(t0), detrend == "spline")
        self.wholes: dict[int, dict[str, np.ndarray]] = {}
        if detrend != "spline":
            self._clip()
            self._moments()
            self._least()

    def _clip(self) -> None:
        """The dips' readings as the trend sees them, and how far it sees the clipped ones elsewhere change."""
        n, flux = self.n, self.flux
        self.others: dict[int, np.ndarray] = {}  # what the trend sees elsewhere, where other readings are clipped than before
        self.shift, self.clipped = np.zeros(len(self.t0)), np.zeros(n, bool)
        self.delta = np.where(self.valid, self.new - flux[self.cols], 0.0)
        if self.detrend == "none":
            return
        order = np.argsort(flux, kind="stable")
        ordered, rank = flux[order], np.empty(n, np.int64)
        rank[order] = np.arange(n)
        mid0 = float(np.median(flux))
        apart0 = np.sort(np.abs(flux - mid0))
        mad0 = float(np.median(apart0))
        scale, low, high = self.smoother.clip * se.MAD_TO_SIGMA, (n - 1) // 2, n // 2
        self.clipped = (mad0 > 0) & (flux > mid0 + scale * mad0)
        # no value rises, so the middle ones are among those at most as many ranks lower as a dip has readings
        d = self.new.shape[1]
        ranks = np.arange(max(low - d, 0), high + 1)
        old = np.where(self.valid, rank[self.cols], -1)
        there = np.repeat(ordered[ranks][None], len(self.t0), axis=0)
        r, k = np.nonzero((old >= ranks[0]) & (old <= ranks[-1]))
        there[r, old[r, k] - ranks[0]] = np.inf
        below = ranks[0] - ((old >= 0) & (old < ranks[0])).sum(axis=1) + (self.valid & (self.new < ordered[ranks[0]])).sum(axis=1)
        values = np.sort(np.concatenate([there, np.where(self.valid & ~(self.new < ordered[ranks[0]]), self.new, np.inf)], axis=1), axis=1)
        every = np.arange(len(self.t0))
        mid = (values[every, low - below] + values[every, high - below]) / 2
        self.shift = mid - mid0
        # the deviation's bounds; it is worked out where a reading lies between the limits that they give
        least = apart0[np.maximum(low - self.count, 0)] - np.abs(self.shift)
        most = np.where(high + self.count < n, apart0[np.minimum(high + self.count, n - 1)] + np.abs(self.shift), np.inf)
        lower, upper = mid + scale * least, mid + scale * most
        open_ = (least <= 0) | (np.searchsorted(ordered, upper, "right") > np.searchsorted(ordered, lower, "left")) | (self.valid & (self.new >= lower[:, None]) & (self.new <= upper[:, None])).any(axis=1)
        open_ &= self.count > 0
        limit = (lower + upper) / 2
        limit[~np.isfinite(limit)] = np.inf
        for r in np.flatnonzero(open_):
            x = flux.copy()
            x[self.first[r] : self.first[r] + self.count[r]] = self.new[r, : self.count[r]]
            mad = float(np.median(np.abs(x - mid[r])))
            limit[r] = mid[r] + scale * mad if mad > 0 else np.inf
            other = (flux > limit[r]) != self.clipped
            other[self.first[r] : self.first[r] + self.count[r]] = False
            if other.any():
                self.others[r] = np.where(other, np.where(flux > limit[r], mid[r] - flux, flux - mid[r]), 0.0)
        clean0 = np.where(self.clipped, mid0, flux)
        clean = np.where(self.new > limit[:, None], mid[:, None], self.new)
        self.delta = np.where(self.valid, clean - clean0[self.cols] - self.clipped[self.cols] * self.shift[:, None], 0.0)

    def _moments(self) -> None:
        """Sums of the dips' readings by powers of their place, from which the trend's change follows anywhere."""
        size, order = self.w_trend, self.smoother.order
        self.trended = self.detrend == "savgol" and size > order
        self.change = np.zeros(len(self.t0))
        if not self.trended:
            return
        self.half = half = size // 2
        basis = np.vander(np.arange(-half, half + 1) / max(half, 1), order + 1, increasing=True)
        inner = np.linalg.inv(basis.T @ basis)
        p = np.arange(self.n)
        self.begin = np.clip(p - half, 0, self.n - size)
        powers = basis[p - self.begin] @ inner  # by place and power of the distance from its window's middle
        self.powers = np.ascontiguousarray(powers.T)
        self.by_shift = se.savgol(self.clipped.astype(float), size, order, True, True) if self.clipped.any() else None
        u = np.arange(self.new.shape[1]) / max(half, 1)
        self.sums = [np.concatenate([np.zeros((len(self.t0), 1)), np.cumsum(self.delta * u**k, axis=1)], axis=1) for k in range(order + 1)]
        # no trend changes by more, by the largest weight
        weights = max(float(np.abs(basis[k] @ inner @ basis.T).max()) for k in {0, half, size - 1})
        self.change = weights * np.abs(self.delta).sum(axis=1) + (0 if self.by_shift is None else np.abs(self.by_shift).max() * np.abs(self.shift))
        for r, x in self.others.items():
            self.others[r] = se.savgol(x, size, order, True, True)
            self.change[r] += np.abs(self.others[r]).max()

    def _least(self) -> None:
        """A value that the least noise of a trial doesn't exceed."""
        apart, level = np.sort(np.abs(self.base["flux"] - self.base["baseline"])), float(np.abs(self.base["baseline"]).max())
        trend = float(np.abs(self.base["trend"]).min())
        # all flattened readings, and so their medians, grow or shrink by less than this share, and those of the dip fall by less than that besides
        with np.errstate(all="ignore"):
            share = np.where(self.change < trend / 2, self.change / (trend - self.change), np.inf)
            fall = self.depth / trend * (1 + share)
        met, bound = self.n // 2 + self.count + self.w_base, lambda k: apart[k] * (1 + share) + 2 * share * level
        with np.errstate(all="ignore"):
            most = np.minimum(bound(self.n // 2) + 2 * fall * (1 + share), np.where(met < self.n, bound(np.minimum(met, self.n - 1)), np.inf))
        self.smallest = se.MAD_TO_SIGMA * 1e-3 * most
        self.whole |= ~np.isfinite(self.smallest)
        # how far min_consecutive readings are from being significant together: more than a dip may move them, or the noise about them
        c, floor = self.c.candidates, max(se.MAD_TO_SIGMA * float(np.median(apart)) * 1e-3, float(np.finfo(float).tiny))
        usable = ~self.whole & (self.count > 0)
        top, m = float(share[usable].max(initial=0.0)), max(c.min_consecutive, 1)
        noise, below = np.where(self.base["sigma"] > floor, self.base["sigma"], 0.0), self.base["baseline"] - self.base["flux"]
        room = c.sigma_threshold * noise * (1 - top) - below * np.where(below > 0, 1 + top, 1 - top)
        with np.errstate(all="ignore"):
            self.moved = np.where(usable, (1 + c.sigma_threshold * se.MAD_TO_SIGMA) * (fall + 2 * share * level), np.inf)
        self.room = np.lib.stride_tricks.sliding_window_view(room, m).max(axis=1) if self.n >= m else np.zeros(0)

    def _flat(self, trial: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
        """The flattened flux of trials (one a row) at `width` places from begin on, which is no less than -width; beyond the series, anything finite."""

        def rows(v: np.ndarray) -> np.ndarray:
            v = np.concatenate([np.full(width, v[0]), v, np.full(width, v[-1])])
            return np.ndarray((len(v) - width + 1, width), v.dtype, v, strides=(v.itemsize, v.itemsize))[begin + width]

        first, most = self.first[trial], self.new.shape[1]
        x = rows(self.flux)
        k, j = np.nonzero(self.valid[trial])
        place = first[k] + j - begin[k]
        inside = (place >= 0) & (place < width)
        x[k[inside], place[inside]] = self.new[trial[k[inside]], j[inside]]
        if not self.trended:
            return x
        start, half = rows(self.begin) - first[:, None], max(self.half, 1)
        change = self._change([m[trial, -1][:, None] for m in self.sums], (start + self.half) / half, [rows(v) for v in self.powers])
        part = np.flatnonzero((start[:, -1] > 0) | (start[:, 0] + self.w_trend < self.count[trial]))
        if len(part):  # some of the dip is beyond some windows' reach
            own, row = start[part], trial[part][:, None]
            low, high = np.clip(own, 0, most), np.clip(own + self.w_trend, 0, most)
            change[part] = self._change([m[row, high] - m[row, low] for m in self.sums], (own + self.half) / half, [rows(v)[part] for v in self.powers])
        trend = rows(self.base["trend"]) + change
        if self.by_shift is not None:
            trend += rows(self.by_shift) * self.shift[trial][:, None]
        if self.others:
            for k in np.flatnonzero(np.isin(trial, list(self.others))):
                trend[k] += self.others[int(trial[k])][np.clip(begin[k] + np.arange(width), 0, self.n - 1)]
        return x / np.where(np.abs(trend) < 1e-12, 1.0, trend)

    @staticmethod
    def _change(sums: list[np.ndarray], v: np.ndarray, powers: list[np.ndarray]) -> np.ndarray:
        """The change of the trend by sums of powers of the places of a dip, at windows whose middle is v from its first reading."""
        out = powers[0] * sums[0]
        for k in range(1, len(sums)):
            moved = sums[0] * (-v) ** k if k > 1 else sums[0] * -v
            for j in range(1, k + 1):
                moved = moved + (math.comb(k, j) * sums[j] * (-v) ** (k - j) if j < k else sums[j])
            out += powers[k] * moved
        return out

    def _smoothed(self, r: int) -> dict[str, np.ndarray]:
        """A trial smoothed as a whole."""
        if r not in self.wholes:
            x = self.flux.copy()
            x[self.first[r] : self.first[r] + self.count[r]] = self.new[r, : self.count[r]]
            self.wholes[r] = self.smoother(self.time, x, self.n, self.cadence, (True, True), None) if self.count[r] else self.base
        return self.wholes[r]

    def _zones(self) -> list[tuple[int, int, int]]:
        """(trial, first, last): the places where a minimum within the tolerance can be. A minimum is less than half its neighbours' distance from its reading."""
        t, n = self.time, self.n
        step = 0.5 * (t[np.minimum(np.arange(n) + 1, n - 1)] - t[np.maximum(np.arange(n) - 1, 0)])
        usual = 3 * (self.cadence or 0.0)
        low, high = np.searchsorted(t, self.t0 - self.tolerance - usual - 1e-9, "left"), np.searchsorted(t, self.t0 + self.tolerance + usual + 1e-9, "right") - 1
        out = [(r, a, b) for r, (a, b) in enumerate(zip(low.tolist(), high.tolist())) if a <= b]
        wide = np.flatnonzero(step > usual)
        r, k = np.nonzero(np.abs(t[wide] - self.t0[:, None]) <= self.tolerance + step[wide] + 1e-9)
        return out + [(a, b, b) for a, b in zip(r.tolist(), wide[k].tolist()) if not low[a] <= b <= high[a]]

    def _possible(self, zones: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The zones that a window may reach: without those in whose reach no readings can be a run."""
        if not zones or not len(self.room):
            return zones
        c, n, m = self.c.candidates, self.n, len(self.room)
        trial, low, high = (np.array(x) for x in zip(*zones))
        beside = c.max_gap_cadences + c.min_consecutive
        first = np.searchsorted(self.time, self.time[low] - c.max_window_days / 2, "left") - beside
        last = np.searchsorted(self.time, self.time[high] + c.max_window_days / 2, "right") + beside
        edges = np.stack([np.clip(first, 0, m - 1), np.clip(last, 1, m)], axis=1)
        least = np.minimum.reduceat(np.append(self.room, np.inf), edges.ravel())[::2]
        return [z for z, gone in zip(zones, (least > self.moved[trial]).tolist()) if not gone]

    def windows(self) -> list[tuple[int, int, int, float]]:
        """(trial, start, end, level): the windows whose deepest reading is near enough for their minimum to be within the tolerance."""
        found: dict[tuple[int, int], tuple[int, float]] = {}
        zones = self._zones()
        zones = zones if self.detrend == "spline" else self._possible(zones)
        fixed: dict[int, list[tuple[int, int]]] = {}
        pad = PAD
        while zones:
            again: list[tuple[int, int, int]] = []
            local = [z for z in zones if not self.whole[z[0]] and self.count[z[0]]]
            local.sort(key=lambda z: z[2] - z[1])
            a = 0
            while a < len(local):
                width = 2 * pad + self.w_base + self.w_noise
                b = a + 1
                while b < len(local) and (b - a + 1) * (local[b][2] - local[b][1] + width) <= ITEMS:
                    b += 1
                again += self._local(local[a:b], pad, found)
                a = b
            for r, first, last in zones:
                if self.whole[r] or not self.count[r]:
                    new = self._smoothed(r)
                    key = r if self.count[r] else -1
                    if key not in fixed:
                        fixed[key] = windows_of(self.time, (new["baseline"] - new["flux"]) / new["sigma"], self.cadence, self.c)
                    for s, e in fixed[key]:
                        if s <= last and e >= first:
                            self._keep(found, r, s, e, new["flux"][s : e + 1], new["baseline"][s : e + 1])
            zones, pad = [z for z in again], pad * 4
        return [(r, s, e, level) for (r, s), (e, level) in sorted(found.items())]

    def _keep(self, found: dict, r: int, s: int, e: int, flux: np.ndarray, base: np.ndarray) -> None:
        t, i = self.time, s + int(flux.argmin())
        step = 0.5 * (t[min(i + 1, self.n - 1)] - t[max(i - 1, 0)])
        if abs(t[i] - self.t0[r]) <= self.tolerance + step + 1e-9:
            ordered = np.sort(base)
            found[r, s] = (e, float((ordered[(len(base) - 1) // 2] + ordered[len(base) // 2]) / 2))

    def _local(self, zones: list[tuple[int, int, int]], pad: int, found: dict) -> list[tuple[int, int, int]]:
        """Adds the windows of some zones to those found; returns the zones for which more places are needed."""
        c, n = self.c.candidates, self.n
        trial, low, high = (np.array(x) for x in zip(*zones))
        h_base, h_noise = self.w_base // 2, self.w_noise // 2
        begin, width = low - pad, int((high - low).max()) + 1 + 2 * pad
        at = (begin - h_noise - h_base)[:, None] + np.arange(width + 2 * (h_noise + h_base))
        there = (at >= 0) & (at < n)
        flat = np.where(there, self._flat(trial, at[:, 0], at.shape[1]), np.inf)
        level = local_medians(flat, self.w_base, there)
        inner = slice(h_base, flat.shape[1] - h_base)
        with np.errstate(all="ignore"):
            apart = np.where(there[:, inner], np.abs(flat[:, inner] - level), np.inf)
            noise = se.MAD_TO_SIGMA * local_medians(apart, self.w_noise, there[:, inner])
            core = slice(h_noise, level.shape[1] - h_noise)
            level = level[:, core]
            flat = flat[:, h_base + h_noise : h_base + h_noise + width]
            there = there[:, h_base + h_noise : h_base + h_noise + width]
            sig = np.where(there, (level - flat) / noise, -np.inf)
        again = []
        lost = (there & ~(noise > self.smallest[trial][:, None])).any(axis=1)
        # beyond a stretch of calm readings that no run bridges there is another window
        g = c.max_gap_cadences + 1
        calm = np.lib.stride_tricks.sliding_window_view(sig <= min(c.recovery_sigma, c.sigma_threshold), g, axis=1).all(axis=2)
        left = (begin <= 0) | calm[:, : max(pad - g + 1, 0)].any(axis=1)
        right = (begin + width >= n) | (calm & (np.arange(calm.shape[1]) > (high - begin)[:, None])).any(axis=1)
        hit = sig > c.sigma_threshold
        m = max(c.min_consecutive, 1)
        some = np.lib.stride_tricks.sliding_window_view(hit, m, axis=1).all(axis=2).any(axis=1) if m <= width else np.zeros(len(zones), bool)
        for k in np.flatnonzero(lost | ~(left & right) | some).tolist():
            r, z0, z1 = zones[k]
            if lost[k]:
                self.whole[r] = True
                again.append(zones[k])
            elif not (left[k] and right[k]):
                again.append(zones[k])
            else:
                a, b = max(int(begin[k]), 0), min(int(begin[k]) + width, n)
                own = slice(a - int(begin[k]), b - int(begin[k]))
                for s, e in windows_of(self.time[a:b], sig[k, own], self.cadence, self.c, a, n):
                    if s <= z1 and e >= z0:
                        self._keep(found, r, s, e, flat[k, s - begin[k] : e + 1 - begin[k]], level[k, s - begin[k] : e + 1 - begin[k]])
        return again

    def events(self) -> list[dict]:
        """The events whose minimum is within the tolerance of their trial's dip, with the readings that their profiles are fitted to; a_dur_sigma where a trial has several."""
        wins = self.windows()
        if not wins:
            return []
        c, n = self.c, self.n
        trial, start, end = (np.array([w[k] for w in wins]) for k in range(3))
        level = np.array([w[3] for w in wins])
        pad = np.rint((end - start + 1) * c.asymmetry.search_padding_factor).astype(np.int64)
        low, high = np.maximum(start - pad, 0), np.minimum(end + pad, n - 1)
        out: list[dict] = []
        order = np.argsort(high - low, kind="stable")
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a + 1) * (high - low)[order[b]] <= ITEMS:
                b += 1
            out += self._measured(*(x[order[a:b]] for x in (trial, start, end, level, low, high)))
            a = b
        several = np.bincount([e["trial"] for e in out], minlength=1) if out else []
        for e in out:
            span = slice(e["low"], e["low"] + len(e["flat"]))
            if several[e["trial"]] > 1:
                base = np.full(len(e["flat"]), e["level"])
                e["a_dur_sigma"] = Event(self.time[span], e["flat"], self.err[span], base, e["low"], e["start"], e["end"], c).a_dur_sigma()
        return out

    def _measured(self, trial: np.ndarray, start: np.ndarray, end: np.ndarray, level: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[dict]:
        c = self.c
        at = low[:, None] + np.arange(int((high - low).max()) + 1)
        inside = at <= high[:, None]
        at = np.minimum(at, self.n - 1)
        local = ~(self.whole[trial] | (self.count[trial] == 0))
        flat = np.zeros(at.shape)
        if local.any():
            flat[local] = self._flat(trial[local], low[local], at.shape[1])
        for k in np.flatnonzero(~local):
            flat[k] = self._smoothed(int(trial[k]))["flux"][at[k]]
        flat = np.where(inside, flat, 0.0)
        m = measure(self.time[at], flat, level, (start - low, end - low), (0, high - low), c.asymmetry.half_depth_fraction, c.asymmetry.min_points_per_side)
        near = np.abs(m["t_min"] - self.t0[trial]) <= self.tolerance
        return [
            {"trial": int(trial[k]), "start": int(start[k]), "end": int(end[k]), "low": int(low[k]), "level": float(level[k]), "flat": flat[k, : high[k] - low[k] + 1], "t_min": float(m["t_min"][k]), "depth": float(m["depth"][k]), "a_dur": float(m["a_dur"][k])}
            for k in np.flatnonzero(near).tolist()
        ]
