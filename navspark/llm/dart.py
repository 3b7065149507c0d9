"""DartMinHash signatures of weighted sets, for many sets at once.

Every element of a set owns the strip from zero to its weight.  Darts fall on the plane of (element, height) in the
course of time as a Poisson process of unit rate that hashes determine, so all sets see the same darts.  A set keeps
those that hit its strips, assigns each by its hash to one of ``k`` coordinates, and takes the earliest of each.  Two
sets agree in a coordinate with a probability of their weighted Jaccard similarity.

Heights are cut into regions [0, 1), [1, 2), [2, 4), ... so that a weight's strip is a few regions; darts of the last
one above the weight miss.  Darts are thrown in order of time up to about ``k ln k + 2 k`` hits; sets with a
coordinate left empty go on for twice as long.
"""

from __future__ import annotations

import math

import numpy as np

from .common import mix64

STEP, HEIGHT, PLACE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7))


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes to numbers over 0, up to 1."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """elements: 64-bit hashes of all sets' elements after each other; sizes: elements per set; none is empty."""
    n = len(sizes)
    out, earliest = np.zeros((n, k), np.uint64), np.full((n, k), np.inf)
    row = np.repeat(np.arange(n), sizes)
    # regions of each element
    regions = np.where(weights > 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) + 1, 1)
    owner = np.repeat(np.arange(len(elements)), regions)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(regions) - regions, regions)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    wide = np.where(level > 0, low, 1.0)
    cell = mix64(elements[owner] + STEP * (level + 1).astype(np.uint64))
    top, cell_row = weights[owner], row[owner]
    total = np.bincount(row, weights, minlength=n)
    until = (k * math.log(k) + 2 * k) / total
    # the next dart of each region and its time
    dart = mix64(cell + STEP)
    time = -np.log(unit(dart)) / wide
    live = np.arange(len(cell))
    while len(live):
        due = live[time[live] <= until[cell_row[live]]]
        while len(due):
            hit = due[low[due] + wide[due] * unit(mix64(dart[due] ^ HEIGHT)) <= top[due]]
            place = (mix64(dart[hit] ^ PLACE) >> np.uint64(32)) % np.uint64(k)
            place = cell_row[hit] * k + place.astype(np.int64)
            first = time[hit] < earliest.ravel()[place]
            hit, place = hit[first], place[first]
            order = np.argsort(-time[hit], kind="stable")  # the earliest is written last
            hit, place = hit[order], place[order]
            earliest.ravel()[place], out.ravel()[place] = time[hit], dart[hit]
            dart[due] = mix64(dart[due] + STEP)
            time[due] -= np.log(unit(dart[due])) / wide[due]
            due = due[time[due] <= until[cell_row[due]]]
        empty = np.isinf(earliest).any(1)
        live = live[empty[cell_row[live]]]
        until = np.where(empty, 2 * until, until)
    return out
