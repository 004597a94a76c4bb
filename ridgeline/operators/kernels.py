"""Array kernels that run inside a task on one block and its halo.

Each function takes an array whose NODATA is NaN and returns a smaller one:
the border that lacks neighbours inside the array is cut off.
"""

from __future__ import annotations

import math

import numpy as np


def _slide(op, a, n, axis):
    """Combine the 2n+1 shifted copies of ``a`` along one axis."""
    size = a.shape[axis] - 2 * n
    take = lambda k: a[k : k + size] if axis == 0 else a[:, k : k + size]
    out = take(0).copy()
    for k in range(1, 2 * n + 1):
        op(out, take(k), out=out)
    return out


def square_stats(a, n):
    """Minimum, maximum, sum and count over the (2n+1)^2 square."""
    known = ~np.isnan(a)
    both = lambda op, x: _slide(op, _slide(op, x, n, 1), n, 0)
    return {
        "vmin": both(np.fmin, a),
        "vmax": both(np.fmax, a),
        "vsum": both(np.add, np.where(known, a, 0.0)),
        "vcount": both(np.add, known.astype(np.float64)),
    }


def square_mean(a, n):
    s = square_stats_sum(a, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(s[1] > 0, s[0] / s[1], np.nan)


def square_stats_sum(a, n):
    known = ~np.isnan(a)
    both = lambda x: _slide(np.add, _slide(np.add, x, n, 1), n, 0)
    return both(np.where(known, a, 0.0)), both(known.astype(np.float64))


def disc_widths(radius):
    """Half width of the disc's run in each row offset, keyed by offset."""
    reach = int(math.floor(radius))
    widths = {}
    for dy in range(-reach, reach + 1):
        w = int(math.isqrt(max(0, int(math.floor(radius * radius - dy * dy + 1e-9)))))
        widths[dy] = w
    return widths


def disc_sum(a, radius):
    """Sum and count over cells with dx^2 + dy^2 <= radius^2."""
    known = ~np.isnan(a)
    reach = int(math.floor(radius))
    rows, cols = a.shape[0] - 2 * reach, a.shape[1] - 2 * reach
    total = np.zeros((rows, cols))
    count = np.zeros((rows, cols))
    filled = np.where(known, a, 0.0)
    run = lambda x: np.concatenate([np.zeros((x.shape[0], 1)), np.cumsum(x, axis=1)], axis=1)
    values, counts = run(filled), run(known.astype(np.float64))
    for dy, w in disc_widths(radius).items():
        band = slice(reach + dy, reach + dy + rows)
        right = slice(reach + w + 1, reach + w + 1 + cols)
        left = slice(reach - w, reach - w + cols)
        total += values[band, right] - values[band, left]
        count += counts[band, right] - counts[band, left]
    return total, count


def horn_sums(a):
    """West-east and north-south weighted differences of the 3x3 neighbourhood.

    A missing neighbour takes the value of the centre.
    """
    c = a[1:-1, 1:-1]
    at = lambda dr, dc: a[1 + dr : a.shape[0] - 1 + dr, 1 + dc : a.shape[1] - 1 + dc]
    near = lambda dr, dc: np.where(np.isnan(at(dr, dc)), c, at(dr, dc))
    nw, n, ne = near(-1, -1), near(-1, 0), near(-1, 1)
    w, e = near(0, -1), near(0, 1)
    sw, s, se = near(1, -1), near(1, 0), near(1, 1)
    east = (ne + 2.0 * e + se) - (nw + 2.0 * w + sw)
    south = (sw + 2.0 * s + se) - (nw + 2.0 * n + ne)
    return east, south


def slope_degrees(east, south, cell_w, cell_h, z_factor):
    gx = east / (8.0 * cell_w)
    gy = south / (8.0 * cell_h)
    return np.degrees(np.arctan(z_factor * np.sqrt(gx * gx + gy * gy)))


def surface(z, cell_w, cell_h, azimuth, altitude, z_factor):
    """Slope and aspect in degrees and hillshade 0..127; needs one cell of halo."""
    east, south = horn_sums(z)
    gx, gy = east / (8.0 * cell_w), south / (8.0 * cell_h)
    az, alt = math.radians(azimuth), math.radians(altitude)
    steep = np.arctan(z_factor * np.sqrt(gx * gx + gy * gy))
    facing = np.arctan2(-gx, gy)
    degrees = np.degrees(facing)
    flat = (east == 0) & (south == 0)
    light = math.sin(alt) * np.cos(steep) + math.cos(alt) * np.sin(steep) * np.cos(az - facing)
    light = np.where(flat, math.sin(alt), light)
    return {
        "slope": np.degrees(steep),
        "aspect": np.where(flat, np.nan, np.where(degrees < 0, degrees + 360.0, degrees)),
        "hillshade": np.floor(127.0 * np.maximum(0.0, light) + 0.5),
    }


def position(z, n):
    """Both forms of topographic position and the ruggedness over the (2n+1)^2 square."""
    s = square_stats(z, n)
    known = s["vcount"] > 0
    above = s["vsum"] / s["vcount"] - s["vmin"]
    span, ratio = s["vmax"] - s["vmin"], s["vmax"] / s["vmin"]
    return {
        "tpi": np.where(known & (span != 0), above / span, np.nan),
        "tpi_ratio": np.where(known & (ratio != 0), above / ratio, np.nan),
        "ruggedness": np.sqrt(np.abs(s["vmax"] * s["vmax"] - s["vmin"] * s["vmin"])),
    }


def rings(value, marked, radii, halo):
    """Codes around marked cells; ``radii`` lists (code, radius in cells), outermost first."""
    side = (value.shape[0] - 2 * halo, value.shape[1] - 2 * halo)
    out = value[halo : halo + side[0], halo : halo + side[1]].copy()
    marks = np.where(value == marked, 1.0, 0.0)
    for code, radius in radii:
        cut = halo - int(math.floor(radius))
        near, _ = disc_sum(marks[cut : marks.shape[0] - cut, cut : marks.shape[1] - cut], radius)
        out[near > 0] = code
    return out


def label_runs(values):
    """Label 4-connected areas of equal value by their least linear index; NaN gets -1."""
    rows, cols = values.shape
    labels = np.arange(rows * cols, dtype=np.int64).reshape(rows, cols)
    known = ~np.isnan(values)
    labels[~known] = -1

    def runs(v):
        v = v.reshape(-1, v.shape[-1])
        new = np.ones(v.shape, dtype=bool)
        new[:, 1:] = ~(v[:, 1:] == v[:, :-1])
        return np.flatnonzero(new.ravel())

    across, down = runs(values), runs(np.ascontiguousarray(values.T))

    def settle(lab, starts):
        flat = np.ascontiguousarray(lab).ravel()
        least = np.minimum.reduceat(flat, starts)
        return np.repeat(least, np.diff(np.append(starts, flat.size))).reshape(lab.shape)

    while True:
        before = labels
        labels = settle(labels, across)
        labels = settle(labels.T, down).T
        if np.array_equal(before, labels):
            return labels
