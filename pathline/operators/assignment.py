"""Boxes of two sets assigned to each other by overlap (T3), for sparse overlaps.

Only pairs that overlap at all can add to the best total. They are found by a sweep along x, so
a frame of very many boxes needs no matrix of all pairs, and fall into connected components,
which are solved one by one: shortest augmenting paths over the pairs, with potentials.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Pairs that are looked at together; so few boxes are compared without a sweep.
_TOGETHER = 1 << 18


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of boxes a and b, row by row (G1); arrays of any shape whose last axis is a box."""
    w = np.maximum(0.0, np.minimum(a[..., 2], b[..., 2]) - np.maximum(a[..., 0], b[..., 0]))
    h = np.maximum(0.0, np.minimum(a[..., 3], b[..., 3]) - np.maximum(a[..., 1], b[..., 1]))
    area = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    return w * h / (area(a) + area(b) - w * h + 1e-12)


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _overlap(a[:, None], b[None])


def overlapping(a: np.ndarray, b: np.ndarray, together: int = _TOGETHER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, IoU) of all pairs that overlap, in order of both."""
    if len(a) * len(b) <= together:
        o = iou_matrix(a, b)
        i, j = np.nonzero(o > 0)
        return i, j, o[i, j]
    by_left = np.argsort(b[:, 0], kind="stable")
    left = b[by_left, 0]
    widest = float((b[:, 2] - b[:, 0]).max())
    lo, hi = np.searchsorted(left, a[:, 0] - widest), np.searchsorted(left, a[:, 2], "right")
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    out, at = [], 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + together, "right")))
        i = np.repeat(np.arange(at, to), n[at:to])
        j = by_left[np.arange(len(i)) - np.repeat(ends[at:to] - n[at:to] - (ends[at - 1] if at else 0), n[at:to]) + np.repeat(lo[at:to], n[at:to])]
        o = _overlap(a[i], b[j])
        some = o > 0
        out.append((i[some], j[some], o[some]))
        at = to
    i, j, o = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((j, i))
    return i[order], j[order], o[order]


def components(i: np.ndarray, j: np.ndarray, n: int, m: int) -> np.ndarray:
    """The component of each pair (i of n rows, j of m columns): pairs are connected that share a row or a column."""
    row, col = np.arange(n), np.full(m, n)
    while True:
        np.minimum.at(col, j, row[i])
        new = row.copy()
        np.minimum.at(new, i, col[j])
        new = new[new]
        if (new == row).all():
            return row[i]
        row = new


def best_pairs(rows: list[list[tuple[int, float]]]) -> tuple[list[int], list[float], dict[int, float]]:
    """(column of each row or -1, potentials of rows, of columns) of the largest total gain. rows: for each the columns that it
    can have, with gains above 0; a row may stay alone.

    The potentials prove it: none is below 0, those of a pair's two sides reach its gain at least, and all
    of them add up to the total.
    """
    row_of: dict[int, int] = {}
    col_of: dict[int, int] = {}
    u, v = [0.0] * len(rows), {}
    for r, own in enumerate(rows):
        u[r] = max((g - v.get(c, 0.0) for c, g in own), default=0.0)
        u[r] = max(u[r], 0.0)
        # least loss against the potentials on the way from r to each row and column
        row_loss, col_loss, came = {r: 0.0}, {}, {}
        queue, end = [(0.0, r, True)], None
        while queue:
            d, k, is_row = heapq.heappop(queue)
            if is_row:
                if d > row_loss[k]:
                    continue
                if end is not None and d >= end[0]:
                    break
                if end is None or d + u[k] < end[0]:  # row k may stay alone
                    end = (d + u[k], k, True)
                for c, g in rows[k]:
                    loss = d + max(0.0, u[k] + v.get(c, 0.0) - g)
                    if loss < col_loss.get(c, float("inf")) and loss < end[0]:
                        col_loss[c], came[c] = loss, k
                        heapq.heappush(queue, (loss, c, False))
            else:
                if d > col_loss[k] or d >= end[0]:
                    continue
                if k not in row_of:
                    end = (d, k, False)
                elif d < row_loss.get(row_of[k], float("inf")):
                    row_loss[row_of[k]] = d
                    heapq.heappush(queue, (d, row_of[k], True))
        far, k, alone = end
        for x, d in row_loss.items():
            if d < far:
                u[x] = max(0.0, u[x] - (far - d))
        for c, d in col_loss.items():
            if d < far:
                v[c] = v.get(c, 0.0) + far - d
        c = None if alone else k
        k = k if alone else came[k]
        while True:  # back along the path: each row hands its column on
            before = col_of.pop(k, None)
            if c is not None:
                row_of[c], col_of[k] = k, c
            elif before is not None:
                del row_of[before]
            if k == r:
                break
            c, k = before, came[before]
    return [col_of.get(r, -1) for r in range(len(rows))], u, v


def solved(i: np.ndarray, j: np.ndarray, gain: np.ndarray, n: int, m: int) -> list[tuple[int, int]]:
    """Pairs of the largest total gain, each row and column used once at most, in order of rows."""
    part = components(i, j, n, m)
    order = np.argsort(part, kind="stable")
    out = []
    for k in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
        if len(k) == 1:
            out.append((int(i[k[0]]), int(j[k[0]])))
            continue
        names, at = np.unique(i[k], return_inverse=True)
        rows: list[list[tuple[int, float]]] = [[] for _ in names]
        for r, c, g in zip(at.tolist(), j[k].tolist(), gain[k].tolist(), strict=True):
            rows[r].append((c, g))
        column, _, _ = best_pairs(rows)
        out += [(int(r), c) for r, c in zip(names, column, strict=True) if c >= 0]
    return sorted(out)


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest total gain of a matrix; what gains nothing stays alone."""
    i, j = np.nonzero(gain > 0)
    return solved(i, j, gain[i, j], *gain.shape)


def associate(dets: np.ndarray, tracks: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Matched (detection, track). Where no box has two partners above the threshold they are taken as they are;
    else the best total overlap decides, and pairs below the threshold fall out (one equal to it stays)."""
    if not len(dets) or not len(tracks):
        return []
    i, j, overlap = overlapping(dets, tracks)
    above = overlap > threshold
    a, b = i[above], j[above]
    if len(a) and len(np.unique(a)) == len(np.unique(b)) == len(a):
        return list(zip(a.tolist(), b.tolist(), strict=True))
    at = {(d, t): o for d, t, o in zip(i.tolist(), j.tolist(), overlap.tolist(), strict=True)}
    return [p for p in solved(i, j, overlap, len(dets), len(tracks)) if at[p] >= threshold]
