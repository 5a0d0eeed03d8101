"""Patches: rectangles laid along the axis of an overlap zone.

A zone is the set of cells that two flights share.  Zones are worked on one per task, as numpy code: their cells
are bounded by the area that two flights have in common.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .footprint import Grid


def largest_component(cells: np.ndarray) -> np.ndarray:
    """The rows of cells (row, col) in the largest 8-connected component; of equal ones that with the least cell."""
    where = {tuple(c): i for i, c in enumerate(cells.tolist())}
    seen, best = set(), []
    for start in sorted(where):
        if start in seen:
            continue
        seen.add(start)
        part, todo = [], [start]
        while todo:
            r, c = todo.pop()
            part.append(where[r, c])
            for near in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if near in where and near not in seen:
                    seen.add(near)
                    todo.append(near)
        if len(part) > len(best):
            best = part
    return np.array(sorted(best), dtype=int)


def outline(cells: np.ndarray, g: Grid, tolerance: float = 0.05) -> np.ndarray:
    """The outer border of connected cells as a closed ring of map points, without points on straight lines."""
    inside = {tuple(c) for c in cells.tolist()}
    ahead = defaultdict(list)
    for r, c in inside:  # each free side of a cell, walked with the cell to the left
        for (dr, dc), a, b in (((-1, 0), (r, c + 1), (r, c)), ((1, 0), (r + 1, c), (r + 1, c + 1)), ((0, -1), (r, c), (r + 1, c)), ((0, 1), (r + 1, c + 1), (r, c + 1))):
            if (r + dr, c + dc) not in inside:
                ahead[a].append(b)
    rings = []
    while ahead:
        ring = [min(ahead)]
        step = None
        while True:
            a = ring[-1]
            out = ahead[a]
            if len(out) > 1 and step:  # where cells touch at a corner, keep to the outside
                out.sort(key=lambda b, a=a, s=step: s[0] * (b[1] - a[1]) - s[1] * (b[0] - a[0]))
            b = out.pop()
            if not out:
                del ahead[a]
            step = (b[0] - a[0], b[1] - a[1])
            ring.append(b)
            if b == ring[0]:
                break
        rings.append(np.array(ring))
    ring = max(rings, key=lambda x: abs(area(x.astype(float))))
    xy = np.column_stack([g.x0 + ring[:, 1] * g.res, g.y0 - ring[:, 0] * g.res])
    return simplify(xy, tolerance)


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Fewer points of a line, none of the left-out ones farther than the tolerance (Douglas-Peucker)."""
    keep = np.zeros(len(ring), dtype=bool)
    keep[[0, len(ring) - 1]] = True
    todo = [(0, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = ring[b] - ring[a]
        rest = ring[a + 1 : b] - ring[a]
        n = np.hypot(*d)
        off = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / n if n else np.hypot(rest[:, 0], rest[:, 1])
        i = int(off.argmax())
        if off[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return ring[keep]


def area(ring: np.ndarray) -> float:
    x, y = ring[:-1].T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def holds(ring: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether points lie in a ring or on it."""
    a, b = ring[:-1], ring[1:]
    d, e = b - a, p[:, None, :] - a[None]
    cross = d[None, :, 0] * e[..., 1] - d[None, :, 1] * e[..., 0]
    dot = (e * d[None]).sum(-1)
    on = (np.abs(cross) <= 1e-9 * np.maximum(1, np.hypot(*d.T))) & (dot >= -1e-9) & (dot <= (d * d).sum(-1) + 1e-9)
    up = (a[None, :, 1] > p[:, None, 1]) != (b[None, :, 1] > p[:, None, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = a[None, :, 0] + e[..., 1] * (d[:, 0] / d[:, 1])[None]
    return ((up & (p[:, None, 0] < x)).sum(1) % 2 == 1) | on.any(1)


def crosses(ring: np.ndarray, other: np.ndarray) -> bool:
    """Whether borders of two rings cross each other properly."""
    a, b, c, d = ring[:-1, None], ring[1:, None], other[None, :-1], other[None, 1:]
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    eps = 1e-9
    return bool(((side(a, b, c) * side(a, b, d) < -eps) & (side(c, d, a) * side(c, d, b) < -eps)).any())


def within(inner: np.ndarray, outer: np.ndarray) -> bool:
    return bool(holds(outer, inner).all()) and not crosses(inner, outer)


def intersects(a: np.ndarray, b: np.ndarray) -> bool:
    return bool(holds(b, a).any() or holds(a, b).any()) or crosses(a, b)


def rectangle(start: np.ndarray, direction: np.ndarray, length: float, width: float) -> np.ndarray:
    """Closed ring of a rectangle that runs from a start point along a direction."""
    side = np.array([-direction[1], direction[0]]) * width / 2
    end = start + length * direction
    return np.array([start + side, end + side, end - side, start - side, start + side])


def axis_of(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Start and end of the principal axis of some points, pointing right, or up."""
    if len(xy) < 2:
        return None
    mid = xy.mean(0)
    d = np.linalg.svd(xy - mid, full_matrices=False)[2][0]
    d = -d if d[0] < -1e-12 or abs(d[0]) <= 1e-12 and d[1] < 0 else d
    s = (xy - mid) @ d
    return mid + s.min() * d, mid + s.max() * d


def series(ring: np.ndarray, start: np.ndarray, end: np.ndarray, length: float, width: float, every: float, lines: int = 1, offset: float = 0.0, first_id: int = 1, search: float = 100.0) -> list[dict]:
    """Patches along an axis.  The first start, looked for every `search`, whose patch on the main line lies within the
    ring holds for all lines; patches follow every `every` up to the axis's end; those at the end of a line that lie
    outside are left out, but their numbers are used up."""
    span = float(np.hypot(*(end - start)))
    if not span:
        return []
    d = (end - start) / span
    side = np.array([-d[1], d[0]])
    begin = next((s for s in np.arange(0, span, search) if within(rectangle(start + s * d, d, length, width), ring)), None)
    if begin is None:
        return []
    out, number = [], first_id
    for k in range(lines):
        shift, line = (k - (lines - 1) / 2) * offset * side, []
        for s in np.arange(begin, span, every):
            at = start + s * d + shift
            line.append({"patch_id": number, "line": k, "ring": rectangle(at, d, length, width), "start": at, "direction": d})
            number += 1
        while line and not within(line[-1]["ring"], ring):
            line.pop()
        out += line
    return out


def longest(ring: np.ndarray, start: np.ndarray, end: np.ndarray, width: float, step: float = 20.0, shrink: float = 10.0) -> tuple[float, float]:
    """The greatest length, in steps of `shrink` below the rest of the axis, that fits at some start; (0, 0) if none."""
    span = float(np.hypot(*(end - start)))
    d = (end - start) / span if span else np.array([1.0, 0.0])
    best = (0.0, 0.0)
    for s in np.arange(0, span, step):
        size = span - s
        while size > best[0]:
            if within(rectangle(start + s * d, d, size, width), ring):
                best = (float(size), float(s))
                break
            size -= shrink
    return best


PATCHES = "patch_id int, line int, x double, y double, cx double, cy double, dx double, dy double, length double, width double, corners array<array<double>>"


def zone_patches(cells: DataFrame, g: Grid, keys: list[str], length: float, width: float, every: float, lines: int = 1, offset: float = 0.0, search: float = 100.0) -> DataFrame:
    """Patches of every zone (keys, row, col): outline of its largest component, axis, series."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c = rows[["row", "col"]].to_numpy()
        c = c[largest_component(c)]
        axis = axis_of(np.column_stack([g.x0 + (c[:, 1] + 0.5) * g.res, g.y0 - (c[:, 0] + 0.5) * g.res]))
        found = series(outline(c, g), *axis, length, width, every, lines, offset, search=search) if axis else []
        key = {k: rows[k].iloc[0] for k in keys}
        out = []
        for p in found:
            mid = p["ring"][:4].mean(0)
            out.append(key | {"patch_id": p["patch_id"], "line": p["line"], "x": p["start"][0], "y": p["start"][1], "cx": mid[0], "cy": mid[1], "dx": p["direction"][0], "dy": p["direction"][1], "length": length, "width": width, "corners": p["ring"].tolist()})
        return pd.DataFrame(out, columns=[*keys, *(f.split()[0] for f in PATCHES.split(", "))])

    schema = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys) + ", " + PATCHES
    return cells.groupBy(*keys).applyInPandas(run, schema)


def component_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of each zone's largest component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[largest_component(rows[["row", "col"]].to_numpy())]

    rows = cells.select(*keys, "row", "col")
    return rows.groupBy(*keys).applyInPandas(run, rows.schema)


def relevant_patches(patches: DataFrame, zones: DataFrame) -> DataFrame:
    """(flight, patch_id, ...) where a patch meets a zone of the flight.  zones: (fi, fj, outline array<array<double>>); one
    row per overlap, few by nature."""
    from pyspark.sql import functions as F

    per = zones.select(F.explode(F.array("fi", "fj")).alias("flight"), "outline")
    names = patches.columns

    def run(batches):
        for rows in batches:
            hit = [intersects(np.array(list(map(list, a))), np.array(list(map(list, b)))) for a, b in zip(rows["corners"], rows["outline"], strict=True)]
            yield rows[hit][["flight", *names]]

    schema = f"flight {per.schema['flight'].dataType.simpleString()}, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in patches.schema)
    return patches.crossJoin(F.broadcast(per)).select("flight", *names, "outline").mapInPandas(run, schema).dropDuplicates(["flight", "patch_id"])
