"""Union, repair and cuts of polygons with holes: a segment index, the faces between segments, and what is kept of them.

A polygon is a list of rings, the outer one first, then its holes. All segments are cut where they meet; a uniform grid
says which can, so nothing of the size sides x sides is ever held: pairs come in blocks of at most BLOCK. The faces between
the cut segments are walked, boundaries of parts that lie loose in a face are its holes, an inner point of each face says
in which polygons it lies, and faces that are kept grow together over shared edges.
"""

from __future__ import annotations

import math

import numpy as np

DIGITS, BLOCK = 6, 1 << 20


def sides_of(ring, closed: bool = True) -> np.ndarray:
    p = np.asarray(ring, float).reshape(-1, 2)
    return np.hstack([p, np.roll(p, -1, 0)])[: len(p) if closed else max(0, len(p) - 1)]


def sides_of_many(p: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sides (m, 4) of many rings (corners one after another) and the ring of each."""
    if not len(p):
        return np.zeros((0, 4)), np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    after = np.arange(1, len(p) + 1)
    after[ends[1:][sizes > 0] - 1] = ends[:-1][sizes > 0]
    return np.hstack([p, p[after]]), np.repeat(np.arange(len(sizes)), sizes)


def area2(ring) -> float:
    """Twice the signed area."""
    p = np.asarray(ring, float).reshape(-1, 2)
    q = np.roll(p, -1, 0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())


def polygon_area(polygon) -> float:
    """Area of the outer ring without the holes."""
    return abs(area2(polygon[0])) / 2 - sum(abs(area2(h)) for h in polygon[1:]) / 2 if polygon else 0.0


def ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count in turn."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def grid_cells(s: np.ndarray, size: float, margin: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Segments and the grid cells that each passes, column by column: (segment, cell), cells numbered by column and row."""
    low = s.reshape(-1, 2).min(0) - 2 * margin
    flip = s[:, 0] > s[:, 2]
    ax, ay, bx, by = np.where(flip[:, None], s[:, [2, 3, 0, 1]], s).T
    c0, c1 = np.floor((ax - margin - low[0]) / size).astype(np.int64), np.floor((bx + margin - low[0]) / size).astype(np.int64)
    seg = np.repeat(np.arange(len(s)), c1 - c0 + 1)
    col = c0[seg] + ranges(c1 - c0 + 1)
    run = bx[seg] - ax[seg]
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(run > 0, (by[seg] - ay[seg]) / run, 0.0)
    left, right = (np.clip(low[0] + (col + k) * size + (2 * k - 1) * margin, ax[seg], bx[seg]) for k in (0, 1))
    steep = run <= 2 * margin
    y0, y1 = np.where(steep, ay[seg], ay[seg] + slope * (left - ax[seg])), np.where(steep, by[seg], ay[seg] + slope * (right - ax[seg]))
    lo, hi = np.minimum(y0, y1) - margin, np.maximum(y0, y1) + margin
    r0, r1 = np.floor((lo - low[1]) / size).astype(np.int64), np.floor((hi - low[1]) / size).astype(np.int64)
    n = r1 - r0 + 1
    return np.repeat(seg, n), np.repeat(col, n) * (1 << 31) + np.repeat(r0, n) + ranges(n)


def met_pairs(s: np.ndarray):
    """Blocks of pairs (i, j) of segments that share a grid cell; a pair may come twice."""
    long = np.abs(s[:, 2:] - s[:, :2]).max(1)
    extent = float(np.ptp(s.reshape(-1, 2), axis=0).max())
    size = max(float(long.mean()), extent / math.sqrt(len(s) + 1), 1e-3)
    seg, cell = grid_cells(s, size)
    order = np.lexsort((seg, cell))
    seg, cell = seg[order], cell[order]
    after = np.searchsorted(cell, cell, side="right") - np.arange(len(cell)) - 1  # entries of the cell that follow
    at = 0
    ends = np.cumsum(after)
    while at < len(seg):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        i = np.repeat(np.arange(at, to), after[at:to])
        j = i + 1 + ranges(after[at:to])
        pair = np.unique(seg[i] * len(s) + seg[j])
        yield pair // len(s), pair % len(s)
        at = to


def cut_segments(segments) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (n, 2) and undirected edges (m, 2) between them: segments (k, 4) cut where they cross or touch."""
    s = np.round(np.asarray(segments, float).reshape(-1, 4), DIGITS)
    s = s[(s[:, :2] != s[:, 2:]).any(1)]
    if not len(s):
        return np.zeros((0, 2)), np.zeros((0, 2), np.int64)
    n = np.arange(len(s))
    d = s[:, 2:] - s[:, :2]
    long = np.hypot(*d.T)
    owner, place, points = [n, n], [np.zeros(len(s)), np.ones(len(s))], [s[:, :2], s[:, 2:]]

    def add(i, t, p):
        owner.append(i)
        place.append(t)
        points.append(p)

    for i, j in met_pairs(s):
        den = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        e = s[j, :2] - s[i, :2]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (e[:, 0] * d[j, 1] - e[:, 1] * d[j, 0]) / den, (e[:, 0] * d[i, 1] - e[:, 1] * d[i, 0]) / den
        crosses = (np.abs(den) > 1e-12) & (np.minimum(t, u) > 1e-9) & (np.maximum(t, u) < 1 - 1e-9)
        ci, cj, t, u = i[crosses], j[crosses], t[crosses], u[crosses]
        node = np.round(s[ci, :2] + t[:, None] * d[ci], DIGITS)  # one point for both segments
        add(ci, t, node)
        add(cj, u, node)
        for a, b in ((i, j), (j, i)):  # ends of one that lie on the other, those of collinear ones as well
            for k in (0, 2):
                p = s[b, k : k + 2]
                q = p - s[a, :2]
                off = q[:, 0] * d[a, 1] - q[:, 1] * d[a, 0]
                at = (q * d[a]).sum(1) / long[a] ** 2
                on = (np.abs(off) <= 1e-6 * long[a]) & (at > 0) & (at < 1)
                add(a[on], at[on], p[on])
    owner, place, points = np.concatenate(owner), np.concatenate(place), np.concatenate(points)
    order = np.lexsort((place, owner))
    owner = owner[order]
    nodes, number = np.unique(points[order] + 0.0, axis=0, return_inverse=True)
    number = number.reshape(-1)
    pairs = np.stack([number[:-1], number[1:]], 1)[(owner[:-1] == owner[1:]) & (number[:-1] != number[1:])]
    return nodes, np.unique(np.sort(pairs, axis=1), axis=0)


def without_loose_ends(edges: np.ndarray, n: int) -> np.ndarray:
    near: list[set] = [set() for _ in range(n)]
    for p, q in edges.tolist():
        near[p].add(q)
        near[q].add(p)
    loose = [p for p in range(n) if len(near[p]) == 1]
    while loose:
        p = loose.pop()
        for q in near[p]:
            near[q].discard(p)
            if len(near[q]) == 1:
                loose.append(q)
        near[p] = set()
    return edges[[q in near[p] for p, q in edges.tolist()]] if len(edges) else edges


def cycles(nodes: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """The walks round all faces of a plane graph: bounded ones have positive area, outer boundaries of loose parts negative."""
    edges = without_loose_ends(edges, len(nodes))
    if not len(edges):
        return []
    start, end = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    m = len(edges)
    twin = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    way = nodes[end] - nodes[start]
    order = np.lexsort((np.arctan2(way[:, 1], way[:, 0]), start))
    first = np.searchsorted(start[order], start[order], side="left")
    last = np.searchsorted(start[order], start[order], side="right") - 1
    rank = np.empty(2 * m, np.int64)
    rank[order] = np.arange(2 * m)
    back = rank[twin]
    follow = order[np.where(back == first[back], last[back], back - 1)].tolist()  # the next edge clockwise from the way back
    seen, found, begin = bytearray(2 * m), [], start.tolist()
    for h in range(2 * m):
        ring = []
        while not seen[h]:
            seen[h] = 1
            ring.append(begin[h])
            h = follow[h]
        if ring:
            found.append(np.array(ring))
    return found


def inside_all(rings, points: np.ndarray) -> np.ndarray:
    """Whether each point lies in a polygon (rings) by the even-odd rule; sides meet points by strips of their height."""
    s = np.concatenate([sides_of(r) for r in rings]) if len(rings) else np.zeros((0, 4))
    if not len(s) or not len(points):
        return np.zeros(len(points), bool)
    lo, hi = np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 1], s[:, 3])
    base, strips = lo.min(), max(1, int(math.sqrt(len(s))))
    high = max((hi.max() - base) / strips, 1e-9)
    strip = lambda y: np.clip(np.floor((y - base) / high), 0, strips - 1).astype(np.int64)
    a, b = strip(lo), strip(hi)
    side, at = np.repeat(np.arange(len(s)), b - a + 1), np.repeat(a, b - a + 1) + ranges(b - a + 1)
    order = np.argsort(at, kind="stable")
    side, at = side[order], at[order]
    of = strip(points[:, 1])
    low, n = np.searchsorted(at, of, side="left"), np.searchsorted(at, of, side="right")
    n = n - low
    odd, begin, ends = np.zeros(len(points), np.int64), 0, np.cumsum(n)
    while begin < len(points):
        to = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BLOCK, side="right")))
        p = np.repeat(np.arange(begin, to), n[begin:to])
        t = s[side[np.repeat(low[begin:to], n[begin:to]) + ranges(n[begin:to])]]
        x, y = points[p].T
        apart = (t[:, 1] > y) != (t[:, 3] > y)
        p, t, x, y = p[apart], t[apart], x[apart], y[apart]
        odd += np.bincount(p[x < (t[:, 2] - t[:, 0]) * (y - t[:, 1]) / (t[:, 3] - t[:, 1]) + t[:, 0]], minlength=len(points))
        begin = to
    return odd % 2 == 1


def inner_point(rings) -> tuple[float, float]:
    """The middle of the widest inner stretch of a scan line between the heights of corners, near the middle of them."""
    s = np.concatenate([sides_of(r) for r in rings])
    heights = np.unique(s[:, 1])
    if len(heights) < 2:
        return float(s[:, 0].mean()), float(s[:, 1].mean())
    k = min(max(int(np.searchsorted(heights, (heights[0] + heights[-1]) / 2)), 1), len(heights) - 1)
    y = (heights[k - 1] + heights[k]) / 2
    t = s[(s[:, 1] > y) != (s[:, 3] > y)]
    x = np.sort((t[:, 2] - t[:, 0]) * (y - t[:, 1]) / (t[:, 3] - t[:, 1]) + t[:, 0])
    wide = int(np.argmax(x[1::2] - x[::2]))
    return float((x[2 * wide] + x[2 * wide + 1]) / 2), float(y)


def faces(nodes: np.ndarray, edges: np.ndarray) -> list[list[np.ndarray]]:
    """Bounded faces as lists of walks: the outer one, then the boundaries of parts that lie loose inside."""
    walks = cycles(nodes, edges)
    sizes = [area2(nodes[w]) for w in walks]
    found = [[w] for w, a in zip(walks, sizes, strict=True) if a > 1e-9]
    size = np.array([a for a in sizes if a > 1e-9])
    loose = [w for w, a in zip(walks, sizes, strict=True) if a < -1e-9]
    if len(loose) > 1:  # the smallest face about a part has it as a hole; a part's own faces lie inside its boundary
        tops = np.array([nodes[w][np.lexsort(nodes[w].T)[0]] for w in loose]) - [1e-7, 0]  # just left of the leftmost node
        boxes = np.array([[*nodes[f[0]].min(0), *nodes[f[0]].max(0)] for f in found])
        order = np.argsort(size)
        for w, (x, y) in zip(loose, tops, strict=True):
            about = order[((boxes[:, 0] <= x) & (boxes[:, 2] >= x) & (boxes[:, 1] <= y) & (boxes[:, 3] >= y))[order]]
            home = next((i for i in about if inside_all([nodes[found[i][0]]], np.array([[x, y]]))[0]), None)
            if home is not None:
                found[home].append(w)
    return found


def tidy(ring: list[tuple]) -> list[tuple]:
    """Without corners on a straight line between their neighbours."""
    p = np.asarray(ring, float)
    a, b = p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p
    keep = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 1e-9
    return [tuple(x) for x in (p[keep] if keep.sum() > 2 else p).tolist()]


def dissolved(nodes: np.ndarray, kept: list[list[np.ndarray]]) -> list[list[list[tuple]]]:
    """Polygons of faces that hang together over shared edges; edges between two of them vanish."""
    owner = {(p, q): i for i, face in enumerate(kept) for w in face for p, q in zip(w.tolist(), np.roll(w, -1).tolist(), strict=True)}
    group = list(range(len(kept)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    border: dict[int, dict[int, list[int]]] = {}
    for (p, q), i in owner.items():
        j = owner.get((q, p))
        if j is not None:
            group[root(i)] = root(j)
    for (p, q), i in owner.items():
        if (q, p) not in owner:
            border.setdefault(root(i), {}).setdefault(p, []).append(q)
    out = []
    for after in border.values():
        rings = []
        while after:
            p = min(after)
            ring, q = [p], after[p].pop()
            if not after[p]:
                del after[p]
            while q in after:
                ring.append(q)
                ways = after[q]
                at = nodes[q]
                back = math.atan2(*(nodes[ring[-2]] - at)[::-1])
                k = min(range(len(ways)), key=lambda k: (math.atan2(*(nodes[ways[k]] - at)[::-1]) - back) % math.tau or math.tau) if len(ways) > 1 else 0
                step = ways.pop(k)
                if not ways:
                    del after[q]
                q = step
            rings.append(np.array(ring))
        shells = [r for r in rings if area2(nodes[r]) > 0]
        holes = [r for r in rings if area2(nodes[r]) < 0]
        for shell in sorted(shells, key=lambda r: -area2(nodes[r])):
            own = [h for h in holes if len(shells) == 1 or inside_all([nodes[shell]], np.array([inner_point([nodes[h]])]))[0]]
            holes = [h for h in holes if not any(h is x for x in own)]
            out.append([tidy([tuple(x) for x in nodes[r].tolist()]) for r in (shell, *own)])
    return out


def overlaid(polygons: list, keep, lines: tuple = (), merge: bool = True) -> list[list[list[tuple]]]:
    """Polygons (with holes) of the faces between the sides of polygons and lines that `keep` wants; it gets a row of truth
    values for each polygon, a column for each face. Without `merge`, each face is a polygon. Largest first."""
    rings = [[r for r in p if len(r) > 2] for p in polygons]
    segments = [sides_of(r) for p in rings for r in p] + [sides_of(line, False) for line in lines]
    if not segments:
        return []
    nodes, edges = cut_segments(np.concatenate(segments))
    found = faces(nodes, edges)
    if not found:
        return []
    points = np.array([inner_point([nodes[w] for w in f]) for f in found])
    wanted = keep(np.array([inside_all(p, points) for p in rings]))
    kept = [f for f, k in zip(found, wanted, strict=True) if k]
    out = dissolved(nodes, kept) if merge else [[tidy([tuple(x) for x in nodes[w].tolist()]) for w in f] for f in kept]
    return sorted(out, key=polygon_area, reverse=True)


def inner_points(s: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places x and y of the inner points of n groups of sides (m, 4), in order of their groups; NaN for groups without two heights."""
    x, y = np.full(n, np.nan), np.full(n, np.nan)
    order = np.lexsort((s[:, 1], owner))
    own, high = owner[order], s[order, 1]
    new = np.r_[True, (own[1:] != own[:-1]) | (high[1:] != high[:-1])][: len(own)]
    own, high = own[new], high[new]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    count = np.diff(np.r_[first, len(own)])
    first, count = first[count > 1], count[count > 1]
    if not len(first):
        return x, y
    group = own[first]
    middle = np.full(n, np.nan)
    middle[group] = (high[first] + high[first + count - 1]) / 2
    k = first + np.clip(np.bincount(own, high < middle[own], minlength=n)[group].astype(np.int64), 1, count - 1)
    y[group] = (high[k - 1] + high[k]) / 2
    cross = (s[:, 1] > y[owner]) != (s[:, 3] > y[owner])
    t, own = s[cross], owner[cross]
    at = (t[:, 2] - t[:, 0]) * (y[own] - t[:, 1]) / (t[:, 3] - t[:, 1]) + t[:, 0]
    order = np.lexsort((at, own))
    at, own = at[order], own[order][::2]
    widest = np.lexsort((at[::2] - at[1::2], own))
    widest = widest[np.flatnonzero(np.diff(own[widest], prepend=-1))]
    x[own[widest]] = (at[2 * widest] + at[2 * widest + 1]) / 2
    return x, y


#: Segments of a job up to which it is worked out together with others.
FEW = 192


def overlaid_many(p: np.ndarray, sizes: np.ndarray, job: np.ndarray, part: np.ndarray, n: int, keep, merge: bool = True) -> list[list[tuple]]:
    """`overlaid` of n jobs at once: for each its polygons, as their area and a list of rings (corners, 2). Rings come one after another, by
    job and in it by `part`: the number of their polygon, then lines as the last ones, whose part is -1. All jobs have as
    many polygons.

    Nodes, faces and borders of all jobs are one table each. A job of over FEW segments, or one whose border meets itself
    in a node, goes alone.
    """
    sizes, job, part = (np.asarray(x, np.int64) for x in (sizes, job, part))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    drop = (part >= 0) & (sizes < 3)
    sides, ring = sides_of_many(p, sizes)
    last = np.zeros(len(sides), bool)
    last[ends[1:][sizes > 0] - 1] = True
    good = ~drop[ring] & ~(last & (part[ring] < 0))
    sides, ring = sides[good], ring[good]
    alone = np.bincount(job[ring], minlength=n) > FEW
    out: list[list] = [[] for _ in range(n)]
    low, most = 0, np.concatenate(([0], np.cumsum(np.where(alone, 0, np.bincount(job[ring], minlength=n) ** 2))))
    first = np.searchsorted(job[ring], np.arange(n + 1))
    while low < n:
        to = max(low + 1, int(np.searchsorted(most, most[low] + 2 * BLOCK, side="right")) - 1)
        own = np.arange(first[low], first[to])
        own = own[~alone[job[ring[own]]]]
        if len(own):
            _overlaid(sides[own], job[ring[own]] - low, part[ring[own]], to - low, keep, merge, alone[low:to], out, low)
        low = to
    parts = int(part.max()) + 1 if len(part) else 0
    start = np.searchsorted(job, np.arange(n + 1))
    for k in np.flatnonzero(alone).tolist():
        own = range(start[k], start[k + 1])
        of = lambda i: [p[ends[r] : ends[r + 1]] for r in own if part[r] == i]  # noqa: E731, B023
        out[k] = [(polygon_area(q), [np.array(r) for r in q]) for q in overlaid([of(i) for i in range(parts)], keep, tuple(of(-1)), merge)]
    return out


def _cut_many(s: np.ndarray, job: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`cut_segments` of many small jobs: nodes, their jobs, edges. Nodes are in order of job, x, y."""
    s = np.round(s, DIGITS)
    some = (s[:, :2] != s[:, 2:]).any(1)
    s, job = s[some], job[some]
    n = np.arange(len(s))
    d = s[:, 2:] - s[:, :2]
    long = np.hypot(*d.T)
    owner, place, points = [n, n], [np.zeros(len(s)), np.ones(len(s))], [s[:, :2], s[:, 2:]]

    def add(i, t, p):
        owner.append(i)
        place.append(t)
        points.append(p)

    after = np.searchsorted(job, job, side="right") - n - 1
    i = np.repeat(n, after)
    j = i + 1 + ranges(after)
    lo, hi = np.minimum(s[:, :2], s[:, 2:]) - 1e-5, np.maximum(s[:, :2], s[:, 2:]) + 1e-5
    near = ((lo[i] <= hi[j]) & (lo[j] <= hi[i])).all(1)
    i, j = i[near], j[near]
    den = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
    e = s[j, :2] - s[i, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (e[:, 0] * d[j, 1] - e[:, 1] * d[j, 0]) / den, (e[:, 0] * d[i, 1] - e[:, 1] * d[i, 0]) / den
    crosses = (np.abs(den) > 1e-12) & (np.minimum(t, u) > 1e-9) & (np.maximum(t, u) < 1 - 1e-9)
    ci, cj, t, u = i[crosses], j[crosses], t[crosses], u[crosses]
    node = np.round(s[ci, :2] + t[:, None] * d[ci], DIGITS)
    add(ci, t, node)
    add(cj, u, node)
    for a, b in ((i, j), (j, i)):
        for k in (0, 2):
            q = s[b, k : k + 2] - s[a, :2]
            off = q[:, 0] * d[a, 1] - q[:, 1] * d[a, 0]
            at = (q * d[a]).sum(1) / long[a] ** 2
            on = (np.abs(off) <= 1e-6 * long[a]) & (at > 0) & (at < 1)
            add(a[on], at[on], s[b[on], k : k + 2])
    owner, place, points = np.concatenate(owner), np.concatenate(place), np.concatenate(points)
    order = np.lexsort((place, owner))
    owner, points = owner[order], points[order] + 0.0
    by = np.lexsort((points[:, 1], points[:, 0], job[owner]))
    sorted_, of = points[by], job[owner[by]]
    new = np.r_[True, (sorted_[1:] != sorted_[:-1]).any(1) | (of[1:] != of[:-1])][: len(by)]
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(new) - 1
    total = int(new.sum())
    pairs = np.sort(np.stack([number[:-1], number[1:]], 1)[(owner[:-1] == owner[1:]) & (number[:-1] != number[1:])], axis=1)
    pairs = np.unique(pairs[:, 0] * total + pairs[:, 1])
    edges = np.stack([pairs // max(total, 1), pairs % max(total, 1)], 1)
    while len(edges):  # loose ends go, a node of each a time
        loose = (np.bincount(edges.reshape(-1), minlength=total) == 1)[edges].any(1)
        if not loose.any():
            break
        edges = edges[~loose]
    return sorted_[new], of[new], edges


def _traced(follow: np.ndarray, order) -> tuple[np.ndarray, np.ndarray]:
    """Cycles of a permutation, each from its first member in the given order: members one after another, where each begins."""
    seen, line, begins, after = bytearray(len(follow)), [], [], follow.tolist()
    for h in order:
        if not seen[h]:
            begins.append(len(line))
            while not seen[h]:
                seen[h] = 1
                line.append(h)
                h = after[h]
    return np.array(line, np.int64), np.array(begins, np.int64)


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the nodes that hang together over links a-b, for each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _doubled(xy: np.ndarray, to: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(xy[:, 0] * to[:, 1] - to[:, 0] * xy[:, 1], begins) if len(begins) else np.zeros(0)


def _overlaid(sides, job, part, n, keep, merge, alone, out, base) -> None:
    nodes, node_job, edges = _cut_many(sides, job)
    if not len(edges):
        return
    m = len(edges)
    start, end = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    twin = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    way = nodes[end] - nodes[start]
    order = np.lexsort((np.arctan2(way[:, 1], way[:, 0]), start))
    first, last = np.searchsorted(start[order], start[order], side="left"), np.searchsorted(start[order], start[order], side="right") - 1
    rank = np.empty(2 * m, np.int64)
    rank[order] = np.arange(2 * m)
    back = rank[twin]
    line, begins = _traced(order[np.where(back == first[back], last[back], back - 1)], range(2 * m))
    counts = np.diff(np.r_[begins, len(line)])
    walk = np.repeat(np.arange(len(begins)), counts)
    size, walk_job = _doubled(nodes[start[line]], nodes[end[line]], begins), node_job[start[line[begins]]]
    face = np.full(len(begins), -1)  # of each walk; parts that lie loose in a face belong to it
    outer = np.flatnonzero(size > 1e-9)
    outer = outer[np.argsort(walk_job[outer], kind="stable")]
    face[outer] = np.arange(len(outer))
    face_job = walk_job[outer]
    loose = np.flatnonzero(size < -1e-9)
    loose = loose[np.bincount(walk_job[loose], minlength=n)[walk_job[loose]] > 1]
    if len(loose):
        xy = nodes[start[line]]
        by = np.lexsort((xy[:, 0], xy[:, 1], walk))
        tops = xy[by[begins]] - [1e-7, 0]
        box = np.hstack([np.minimum.reduceat(xy, begins), np.maximum.reduceat(xy, begins)])
        faces_of = np.searchsorted(face_job, np.arange(n + 1))
        many = np.diff(faces_of)[walk_job[loose]]
        w, f = np.repeat(loose, many), np.repeat(faces_of[walk_job[loose]], many) + ranges(many)
        x, y = tops[w].T
        about = (box[outer[f], 0] <= x) & (box[outer[f], 2] >= x) & (box[outer[f], 1] <= y) & (box[outer[f], 3] >= y)
        w, f = w[about], f[about]
        long = counts[outer[f]]
        k, at = np.repeat(np.arange(len(w)), long), line[np.repeat(begins[outer[f]], long) + ranges(long)]
        inside = _odd(np.hstack([nodes[start[at]], nodes[end[at]]]), tops[w[k]], k, len(w))
        w, f = w[inside], f[inside]
        by = np.lexsort((size[outer[f]], w))
        by = by[np.flatnonzero(np.diff(w[by], prepend=-1))]
        face[w[by]] = f[by]
    half = np.full(2 * m, -1)  # the face of each half of an edge
    half[line] = face[walk]
    held = line[half[line] >= 0]
    by = np.argsort(half[held], kind="stable")
    points = np.stack(inner_points(np.hstack([nodes[start[held[by]]], nodes[end[held[by]]]]), half[held[by]], len(outer)), 1)
    truth = []
    for k in range(int(part.max()) + 1):
        s, of = sides[part == k], job[part == k]
        bounds = np.searchsorted(of, np.arange(n + 1))
        many = np.diff(bounds)[face_job]
        f = np.repeat(np.arange(len(outer)), many)
        truth.append(_odd(s[np.repeat(bounds[face_job], many) + ranges(many)], points[f], f, len(outer)))
    wanted = np.asarray(keep(np.array(truth)), bool)
    if merge:
        inner = (half >= 0) & (half[twin] >= 0)
        kept = half >= 0
        kept[kept] = wanted[half[kept]]
        inner = kept & kept[twin]
        group = _joined(half[inner], half[twin[inner]], len(outer))
        position = np.empty(2 * m, np.int64)
        position[held[by]] = np.arange(len(held))
        rim = np.flatnonzero(kept & ~kept[twin])
        if not len(rim):
            return
        whose = group[half[rim]]
        by = np.lexsort((start[rim], whose))
        rim, whose = rim[by], whose[by]
        key = whose * len(nodes) + start[rim]
        twice = np.flatnonzero(key[1:] == key[:-1])
        alone[face_job[whose[twice]]] = True  # borders that meet themselves go the long way
        line, begins = _traced(np.minimum(np.searchsorted(key, whose * len(nodes) + end[rim]), len(rim) - 1), range(len(rim)))
        walk_group, xy = whose[line[begins]], nodes[start[rim[line]]]
        size = _doubled(xy, nodes[end[rim[line]]], begins)
        shells = np.bincount(walk_group, size > 0, minlength=len(outer))
        alone[face_job[np.unique(walk_group)[shells[np.unique(walk_group)] != 1]]] = True
        seat = np.full(len(outer), 2 * m)
        np.minimum.at(seat, whose, position[rim])
        by = np.lexsort((np.arange(len(begins)), size <= 0, seat[walk_group], face_job[walk_group]))
        by = by[size[by] != 0]
        polygon, ring_job = walk_group[by], face_job[walk_group[by]]
        rings = _tidied(xy, begins, len(line), by)
    else:
        chosen = np.flatnonzero(face >= 0)
        chosen = chosen[wanted[face[chosen]]]
        by = chosen[np.lexsort((chosen, size[chosen] <= 0, face[chosen]))]
        polygon, ring_job = face[by], face_job[face[by]]
        rings = _tidied(nodes[start[line]], begins, len(line), by)
    p, sizes = rings
    if not len(sizes):
        return
    ends = np.concatenate(([0], np.cumsum(sizes)))
    sides_, _ = sides_of_many(p, sizes)
    areas = np.abs(_doubled(sides_[:, :2], sides_[:, 2:], ends[:-1])) / 2
    new = np.flatnonzero(np.diff(polygon, prepend=-1))
    found: dict[int, list] = {}
    cuts, areas, jobs = ends.tolist(), areas.tolist(), ring_job.tolist()
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(polygon)], strict=True):
        found.setdefault(jobs[a], []).append((areas[a] - sum(areas[a + 1 : b]), [p[cuts[r] : cuts[r + 1]] for r in range(a, b)]))
    for k, polygons in found.items():
        if not alone[k]:
            out[base + k] = sorted(polygons, key=lambda x: x[0], reverse=True)


def _odd(s: np.ndarray, points: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Whether the point beside each side lies in what the sides of its owner enclose, by the even-odd rule; blocks bound the work."""
    odd = np.zeros(n, np.int64)
    for at in range(0, len(s), 4 * BLOCK):
        t, (x, y), own = s[at : at + 4 * BLOCK], points[at : at + 4 * BLOCK].T, owner[at : at + 4 * BLOCK]
        apart = (t[:, 1] > y) != (t[:, 3] > y)
        t, x, y, own = t[apart], x[apart], y[apart], own[apart]
        odd += np.bincount(own[x < (t[:, 2] - t[:, 0]) * (y - t[:, 1]) / (t[:, 3] - t[:, 1]) + t[:, 0]], minlength=n)
    return odd % 2 == 1


def _tidied(xy: np.ndarray, begins: np.ndarray, total: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`tidy` of chosen rings: their corners one after another, and how many each has."""
    counts = np.diff(np.r_[begins, total])[chosen]
    p = xy[np.repeat(begins[chosen], counts) + ranges(counts)]
    ring, ends = np.repeat(np.arange(len(chosen)), counts), np.cumsum(counts)
    before, after = np.arange(len(p)) - 1, np.arange(len(p)) + 1
    before[ends - counts], after[ends - 1] = ends - 1, ends - counts
    a, b = p - p[before], p[after] - p
    stays = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) > 1e-9
    stays |= (np.bincount(ring, stays, minlength=len(chosen)) <= 2)[ring]
    return p[stays], np.bincount(ring[stays], minlength=len(chosen))


def valid(polygon, least: float = 1.0) -> list:
    """What rings enclose by the even-odd rule, as polygons with holes above `least`, largest first."""
    return [p for p in overlaid([polygon], lambda m: m[0]) if polygon_area(p) > least]


def union(first, second, least: float = 1.0) -> list:
    """The parts of the union of two polygons above `least`; parts that only touch in a point are apart."""
    return [p for p in overlaid([first, second], lambda m: m.any(0)) if polygon_area(p) > least]


def cut(polygon, line, least: float = 1.0) -> list:
    """The pieces of a polygon that a line of corners leaves, those above `least`, largest first."""
    return [p for p in overlaid([polygon], lambda m: m[0], (line,), merge=False) if polygon_area(p) > least]


def in_order(groups: list[tuple]) -> tuple:
    """Rings of several groups (corners, sizes, jobs, number of the part) as one, by job, then by part: what overlaid_many takes."""
    p, sizes, job = (np.concatenate([g[k] for g in groups]) for k in range(3))
    part = np.repeat([g[3] for g in groups], [len(g[1]) for g in groups])
    order = np.lexsort((np.arange(len(job)), part < 0, job))
    begins = np.cumsum(sizes) - sizes
    return p[np.repeat(begins[order], sizes[order]) + ranges(sizes[order])], sizes[order], job[order], part[order]


def valid_many(p, sizes, job, n: int, least: float = 1.0) -> list:
    """`valid` of n polygons, whose rings come one after another with their polygon's number in `job`."""
    found = overlaid_many(p, sizes, job, np.zeros(len(sizes), np.int64), n, lambda m: m[0])
    return [[q for a, q in f if a > least] for f in found]


def union_many(first: tuple, second: tuple, n: int, least: float = 1.0) -> list:
    """`union` of n pairs of polygons (corners, sizes, jobs)."""
    found = overlaid_many(*in_order([(*first, 0), (*second, 1)]), n, lambda m: m.any(0))
    return [[q for a, q in f if a > least] for f in found]


def cut_many(polygon: tuple, line: tuple, n: int, least: float = 1.0) -> list:
    """`cut` of n polygons by a line each (corners, sizes, jobs). Segments of a line beyond its polygon's box cut nothing and are left out."""
    (p, sizes, job), (q, long, of) = polygon, line
    low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
    np.minimum.at(low, np.repeat(job, sizes), p)
    np.maximum.at(high, np.repeat(job, sizes), p)
    ends = np.cumsum(long)
    last = np.zeros(len(q), bool)
    last[ends[long > 0] - 1] = True
    i, own = np.flatnonzero(~last), np.repeat(of, long)[~last]
    near = ((np.maximum(q[i], q[i + 1]) >= low[own] - 1e-3) & (np.minimum(q[i], q[i + 1]) <= high[own] + 1e-3)).all(1)
    i, own = i[near], own[near]
    pieces = (np.stack([q[i], q[i + 1]], 1).reshape(-1, 2), np.full(len(i), 2), own, -1)
    found = overlaid_many(*in_order([(p, sizes, job, 0), pieces]), n, lambda m: m[0], merge=False)
    return [[r for a, r in f if a > least] for f in found]


def outlines(parts: list, least: float = 1.0) -> list[list[tuple]]:
    """Outer rings of parts, largest first, without parts that lie in another's hole."""
    rings = sorted((p[0] for p in parts if abs(area2(p[0])) / 2 > least), key=lambda r: -abs(area2(r)))
    if all(len(p) < 2 for p in parts):
        return rings
    return [r for i, r in enumerate(rings) if not any(inside_all([o], np.array([inner_point([r])]))[0] for o in rings[:i])] if len(rings) > 1 else rings
