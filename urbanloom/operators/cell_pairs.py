"""Pairs of lines, or of points and lines, that share a grid cell, worked out in Arrow batches: Spark deals and sorts the cells, numpy measures.

A cell is divided as finely as its rows are dense, lines are filed under the parts they touch, and the pairs of a part are
tested in blocks of a bounded number. Ids are whole numbers.
"""

from __future__ import annotations

import numpy as np

#: Pairs that are tested at once.
PAIRS_AT_ONCE = 200_000
#: Parts along a cell's side, at most.
MOST_PARTS = 128
#: Degrees by which lines are grown when they are filed; places are rounded by less.
SLACK = 1e-7


def whole_groups(batches, keys: int):
    """Tables from Arrow batches in the order of their first ``keys`` columns, never cut within a group of these."""
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in first]))
        if len(cuts):
            cut = int(cuts[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = [batch.slice(cut)]
        elif held and all(held[0].column(k)[0].as_py() == first[k][0] for k in range(keys)):
            held.append(batch)
        else:
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held = [batch]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def columns(table, *names: str) -> list:
    return [table.column(n).to_numpy() for n in names]


def new_from(*cols):
    """Where a row differs from the one before it; the first one does."""
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])


def group_ends(new):
    """For each row the end of its group, by the flags of :func:`new_from`."""
    starts = np.flatnonzero(new)
    return np.repeat(np.append(starts[1:], len(new)), np.diff(np.append(starts, len(new))))


def counted(first, n):
    """(position, value): for each position the ``n`` values from ``first`` on."""
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) + np.repeat(first - (np.cumsum(n) - n), n)


class Parts:
    """Cells (rows of equal ``cell``, in order) from (ox, oy) on, divided into n x n parts of ``step`` degrees; n, step and origin are arrays, a value a cell."""

    def __init__(self, ox, oy, n, step):
        self.ox, self.oy, self.n, self.step = ox, oy, n, step
        self.base = np.cumsum(n * n) - n * n

    def of_places(self, cell, x, y):
        """The part of each place; what lies outside of the cell goes to its edge."""
        n, step = self.n[cell], self.step[cell]
        part = lambda v, o: np.clip(np.floor((v - o[cell]) / step), 0, n - 1).astype(np.int64)
        return self.base[cell] + part(x, self.ox) * n + part(y, self.oy)

    def of_lines(self, cell, x1, y1, x2, y2, wide=0.0, reach=0.0):
        """(row, part) for each part that a line touches when it is grown by ``wide`` and ``reach`` degrees, in the order of the parts and then of the rows."""
        wide, reach = np.broadcast_to(wide, x1.shape) + SLACK, np.broadcast_to(reach, x1.shape) + SLACK
        x_low, x_high, y_low, y_high = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
        n, step, ox, oy = self.n[cell], self.step[cell], self.ox[cell], self.oy[cell]

        def span(low, high, o, n, step):
            a, b = np.maximum(np.floor((low - o) / step), 0).astype(np.int64), np.minimum(np.floor((high - o) / step), n - 1).astype(np.int64)
            return a, np.maximum(b - a + 1, 0)

        a, across = span(x_low - wide, x_high + wide, ox, n, step)
        r, sx = counted(a, across)
        n, step, ox, oy, wide, low, high = n[r], step[r], ox[r], oy[r], wide[r], x_low[r], x_high[r]
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (y2 - y1) / (x2 - x1)
        steep = (x_high - x_low <= self.step[cell])[r]  # in few columns: takes its whole height

        def height(x):
            return np.where(steep, 0.0, np.clip(y1[r] + (np.clip(x, low, high) - x1[r]) * np.where(steep, 0.0, slope[r]), y_low[r], y_high[r]))

        ya, yb = height(ox + sx * step - wide), height(ox + (sx + 1) * step + wide)
        bottom, top = np.where(steep, y_low[r], np.minimum(ya, yb)), np.where(steep, y_high[r], np.maximum(ya, yb))
        b, up = span(bottom - reach[r], top + reach[r], oy, n, step)
        at, sy = counted(b, up)
        part = self.base[cell[r[at]]] + sx[at] * n[at] + sy
        order = part * max(len(part), 1) + np.arange(len(part))  # sorted as single numbers, which is a stable order
        order.sort()
        part, order = np.divmod(order, max(len(part), 1))
        return r[at][order], part


def blocks(n, ends):
    """(low, high) of consecutive rows with ``n`` pairs each, cut only where ``ends`` holds for the last row, of a bounded number of pairs unless one stretch has more."""
    if not len(n):
        return
    stops = np.flatnonzero(ends) + 1
    done = np.cumsum(n)[stops - 1]
    low, before, k = 0, 0, 0
    while k < len(stops):
        k = max(int(np.searchsorted(done, before + PAIRS_AT_ONCE, "right")), k + 1)
        yield low, int(stops[k - 1])
        low, before = int(stops[k - 1]), done[k - 1]


def rounded_places(degrees):
    """Degrees rounded to 8 decimals, halves away from zero."""
    return np.sign(degrees) * np.floor(np.abs(degrees) * 1e8 + 0.5) / 1e8


def meetings(i, j, x1, y1, dx, dy):
    """(pairs, t, u): which pairs of segments meet, at which part of i and of j. Swapped ones give the same numbers."""
    ix, iy, jx, jy = dx[i], dy[i], dx[j], dy[j]
    px, py = x1[j] - x1[i], y1[j] - y1[i]
    d = ix * jy - iy * jx
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        t, u = (px * jy - py * jx) / d, (px * iy - py * ix) / d
    at = np.flatnonzero((np.abs(d) > 1e-18) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
    return at, t[at], u[at]


def without_copies(pair, kx, ky, lon, lat):
    """Row numbers, one of each (pair, kx, ky): that of the least (lon, lat)."""
    some = np.sort(pair)
    some = np.unique(some[1:][some[1:] == some[:-1]])
    if not len(some):
        return np.arange(len(pair))
    twice = np.isin(pair, some)
    r = np.flatnonzero(twice)
    r = r[np.lexsort((lat[r], lon[r], ky[r], kx[r], pair[r]))]
    return np.sort(np.concatenate([np.flatnonzero(~twice), r[new_from(pair[r], kx[r], ky[r])]]))


def cell_crossings(table, size: float):
    """Yields dicts of what crosses in a table of whole cells (cx, cy, line, x1, y1, x2, y2), in the order of cell and line.

    i, j: rows of the smaller and the larger line; lon, lat; kx, ky: the place rounded, by whose part a crossing counts, so
    that all of a place are together; part; ``ends``: none of this part's crossings are still to come.
    """
    cx, cy, line, x1, y1, x2, y2 = columns(table, "cx", "cy", "line", "x1", "y1", "x2", "y2")
    new = new_from(cx, cy)
    cell, m = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(new)))
    n = np.minimum(np.sqrt(m) / 4 + 1, MOST_PARTS).astype(np.int64)
    parts = Parts(cx[new] * size, cy[new] * size, n, size / n)
    r, part = parts.of_lines(cell, x1, y1, x2, y2)
    if not len(r):
        return
    x1, y1, dx, dy = x1[r], y1[r], (x2 - x1)[r], (y2 - y1)[r]
    new_part = new_from(part)
    new_line = new_part | new_from(line[r])
    run = np.cumsum(new_line)
    first, last = group_ends(new_line), group_ends(new_part)
    part_ends, line_ends = np.append(new_part[1:], True), np.append(new_line[1:], True)
    pairs = last - first
    crowded = np.repeat(np.add.reduceat(pairs, np.flatnonzero(new_part)) > PAIRS_AT_ONCE, np.diff(np.append(np.flatnonzero(new_part), len(part))))
    for low, high in blocks(pairs, part_ends | line_ends & crowded):
        i, j = counted(first[low:high], pairs[low:high])
        i += low
        at, t, _ = meetings(i, j, x1, y1, dx, dy)
        i, j = i[at], j[at]
        lon, lat = x1[i] + t * dx[i], y1[i] + t * dy[i]
        kx, ky = rounded_places(lon), rounded_places(lat)
        rows = r[i]
        own = np.flatnonzero((np.floor(kx / size) == cx[rows]) & (np.floor(ky / size) == cy[rows]) & (parts.of_places(cell[rows], kx, ky) == part[i]))
        own = own[without_copies(run[i[own]] * (run[-1] + 1) + run[j[own]], kx[own], ky[own], lon[own], lat[own])]
        i, j = i[own], j[own]
        yield {"i": r[i], "j": r[j], "lon": lon[own], "lat": lat[own], "kx": kx[own], "ky": ky[own], "part": part[i], "ends": bool(part_ends[high - 1])}


def crossing_rows(size: float):
    """Batches of (line1, line2, lon, lat) of all crossings."""
    import pyarrow as pa

    def work(batches):
        for table in whole_groups(batches, 2):
            line = table.column("line").to_numpy()
            for h in cell_crossings(table, size):
                if len(h["i"]):
                    yield pa.RecordBatch.from_arrays([pa.array(line[h["i"]]), pa.array(line[h["j"]]), pa.array(h["lon"]), pa.array(h["lat"])], ["line1", "line2", "lon", "lat"])

    return work


def crossings_a_line(size: float):
    """Batches of (street, crossings): what each line has in a block."""
    import pyarrow as pa

    def work(batches):
        for table in whole_groups(batches, 2):
            line = table.column("line").to_numpy()
            n = np.zeros(len(line), np.int64)
            for h in cell_crossings(table, size):
                n += np.bincount(h["i"], minlength=len(line)) + np.bincount(h["j"], minlength=len(line))
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(line[some]), pa.array(n[some])], ["street", "crossings"])

    return work


def _needed(h: dict, line) -> dict:
    """Of crossings of one part those that first bring a street to its place, and the first of each place."""
    i, j, kx, ky, lon, lat = (h[k] for k in ("i", "j", "kx", "ky", "lon", "lat"))
    o = np.lexsort((lat, lon, line[j], line[i], ky, kx))
    i, j, new = i[o], j[o], new_from(kx[o], ky[o])
    place = np.cumsum(new) - 1
    ends, at, hit = np.concatenate([line[i], line[j]]), np.concatenate([place, place]), np.concatenate([o, o])
    by = np.lexsort((ends, at))
    kept = np.union1d(hit[by][new_from(at[by], ends[by])], o[new])
    return {k: v[kept] if k != "ends" else v for k, v in h.items()}


def _places(table, size: float):
    """(alone, shared): crossings that have their place to themselves (i, j, kx, ky, lon, lat), and places of several as (kx, ky, lon, lat, offsets, rows), a row of each of their streets in the order of these."""
    line = table.column("line").to_numpy()
    held: list = []
    for h in cell_crossings(table, size):
        held.append(h)
        if not h["ends"]:  # a part of very many: what its places need is kept
            if sum(len(p["i"]) for p in held) > 4 * PAIRS_AT_ONCE:
                held = [_needed({k: np.concatenate([p[k] for p in held]) for k in h if k != "ends"}, line)]
            continue
        if len(held) > 1:
            h = {k: np.concatenate([p[k] for p in held]) for k in h if k != "ends"}
        held = []
        i, j, kx, ky, lon, lat = (h[k] for k in ("i", "j", "kx", "ky", "lon", "lat"))
        place = (kx * 1e8).astype(np.int64) * 73_856_093 + (ky * 1e8).astype(np.int64)  # equal places have equal numbers; others hardly ever do
        some = np.sort(place)
        some = np.unique(some[1:][some[1:] == some[:-1]])
        r = np.flatnonzero(np.isin(place, some)) if len(some) else np.zeros(0, np.int64)
        alone = np.delete(np.arange(len(i)), r)
        if not len(r):
            none = np.zeros(0)
            yield (i, j, kx, ky, lon, lat), (none, none, none, none, np.zeros(1, np.int64), r)
            continue
        r = r[np.lexsort((lat[r], lon[r], line[j[r]], line[i[r]], ky[r], kx[r]))]
        new = new_from(kx[r], ky[r])
        place = np.cumsum(new) - 1
        ends, at = np.concatenate([i[r], j[r]]), np.concatenate([place, place])
        o = np.lexsort((ends, line[ends], at))
        ends, at = ends[o], at[o]
        one = new_from(at, line[ends])
        r = r[new]
        yield tuple(v[alone] for v in (i, j, kx, ky, lon, lat)), (kx[r], ky[r], lon[r], lat[r], np.append(0, np.cumsum(np.bincount(at[one]))), ends[one])


def merged_rows(size: float):
    """Batches of (kx, ky, streets, lon, lat), a row a place."""
    import pyarrow as pa

    def batch(kx, ky, lon, lat, offsets, streets):
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(streets, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(kx, pa.float64()), pa.array(ky, pa.float64()), listed, pa.array(lon, pa.float64()), pa.array(lat, pa.float64())], ["kx", "ky", "streets", "lon", "lat"])

    def work(batches):
        for table in whole_groups(batches, 2):
            line = table.column("line").to_numpy()
            for (i, j, kx, ky, lon, lat), (kx2, ky2, lon2, lat2, offsets, rows) in _places(table, size):
                if len(i):
                    yield batch(kx, ky, lon, lat, np.arange(len(i) + 1) * 2, line[np.stack([i, j], 1).ravel()])
                if len(rows):
                    yield batch(kx2, ky2, lon2, lat2, offsets, line[rows])

    return work


def merged_names(size: float):
    """Batches of (names, n): how many places of a block have these streets' names, in the order of the streets; a row is given for each place of several crossings."""
    import pyarrow as pa

    def batch(offsets, names, n):
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names.cast(pa.string())), pa.array(n, pa.int64())], ["names", "n"])

    def work(batches):
        for table in whole_groups(batches, 2):
            coded = table.column("name").combine_chunks().dictionary_encode()
            coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
            code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            for (i, j, *_), (*_, offsets, rows) in _places(table, size):
                if len(i):
                    both, n = np.unique(code[i] * len(words) + code[j], return_counts=True)
                    yield batch(np.arange(len(both) + 1) * 2, words.take(pa.array(np.stack(np.divmod(both, len(words)), 1).ravel())), n)
                if len(rows):
                    yield batch(offsets, words.take(pa.array(code[rows])), np.ones(len(offsets) - 1, np.int64))

    return work


#: Distances that are held at once.
DISTANCES_AT_ONCE = 32_768


def distances_between(x, y, u, v) -> float:
    """Summed planar distance of the places (x, y) to the places (u, v), by pieces in memory that is used again."""
    total, wide = 0.0, min(len(u), DISTANCES_AT_ONCE)
    high = max(1, min(len(x), DISTANCES_AT_ONCE // max(wide, 1)))
    one, two = np.empty(high * wide), np.empty(high * wide)
    for j in range(0, len(u), wide or 1):
        w = min(wide, len(u) - j)
        for i in range(0, len(x), high):
            h = min(high, len(x) - i)
            a, b = one[: h * w].reshape(h, w), two[: h * w].reshape(h, w)
            np.subtract(x[i : i + h, None], u[j : j + w], out=a)
            np.subtract(y[i : i + h, None], v[j : j + w], out=b)
            np.multiply(a, a, out=a)
            np.multiply(b, b, out=b)
            np.add(a, b, out=a)
            total += float(np.sqrt(a, out=a).sum())
    return total


def pairs_of_streets(street, segment, part, other, lon, lat):
    """(street, pairs, distance) of crossings in the order of street and segment; ``part``: how far along the segment they lie, in degrees; crossings with one and the same other line are no pair.

    On one segment the distances follow from the order of the parts; those between segments are measured.
    """
    o = np.lexsort((part, segment, street))
    street, segment, part, other, lon, lat = (v[o] for v in (street, segment, part, other, lon, lat))
    new, new_segment = new_from(street), new_from(street, segment)
    edges, cuts = np.append(np.flatnonzero(new), len(street)), np.append(np.flatnonzero(new_segment), len(street))
    n, size = np.diff(edges), np.diff(cuts)
    rank = np.arange(len(street)) - np.repeat(cuts[:-1], size)
    part = part - np.repeat(part[cuts[:-1]], size)
    its = np.cumsum(new) - 1
    far = np.bincount(its, weights=(2 * rank - np.repeat(size, size) + 1) * part)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        end = edges[its[a] + 1]
        if b < end:
            far[its[a]] += distances_between(lon[a:b], lat[a:b], lon[b:end], lat[b:end])
    pairs = n * (n - 1) // 2
    key = its * (other.max() + 1) + other
    o = np.argsort(key, kind="stable")
    same, first = np.diff(np.append(np.flatnonzero(new_from(key[o])), len(key))), np.flatnonzero(new_from(key[o]))
    at = o[first[same == 2]]
    twin = o[first[same == 2] + 1]
    pairs -= np.bincount(its[at], minlength=len(n))
    far -= np.bincount(its[at], weights=np.sqrt((lon[at] - lon[twin]) ** 2 + (lat[at] - lat[twin]) ** 2), minlength=len(n))
    for k in np.flatnonzero(same > 2):
        r = o[first[k] : first[k] + same[k]]
        pairs[its[r[0]]] -= same[k] * (same[k] - 1) // 2
        far[its[r[0]]] -= distances_between(lon[r], lat[r], lon[r], lat[r]) / 2
    some = np.flatnonzero(pairs)
    return street[edges[:-1]][some], pairs[some], far[some]


def street_totals(batches):
    """(street, pairs, metres): of the streets that a tile is home to (hx, hy, line, x1, y1, x2, y2, home) the pairs of their crossings with all lines there, summed in degrees."""
    import pyarrow as pa

    for table in whole_groups(batches, 2):
        hx, hy, line, x1, y1, x2, y2, home = columns(table, "hx", "hy", "line", "x1", "y1", "x2", "y2", "home")
        once = np.flatnonzero(new_from(hx, hy, line, x1, y1, x2, y2))  # what came by several cells
        hx, hy, line, x1, y1, x2, y2, home = (v[once] for v in (hx, hy, line, x1, y1, x2, y2, home))
        starts = np.flatnonzero(new_from(hx, hy))
        for a, b in zip(starts, np.append(starts[1:], len(hx)), strict=True):
            for street, pairs, far in _totals_of_tile(line[a:b], x1[a:b], y1[a:b], x2[a:b], y2[a:b], home[a:b]):
                yield pa.RecordBatch.from_arrays([pa.array(street), pa.array(pairs), pa.array(far)], ["street", "pairs", "metres"])


def _totals_of_tile(line, x1, y1, x2, y2, home):
    own = np.flatnonzero(home)
    xs, ys = np.concatenate([x1[own], x2[own]]), np.concatenate([y1[own], y2[own]])
    wide = max(np.ptp(xs), np.ptp(ys), 1e-6)
    n = np.array([min(int(np.sqrt(len(line)) / 4) + 1, MOST_PARTS)])
    parts = Parts(np.array([xs.min()]), np.array([ys.min()]), n, wide / n)
    zero = np.zeros(len(line), np.int64)
    r, part = parts.of_lines(zero, x1, y1, x2, y2)
    dx, dy, rank = x2 - x1, y2 - y1, np.cumsum(new_from(line)) - 1
    new = np.flatnonzero(new_from(part))
    starts, stops = np.repeat(new, np.diff(np.append(new, len(part)))), np.repeat(np.append(new[1:], len(part)), np.diff(np.append(new, len(part))))
    e = np.flatnonzero(home[r])
    e = e[np.argsort(r[e], kind="stable")]  # street by street
    me, first, count, mine = r[e], starts[e], (stops - starts)[e], line[r[e]]
    for low, high in blocks(count, np.append(mine[1:] != mine[:-1], True)):
        found, piece = [], max(1, (high - low) // int(count[low:high].sum() // PAIRS_AT_ONCE + 1))
        for a in range(low, high, piece):  # a street of very many pairs in pieces
            b = min(high, a + piece)
            k, j = counted(first[a:b], count[a:b])
            i, j, at = me[a:b][k], r[j], part[e[a:b]][k]
            other = np.flatnonzero(line[i] != line[j])
            i, j, at = i[other], j[other], at[other]
            hit, t, u = meetings(i, j, x1, y1, dx, dy)
            i, j, at = i[hit], j[hit], at[hit]
            less = line[i] < line[j]
            s, t = np.where(less, i, j), np.where(less, t, u)
            lon, lat = x1[s] + t * dx[s], y1[s] + t * dy[s]
            kx, ky = rounded_places(lon), rounded_places(lat)
            its = np.flatnonzero(parts.of_places(0, kx, ky) == at)
            found.append((i[its], j[its], kx[its], ky[its], lon[its], lat[its]))
        i, j, kx, ky, lon, lat = (np.concatenate(v) for v in zip(*found, strict=True))
        if len(i):
            o = without_copies(rank[i] * (rank[-1] + 1) + rank[j], kx, ky, lon, lat)
            i, j, lon, lat = i[o], j[o], lon[o], lat[o]
            yield pairs_of_streets(line[i], i, ((lon - x1[i]) * dx[i] + (lat - y1[i]) * dy[i]) / np.sqrt(dx[i] ** 2 + dy[i] ** 2), rank[j], lon, lat)


def near_pairs(size: float, finest: float):
    """Batches of (point_id, lon, lat, line_id, foot_lon, foot_lat): for each point the segments of its part that may be the nearest.

    Rows are (cx, cy, kind, id, x1, y1, x2, y2, wide, reach): kind 0 points at x1, y1, kind 1 segments, filed under all cells
    and parts that they touch when grown by ``wide`` and ``reach`` degrees. Parts are no finer than ``finest`` degrees. Up to 89 degrees of latitude
    the planar square is within 1 % of the distance's, so what is within 5 % of the least is kept; beyond, all pairs are.
    """
    import pyarrow as pa

    def work(batches):
        for table in whole_groups(batches, 2):
            cx, cy, kind, ids, x1, y1, x2, y2, wide, reach = columns(table, "cx", "cy", "kind", "id", "x1", "y1", "x2", "y2", "wide", "reach")
            new = new_from(cx, cy)
            cell, point = np.cumsum(new) - 1, kind == 0
            n = np.clip(np.minimum(np.sqrt(np.bincount(cell, weights=point)), size / finest), 1, MOST_PARTS).astype(np.int64)
            parts = Parts(cx[new] * size, cy[new] * size, n, size / n)
            p, s = np.flatnonzero(point), np.flatnonzero(~point)
            if not len(p) or not len(s):
                continue
            r, part = parts.of_lines(cell[s], x1[s], y1[s], x2[s], y2[s], wide[s], reach[s])
            r = s[r]
            at = parts.of_places(cell[p], x1[p], y1[p])
            o = np.argsort(at)
            p, at = p[o], at[o]
            first = np.searchsorted(part, at, "left")
            count = np.searchsorted(part, at, "right") - first
            some = np.flatnonzero(count)
            p, first, count = p[some], first[some], count[some]
            line, ax, ay, dx, dy = ids[r], x1[r], y1[r], (x2 - x1)[r], (y2 - y1)[r]
            norm = dx * dx + dy * dy
            with np.errstate(divide="ignore"):
                inverse = np.where(norm > 0, 1 / norm, 0.0)
            for low, high in blocks(count, np.ones(len(p), bool)):
                i, j = counted(first[low:high], count[low:high])
                lon, lat = x1[p[low:high]], y1[p[low:high]]
                px, py, jx, jy = lon[i] - ax[j], lat[i] - ay[j], dx[j], dy[j]
                t = np.clip((px * jx + py * jy) * inverse[j], 0.0, 1.0)
                ex, ey = (px - t * jx) * np.cos(np.radians(lat))[i], py - t * jy
                square = ex * ex + ey * ey
                least = np.minimum.reduceat(square, np.cumsum(count[low:high]) - count[low:high])
                kept = np.flatnonzero(square <= np.where(np.abs(lat) > 89, np.inf, least * 1.05 + 1e-24)[i])
                i, j = i[kept], j[kept]
                lon, lat, k = lon[i], lat[i], norm[j] > 0  # the foot as SQL works it out
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.where(k, np.clip(((lon - ax[j]) * dx[j] + (lat - ay[j]) * dy[j]) / norm[j], 0.0, 1.0), 0.0)
                arrays = [ids[p[low:high]][i], lon, lat, line[j], ax[j] + t * dx[j], ay[j] + t * dy[j]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], ["point_id", "lon", "lat", "line_id", "foot_lon", "foot_lat"])

    return work
