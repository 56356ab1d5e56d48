"""Bitmap algebra in numpy: morphology, components, distances, thinning, outlines, filling, boxes.

Bitmaps are boolean arrays indexed [y, x]; points are (x, y) at pixel centres.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

import numpy as np


def box_dilate(mask: np.ndarray, r: int) -> np.ndarray:
    """Any pixel set within a square of side 2r + 1."""
    if r <= 0:
        return mask.copy()
    p = Packed(mask, r + 1)
    return p.mask(p.spread(p.spread(p.bits, True, ((0, -r, 2 * r + 1),)), False, ((-r, 0, 2 * r + 1),)))


def box_erode(mask: np.ndarray, r: int) -> np.ndarray:
    """All pixels set within the square; what lies outside the image counts as set."""
    return ~box_dilate(~mask, r)


def box_close(mask: np.ndarray, r: int) -> np.ndarray:
    return box_erode(box_dilate(np.pad(mask, r), r), r)[r:-r, r:-r] if r > 0 else mask.copy()


def disc(size: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) of a disc of odd size."""
    r = size // 2
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if x * x + y * y <= r * r + 0.25 * r]


def line(length: int, degrees: float) -> list[tuple[int, int]]:
    """Offsets of a straight run of pixels of about ``length``, centred."""
    r, a = (length - 1) / 2, np.deg2rad(degrees)
    x, y = round(np.cos(a) * r), round(np.sin(a) * r)
    n = max(abs(x), abs(y), 1)
    return list(dict.fromkeys((round(y * k / n), round(x * k / n)) for k in range(-n, n + 1)))


def _runs(offsets: list[tuple[int, int]], level: bool) -> list[tuple[int, int, int]]:
    """(dy, dx, length): offsets as runs along rows, or along columns."""
    out: list[tuple[int, int, int]] = []
    for a, b in sorted(set(offsets) if level else {(dx, dy) for dy, dx in offsets}):
        if out and out[-1][0] == a and out[-1][1] + out[-1][2] == b:
            out[-1] = (a, out[-1][1], out[-1][2] + 1)
        else:
            out.append((a, b, 1))
    return out if level else [(b, a, n) for a, b, n in out]


def dilate(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Any pixel set at one of the offsets. Rows are packed to bits and lie one behind the other with room between, so that
    an offset is one shift of all bytes; runs of offsets are made by doubling."""
    h, w = mask.shape
    offsets = [(dy, dx) for dy, dx in offsets if abs(dy) < h and abs(dx) < w]
    if not offsets:
        return np.zeros((h, w), bool)
    runs, along = _runs(offsets, True), _runs(offsets, False)
    level = len(runs) <= len(along)
    runs = runs if level else along
    longest = max(n for _, _, n in runs)
    dys, dxs = [dy for dy, _, _ in runs], [dx for _, dx, _ in runs]
    left, right = max(0, -min(dxs)), max(0, max(dxs)) + level * longest
    n = (w + 7) // 8
    wide = (n + (max(left, right) + 7) // 8 + 9) // 8 * 8  # bytes of a row, the room is free
    packed = np.zeros((h + (not level) * longest + 1, wide), np.uint8)
    packed[:h, :n] = np.packbits(mask, axis=1, bitorder="little")
    size = packed.size
    made, shifted = {1: packed.ravel()}, {}

    def run(length: int) -> np.ndarray:
        if length not in made:
            half = (length + 1) // 2
            q, s = divmod(length - half, 8) if level else ((length - half) * wide, 0)
            p = run(half)
            out = p.copy()
            out[q:] |= _by_bits(p, s)[: size - q]
            made[length] = out
        return made[length]

    head = max(0, -min(dys)) * wide + left // 8 + 1
    out = np.zeros(head + size + max(0, max(dys)) * wide + right // 8 + 1, np.uint8)
    for dy, dx, length in runs:
        key = length, dx % 8
        if key not in shifted:
            shifted[key] = _by_bits(run(length), dx % 8)
        at = head + dy * wide + dx // 8
        part = out[at : at + size]
        np.bitwise_or(part, shifted[key], out=part)
    return np.unpackbits(out[head : head + h * wide].reshape(h, wide)[:, :n], axis=1, bitorder="little")[:, :w].view(bool)


def erode(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    """Offsets must be symmetric; what lies outside the image counts as set."""
    return ~dilate(~mask, offsets)


def open_disc(mask: np.ndarray, size: int) -> np.ndarray:
    d = disc(max(3, size | 1))
    return dilate(erode(mask, d), d)


def odd_length(pixels: float) -> int:
    return max(3, int(round(pixels))) | 1


class Packed:
    """A mask as bits, its rows one behind the other with free room of ``margin`` pixels on all sides."""

    def __init__(self, mask: np.ndarray, margin: int):
        self.shape, self.margin, self.left = mask.shape, margin, (margin + 7) // 8
        h, w = mask.shape
        self.across = (w + 7) // 8  # bytes of a row's pixels
        self.wide = (self.across + 2 * self.left + 7) // 8 * 8
        rows = np.zeros((h + 2 * margin, self.wide), np.uint8)
        rows[margin : margin + h, self.left : self.left + self.across] = np.packbits(mask, axis=1, bitorder="little")
        self.bits = rows.ravel()

    def mask(self, bits: np.ndarray) -> np.ndarray:
        """The image of bits that lie as these do."""
        h, w = self.shape
        rows = bits.reshape(-1, self.wide)[self.margin : self.margin + h, self.left : self.left + self.across]
        return np.unpackbits(rows, axis=1, bitorder="little")[:, :w].view(bool)

    def spread(self, bits: np.ndarray, level: bool, runs: tuple) -> np.ndarray:
        """Any bit set at one of the offsets, given as runs; they reach less far than the margin."""
        wide, longest = self.wide, max(n for _, _, n in runs)
        room = np.zeros((longest // 64 + 1) * 8 if level else longest * wide, np.uint8)  # runs are made to one side, then moved back
        made, shifted = {1: np.concatenate([bits, room])}, {}
        size = made[1].size

        def run(length: int) -> np.ndarray:
            if length not in made:
                half = (length + 1) // 2
                q, s = divmod(length - half, 8) if level else ((length - half) * wide, 0)
                p = run(half)
                out = p.copy()
                out[q:] |= _by_bits(p, s)[: size - q]
                made[length] = out
            return made[length]

        head = (max(abs(dy) * wide + abs(dx) // 8 for dy, dx, _ in runs) + 9) // 8 * 8
        out = np.zeros(size + 2 * head, np.uint8)
        for dy, dx, length in runs:
            key = length, dx % 8
            if key not in shifted:
                shifted[key] = _by_bits(run(length), dx % 8)
            at = head + dy * wide + dx // 8
            out[at : at + size] |= shifted[key]
        return out[head : head + bits.size]

    @cached_property
    def within(self) -> np.ndarray:
        """The image's own pixels."""
        return Packed(np.ones(self.shape, bool), self.margin).bits

    def labels(self, bits: np.ndarray) -> Labels:
        """Groups of bits that lie as these do and are all within the image."""
        h = self.shape[0]
        return Labels(None, bits.reshape(-1, self.wide)[self.margin : self.margin + h], 8 * self.left, self.shape)

    def places(self, bits: np.ndarray) -> np.ndarray:
        """Where bits that lie as these do are set in the image, in reading order."""
        h, w = self.shape
        y, x = np.divmod(_set_bits(bits.reshape(-1, self.wide)[self.margin : self.margin + h].ravel().view("<u8")), 8 * self.wide)
        return y * w + x - 8 * self.left

    def closed(self, length: int, degrees: float) -> np.ndarray:
        """Bits of the closing by a line; the image lies in free space, so margins stay free."""
        how = _line_runs(length, degrees)
        return ~self.spread(~self.spread(self.bits, *how), *how)


def _set_bits(words: np.ndarray) -> np.ndarray:
    """Places of the set bits of 64-bit words, most of which are 0."""
    some = np.flatnonzero(words != 0)
    at = np.flatnonzero(np.unpackbits(words[some].view(np.uint8), bitorder="little").view(bool))
    return some[at >> 6] * 64 + (at & 63)


def _by_bits(p: np.ndarray, s: int) -> np.ndarray:
    """Bytes that are whole words, shifted by s < 8 pixels to the right."""
    if not s:
        return p
    words = p.view("<u8")  # pixels to the right are higher bits
    out = words << np.uint64(s)
    out[1:] |= words[:-1] >> np.uint64(64 - s)
    return out.view(np.uint8)


@lru_cache(maxsize=4096)
def _line_runs(length: int, degrees: float) -> tuple[bool, tuple]:
    """Whether a line's offsets are fewer runs along rows than along columns, and those runs."""
    offsets = line(length, degrees)
    runs, along = _runs(offsets, True), _runs(offsets, False)
    return (True, tuple(runs)) if len(runs) <= len(along) else (False, tuple(along))


def close_line(mask: np.ndarray, length: int, degrees: float) -> np.ndarray:
    """Closing by a line: bridges gaps in walls along it. The image lies in free space, so margins stay free."""
    p = Packed(mask, length // 2 + 1)
    return p.mask(p.closed(length, degrees))


def close_lines(mask: np.ndarray, pixels: float, orientations: int = 12) -> np.ndarray:
    length = odd_length(pixels)
    p = Packed(mask, length // 2 + 1)
    out = p.bits.copy()
    for k in range(orientations):
        out |= p.closed(length, 180 * k / orientations)
    return p.mask(out)


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels from 1 of 8-connected groups in the order of their first pixel, and their number."""
    labels, n, _, _ = labelled(mask)
    return labels, n


def labelled(mask: np.ndarray) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """What components() gives, and the places of all set pixels in reading order with their labels."""
    r = Labels(mask)
    return r.image, r.n, r.at, r.of


class Labels:
    """8-connected groups of a mask, numbered from 1 in the order of their first pixel.

    Runs of a row are the vertices; runs of neighbouring rows that touch are joined until nothing changes. y, first and
    last tell the runs in reading order, label their groups, at and of all set pixels and theirs."""

    def __init__(self, mask: np.ndarray | None, bits: np.ndarray | None = None, left: int = 0, shape: tuple[int, int] | None = None):
        """A mask, or bits of rows with at least a free one behind each, which begin ``left`` bits from their row's first."""
        self.shape = h, w = shape or mask.shape
        if bits is None:
            bits = np.zeros((h, (w + 8) // 8), np.uint8)
            bits[:, : (w + 7) // 8] = np.packbits(mask, axis=1, bitorder="little")
        across = 8 * bits.shape[1]
        words = np.append(bits.ravel(), np.zeros(8 + -bits.size % 8, np.uint8)).view("<u8")
        change = words ^ (words << np.uint64(1))
        change[1:] ^= words[:-1] >> np.uint64(63)
        ends = _set_bits(change)  # beginnings and ends by turns
        self.y = ys = ends[::2] // across
        self.first = starts = ends[::2] - ys * across - left
        ends = ends[1::2] - ys * across - left  # exclusive
        self.last, self.sizes, n = ends - 1, ends - starts, len(ys)
        if not n:
            self.label, self.n = np.zeros(0, np.int32), 0
            return
        # Runs of the row above that touch [start - 1, end]: a range, as runs of a row are sorted.
        span = w + 4
        lo = np.searchsorted(ys * span + ends, (ys - 1) * span + starts, side="left")
        hi = np.searchsorted(ys * span + starts, (ys - 1) * span + ends, side="right")
        row = np.searchsorted(ys, np.arange(h + 1))
        above = row[np.maximum(ys - 1, 0)]
        lo, hi = np.maximum(lo, above), np.minimum(hi, np.where(ys > 0, row[ys], above))
        counts = np.maximum(0, hi - lo)
        a = np.repeat(np.arange(n), counts)
        b = np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
        root = np.arange(n)
        while True:
            ra, rb = root[a], root[b]
            apart = np.flatnonzero(ra != rb)
            if not len(apart):
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                new = root[root]
                if (new == root).all():
                    break
                root = new
        number = np.cumsum(root == np.arange(n), dtype=np.int32)  # roots are first runs
        self.label, self.n = number[root], int(number[-1])

    @cached_property
    def at(self) -> np.ndarray:
        begin, before = self.y * self.shape[1] + self.first, np.cumsum(self.sizes) - self.sizes
        return np.repeat(begin - before, self.sizes) + np.arange(int(self.sizes.sum()))

    def label_at(self, at: np.ndarray) -> np.ndarray:
        """Labels of set pixels by their places."""
        return self.label[np.searchsorted(self.y * self.shape[1] + self.first, at, side="right") - 1]

    @cached_property
    def of(self) -> np.ndarray:
        return np.repeat(self.label, self.sizes)

    @cached_property
    def image(self) -> np.ndarray:
        return self.drawn(np.arange(self.n + 1, dtype=np.int32))

    def drawn(self, values: np.ndarray) -> np.ndarray:
        """An image of a value for each group, by its number; the first is that of free pixels."""
        h, w = self.shape
        # Free stretches and runs by turns.
        begin = self.y * w + self.first
        parts, of = np.zeros(2 * len(begin) + 1, np.int64), np.zeros(2 * len(begin) + 1, np.int32)
        parts[1::2], of[1::2] = self.sizes, self.label
        parts[0::2] = np.append(begin, h * w) - np.append(0, begin + self.sizes)
        return np.repeat(values[of], parts).reshape(h, w)

    @cached_property
    def size(self) -> np.ndarray:
        """Pixels of the groups from 0, of which there are none, to n."""
        return np.bincount(self.label, weights=self.sizes, minlength=self.n + 1).astype(np.int64)

    @cached_property
    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """x0, y0, x1, y1 of the groups from 1, both ends included, at k - 1."""
        if not self.n:
            return (np.zeros(0, np.int64),) * 4
        order = np.argsort(self.label, kind="stable")
        cuts = np.searchsorted(self.label[order], np.arange(1, self.n + 1))
        return tuple(f.reduceat(v[order], cuts) for f, v in ((np.minimum, self.first), (np.minimum, self.y), (np.maximum, self.last), (np.maximum, self.y)))

    def crop(self, k: int) -> tuple[np.ndarray, int, int]:
        """(crop, x0, y0) of the group k."""
        x0, y0, x1, y1 = (int(v[k - 1]) for v in self.boxes)
        box = slice(y0, y1 + 1), slice(x0, x1 + 1)
        return self.image[box] == k, x0, y0


def groups(mask: np.ndarray, least: float = 1) -> list[tuple[np.ndarray, int, int]]:
    """(crop, x0, y0) of every group of at least ``least`` pixels."""
    g = Labels(mask)
    return [g.crop(int(k)) for k in np.flatnonzero(g.size >= least) if k]


def _down(g: np.ndarray) -> np.ndarray:
    """Least of g[y'] + (y - y')**2 over every column."""
    best, other, k, most, n = g.copy(), np.empty_like(g), 1, int(g.max()), len(g)
    lo, hi = 0, n  # rows beyond have nothing over k * k
    while k < n and k * k < most:
        for a, b, d in ((lo, min(hi, n - k), k), (max(lo, k), hi, -k)):
            if a < b:
                np.add(g[a + d : b + d], g.dtype.type(k * k), out=other[a:b])
                np.minimum(best[a:b], other[a:b], out=best[a:b])
        if k % 4 == 0:
            rows = best[lo:hi].max(1)
            most = int(rows.max())
            open_ = np.flatnonzero(rows > k * k)
            if not len(open_):
                break
            lo, hi = lo + int(open_[0]), lo + int(open_[-1]) + 1
        k += 1
    return best


def distances(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of every set pixel to the nearest unset one; the image border is no obstacle."""
    out = np.zeros(mask.shape)
    ys, xs = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not len(ys):
        return out
    # Only the box of the set pixels and what is right beside it matters.
    box = slice(max(0, ys[0] - 1), ys[-1] + 2), slice(max(0, xs[0] - 1), xs[-1] + 2)
    mask = mask[box]
    h, w = mask.shape
    x = np.arange(w, dtype=np.int32)
    far = np.int32(h + w)
    before = np.maximum.accumulate(np.where(mask, -far, x), axis=1)
    after = np.minimum.accumulate(np.where(mask, 2 * far, x)[:, ::-1], axis=1)[:, ::-1]
    g = np.minimum(np.minimum(x - before, after - x), far)
    # Squares of up to 180 in half words, as few spaces are wider; where one is, all over again in whole ones.
    near = np.minimum(g, 180).astype(np.uint16)
    best = _down(near * near)
    if best.max() >= 180 * 180:
        best = _down(g.astype(np.int64) ** 2)
    out[box] = np.sqrt(np.where(mask, best, 0).astype(np.float64))
    return out


def _thin_tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a pixel may go in either pass of Zhang and Suen's thinning, by its eight neighbours clockwise from north."""
    one, two = np.zeros(256, bool), np.zeros(256, bool)
    for code in range(256):
        p = [(code >> k) & 1 for k in range(8)]
        turns = sum(p[k] == 0 and p[(k + 1) % 8] == 1 for k in range(8))
        if 2 <= sum(p) <= 6 and turns == 1:
            one[code] = not (p[0] & p[2] & p[4]) and not (p[2] & p[4] & p[6])
            two[code] = not (p[0] & p[2] & p[6]) and not (p[0] & p[4] & p[6])
    return one, two


_THIN = _thin_tables()


def thin(mask: np.ndarray) -> np.ndarray:
    """Skeleton one pixel wide, by Zhang and Suen's two passes until nothing changes."""
    p = np.pad(mask, 1)
    flat, w = p.ravel(), p.shape[1]
    around = (-w, -w + 1, 1, w + 1, w, w - 1, -1, -w - 1)
    inner = flat.copy()
    for d in around:
        inner[w + 1 : -w - 1] &= flat[w + 1 + d : len(flat) - w - 1 + d]
    rim = np.flatnonzero(flat & ~inner)  # only these may go; what lies beside one that goes is at the rim next
    while True:
        gone = 0
        for table in _THIN:
            code = np.zeros(len(rim), np.uint8)
            for k, d in enumerate(around):
                code |= flat[rim + d].view(np.uint8) << np.uint8(k)
            drop = table[code]
            out = rim[drop]
            if len(out):
                flat[out] = False
                next_ = (out[:, None] + np.array(around)).ravel()
                rim = np.sort(np.concatenate([rim[~drop], next_[flat[next_]]]))
                rim = rim[np.append(True, rim[1:] != rim[:-1])] if len(rim) else rim
            gone += len(out)
        if not gone:
            return p[1:-1, 1:-1].copy()


#: Steps along a pixel's side, with the pixel on the right: right, down, left, up; where they begin, from the pixel's first corner.
_STEPS, _BEGIN = ((1, 0), (0, 1), (-1, 0), (0, -1)), ((0, 0), (1, 0), (1, 1), (0, 1))


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """Closed rings along pixel edges with the set pixels on their right: areas are positive for outer rings, negative for holes.

    Sides in a line are one segment, and what follows a segment is read from the pixels where it ends; where two
    corners meet, both sides are one ring. Rings begin at their first corner in reading order."""
    h, w = mask.shape
    wide = (w + 4 + 63) // 64 * 8
    rows = np.zeros((h + 4, wide), np.uint8)
    rows[2:-2, : (w + 9) // 8] = np.packbits(np.pad(mask.astype(bool), ((0, 0), (2, 0))), axis=1, bitorder="little")
    on, w = rows.view("<u8"), 8 * wide
    flat, ones, most = on.ravel(), np.uint64(1), np.uint64(63)
    starts, parts, n = [], [], 0

    def beside(m: np.ndarray, dx: int, dy: int) -> np.ndarray:
        """Bits of what lies a step on; the margin is free, so nothing is seen around the ends."""
        out = np.zeros_like(m)
        if dy:
            out[max(0, -dy) : len(m) - max(0, dy)] = m[max(0, dy) : len(m) - max(0, -dy)]
        elif dx > 0:
            out = m >> ones
            out[:, :-1] |= m[:, 1:] << most
        else:
            out = m << ones
            out[:, 1:] |= m[:, :-1] >> most
        return out

    def lies(at: np.ndarray) -> np.ndarray:
        return (flat[at >> 6] >> (at & 63).astype(np.uint64) & ones).astype(bool)

    for way, (dx, dy) in enumerate(_STEPS):
        side = on & ~beside(on, dy, -dx)  # nothing lies to the left
        begin, end = _set_bits((side & ~beside(side, -dx, -dy)).ravel()), _set_bits((side & ~beside(side, dx, dy)).ravel())
        starts.append((begin, n + np.arange(len(begin))))
        if way % 2:  # segments run along columns, so both ends are in the order of those
            order = np.argsort(begin % w, kind="stable")
            starts[-1][1][order] = n + np.arange(len(begin))
            begin, end = begin[order], end[np.argsort(end % w, kind="stable")]
        parts.append((np.full(len(begin), way), begin, end))
        n += len(begin)
    if not n:
        return []
    way, begin, end = (np.concatenate([p[i] for p in parts]) for i in range(3))
    step = np.array([dy * w + dx for dx, dy in _STEPS])
    front = end + step[way]
    left = lies(front + step[(way + 3) % 4])  # to the left where a pixel lies there, else to the right around the same one
    turn, at = np.where(left, (way + 3) % 4, (way + 1) % 4), np.where(left, front + step[(way + 3) % 4], end)
    then = np.empty(n, np.int64)
    for k, (places, numbers) in enumerate(starts):
        mine = np.flatnonzero(turn == k)
        then[mine] = numbers[np.searchsorted(places, at[mine])]
    corner = np.array(_BEGIN)
    x, y = begin % w - 2 + corner[way, 0], begin // w - 2 + corner[way, 1]
    place = (y * (w + 1) + x).tolist()
    # Where a level side begins, one that runs back may begin too.
    first = range(len(parts[0][0]))
    back = {place[k]: k for k in range(n) if way[k] == 2}
    then, used, rings = then.tolist(), bytearray(n), []
    for k in first:
        for begins in (k, back.get(place[k])):
            if begins is None or used[begins]:
                continue
            ring, at = [], begins
            while True:
                used[at] = 1
                ring.append(at)
                at = then[at]
                if place[at] == place[begins]:
                    break
            rings.append(np.stack([x[ring], y[ring]], 1).astype(float) - 0.5)
    return rings


def signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def simplify(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's selection of points: no dropped one is farther than ``tolerance`` from the chord; chords of no length measure from their end."""
    points = np.asarray(points, float)
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, r = points[b] - points[a], points[a + 1 : b] - points[a]
        n = np.hypot(*d)
        far = np.hypot(r[:, 0], r[:, 1]) if n == 0 else np.abs(d[0] * r[:, 1] - d[1] * r[:, 0]) / n
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep.add(a + 1 + k)
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[sorted(keep)]


def polygons(mask: np.ndarray, tolerance: float = 1.0, least: float = 4.0) -> list[dict]:
    """{outer, holes} of every group, rings simplified and not closed; the simplification of a ring that it would collapse is left out."""
    out = []
    for crop, x0, y0 in groups(mask, least):
        rings = outlines(crop)
        slim = []
        for r in rings:
            s = simplify(np.vstack([r, r[:1]]), tolerance)[:-1] if tolerance > 0 and len(r) > 4 else r
            slim.append(((s if len(s) >= 3 and abs(signed_area(s)) >= least / 2 else r) + (x0, y0), signed_area(r)))
        outer = max(slim, key=lambda x: x[1])
        out.append({"outer": outer[0], "holes": [r for r, a in slim if a < 0 and -a >= least]})
    return out


def fill(rings: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """Pixels whose centres lie inside an odd number of rings."""
    h, w = shape
    out = np.zeros(shape, bool)
    every = [np.asarray(r, float) for r in rings if len(r)]
    if not every:
        return out
    low, high = np.min([r.min(0) for r in every], axis=0), np.max([r.max(0) for r in every], axis=0)
    # Only the box around the rings: there and beyond it nothing is inside.
    x0, x1 = (int(np.clip(np.ceil(v), 0, w)) for v in (low[0], high[0]))
    y0, y1 = (int(np.clip(np.ceil(v), 0, h)) for v in (low[1], high[1]))
    if x0 >= x1 or y0 >= y1:
        return out
    flips = np.zeros((y1 - y0, x1 - x0 + 1), np.int32)
    for a in every:
        for (ax, ay), (bx, by) in zip(a, np.roll(a, -1, axis=0)):
            if ay == by:
                continue
            lo, hi = min(ay, by), max(ay, by)
            ys = np.arange(max(0, int(np.ceil(lo))), min(h, int(np.ceil(hi))))
            xs = ax + (ys - ay) * (bx - ax) / (by - ay)
            np.add.at(flips, (ys - y0, np.clip(np.ceil(xs), x0, x1).astype(int) - x0), 1)
    out[y0:y1, x0:x1] = flips.cumsum(1)[:, :-1] & 1
    return out


def rasterized(shapes: list[dict], shape: tuple[int, int], grow: int = 0) -> np.ndarray:
    out = np.zeros(shape, bool)
    for s in shapes:
        out |= fill([s["outer"], *s.get("holes", ())], shape)
    return box_dilate(out, grow)


def stroke(mask: np.ndarray, points: np.ndarray, width: float, value: bool = True) -> None:
    """Draws a polyline of that width into the mask."""
    h, w = mask.shape
    for (ax, ay), (bx, by) in zip(points[:-1], points[1:]):
        r = width / 2
        x0, x1 = max(0, int(min(ax, bx) - r - 1)), min(w, int(max(ax, bx) + r + 2))
        y0, y1 = max(0, int(min(ay, by) - r - 1)), min(h, int(max(ay, by) + r + 2))
        if x0 >= x1 or y0 >= y1:
            continue
        y, x = np.ogrid[y0:y1, x0:x1]
        dx, dy = bx - ax, by - ay
        n = dx * dx + dy * dy
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / n, 0, 1) if n else np.zeros(x.shape)
        mask[y0:y1, x0:x1][(x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2 <= r * r] = value


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, by monotone chains over the outermost points of each row."""
    points = np.asarray(points, float)
    if len(points) > 500:
        rows, at = np.unique(points[:, 1], return_inverse=True)
        low, high = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
        np.minimum.at(low, at, points[:, 0])
        np.maximum.at(high, at, points[:, 0])
        points = np.concatenate([np.stack([low, rows], 1), np.stack([high, rows], 1)])
    p = sorted(set(map(tuple, np.asarray(points, float).tolist())))
    if len(p) < 3:
        return np.array(p)

    def half(seq):
        out: list[tuple[float, float]] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def oriented_box(points: np.ndarray) -> tuple[np.ndarray, float, float, np.ndarray]:
    """(centre, long side, short side, unit axis along the long side) of the smallest box around the points."""
    q = hull(points)
    edges = np.roll(q, -1, axis=0) - q if len(q) > 1 else np.array([[1.0, 0.0]])
    best = None
    for e in edges:
        n = np.hypot(*e)
        if n == 0:
            continue
        u = e / n
        v = np.array([-u[1], u[0]])
        a, b = q @ u, q @ v
        la, lb = np.ptp(a), np.ptp(b)
        if best is None or la * lb < best[0] - 1e-9:
            centre = u * (a.max() + a.min()) / 2 + v * (b.max() + b.min()) / 2
            best = (la * lb, centre, la, lb, u) if la >= lb else (la * lb, centre, lb, la, v)
    if best is None:
        return q[0], 0.0, 0.0, np.array([1.0, 0.0])
    return best[1], float(best[2]), float(best[3]), best[4]


def corners(centre, axis, width: float, depth: float) -> np.ndarray:
    c, u = np.asarray(centre), np.asarray(axis)
    v = np.array([-u[1], u[0]])
    return np.array([c + u * sx * width / 2 + v * sy * depth / 2 for sx, sy in ((1, 1), (-1, 1), (-1, -1), (1, -1))])


def boxes_overlap(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two convex rings meet: no edge of either parts them."""
    for ring in (a, b):
        for e in np.roll(ring, -1, axis=0) - ring:
            n = np.array([-e[1], e[0]])
            p, q = a @ n, b @ n
            if p.max() < q.min() or q.max() < p.min():
                return False
    return True


def clear(barrier: np.ndarray, a, b) -> bool:
    """Whether the straight line between two points meets no barrier pixel, sampled twice a pixel."""
    (ax, ay), (bx, by) = a, b
    n = int(2 * max(abs(bx - ax), abs(by - ay))) + 2
    x, y = np.rint(np.linspace(ax, bx, n)).astype(int), np.rint(np.linspace(ay, by, n)).astype(int)
    ok = (x >= 0) & (y >= 0) & (x < barrier.shape[1]) & (y < barrier.shape[0])
    return not barrier[y[ok], x[ok]].any()


def stroke_thickness(mask: np.ndarray) -> float:
    """The thickness that most ink has: twice the distance on the skeleton, in bins of a pixel weighted by thickness."""
    s = thin(mask)
    t = 2 * distances(np.pad(mask, 1))[1:-1, 1:-1][s]
    if not len(t):
        return 1.0
    n = np.bincount(np.floor(t - t.min()).astype(int))
    edge = t.min() + np.arange(len(n))
    return float(edge[int(np.argmax(n * edge))] + 0.5)


def otsu(gray: np.ndarray) -> int:
    """The gray that parts the histogram with the largest variance between its sides."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    w, s = n.cumsum(), (n * np.arange(256)).cumsum()
    rest = w[-1] - w
    with np.errstate(all="ignore"):
        v = np.where((w > 0) & (rest > 0), w * rest * (s / w - (s[-1] - s) / rest) ** 2, 0)
    return int(np.argmax(v))


def dark(gray: np.ndarray, most: int = 110, least: int = 40) -> np.ndarray:
    return gray < max(min(otsu(gray), most), least)
