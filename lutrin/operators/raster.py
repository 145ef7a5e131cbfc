"""Binary masks and ink profiles: the array operators, and queries that draw each page's boxes on a grid.

Masks are small boolean arrays (one page on a fixed grid); their size is bounded by the grid, whatever the number of
boxes.  The query measures many pages at a time, with the same results as the operators on one mask give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.operators.spatial import PAGE, boxes

GRID, CELL = 64, 25
#: Pages whose cells are held at once.
_AT_ONCE = 256


def dilate(mask: np.ndarray, k: int = 1) -> np.ndarray:
    """Cells with any set cell in the square of side ``2k + 1`` around them, clipped to the mask (each of a stack's)."""
    out = np.asarray(mask, bool)
    for axis in (-2, -1) if k > 0 else ():
        margin = [(0, 0)] * out.ndim
        margin[axis] = (k, k)
        wide = np.moveaxis(np.pad(out, margin), axis, 0)
        out = np.moveaxis(np.logical_or.reduce([wide[i : len(wide) - 2 * k + i] for i in range(2 * k + 1)]), 0, axis)
    return out.copy()


def erode(mask: np.ndarray, k: int = 1) -> np.ndarray:
    """Cells without an unset cell in their square; what lies outside of the mask takes nothing away."""
    return ~dilate(~np.asarray(mask, bool), k)


def safe_erode(mask: np.ndarray, k: int, keep: float = 0.1, least: int = 2) -> tuple[np.ndarray, int]:
    """(mask, depth): erosion by ``k``, else by ``least``, if it leaves ``keep`` of the cells; else the mask and 0."""
    tried = ((erode(mask, depth), depth) for depth in (k, least) if depth > 0 and mask.any())
    return next(((out, depth) for out, depth in tried if out.sum() >= keep * mask.sum()), (mask.copy(), 0))


def components(mask: np.ndarray, least: int = 1) -> list[np.ndarray]:
    """Masks of the parts that hang together by edges, the largest first (ties by first cell)."""
    left, out = mask.copy(), []
    for start in map(tuple, np.argwhere(mask)):
        if not left[start]:
            continue
        part, todo = np.zeros_like(mask), [start]
        left[start] = False
        while todo:
            y, x = todo.pop()
            part[y, x] = True
            for a, b in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and left[a, b]:
                    left[a, b] = False
                    todo.append((a, b))
        if part.sum() >= least:
            out.append(part)
    return sorted(out, key=lambda p: -int(p.sum()))


def fill_ratio(mask: np.ndarray) -> float:
    """Set cells over those of the enclosing box; 0 for an empty mask."""
    at = np.argwhere(mask)
    if not len(at):
        return 0.0
    (y0, x0), (y1, x1) = at.min(0), at.max(0) + 1
    return float(mask.sum() / ((y1 - y0) * (x1 - x0)))


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Half-open spans of consecutive true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def ink_bands(mask: np.ndarray, axis: int = 0, least: int = 1) -> list[tuple[int, int]]:
    """Spans of columns (axis 0) or rows (axis 1) that hold at least ``least`` set cells."""
    return runs(mask.sum(axis) >= least)


def gutters(mask: np.ndarray, axis: int = 0, least: int = 1) -> list[tuple[int, int]]:
    """Blank spans of at least ``least`` between the first and the last band."""
    bands = ink_bands(mask, axis)
    return [(a[1], b[0]) for a, b in zip(bands, bands[1:]) if b[0] - a[1] >= least]


def regularity(widths: list[float], tolerance: float = 0.2) -> float:
    """Regular steps less half of the irregular ones, against the median step."""
    if not widths:
        return 0.0
    step = float(np.median(widths))
    good = sum(abs(w - step) <= tolerance * step for w in widths)
    return good - 0.5 * (len(widths) - good)


def radial_profile(mask: np.ndarray, frame: np.ndarray | None = None, sectors: int = 120) -> np.ndarray:
    """Farthest set cell per sector of the angle, in units of the half extents, so that an ellipse is a circle.

    ``frame`` is the mask that gives centre and extents (the mask itself by default).  A sector without cells has the
    median of the others; an empty mask has zeros.
    """
    if not mask.any():
        return np.zeros(sectors)
    at = np.argwhere(mask if frame is None or not frame.any() else frame)
    half = np.maximum(np.ptp(at, axis=0) / 2, 1.0)
    y, x = ((np.argwhere(mask) - at.mean(0)) / half).T
    place = pd.Series(x + 1j * y)
    sector = np.minimum(((np.angle(place) / (2 * np.pi) + 0.5) * sectors).astype(int), sectors - 1)
    far = place.abs().groupby(sector).max().reindex(range(sectors))
    far = far.where(far > 0)
    return far.fillna(far.median()).fillna(0.0).to_numpy()


def harmonic(profile: np.ndarray, low: int = 6, high: int = 20) -> float:
    """Amplitude of the strongest of the waves that go ``low`` to ``high`` times round, against the median radius."""
    middle = np.median(profile) if len(profile) else 0.0
    waves = np.abs(np.fft.rfft(profile))[low : high + 1] if len(profile) else np.zeros(0)
    return float(2 * waves.max() / (len(profile) * middle)) if middle > 0 and len(waves) else 0.0


def diffuse(values: np.ndarray, hole: np.ndarray, passes: int = 30) -> np.ndarray:
    """Fill a hole from its edge inwards: each pass takes the mean of the four neighbours."""
    out = values.astype(float).copy()
    out[hole] = out[~hole].mean() if (~hole).any() else 0.0
    for _ in range(passes):
        p = np.pad(out, 1, mode="edge")
        mean = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4
        out[hole] = mean[hole]
    return out


def draw(pdf: pd.DataFrame) -> np.ndarray:
    """The boxes of one page on the grid."""
    mask = np.zeros((GRID, GRID), bool)
    for x0, y0, x1, y1 in pdf[["x0", "y0", "x1", "y1"]].clip(lower=0).itertuples(index=False):
        mask[y0 // CELL : -(-y1 // CELL), x0 // CELL : -(-x1 // CELL)] = True
    return mask


def drawn(page: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
    """Masks of ``n`` pages from packed boxes and whose they are; a blank row and column after each keep runs apart."""
    edges = np.zeros((n, GRID + 1, GRID + 1), np.int32)
    y0, y1, x0, x1 = ((cells >> s) & 127 for s in (21, 14, 7, 0))
    for y, x, v in ((y0, x0, 1), (y1, x1, 1), (y0, x1, -1), (y1, x0, -1)):
        np.add.at(edges, (page, y, x), v)
    return edges.cumsum(1).cumsum(2) > 0


def parts_of_runs(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set cells along the rows of masks as ``drawn``, in order: flat start, flat end, first run of its part."""
    edge = np.flatnonzero(np.diff(masks.ravel(), prepend=False))
    start, end = edge[::2], edge[1::2]
    root, above = np.arange(len(start)), np.searchsorted(end, start - masks.shape[2], "right")
    n = np.maximum(np.searchsorted(start, end - masks.shape[2]) - above, 0)
    below = np.repeat(root, n)
    above = np.arange(len(below)) + np.repeat(above - n.cumsum() + n, n)
    while len(apart := np.flatnonzero((a := root[above]) != (b := root[below]))):
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root != root[root]).any():
            root = root[root]
    return start, end, root


def profiles(page: np.ndarray, y: np.ndarray, x: np.ndarray, sectors: int = 120) -> np.ndarray:
    """``radial_profile`` of every page's cells, given in order of the pages, 0 and on without a gap."""
    first = np.flatnonzero(np.diff(page, prepend=-1))
    size = np.diff(first, append=len(page))
    unit = []
    for v in (y, x):
        half = np.maximum((np.maximum.reduceat(v, first) - np.minimum.reduceat(v, first)) / 2, 1.0)
        unit.append((v - (np.add.reduceat(v, first) / size)[page]) / half[page])
    place = unit[1] + 1j * unit[0]
    sector = np.minimum(((np.angle(place) / (2 * np.pi) + 0.5) * sectors).astype(int), sectors - 1)
    far = np.zeros(len(first) * sectors)
    np.maximum.at(far, page * sectors + sector, np.abs(place))
    far = far.reshape(-1, sectors)
    known, ranked, each = (far > 0).sum(1), np.sort(np.where(far > 0, far, np.inf), axis=1), np.arange(len(far))
    middle = np.where(known > 0, (ranked[each, np.maximum(known - 1, 0) // 2] + ranked[each, np.minimum(known // 2, sectors - 1)]) / 2, 0.0)
    return np.where(far > 0, far, middle[:, None])


def harmonics(far: np.ndarray, low: int = 6, high: int = 20) -> np.ndarray:
    """``harmonic`` of every profile."""
    middle, waves = np.median(far, axis=1), np.abs(np.fft.rfft(far))[:, low : high + 1].max(1)
    return np.divide(2 * waves, far.shape[1] * middle, out=np.zeros(len(far)), where=middle > 0)


def measures(masks: np.ndarray, k: int = 3, keep: float = 0.1, least: int = 2) -> list[np.ndarray]:
    """What ``page_masks`` gives of every mask: covered share, parts, fill, bands, gutters, depth, cells left, wave."""
    inner, count = masks[:, :GRID, :GRID], masks.sum((1, 2))
    extent = [np.where(f.any(1), GRID - f[:, ::-1].argmax(1) - f.argmax(1), 0) for f in (inner.any(2), inner.any(1))]
    bands = np.diff(inner.any(2).astype(np.int8), axis=1, prepend=0, append=0).clip(0).sum(1)
    depth, left = np.zeros(len(masks), int), count
    for tried in (least, k):  # the deepest that leaves enough counts
        rest = erode(inner, tried).sum((1, 2))
        enough = (count > 0) & (rest >= keep * count)
        depth, left = np.where(enough, tried, depth), np.where(enough, rest, left)
    start, end, root = parts_of_runs(masks)
    tops = np.flatnonzero(root == np.arange(len(root)))
    page, size = start // masks[0].size, np.bincount(root, end - start, len(root)).astype(int)
    ranked = tops[np.lexsort((tops, -size[tops], page[tops]))]
    largest = ranked[np.unique(page[ranked], return_index=True)[1]]
    mine = np.isin(root, largest)
    n, wave = (end - start)[mine], np.zeros(len(masks))
    if len(n):
        of, y, x = np.unravel_index(np.repeat(start[mine] - n.cumsum() + n, n) + np.arange(n.sum()), masks.shape)
        filled, of = np.unique(of, return_inverse=True)
        wave[filled] = harmonics(profiles(of, y, x))
    fill = np.divide(count, extent[0] * extent[1], out=np.zeros(len(masks)), where=count > 0)
    return [count / GRID**2, np.bincount(page[tops], minlength=len(masks)), fill, bands, np.maximum(bands - 1, 0), depth, left, wave]


def q_page_masks(s: SparkSession, d: str) -> DataFrame:
    """Shape of every page's boxes: covered share, parts, fill, bands and gutters, strongest wave."""
    low = lambda c: f"least(greatest({c}, 0) div {CELL}, {GRID})"
    high = lambda c: f"least((greatest({c}, 0) + {CELL - 1}L) div {CELL}, {GRID})"
    # The cells a box covers, packed: as many different ones as the grid has, however many boxes a page has.
    packed = F.expr(" | ".join(f"shiftleft(cast({c} AS int), {n})" for c, n in ((low("y0"), 21), (high("y1"), 14), (low("x0"), 7), (high("x1"), 0))))
    pages = boxes(s, d).groupBy(*PAGE).agg(F.collect_set(packed).alias("cases"))
    names = [*PAGE, "part", "morceaux", "remplissage", "bandes", "gouttieres", "profondeur", "reste", "harmonique"]
    kinds = [pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), _AT_ONCE):
                b = whole.slice(k, _AT_ONCE)
                cells = b.column("cases")
                masks = drawn(cells.value_parent_indices().to_numpy(), cells.flatten().to_numpy(), len(b))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in PAGE), *(pa.array(x, kind) for x, kind in zip(measures(masks), kinds))], names=names)

    return pages.mapInArrow(measure, "oeuvre string, tome string, planche int, part double, morceaux int, remplissage double, bandes int, gouttieres int, profondeur int, reste int, harmonique double")


QUERIES = {"page_masks": q_page_masks}
SQL: dict[str, str] = {}
