"""Scanned pages: grey rasters cleaned, straightened, and searched for cells of bordered tables.

A page is a row (doc_id, page_no, width, height, grey), grey one byte a pixel,
row by row from the top. Each function works on one page in numpy, inside a
task; pages are independent, so nothing is shuffled. Rows of cells are grouped by
``layout.box_grid`` afterwards.

Defined results: a page whose bytes are not width times height is an error; a page
without dark pixels has skew 0 and no cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layout

RASTER = "doc_id string, page_no int, width int, height int, grey binary"
#: Sides of the windows, and what a pixel is below its window's mean, for reading text and for finding lines.
TEXT_WINDOW, TEXT_BELOW, LINE_WINDOW, LINE_BELOW = 11, 2, 15, 5
#: A ruled line is at least this share of its page's side, twice; and the largest skew that is looked for, in degrees.
LINE_SHARE, MOST_SKEW = 20, 5.0


def median3(grey: np.ndarray) -> np.ndarray:
    """The median of each pixel and its eight neighbours; edges repeat."""
    p = np.pad(grey, 1, mode="edge")
    # Each column's three are sorted once; the median is that of the greatest least, the middle middle and the least greatest.
    a, b, c = p[:-2], p[1:-1], p[2:]
    low, high = np.minimum(a, b), np.maximum(a, b)
    least, most = np.minimum(low, c), np.maximum(high, c)
    middle = np.maximum(low, np.minimum(high, c))
    sides = lambda m: (m[:, :-2], m[:, 1:-1], m[:, 2:])
    of = lambda x, y, z: np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))
    x, y, z = sides(least)
    i, j, k = sides(most)
    return of(np.maximum(np.maximum(x, y), z), of(*sides(middle)), np.minimum(np.minimum(i, j), k))


def dark(grey: np.ndarray, window: int, below: float) -> np.ndarray:
    """Where a pixel is more than ``below`` darker than the mean of the window around it, by sums over rectangles."""
    r = window // 2
    p = np.pad(grey.astype(np.int64), ((r + 1, r), (r + 1, r)), mode="edge")
    p[0], p[:, 0] = 0, 0
    s = p.cumsum(axis=0).cumsum(axis=1)
    h, w = grey.shape
    total = s[window : window + h, window : window + w] - s[:h, window : window + w] - s[window : window + h, :w] + s[:h, :w]
    return grey * float(window * window) < total - below * window * window


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of runs of True along rows, in order."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    return row, start, np.nonzero(edge == -1)[1]


def long_runs(mask: np.ndarray, least: int) -> np.ndarray:
    """The mask's runs of at least so many pixels along rows."""
    row, start, end = runs(mask)
    kept = end - start >= least
    out = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int32)
    np.add.at(out, (row[kept], start[kept]), 1)
    np.add.at(out, (row[kept], end[kept]), -1)
    return out.cumsum(axis=1)[:, :-1] > 0


def components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Boxes (x0, y0, x1, y1) of the mask's four-connected components, and how many pixels each has, in order of their first run.

    Runs are labelled, not pixels: a run takes the least label of those that it
    touches in the row above or below, and labels are followed to their own until
    nothing changes.
    """
    row, start, end = runs(mask)
    n, wide = len(row), mask.shape[1] + 1
    if not n:
        return np.empty((0, 4), np.int64), np.empty(0, np.int64)
    starts, ends = row * wide + start, row * wide + end
    low = np.searchsorted(ends, (row - 1) * wide + start, "right")
    high = np.searchsorted(starts, (row - 1) * wide + end, "left")
    count = np.maximum(high - low, 0)
    below = np.repeat(np.arange(n), count)
    above = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    label = np.arange(n)
    while True:
        least = np.minimum(label[below], label[above])
        new = label.copy()
        np.minimum.at(new, label[below], least)
        np.minimum.at(new, label[above], least)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    roots, own = np.unique(label, return_inverse=True)
    boxes = np.empty((len(roots), 4), np.int64)
    for k, (f, v, first) in enumerate(((np.minimum, start, wide), (np.minimum, row, mask.shape[0]), (np.maximum, end, 0), (np.maximum, row + 1, 0))):
        boxes[:, k] = first
        f.at(boxes[:, k], own, v)
    return boxes, np.bincount(own, end - start).astype(np.int64)


def table_cells(grey: np.ndarray) -> np.ndarray:
    """Boxes of what ruled lines enclose: the background's components within the lines' mask that don't reach the page's edge."""
    ink = dark(grey, LINE_WINDOW, LINE_BELOW)
    h, w = grey.shape
    # What two openings by a line of this length leave.
    lines = long_runs(ink, max(2 * (w // LINE_SHARE) - 1, 1)) | long_runs(ink.T, max(2 * (h // LINE_SHARE) - 1, 1)).T
    boxes, _ = components(~lines)
    inside = (boxes[:, 0] > 0) & (boxes[:, 1] > 0) & (boxes[:, 2] < w) & (boxes[:, 3] < h)
    return boxes[inside]


def skew(ink: np.ndarray, most: float = MOST_SKEW) -> float:
    """The angle in degrees, counter-clockwise, by which lines of ink are turned: where their profile along rows is sharpest, by half degrees, then by twentieths."""
    y, x = np.nonzero(ink)
    if not len(y):
        return 0.0
    y, across = y.astype(np.int32), np.arange(ink.shape[1])

    def sharp(angle: float) -> float:
        down = np.rint(across * np.tan(np.radians(angle))).astype(np.int32)
        n = np.bincount(y + (down - down.min())[x]).astype(float)
        return float((n * n).sum())

    best = max(np.arange(-most, most + 0.01, 0.5), key=sharp)
    return round(float(max(np.arange(best - 0.5, best + 0.51, 0.05), key=sharp)), 2)


def turned(grey: np.ndarray, angle: float) -> np.ndarray:
    """The page turned clockwise by an angle about its middle; white comes in from outside."""
    h, w = grey.shape
    t = np.radians(angle)
    y, x = np.ogrid[:h, :w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.rint(np.cos(t) * (x - cx) + np.sin(t) * (y - cy) + cx).astype(np.int64)
    sy = np.rint(-np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy).astype(np.int64)
    there = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(there, grey.ravel()[np.clip(sy, 0, h - 1) * w + np.clip(sx, 0, w - 1)], np.uint8(255))


def prepared(grey: np.ndarray) -> tuple[np.ndarray, float]:
    """A page as recognition wants it, black on white without specks and straight, and the skew that it had; one below half a degree stays."""
    ink = dark(median3(grey), TEXT_WINDOW, TEXT_BELOW)
    angle = skew(ink)
    page = np.where(ink, 0, 255).astype(np.uint8)
    return (turned(page, angle) if abs(angle) > 0.5 else page), angle


def _pages(pages: DataFrame, schema: str, work: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
    """pages without their rasters, and a row of work for each of what is found.

    A plain function takes few rows at a time, where an Arrow batch has ten
    thousand pages whatever their size.
    """

    def run(width: int, height: int, grey: bytes) -> list[tuple]:
        return work(np.frombuffer(grey, np.uint8).reshape(height, width))

    found = F.udf(run, f"array<struct<{schema}>>", useArrow=False)("width", "height", "grey")
    others = [c for c in pages.columns if c != "grey"]
    return pages.select(*others, F.inline(found))


def cells(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, page_width, page_height, x0, y0, x1, y1) of cells that are neither specks nor pages."""
    found = _pages(pages.select("doc_id", "page_no", "width", "height", "grey"), "x0 double, y0 double, x1 double, y1 double", lambda g: [tuple(map(float, b)) for b in table_cells(g)])
    return layout.cells_of_interest(found.withColumnsRenamed({"width": "page_width", "height": "page_height"}))


def straightened(pages: DataFrame) -> DataFrame:
    """pages with their rasters as prepared() has them, and the skew that they had; other columns are kept."""

    def work(grey: np.ndarray) -> list[tuple]:
        page, angle = prepared(grey)
        return [(page.tobytes(), angle)]

    return _pages(pages, "grey binary, skew double", work)
