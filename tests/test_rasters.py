"""Scanned pages against plain loops, and the looks of a workbook's cells."""

import re
import zipfile

import numpy as np
import pytest

from tallyforge.operators import rasters
from tallyforge.sources import workbook


def flood(mask):
    """Boxes and sizes of components by following each pixel."""
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        todo, own = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            own.append((a, b))
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    todo.append((c, d))
        ys, xs = [p[0] for p in own], [p[1] for p in own]
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(own)))
    return sorted(out)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.6, 0.9, 1.0])
def test_components(share):
    for seed in range(8):
        mask = np.random.default_rng(seed).random((23, 31)) < share
        boxes, sizes = rasters.components(mask)
        assert sorted((*b, n) for b, n in zip(boxes.tolist(), sizes.tolist())) == flood(mask)
    spiral = np.array([[c == "#" for c in row] for row in ("#########", "........#", "#######.#", "#.....#.#", "#.###.#.#", "#...#.#.#", "#####.#.#", "......#.#", "#######.#")])
    boxes, sizes = rasters.components(spiral)
    assert sorted((*b, n) for b, n in zip(boxes.tolist(), sizes.tolist())) == flood(spiral)


def test_filters_by_definition():
    g = np.random.default_rng(1).integers(0, 256, (20, 17)).astype(np.uint8)
    p, q = np.pad(g, 1, mode="edge"), np.pad(g.astype(float), 5, mode="edge")
    for y in range(20):
        for x in range(17):
            assert rasters.median3(g)[y, x] == np.median(p[y : y + 3, x : x + 3])
            assert rasters.dark(g, 11, 2)[y, x] == (g[y, x] < q[y : y + 11, x : x + 11].mean() - 2)
    mask = g < 128
    for y, row in enumerate(rasters.long_runs(mask, 3)):
        text = "".join("#" if v else "." for v in mask[y])
        assert "".join("#" if v else "." for v in row) == re.sub("#+", lambda m: m[0] if len(m[0]) > 2 else "." * len(m[0]), text)


def test_skew_and_empty_pages():
    page = np.full((200, 260), 240, np.uint8)
    assert rasters.skew(page < 128) == 0 and len(rasters.table_cells(page)) == 0
    for y in range(40, 160, 14):
        page[y : y + 5, 30:230:2] = 30
    for angle in (-4.3, -1.0, 0.0, 2.2, 3.7):
        ink = rasters.turned(page, -angle) < 128
        assert abs(rasters.skew(ink) - angle) <= 0.5
        assert abs(rasters.skew(rasters.prepared(rasters.turned(page, -angle))[0] < 128)) <= 0.5


def test_looks_of_cells(tmp_path):
    at = str(tmp_path / "x.xlsx")
    workbook.write_workbook(at, [("Summary", [["No", "Status", "Total"], ["1", "PASS", "12.50"], ["2", "FAIL", "3"], ["3", "WARNING", "other"]]), ("More", [["head"], ["PASS"]])])
    with zipfile.ZipFile(at) as z:
        style, one, two = (z.read(f"xl/{n}.xml").decode() for n in ("styles", "worksheets/sheet1", "worksheets/sheet2"))
    fills = re.findall(r'<fgColor rgb="FF(\w+)"', style)
    looks = re.findall(r'<xf numFmtId="(\d+)" fontId="(\d)" fillId="(\d)"', style)
    look = lambda sheet, ref: (m := re.search(rf'<c r="{ref}"[^>]*?(?: s="(\d+)")?(?: t="\w+")?(?: s="(\d+)")?>', sheet)) and looks[int(m[1] or m[2] or 0)]
    fill = lambda sheet, ref: (k := int(look(sheet, ref)[2])) and fills[k - 2]
    assert fill(one, "A1") == workbook.FILLS["header"] == fill(two, "A1") and look(one, "A1")[1] == "1"
    assert [fill(one, f"B{i}") for i in (2, 3, 4)] == [workbook.FILLS[s] for s in ("PASS", "FAIL", "WARNING")] and fill(two, "A2") == workbook.FILLS["PASS"]
    assert look(one, "C2")[0] == "164" and look(one, "C3")[0] == "0" and not fill(one, "C4") and workbook.CURRENCY in style


def test_pages_at_once(spark):
    """Pages are dealt to many tasks, and a worker holds few of them at a time, whatever the table's files are."""
    from tallyforge.plans import scans

    frame = scans.q_image_skew(spark, "/root/testdata/sf0.01")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("RepartitionByExpression") == 1 and plan.count("BatchEvalPython") == 3
    assert frame.count() == 100
    grey = np.full((40, 60), 255, np.uint8)
    rows = spark.createDataFrame([("a", 1, 60, 40, bytearray(grey.tobytes()), "kept")], rasters.RASTER + ", more string")
    assert rasters.straightened(rows).select("doc_id", "more", "skew").collect() == [("a", "kept", 0.0)] and rasters.cells(rows).count() == 0
