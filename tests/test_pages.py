"""Page operators against plain numpy on small pages."""

import statistics
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sealwright.functions import reports as fr
from sealwright.operators import components, pages as pg
from sealwright.sources import evidence as esrc, reports as rsrc


def pixels(spark, grids):
    rows = [(p, y, x, int(v)) for p, g in grids.items() for (y, x), v in np.ndenumerate(g)]
    return spark.createDataFrame(rows, "page_id string, y int, x int, v int")


def test_pixel_statistics(spark):
    rng = np.random.default_rng(1)
    grids = {"a": rng.integers(0, 256, (9, 7)), "white": np.full((4, 4), 255), "half": np.array([[249, 251]])}
    got = {r.page_id: r for r in pg.clip_stats(pixels(spark, grids)).collect()}
    for name, g in grids.items():
        assert (got[name].clipped_glare_pixels, got[name].clipped_shadow_pixels) == ((g >= 250).sum(), (g <= 5).sum())
        assert got[name].paper_at_clip == (np.median(g) >= 250)
    hist = pg.histogram(pixels(spark, grids)).where("page_id = 'a'").collect()
    assert {r.v: r.n for r in hist} == {int(v): int(n) for v, n in zip(*np.unique(grids["a"], return_counts=True))}


def best_threshold(g):
    v, best, at = g.ravel(), 0.0, 0
    for t in range(256):
        low, high = v[v <= t], v[v > t]
        if len(low) and len(high):
            score = len(low) * len(high) * (low.mean() - high.mean()) ** 2
            if score > best * (1 + 1e-12):
                best, at = score, t
    return at


def test_threshold_and_ink(spark):
    rng = np.random.default_rng(2)
    grids = {f"p{i}": np.where(rng.random((12, 10)) < share, rng.integers(10, 80, (12, 10)), rng.integers(170, 250, (12, 10)))
             for i, share in enumerate((0.1, 0.3, 0.8))}
    grids["flat"] = np.full((5, 5), 90)
    got = {r.page_id: r for r in pg.otsu(pg.histogram(pixels(spark, grids))).collect()}
    ink = {(r.page_id, r.y, r.x) for r in pg.ink_pixels(pixels(spark, grids)).collect()}
    for name, g in grids.items():
        t = best_threshold(g)
        mask = g <= t
        if mask.sum() > g.size // 2:
            mask = ~mask
        assert got[name].threshold == t and got[name].ink_pixels == mask.sum()
        assert {(y, x) for p, y, x in ink if p == name} == {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}


def flood(mask):
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        todo, cells = [(y, x)], []
        seen[y, x] = True
        while todo:
            cy, cx = todo.pop()
            cells.append((cy, cx))
            for ny in range(max(0, cy - 1), min(mask.shape[0], cy + 2)):
                for nx in range(max(0, cx - 1), min(mask.shape[1], cx + 2)):
                    if mask[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = True
                        todo.append((ny, nx))
        ys, xs = [c[0] for c in cells], [c[1] for c in cells]
        out.append((int(min(xs)), int(min(ys)), int(max(xs) - min(xs) + 1), int(max(ys) - min(ys) + 1), len(cells)))
    return sorted(out)


@pytest.mark.parametrize("band", [3, 256])
def test_regions_like_flood_fill(spark, band):
    rng = np.random.default_rng(4)
    masks = {f"m{i}": rng.random((17, 23)) < share for i, share in enumerate((0.2, 0.4, 0.55))}
    rows = [(p, int(y), int(x)) for p, m in masks.items() for y, x in zip(*np.nonzero(m))]
    spans = pg.mask_spans(spark.createDataFrame(rows, "page_id string, y int, x int"))
    got = pg.regions(spans, band_rows=band).collect()
    for name, m in masks.items():
        assert sorted((r.x, r.y, r.w, r.h, r.area) for r in got if r.page_id == name) == flood(m)
    top = pg.top_regions(pg.regions(spans, band_rows=band), 2).collect()
    assert len(top) == 6 and all(r.rank <= 2 for r in top)


def test_long_chain_settles(spark):
    n = 300
    nodes = spark.createDataFrame([("s", i) for i in range(n)] + [("t", 5)], "page_id string, node bigint")
    edges = spark.createDataFrame([("s", i, i + 1) for i in range(n - 1)], "page_id string, a bigint, b bigint")
    got = components.connected_components(nodes, edges, ["page_id"], max_rounds=14).collect()
    assert {(r.page_id, r.component) for r in got} == {("s", 0), ("t", 5)} and len(got) == n + 1


@pytest.mark.parametrize("tile", [3, 64])
def test_density(spark, tile):
    rng = np.random.default_rng(6)
    ink = rng.random((30, 40)) < 0.4
    boxes = [(0, 0, 40, 30), (5, 6, 11, 9), (5, 6, 1, 1), (20, 10, 13, 20)]
    blocks = spark.createDataFrame([("p", *b) for b in boxes], "page_id string, x int, y int, w int, h int")
    dots = spark.createDataFrame([("p", int(y), int(x)) for y, x in zip(*np.nonzero(ink))], "page_id string, y int, x int")
    got = {(r.x, r.y, r.w, r.h): r.density for r in pg.block_density(blocks, dots, tile).collect()}
    assert got == {b: round(float(ink[b[1]:b[1] + b[3], b[0]:b[0] + b[2]].sum()) / (b[2] * b[3]), 4) for b in boxes}


def test_blocks_in_order(spark):
    boxes = [(10, 0, 500, 20), (10, 40, 200, 10), (300, 45, 200, 10), (10, 60, 200, 10), (300, 65, 200, 10)]
    blocks = spark.createDataFrame([(p, *b, 1000, 1300) for p in ("p", "q") for b in boxes],
                                   "page_id string, x int, y int, w int, h int, page_width int, page_height int")
    out = pg.reading_order(pg.cap_blocks(blocks), min_col_gap=9).orderBy("page_id", "order").collect()
    assert [(r.x, r.y) for r in out] == [(boxes[i][0], boxes[i][1]) for i in (0, 1, 3, 2, 4)] * 2
    assert {(r.gap, r.cut) for r in pg.widest_gap(blocks, "y").collect()} == {(20, 40)}
    col = F.when(F.col("w") > 300, 2).otherwise((F.col("x") > 250).cast("int")).alias("column")
    naive = pg.naive_order(blocks).select("page_id", "order", col)
    cut = pg.reading_order(blocks, min_col_gap=9).select("page_id", "order", col)
    assert {r.switches for r in pg.column_switches(naive).collect()} == {4}
    assert {r.switches for r in pg.column_switches(cut).collect()} == {2}


def test_small_and_surplus_blocks_are_dropped(spark):
    rows = [("p", i, 0, 3, 5 + i % 3, 1000, 4000) for i in range(20)] + [("p", 0, 0, 4, 4, 1000, 4000)]
    blocks = spark.createDataFrame(rows, "page_id string, x int, y int, w int, h int, page_width int, page_height int")
    # 1000 x 4000 pixels: blocks need 20 pixels
    assert [r.area for r in pg.cap_blocks(blocks).collect()] == [21] * 6
    assert [(r.x, r.area) for r in pg.cap_blocks(blocks, 2).orderBy("x").collect()] == [(2, 21), (5, 21)]


def test_video(spark):
    frames = spark.createDataFrame([("v", 0, 2.0), ("v", 1, 5.0), ("v", 2, 5.0)], "video_id string, frame int, sharpness double")
    assert pg.reference_frame(frames).first().reference == 1
    many = spark.range(1000).select(F.lit("v").alias("video_id"), F.col("id").alias("frame"), F.lit(1000).alias("frame_count"))
    assert [r.frame for r in pg.sample_frames(many).orderBy("frame").collect()] == [71 * i for i in range(13)]
    blind = many.withColumn("frame_count", F.lit(0))
    assert [r.frame for r in pg.sample_frames(blind).orderBy("frame").collect()] == [4 * i for i in range(14)]


def one_pixel(values, valid, hi=250, lo=5):
    """What a pixel shows at last: values is a list of frames, each a list of channels; the first is shown.

    A frame that is burnt out or black there has no say, unless all valid ones are; then nothing is known better."""
    shown = [f for f, ok in zip(values, valid) if ok]
    dark_or_burnt = [not lo < statistics.fmean(f) < hi for f in shown]
    if all(dark_or_burnt) or not dark_or_burnt[0]:
        return list(values[0]), False
    told = [f for f, bad in zip(shown, dark_or_burnt) if not bad]
    return [round(statistics.median(f[c] for f in told)) for c in range(3)], True


def test_one_pixel_by_hand():
    assert one_pixel([[255] * 3, [10, 20, 30], [20, 30, 41], [0] * 3], [True] * 4) == ([15, 25, 36], True)
    assert one_pixel([[255] * 3, [254] * 3, [9, 9, 9]], [True, True, False]) == ([255] * 3, False)
    assert one_pixel([[7] * 3, [90] * 3], [True, True]) == ([7] * 3, False)


def test_composite_pixel_by_pixel(spark):
    rng = np.random.default_rng(8)
    stack = rng.integers(0, 256, (5, 6, 7, 3))
    stack[rng.random((5, 6, 7)) < 0.4] = 255
    stack[:, 0, 0] = 255
    valid = rng.random((5, 6, 7)) < 0.8
    valid[0] = True
    rows = [(p, f, y, x, c, int(stack[f, y, x, c]), bool(valid[f, y, x]))
            for p, frames in (("p", 5), ("two", 2)) for f in range(frames) for y in range(6) for x in range(7) for c in range(3)]
    samples = spark.createDataFrame(rows, "page_id string, frame int, y int, x int, channel int, v int, valid boolean")
    ref = spark.createDataFrame([("p", 0), ("two", 0)], "page_id string, reference int")
    out = pg.composite(samples, ref)
    known = {(y, x): one_pixel(stack[:, y, x].tolist(), valid[:, y, x].tolist()) for y in range(6) for x in range(7)}
    got = {(r.page_id, r.y, r.x, r.channel): (r.v, r.replaced) for r in out.collect()}
    for y in range(6):
        for x in range(7):
            for c in range(3):
                assert got["p", y, x, c] == (known[y, x][0][c], known[y, x][1])
                assert got["two", y, x, c] == (stack[0, y, x, c], False)
    summary = {r.page_id: r for r in pg.composite_summary(out).collect()}
    assert summary["p"].replaced_fraction == round(sum(done for _, done in known.values()) / 42, 6) and summary["two"].fallback


def test_status_edges(spark):
    rows = [(0.30, 5, 0, True, True), (0.3000004, 5, 0, True, True), (0.31, 5, 0, True, True), (0.0, 0, 0, True, True),
            (0.0, 0, 0, True, False), (0.0, 0, 3, False, False), (0.0, 0, 0, False, False), (0.1, 4, 0, False, False)]
    df = spark.createDataFrame(rows, "f double, m int, s int, r boolean, ch boolean")
    got = [r.st for r in df.select(fr.page_status(F.col("f"), F.col("m"), F.col("s"), F.col("r"), F.col("ch")).alias("st")).collect()]
    assert got == ["repaired", "repaired", "skipped_damage_too_extensive", "enhanced", "stable", "detected_not_repaired", "stable",
                   "detected_not_repaired"]
    lifted = df.select(fr.page_status(F.col("f"), F.col("m"), F.col("s"), F.col("r"), F.col("ch"), F.lit(0.2)).alias("st")).collect()
    assert [r.st for r in lifted][3:7] == ["repaired", "repaired", "detected_not_repaired", "stable"]


def test_percent_and_odd(spark):
    df = spark.createDataFrame([(0.0,), (0.0004,), (0.001,), (0.3,), (0.0123,), (0.000949,)], "x double")
    assert [r.p for r in df.select(fr.pct(F.col("x")).alias("p")).collect()] == [
        "0.0%", "under 0.1%", "0.1%", "30.0%", "1.2%", "under 0.1%"]
    df = spark.createDataFrame([(8.5, 3), (9.5, 3), (2.0, 3), (4.0, 3), (1.0, 7)], "x double, m int")
    assert [r.o for r in df.select(fr.odd(F.col("x"), F.col("m")).alias("o")).collect()] == [9, 11, 3, 5, 7]


def test_findings_of_a_repaired_page(spark, tmp_path):
    (tmp_path / "page.json").write_text('{"width": 800,\n "status": "repaired", "masked_fraction": 0.019423,'
                                        '"glare_regions": [{"x":1,"y":1,"w":2,"h":2,"area":4}], "shadow_regions": [{"x":9,"y":9,"w":2,"h":2,"area":4}],'
                                        '"repair": {"illumination_flattened": true, "shadow_filled": false}, "reading_order_nodes": 25}')
    reports = rsrc.read_page_reports(spark, str(tmp_path))
    found = rsrc.with_findings(reports).orderBy("position").collect()
    assert [f.level for f in found] == ["ok", "warn", "info", "info"]
    assert found[1].text.startswith("1 glare spot found. Faded text around it was restored. The blown-out centre (1.9% of the page)")
    assert found[2].text.startswith("1 solid black area left") and found[3].text == "Reading order mapped: 25 text blocks."
    assert found[0].page_id.endswith("page.json")


def png(grid):
    raw = b"".join(b"\0" + bytes(row) for row in grid.astype(np.uint8).tolist())
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", grid.shape[1], grid.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_rasters(spark, tmp_path):
    grid = np.random.default_rng(9).integers(0, 256, (5, 4))
    (tmp_path / "a.png").write_bytes(png(grid))
    (tmp_path / "junk.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    scanned = esrc.scan_pages(spark, str(tmp_path))
    sizes = {r.path.rsplit("/", 1)[1]: (r.width, r.height) for r in scanned.collect()}
    assert sizes == {"a.png": (4, 5), "junk.png": (-1, -1)}
    hist = {r.v: r.n for r in rsrc.raster_histogram(scanned).collect()}
    assert hist == {int(v): int(n) for v, n in zip(*np.unique(grid, return_counts=True))}
    cells = {(r.y, r.x): r.v for r in rsrc.raster_pixels(scanned).collect()}
    assert cells == {(int(y), int(x)): int(v) for (y, x), v in np.ndenumerate(grid)}
