"""Page damage, layout and video compositing over pixel, block and sample tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.reports import GLARE_LEVEL, SHADOW_LEVEL
from ..session import broadcast_if_small, spread, stage
from .batches import borders, whole_groups
from .components import connected_components
from .joins import skew_join
from .ordered import Running, bucket_of, prefix_scan, range_bucketed

# Caps and sampling of the page engine.
MAX_REGIONS = 50
MAX_NODES = 5000
SHOWN_NODES = 400
MAX_FRAMES_READ = 900
MAX_FRAMES_KEPT = 14
MIN_FRAMES_USED = 3

GROUP_ROWS = 200_000  # blocks one task orders in arrays


# ---- pixel statistics -------------------------------------------------------------------

def clip_stats(pixels: DataFrame, hi: int = GLARE_LEVEL, lo: int = SHADOW_LEVEL) -> DataFrame:
    """Clipped pixel counts per page and whether the paper itself sits at clip level.

    The exact median keeps a count per distinct value, at most 256 of them, and combines map-side.
    """
    v = F.col("v")
    return pixels.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("total_pixels"), F.count_if(v >= hi).alias("clipped_glare_pixels"),
        F.count_if(v <= lo).alias("clipped_shadow_pixels"),
        (F.percentile(v, F.lit(0.5)) >= hi).alias("paper_at_clip"))


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("page_id", "v").agg(F.count(F.lit(1)).alias("n"))


def masked_fractions(mask: DataFrame) -> DataFrame:
    """Share of masked pixels per page, six decimals half-even."""
    return mask.groupBy("page_id").agg(
        F.count_if(F.col("m") > 0).alias("masked_pixels"), F.count(F.lit(1)).alias("total_pixels")).withColumn(
        "masked_fraction", F.bround(F.col("masked_pixels") / F.col("total_pixels"), 6))


def otsu(hist: DataFrame) -> DataFrame:
    """Threshold with the largest between-class variance, and whether the page is inverted.

    A histogram has at most 256 rows per page, so the running sums stay small. Ink is at or below
    the threshold; when that is more than half of the page, ink is the rest.
    """
    running = Window.partitionBy("page_id").orderBy("v")
    whole = Window.partitionBy("page_id")
    c = F.col
    sums = hist.select("page_id", "v", "n", F.sum("n").over(running).alias("nt"),
                       F.sum(c("n") * c("v")).over(running).alias("st"),
                       F.sum("n").over(whole).alias("nn"), F.sum(c("n") * c("v")).over(whole).alias("ss"))
    gap = (c("nn") * c("st") - c("nt") * c("ss")).cast("double")
    score = F.when(c("nt") < c("nn"), gap * gap / (c("nt") * (c("nn") - c("nt"))).cast("double"))
    best = sums.withColumn("score", score).groupBy("page_id").agg(
        F.max("nn").alias("pixels"),
        F.max_by("v", F.when(c("score").isNotNull(), F.struct("score", -c("v")))).alias("t"),
        F.max_by("nt", F.when(c("score").isNotNull(), F.struct("score", -c("v")))).alias("below"),
        F.coalesce(F.sum(F.when(c("v") <= 0, c("n"))), F.lit(0)).alias("zeros"))
    ink = F.coalesce(c("below"), c("zeros"))
    inverted = ink > F.floor(c("pixels") / 2)
    return best.select("page_id", F.coalesce("t", F.lit(0)).alias("threshold"), inverted.alias("inverted"),
                       F.when(inverted, c("pixels") - ink).otherwise(ink).alias("ink_pixels"))


def ink_pixels(pixels: DataFrame) -> DataFrame:
    """Positions of ink per page after thresholding."""
    cut = otsu(histogram(pixels)).select("page_id", "threshold", "inverted")
    joined = skew_join(pixels, cut, ["page_id"])
    return joined.where((F.col("v") <= F.col("threshold")) != F.col("inverted")).select("page_id", "y", "x")


# ---- page keys in arrays ------------------------------------------------------------------

def _with_page_key(rows: DataFrame) -> DataFrame:
    """``page_id`` as text that is never null: arrays would turn a null among numbers into a number unlike itself, and
    large numbers beside it into others."""
    return rows.withColumn("page_id", F.coalesce(F.concat(F.lit("p"), F.col("page_id").cast("string")), F.lit("n")))


def _from_page_key(rows: DataFrame, page_type: str) -> DataFrame:
    return rows.withColumn("page_id", F.when(F.col("page_id") != "n", F.expr("substring(page_id, 2)").cast(page_type)))


# ---- regions ----------------------------------------------------------------------------

def mask_spans(mask: DataFrame) -> DataFrame:
    """Runs of masked pixels on a row: page_id, y, x0, x1. Row width is bounded by the pixel limit."""
    w = Window.partitionBy("page_id", "y").orderBy("x")
    runs = mask.select("page_id", "y", "x", (F.col("x") - F.row_number().over(w)).alias("run"))
    return runs.groupBy("page_id", "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("run")


def span_edges(spans: DataFrame, tile: int = 256) -> DataFrame:
    """Touching runs on neighbouring rows (corners count): page_id, a, b as node numbers.

    Runs are joined on shared column tiles, so a row with many runs never meets the whole row above.
    """
    c = F.col
    upper = spans.select("page_id", (c("y") + 1).alias("row"), c("x0").alias("u0"), c("x1").alias("u1"),
                         F.explode(F.sequence(F.floor(c("x0") / tile), F.floor(c("x1") / tile))).alias("tile"))
    lower = spans.select("page_id", c("y").alias("row"), c("x0").alias("l0"), c("x1").alias("l1"),
                         F.explode(F.sequence(F.floor((c("x0") - 1) / tile), F.floor((c("x1") + 1) / tile))).alias("tile"))
    touching = upper.join(lower, ["page_id", "row", "tile"]).where((c("l0") <= c("u1") + 1) & (c("u0") <= c("l1") + 1))
    return touching.select("page_id", span_node(c("row") - 1, c("u0")).alias("a"),
                           span_node(c("row"), c("l0")).alias("b")).distinct()


def span_node(y: Column, x0: Column) -> Column:
    """Node number of a run: unique per page, in row order."""
    return y.cast("bigint") * F.lit(1 << 32) + x0


BAND_ROWS = 256


def _touching_roots(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Smallest row index of the region each run belongs to; runs sorted by (group, y, x0), groups apart.

    Runs of a row do not overlap, so those that touch a run from the row below are one stretch, found by binary search.
    Labels then sink to the smallest of each region by hooking and pointer jumping, a few passes over whole arrays.
    """
    n = len(y)
    if not n:
        return np.zeros(0, dtype=np.int64)
    group = np.zeros(n, dtype=np.int64) if group is None else group
    same = group[1:] == group[:-1]
    # rows that follow each other get numbers one apart, all others more
    step = np.where(same & (y[1:] == y[:-1]), 0, np.where(same & (y[1:] == y[:-1] + 1), 1, 2))
    row = np.concatenate([[0], np.cumsum(step)])
    low = int(x0.min()) - 1
    width = int(x1.max()) - low + 3
    lefts, rights = row * width + (x0 - low), row * width + (x1 - low)
    first = np.searchsorted(rights, (row + 1) * width + (x0 - low) - 1, "left")
    after = np.searchsorted(lefts, (row + 1) * width + (x1 - low) + 1, "right")
    count = np.maximum(after - first, 0)
    upper = np.repeat(np.arange(n), count)
    lower = np.arange(len(upper)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    label = np.arange(n)
    while True:
        a, b = label[upper], label[lower]
        apart = a != b
        if not apart.any():
            return label
        upper, lower, a, b = upper[apart], lower[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            higher = label[label]
            if np.array_equal(higher, label):
                break
            label = higher


def _label_bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the first run of the region each run belongs to, per (page, band)."""
    for cols in whole_groups(batches, ("page_id", "band", "y", "x0", "x1"), ("page_id", "band")):
        edges = borders(cols["page_id"], cols["band"])
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        first = _touching_roots(cols["y"], cols["x0"], cols["x1"], group)
        yield pd.DataFrame({**cols, "root_y": cols["y"][first], "root_x": cols["x0"][first]})


def regions(spans: DataFrame, band_rows: int = BAND_ROWS) -> DataFrame:
    """Bounding box and area of every 8-connected region.

    Pages are cut into bands of rows. A task joins the runs of one band, two rows at a time, and
    gives one partial region per root; only regions that touch across a band border go through
    the distributed component search. A large page thus spreads over many tasks, and small pages
    need no iteration at all.
    """
    c = F.col
    page_type = spans.schema["page_id"].dataType.simpleString()
    spans = _with_page_key(spans)
    banded = spans.select("page_id", F.floor(c("y") / band_rows).alias("band"), c("y").cast("bigint").alias("y"),
                          c("x0").cast("bigint").alias("x0"), c("x1").cast("bigint").alias("x1"))
    labelled = stage(
        spread(banded, "page_id", "band").sortWithinPartitions("page_id", "band", "y", "x0").mapInPandas(
            _label_bands, "page_id string, band bigint, y bigint, x0 bigint, x1 bigint, root_y bigint, root_x bigint"),
        "region-bands").withColumn("root", span_node(c("root_y"), c("root_x")))
    partial = labelled.groupBy("page_id", "root").agg(
        F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"),
        F.sum(c("x1") - c("x0") + 1).alias("area"))
    rim = labelled.where((c("y") % band_rows == 0) | (c("y") % band_rows == band_rows - 1))
    across = span_edges(rim).where(F.floor(c("a") / F.lit(1 << 32) / band_rows) != F.floor(c("b") / F.lit(1 << 32) / band_rows))
    roots = rim.select("page_id", span_node(c("y"), c("x0")).alias("node"), "root")
    across = (across.join(roots.withColumnsRenamed({"node": "a", "root": "ra"}), ["page_id", "a"])
              .join(roots.withColumnsRenamed({"node": "b", "root": "rb"}), ["page_id", "b"])
              .select("page_id", c("ra").alias("a"), c("rb").alias("b")))
    if across.isEmpty():
        joined = partial.withColumn("component", c("root"))
    else:
        joined = connected_components(partial.withColumnRenamed("root", "node"), across, ["page_id"])
    return _from_page_key(joined.groupBy("page_id", "component").agg(
        F.min("left").alias("x"), F.min("top").alias("y"), (F.max("right") - F.min("left") + 1).alias("w"),
        (F.max("bottom") - F.min("top") + 1).alias("h"), F.sum("area").alias("area")), page_type)


def top_regions(found: DataFrame, limit: int = MAX_REGIONS) -> DataFrame:
    """The largest regions per page, by area, then position."""
    w = Window.partitionBy("page_id").orderBy(F.desc("area"), "y", "x", "component")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


# ---- blocks and reading order -----------------------------------------------------------

def cap_blocks(blocks: DataFrame, limit: int = MAX_NODES) -> DataFrame:
    """Blocks of at least max(16, height·width div 200000) pixels, the largest ``limit`` per page.

    Needs page_width and page_height. The ranking is cut per task before the shuffle.
    """
    c = F.col
    area = c("w").cast("bigint") * c("h")
    least = F.greatest(F.lit(16), F.floor(c("page_height").cast("bigint") * c("page_width") / 200_000))
    w = Window.partitionBy("page_id").orderBy(F.desc("area"), "y", "x", "w", "h")
    return (blocks.withColumn("area", area).where(c("area") >= least)
            .withColumn("rank", F.row_number().over(w)).where(c("rank") <= limit).drop("rank"))


def widest_gap(blocks: DataFrame, axis: str = "x", keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Widest empty band of each page along an axis and where it ends; 0, 0 without one.

    A page may hold any number of blocks: its blocks are range-partitioned, and only one summary row for each
    stretch is ordered per page.
    """
    size = "w" if axis == "x" else "h"
    c = F.col
    spans = blocks.select(*keys, c(axis).alias("start"), (c(axis) + c(size)).alias("end"))
    placed = range_bucketed(spans, keys, ["start", "end"])
    reached = prefix_scan(placed, keys, "_bucket", "_ord", [Running("_reach", "max", c("end"), inclusive=False)])
    gaps = reached.select(*keys, "start", (c("start") - c("_reach")).alias("gap"))
    best = gaps.groupBy(*keys).agg(F.max(F.when(c("gap") > 0, F.struct(c("gap").alias("gap"), (-c("start")).alias("at")))).alias("best"))
    return best.select(*keys, F.coalesce("best.gap", F.lit(0)).alias("gap"),
                       F.coalesce(-c("best.at"), F.lit(0)).alias("cut"))


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``order``, the place of every row of a page from 0; a page may spread over many tasks."""
    placed = range_bucketed(rows, ["page_id"], order)
    counted = prefix_scan(placed, ["page_id"], "_bucket", "_ord", [Running("order", "count")])
    return counted.withColumn("order", F.col("order") - 1).drop("_bucket", "_ord")


def naive_order(blocks: DataFrame) -> DataFrame:
    """Plain top-to-bottom, left-to-right order from 0."""
    return _numbered(blocks, ["y", "x", "w", "h"])


def _bands(start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Widest empty band of every group at once: (width, where it ends), the first on ties.

    ``group`` numbers rows densely from 0. Shifting each group by the value range lets one running
    maximum serve all groups.
    """
    by = np.lexsort((end, start, group))
    g = group[by]
    low = int(start.min())
    span = int(end.max()) - low + 1
    lows = start[by] - low + g * span
    reach = np.maximum.accumulate(end[by] - low + g * span)
    gaps = np.zeros(len(by), dtype=np.int64)
    gaps[1:] = np.where(g[1:] == g[:-1], lows[1:] - reach[:-1], 0)
    np.maximum(gaps, 0, out=gaps)
    heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    widest = np.maximum.reduceat(gaps, heads)
    hits = np.flatnonzero(gaps == widest[g])
    _, first = np.unique(g[hits], return_index=True)
    return widest, start[by][hits[first]]


def cut_positions(page: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray,
                  min_gap: np.ndarray, mode: str) -> np.ndarray:
    """Reading position of every row; rows are sorted by (page, y, x).

    All pages of a batch are cut together, one level of cuts per pass. A group is known by the
    position of its first block; a cut keeps that position for the first side and adds the first
    side's size for the second.
    """
    edges = borders(page)
    place = np.repeat(edges[:-1], np.diff(edges))
    open_rows = np.arange(len(page))
    while len(open_rows):
        starts, group, sizes = np.unique(place[open_rows], return_inverse=True, return_counts=True)
        keep = sizes[group] > 1
        if not keep.all():
            open_rows = open_rows[keep]
            if not len(open_rows):
                break
            starts, group = np.unique(place[open_rows], return_inverse=True)
        ax, ay = x[open_rows], y[open_rows]
        gap_x, cut_x = _bands(ax, ax + w[open_rows], group)
        gap_y, cut_y = _bands(ay, ay + h[open_rows], group)
        limit = np.zeros(len(starts), dtype=np.int64)
        limit[group] = min_gap[open_rows]
        columns = (gap_x >= limit) & (gap_x > 0)
        if mode == "widest":
            columns &= gap_x >= gap_y
        cut = columns | (gap_y > 0)
        later = np.where(columns[group], ax >= cut_x[group], ay >= cut_y[group]) & cut[group]
        first_side = np.bincount(group, weights=~later, minlength=len(starts)).astype(np.int64)
        place[open_rows[later]] += first_side[group[later]]
        # uncut groups read by (y, x): their rows are already in that order
        done = open_rows[~cut[group]]
        if len(done):
            at = place[done]
            order = np.argsort(at, kind="stable")
            runs = borders(at[order])
            place[done[order]] += np.arange(len(done)) - np.repeat(runs[:-1], np.diff(runs))
        open_rows = open_rows[cut[group]]
    return place


def _order_groups(mode: str):
    names = ("page_id", "path", "x", "y", "w", "h", "min_col_gap")

    def ordered(cols: dict[str, np.ndarray]) -> pd.DataFrame:
        edges = borders(cols["page_id"], cols["path"])
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        place = cut_positions(group, *(cols[k] for k in names[2:]), mode)
        return pd.DataFrame({**{k: cols[k] for k in names[:-1]}, "place": place - edges[:-1][group]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cols in whole_groups(batches, names, ["page_id", "path"]):
            yield ordered(cols)
    return run


def _cut_large(rows: DataFrame, mode: str, group_rows: int, levels: int) -> tuple[DataFrame, bool]:
    """Cuts groups of more than ``group_rows`` blocks over the cluster, one level per pass. ``path`` names the
    side of every cut; ``whole`` marks groups without a gap, which are read by (y, x). The second value says
    whether any page was cut."""
    c = F.col
    rows = rows.withColumns({"path": F.lit(""), "whole": F.lit(False)})
    keys = ["page_id", "path"]
    for level in range(levels):
        large = rows.where(~c("whole")).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.max("min_col_gap").alias("_least")).where(c("_n") > group_rows)
        large = stage(large, "large-groups")
        if large.isEmpty():
            return rows, level > 0
        busy = rows.where(~c("whole")).join(large.select(*keys), keys, "left_semi")
        gaps = large
        for axis in ("x", "y"):
            found = widest_gap(busy, axis, keys)
            gaps = gaps.join(found.select(*keys, c("gap").alias(f"_g{axis}"), c("cut").alias(f"_c{axis}")), keys)
        columns = (c("_gx") >= c("_least")) & (c("_gx") > 0)
        if mode == "widest":
            columns = columns & (c("_gx") >= c("_gy"))
        gaps = gaps.withColumn("_columns", columns)
        marked = rows.join(gaps.select(*keys, "_columns", "_cx", "_cy", (columns | (c("_gy") > 0)).alias("_cut")), keys, "left")
        late = F.when(c("_columns"), c("x") >= c("_cx")).otherwise(c("y") >= c("_cy"))
        rows = stage(marked.select(
            "page_id", "x", "y", "w", "h", "min_col_gap",
            F.when(c("_cut"), F.concat("path", F.when(late, "1").otherwise("0"))).otherwise(c("path")).alias("path"),
            (c("whole") | (c("_cut").isNotNull() & ~c("_cut"))).alias("whole")), "cut-groups")
    return rows, True


def reading_order(blocks: DataFrame, mode: str = "gutter_first", min_col_gap: int = 1,
                  group_rows: int = GROUP_ROWS, levels: int = 32) -> DataFrame:
    """Blocks of each page in XY-cut order.

    ``gutter_first`` cuts at any gutter of ``min_col_gap`` before any row gap, ``widest`` at the wider of the
    two. Pages of more than ``group_rows`` blocks are first cut over the cluster, level by level, until their
    groups are small (or ``levels`` are done); each group is then ordered by one task in arrays. The order does
    not depend on where the one way hands over to the other. A ``min_col_gap`` column, when present, overrides
    the argument.
    """
    if mode not in ("gutter_first", "widest"):
        raise ValueError(f"unknown mode: {mode}")
    if "min_col_gap" not in blocks.columns:
        blocks = blocks.withColumn("min_col_gap", F.lit(min_col_gap))
    page_type = blocks.schema["page_id"].dataType.simpleString()
    slim = _with_page_key(blocks).select("page_id", *[F.col(k).cast("bigint") for k in ("x", "y", "w", "h")], "min_col_gap")
    rows, split = _cut_large(slim, mode, group_rows, levels)
    small = rows.where(~F.col("whole")).select("page_id", "path", "x", "y", "w", "h", "min_col_gap")
    schema = "page_id string, path string, x bigint, y bigint, w bigint, h bigint, place bigint"
    placed = spread(small, "page_id", "path").sortWithinPartitions("page_id", "path", "y", "x", "w", "h").mapInPandas(
        _order_groups(mode), schema)
    if not split:
        return _from_page_key(placed.select("page_id", F.col("place").alias("order"), "x", "y", "w", "h"), page_type)
    whole = rows.where("whole").select("page_id", "path", "x", "y", "w", "h", F.lit(0).cast("bigint").alias("place"))
    every = _numbered(placed.unionByName(whole), ["path", "place", "y", "x", "w", "h"])
    return _from_page_key(every.select("page_id", "order", "x", "y", "w", "h"), page_type)


def page_nodes(ordered: DataFrame, shown: int = SHOWN_NODES) -> DataFrame:
    """The first nodes of a page, as shown to a reader."""
    return ordered.where(F.col("order") < shown)


def column_switches(ordered: DataFrame) -> DataFrame:
    """How often an order jumps between columns. Needs page_id, order and column."""
    c = F.col
    bucketed = ordered.select("page_id", "order", F.struct("column").alias("_now")).withColumn("_bucket", bucket_of(c("order")))
    seen = prefix_scan(bucketed, ["page_id"], "_bucket", "order", [Running("_before", "last", c("_now"), inclusive=False)])
    moved = F.coalesce(c("_before.column") != c("_now.column"), F.lit(False))
    return seen.groupBy("page_id").agg(F.count_if(moved).alias("switches"))


_CORNERS = ("page_id", "level", "group", "corner", "row", "x", "n", "cy")


def _corner_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ink left of and above every corner of each group, from a summed-area table of the group: two running sums, over
    its rows and over the columns at which corners lie."""
    for cols in whole_groups(batches, _CORNERS, _CORNERS[:3]):
        edges = borders(*(cols[k] for k in _CORNERS[:3]))
        asked, counts = [], []
        for low, high in zip(edges[:-1], edges[1:]):
            corner = cols["corner"][low:high].astype(bool)
            here, dots = low + np.flatnonzero(corner), low + np.flatnonzero(~corner)
            if not len(here) or not len(dots):
                continue
            row, x = cols["row"], cols["x"]
            at, first = np.unique(x[here]), int(row[dots].min())
            table = np.zeros((int(row[dots].max()) - first + 1, len(at) + 1), dtype=np.int64)
            np.add.at(table, (row[dots] - first, np.searchsorted(at, x[dots], "left")), cols["n"][dots])
            table = table.cumsum(axis=0).cumsum(axis=1)
            last = np.minimum(row[here] - first, len(table) - 1)
            asked.append(here)
            counts.append(np.where(last >= 0, table[last, np.searchsorted(at, x[here])], 0))
        if asked:
            rows = np.concatenate(asked)
            yield pd.DataFrame({"page_id": cols["page_id"][rows], "cx": cols["x"][rows], "cy": cols["cy"][rows], "n": np.concatenate(counts)})


def ink_before(corners: DataFrame, ink: DataFrame, tile: int = 256) -> DataFrame:
    """Summed-area lookups: for corners (page_id, cx, cy; distinct, no nulls, from 0) rows (page_id, cx, cy, n) whose ``n`` add up
    to the ink at or left of cx and at or above cy. Corners without ink have no rows.

    Rows of a page form groups of ``tile``, these form groups of ``tile`` groups, and so on. On the lowest level a corner
    counts the rows of its group down to its own, on every other one the groups of its group before its own. Each
    (page, level, group) holds at most ``tile`` rows of counts, so a large page spreads over many tasks.
    """
    c = F.col
    tallest = corners.agg(F.max("cy")).first()[0] or 0
    levels = 1
    while tile ** levels <= tallest:
        levels += 1
    unit = F.pow(F.lit(float(tile)), c("level")).cast("bigint")
    by_level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")

    def placed(rows: DataFrame, y: Column) -> DataFrame:
        return rows.withColumn("row", F.call_function("div", y.cast("bigint"), unit)).withColumn(
            "group", F.call_function("div", c("row"), F.lit(tile)))

    dots = placed(ink.where(c("y") <= tallest).select("page_id", "x", "y", by_level), c("y")).groupBy(
        "page_id", "level", "group", "row", "x").agg(F.count(F.lit(1)).alias("n"))
    # above the lowest level a corner's own row was counted below
    wanted = placed(corners.select("*", by_level), c("cy")).withColumn(
        "row", F.when(c("level") == 0, c("row")).otherwise(c("row") - 1))
    page_type = corners.schema["page_id"].dataType.simpleString()
    none = F.lit(0).cast("bigint")
    events = dots.select("page_id", "level", "group", F.lit(False).alias("corner"), "row", c("x").cast("bigint").alias("x"), "n",
                         none.alias("cy")).unionByName(wanted.select(
        "page_id", "level", "group", F.lit(True).alias("corner"), "row", c("cx").alias("x"), none.alias("n"), "cy"))
    return spread(events, *_CORNERS[:3]).sortWithinPartitions(*_CORNERS[:3]).mapInPandas(
        _corner_counts, f"page_id {page_type}, cx bigint, cy bigint, n bigint")


def block_density(blocks: DataFrame, ink: DataFrame, tile: int = 256) -> DataFrame:
    """Share of ink in every block, four decimals half-even.

    The ink of a block is four lookups in a summed-area table of its page (see ``ink_before``): one row per block
    corner, however large the block.
    """
    c = F.col
    block_id = ["page_id", "x", "y", "w", "h"]
    page_type = blocks.schema["page_id"].dataType.simpleString()
    unique = _with_page_key(blocks).select(*block_id).distinct()
    left, top = c("x").cast("bigint") - 1, c("y").cast("bigint") - 1
    right, bottom = left + c("w"), top + c("h")
    signed = [F.struct(cx.alias("cx"), cy.alias("cy"), F.lit(sign).alias("sign"))
              for cx, cy, sign in ((right, bottom, 1), (left, bottom, -1), (right, top, -1), (left, top, 1))]
    looked = unique.select("*", F.inline(F.filter(F.array(*signed), lambda s: (s["cx"] >= 0) & (s["cy"] >= 0))))
    counts = ink_before(looked.select("page_id", "cx", "cy").distinct(), _with_page_key(ink), tile)
    counted = looked.join(counts, ["page_id", "cx", "cy"], "left").groupBy(*block_id).agg(
        F.coalesce(F.sum(c("sign") * c("n")), F.lit(0)).alias("ink"))
    return _from_page_key(counted, page_type).withColumn("density", F.bround(c("ink") / (c("w") * c("h")), 4))


def ink_f1(pred: DataFrame, truth: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """F1 of two ink masks inside a box (x0, y0, x1, y1). Both masks are stacked and counted per
    pixel, so no pixel join is needed."""
    x0, y0, x1, y1 = box
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    a = pred.where(inside).select("page_id", "y", "x", F.lit(1).alias("p"), F.lit(0).alias("t"))
    b = truth.where(inside).select("page_id", "y", "x", F.lit(0).alias("p"), F.lit(1).alias("t"))
    cells = a.unionByName(b).groupBy("page_id", "y", "x").agg(F.max("p").alias("p"), F.max("t").alias("t"))
    sums = cells.groupBy("page_id").agg(F.sum(F.col("p") * F.col("t")).alias("both"), F.sum("p").alias("pred"),
                                        F.sum("t").alias("truth"))
    return sums.withColumn("f1", 2 * F.col("both") / (F.col("pred") + F.col("truth")))


# ---- video ------------------------------------------------------------------------------

def sample_frames(frames: DataFrame, kept: int = MAX_FRAMES_KEPT, read: int = MAX_FRAMES_READ) -> DataFrame:
    """Evenly spaced frames per video. Needs video_id, frame (from 0) and frame_count; an unknown
    count (0) means every fourth frame. Pure arithmetic on the frame number, no window."""
    c = F.col
    stride = F.when(c("frame_count") > 0, F.greatest(F.lit(1), F.floor(c("frame_count") / kept))).otherwise(4)
    return frames.withColumn("stride", stride).where(
        (c("frame") < read) & (c("frame") % c("stride") == 0) & (c("frame") / c("stride") < kept))


def reference_frame(frames: DataFrame) -> DataFrame:
    """Sharpest frame per video, the first on ties."""
    return frames.groupBy("video_id").agg(
        F.min_by("frame", F.struct(-F.col("sharpness"), F.col("frame"))).alias("reference"))


def composite(samples: DataFrame, reference: DataFrame, hi: int = GLARE_LEVEL, lo: int = SHADOW_LEVEL,
              min_frames: int = MIN_FRAMES_USED) -> DataFrame:
    """Composited pixels: page_id, y, x, channel, v, replaced.

    ``samples``: page_id, frame, y, x, channel, v, valid. ``reference``: page_id, reference.
    A reference pixel whose channel mean is clipped takes the per-channel median of the valid
    samples that are not clipped, where there are any. With fewer than ``min_frames`` frames on a
    page the reference frame is kept.
    """
    c = F.col
    # one exchange of the samples: both groupings below are by what they were dealt out on, and more
    dealt = samples.repartition("page_id", "y", "x")
    per_sample = dealt.groupBy("page_id", "y", "x", "frame").agg(
        F.avg("v").alias("grey"), F.bool_and("valid").alias("valid"), F.collect_list(F.struct("channel", "v")).alias("values"))
    clipped = (c("grey") >= hi) | (c("grey") <= lo)
    used = (samples.where("valid").select("page_id", "frame").distinct()
            .groupBy("page_id").agg(F.count(F.lit(1)).alias("frames_used")))
    # one row per page
    setup = broadcast_if_small(reference.select("page_id", "reference").join(used, "page_id", "left"))
    is_ref = c("frame") == c("reference")
    long = per_sample.join(setup, "page_id").select(
        "page_id", "y", "x", (c("valid") & ~clipped).alias("clean"), is_ref.alias("is_ref"), "frames_used",
        (is_ref & c("valid") & clipped).alias("ref_clipped"), F.inline("values"))
    # the exact median keeps counts per level, at most 256 of them
    out = long.groupBy("page_id", "y", "x", "channel").agg(
        F.max(F.when(c("is_ref"), c("v"))).alias("ref_v"), F.max("ref_clipped").alias("ref_clipped"),
        F.percentile(F.when(c("clean"), c("v")), F.lit(0.5)).alias("median"), F.max("frames_used").alias("frames_used"))
    fix = c("ref_clipped") & c("median").isNotNull() & (c("frames_used") >= min_frames)
    filled = F.greatest(F.lit(0), F.least(F.lit(255), F.rint("median").cast("int")))
    return out.where(c("ref_v").isNotNull()).select(
        "page_id", "y", "x", "channel", F.when(fix, filled).otherwise(c("ref_v")).alias("v"), fix.alias("replaced"),
        "frames_used")


def composite_summary(pixels: DataFrame, min_frames: int = MIN_FRAMES_USED) -> DataFrame:
    """Replaced share per page, six decimals, and the fallback note."""
    cells = pixels.groupBy("page_id", "y", "x").agg(F.max("replaced").alias("replaced"),
                                                    F.max("frames_used").alias("frames_used"))
    return cells.groupBy("page_id").agg(
        F.max("frames_used").alias("frames_used"),
        F.bround(F.count_if("replaced") / F.count(F.lit(1)), 6).alias("replaced_fraction")).withColumn(
        "fallback", F.col("frames_used") < min_frames)


# ---- batches ----------------------------------------------------------------------------

def batch_summary(results: DataFrame, *by: str) -> DataFrame:
    """Sealed and failed inputs of a run, with total time."""
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("sealed"),
        F.count_if(~F.col("ok")).alias("failed"), F.sum("ms").alias("total_ms"))


def batch_sketches(results: DataFrame, *by: str, k: int = 200) -> DataFrame:
    """Timing sketches of a run (``ms``, bigint), to be kept beside its results: ``by``, ``n`` and ``sketch``. Runs of any
    size leave a few kilobytes; up to ``k`` timings are kept as they are."""
    return results.where(F.col("ms").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col("ms").cast("bigint"), k).alias("sketch"))


def batch_quantiles(sketches: DataFrame, *by: str, shares: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Timing quantiles over the sketches of one or many runs, merged per ``by``: ``n`` and one column per share, such
    as ``p50``: the least timing that at least this share of all does not exceed."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias(f"p{q * 100:g}".replace(".", "_"))
                                     for q in shares])


def batch_failures(results: DataFrame) -> DataFrame:
    return results.where(~F.col("ok")).select("source", "error")
