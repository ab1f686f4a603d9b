"""Registered queries over pages: damage, layout, reports and video samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reports as fr
from ..operators import pages as pg
from ..operators.ordered import with_position
from ..sources import reports as rsrc
from . import tables as t

_files: dict = {}


# ---- views ------------------------------------------------------------------------------

def pixels(spark, sf_dir):
    """Every embedding as an 8-pixel-wide page."""
    e = t.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    level = F.floor((F.col("e").cast("double") + 0.25) * 510)
    return e.select(F.col("vec_id").alias("page_id"), F.floor(F.col("i") / 8).cast("int").alias("y"),
                    (F.col("i") % 8).cast("int").alias("x"),
                    F.greatest(F.lit(0), F.least(F.lit(255), level)).cast("int").alias("v"))


PIXELS_SQL = """
WITH RECURSIVE cells AS (SELECT vec_id, unnest(range(len(embedding))) AS i, embedding FROM embeddings),
pixels AS (
  SELECT vec_id AS page_id, i // 8 AS y, i % 8 AS x,
         greatest(0, least(255, floor((embedding[i + 1]::DOUBLE + 0.25) * 510)))::INTEGER AS v FROM cells),
hist AS (SELECT page_id, v, count(*) AS n FROM pixels GROUP BY ALL),
running AS (
  SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY v) AS nt, sum(n * v) OVER (PARTITION BY page_id ORDER BY v) AS st,
         sum(n) OVER (PARTITION BY page_id) AS nn, sum(n * v) OVER (PARTITION BY page_id) AS ss FROM hist),
scored AS (
  SELECT *, (nn * st - nt * ss)::DOUBLE * (nn * st - nt * ss)::DOUBLE / (nt * (nn - nt))::DOUBLE AS score
  FROM running WHERE nt < nn),
cuts AS (SELECT page_id, v AS threshold, nn, nt FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, v) AS k FROM scored) WHERE k = 1),
otsu AS (SELECT page_id, threshold, nt > nn // 2 AS inverted, CASE WHEN nt > nn // 2 THEN nn - nt ELSE nt END AS ink_pixels FROM cuts),
mask AS (SELECT page_id, y, x FROM pixels WHERE v >= 150),
runs AS (SELECT *, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS run FROM mask),
spans AS (SELECT page_id, y, min(x) AS x0, max(x) AS x1 FROM runs GROUP BY page_id, y, run),
links AS (
  SELECT a.page_id, a.y * 4294967296 + a.x0 AS a, b.y * 4294967296 + b.x0 AS b FROM spans a
  JOIN spans b ON a.page_id = b.page_id AND b.y = a.y + 1 AND b.x0 <= a.x1 + 1 AND a.x0 <= b.x1 + 1),
both_ways AS (SELECT page_id, a, b FROM links UNION ALL SELECT page_id, b, a FROM links),
reach AS (
  SELECT page_id, y * 4294967296 + x0 AS node, y * 4294967296 + x0 AS other FROM spans
  UNION
  SELECT r.page_id, r.node, l.b FROM reach r JOIN both_ways l ON l.page_id = r.page_id AND l.a = r.other),
labels AS (SELECT page_id, node, min(other) AS component FROM reach GROUP BY ALL),
regions AS (
  SELECT s.page_id, component, min(x0) AS x, min(y) AS y, max(x1) - min(x0) + 1 AS w, max(y) - min(y) + 1 AS h,
         sum(x1 - x0 + 1) AS area
  FROM spans s JOIN labels l ON l.page_id = s.page_id AND l.node = s.y * 4294967296 + s.x0 GROUP BY s.page_id, component)
"""


def spans(spark, sf_dir):
    return pg.mask_spans(pixels(spark, sf_dir).where("v >= 150"))


def region_table(spark, sf_dir):
    return t.once(spark, sf_dir, "regions", lambda: pg.regions(spans(spark, sf_dir)))


def blocks(spark, sf_dir):
    """Line items as blocks of the page named by their order."""
    li = t.table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") % 1000).cast("int").alias("x"),
        (F.col("l_suppkey") * 13 % 1300).cast("int").alias("y"), F.col("l_quantity").cast("int").alias("w"),
        (F.col("l_linenumber") * 3).cast("int").alias("h"), F.lit(1400).alias("page_height"), F.lit(1100).alias("page_width"))


BLOCKS_SQL = """
WITH blocks AS (
  SELECT l_orderkey AS page_id, l_partkey % 1000 AS x, l_suppkey * 13 % 1300 AS y, l_quantity::INTEGER AS w,
         l_linenumber * 3 AS h FROM lineitem),
kept AS (SELECT *, w * h AS area, row_number() OVER (PARTITION BY page_id ORDER BY w * h DESC, y, x, w, h) AS k
         FROM blocks WHERE w * h >= greatest(16, 1400 * 1100 // 200000)),
gaps AS (
  SELECT page_id, {axis} AS start, {axis} - max({axis} + {size}) OVER (
    PARTITION BY page_id ORDER BY {axis}, {axis} + {size} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM blocks),
widest AS (
  SELECT page_id, CASE WHEN gap > 0 THEN gap ELSE 0 END AS gap, CASE WHEN gap > 0 THEN start ELSE 0 END AS cut FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN gap > 0 THEN gap ELSE 0 END DESC, start) AS k FROM gaps) WHERE k = 1),
naive AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, w, h) - 1 AS "order" FROM blocks)
"""


ORDER_SQL = """,
cuts AS (
  SELECT page_id, x, y, w, h, row_number() OVER () AS id, '' AS path FROM blocks
  UNION ALL
  SELECT page_id, x, y, w, h, id, path || CASE WHEN (use_x AND x >= cx) OR (NOT use_x AND y >= cy) THEN '1' ELSE '0' END
  FROM (
    SELECT *, gx >= 9 {rule} AS use_x,
           min(CASE WHEN bx = gx THEN x END) OVER grp AS cx, min(CASE WHEN by_ = gy THEN y END) OVER grp AS cy
    FROM (
      SELECT *, max(bx) OVER grp AS gx, max(by_) OVER grp AS gy
      FROM (
        SELECT *, greatest(0, coalesce(x - max(x + w) OVER (PARTITION BY page_id, path ORDER BY x, x + w
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS bx,
               greatest(0, coalesce(y - max(y + h) OVER (PARTITION BY page_id, path ORDER BY y, y + h
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS by_
        FROM cuts)
      WINDOW grp AS (PARTITION BY page_id, path))
    WINDOW grp AS (PARTITION BY page_id, path))
  WHERE use_x OR gy > 0),
placed AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(path) DESC) = 1)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY path, y, x, w, h) - 1 AS "order", x, y, w, h FROM placed"""


def samples(spark, sf_dir):
    """Events as video samples: the page is the user, ten pixels, one frame per event type."""
    e = t.table(spark, sf_dir, "events")
    frame = (F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1)
             .when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4))
    cells = e.select(F.col("user_id").alias("page_id"), frame.alias("frame"), F.lit(0).alias("y"),
                     F.floor(F.regexp_extract("props", r"(\d+)", 1).cast("int") / 10).cast("int").alias("x"),
                     F.floor("value").cast("int").alias("level"))
    cells = cells.groupBy("page_id", "frame", "y", "x").agg(F.max("level").alias("level"))
    channel = F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), F.least(F.lit(255), F.col("level") * 4 + 7 * k).alias("v"))
                                  for k in range(3)]))
    return cells.select("page_id", "frame", "y", "x", ((F.col("frame") != 4) | (F.col("level") > 10)).alias("valid"),
                        channel.alias("c")).select("page_id", "frame", "y", "x", "valid", "c.channel", "c.v")


def sharpness(spark, sf_dir):
    return samples(spark, sf_dir).groupBy(F.col("page_id").alias("video_id"), "frame").agg(
        F.max("v").cast("double").alias("sharpness"))


def reference(spark, sf_dir):
    return pg.reference_frame(sharpness(spark, sf_dir)).select(F.col("video_id").alias("page_id"), "reference")


SAMPLES_SQL = """
WITH cells AS (
  SELECT user_id AS page_id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS frame,
         0 AS y, regexp_extract(props, '(\\d+)', 1)::INTEGER // 10 AS x, max(floor(value)::INTEGER) AS level
  FROM events GROUP BY ALL),
samples AS (
  SELECT page_id, frame, y, x, frame <> 4 OR level > 10 AS valid, k AS channel, least(255, level * 4 + 7 * k) AS v
  FROM cells, LATERAL (SELECT unnest(range(3)) AS k)),
sharp AS (SELECT page_id, frame, max(v) AS sharpness FROM samples GROUP BY ALL),
refs AS (SELECT page_id, arg_min(frame, -sharpness * 10 + frame) AS reference FROM sharp GROUP BY page_id),
used AS (SELECT page_id, count(DISTINCT frame) FILTER (WHERE valid) AS frames_used FROM samples GROUP BY page_id),
grey AS (
  SELECT *, avg(v) OVER (PARTITION BY page_id, y, x, frame) AS g FROM samples),
marked AS (
  SELECT g.*, g >= 250 OR g <= 5 AS clipped, frame = reference AS is_ref, frames_used
  FROM grey g JOIN refs USING (page_id) JOIN used USING (page_id)),
pixels AS (
  SELECT page_id, y, x, channel, max(v) FILTER (WHERE is_ref) AS ref_v, max(frames_used) AS frames_used,
         bool_or(is_ref AND valid AND clipped) AS ref_clipped,
         quantile_cont(v, 0.5) FILTER (WHERE valid AND NOT clipped) AS med
  FROM marked GROUP BY ALL),
composed AS (
  SELECT page_id, y, x, channel, frames_used,
         ref_clipped AND med IS NOT NULL AND frames_used >= 3 AS replaced,
         CASE WHEN ref_clipped AND med IS NOT NULL AND frames_used >= 3
              THEN greatest(0, least(255, round_even(med, 0)))::INTEGER ELSE ref_v END AS v
  FROM pixels WHERE ref_v IS NOT NULL)
"""


def frames(spark, sf_dir):
    e = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id")
    placed = with_position(e, ["video_id"], "event_id")
    counts = e.groupBy("video_id").agg(F.count(F.lit(1)).alias("frame_count"))
    return placed.join(counts, "video_id").select("video_id", (F.col("pos") - 1).alias("frame"), "frame_count")


# ---- reports ----------------------------------------------------------------------------

def report_inputs(spark, sf_dir):
    """What the page engine measured, one page per order."""
    o, k = t.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("page_id"), (k * 37 % 400_001 / F.lit(1_000_000.0)).alias("masked_fraction"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(F.col("o_custkey") % 4).cast("int").alias("g"),
        (k % 3).cast("int").alias("s"), (F.col("o_orderstatus") != "O").alias("repair"),
        (F.col("o_orderpriority") != "5-LOW").alias("flatten"), (F.col("o_orderstatus") == "P").alias("fill"),
        F.when(F.col("o_orderpriority") == "2-HIGH", 0.25).alias("replaced"), (k % 7).cast("int").alias("nodes"))


def report_rows(spark, sf_dir):
    c = F.col
    df = report_inputs(spark, sf_dir)
    mask_px = c("g") * 100 + F.when(c("fill"), c("s") * 10).otherwise(0)
    status = fr.page_status(c("masked_fraction"), mask_px, c("s"), c("repair"), c("flatten"), c("replaced"))
    region = lambda n: F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(
        i.alias("x"), i.alias("y"), F.lit(2).alias("w"), F.lit(3).alias("h"), F.lit(6).alias("area")))
    regions = lambda n: F.slice(region(n), F.lit(1), n)
    df = df.withColumn("status", status)
    acted = c("repair") & (c("status") != "skipped_damage_too_extensive")
    return df.select(
        "page_id", F.lit(1000).alias("width"), F.lit(1300).alias("height"), (c("g") * 100).alias("glare_pixels"),
        (c("s") * 10).alias("shadow_pixels"), regions(c("g")).alias("glare_regions"), regions(c("s")).alias("shadow_regions"),
        "masked_fraction", "status",
        F.struct((acted & c("flatten")).alias("illumination_flattened"), (acted & (c("g") > 0)).alias("glare_halo_stretched"),
                 F.when(acted, mask_px).otherwise(0).alias("inpainted_pixels"),
                 (acted & c("fill") & (c("s") > 0)).alias("shadow_filled")).alias("repair"),
        c("nodes").alias("reading_order_nodes"), c("replaced").alias("composite_replaced_fraction"))


def report_files(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _files:
        path = t.scratch(spark, "page-reports")
        t.packed(report_rows(spark, sf_dir)).json(path)
        _files[key] = path
    return rsrc.read_page_reports(spark, _files[key], multi_line=False)


REPORTS_SQL = """
WITH inputs AS (
  SELECT o_orderkey::VARCHAR AS page_id, o_orderkey * 37 % 400001 / 1000000.0::DOUBLE AS masked_fraction,
         CASE o_orderpriority WHEN '1-URGENT' THEN 0 ELSE o_custkey % 4 END AS g, o_orderkey % 3 AS s,
         o_orderstatus <> 'O' AS repair, o_orderpriority <> '5-LOW' AS flatten, o_orderstatus = 'P' AS fill,
         CASE o_orderpriority WHEN '2-HIGH' THEN 0.25 ELSE 0 END AS replaced, o_orderkey % 7 AS nodes FROM orders),
based AS (
  SELECT *, g * 100 + CASE WHEN fill THEN s * 10 ELSE 0 END AS mask_px FROM inputs),
first_status AS (
  SELECT *, CASE WHEN NOT repair THEN CASE WHEN mask_px > 0 OR s > 0 THEN 'detected_not_repaired' ELSE 'stable' END
                 WHEN masked_fraction > 0.3::DOUBLE THEN 'skipped_damage_too_extensive' WHEN mask_px > 0 THEN 'repaired'
                 WHEN flatten THEN 'enhanced' ELSE 'stable' END AS st FROM based),
reports AS (
  SELECT *, CASE WHEN repair AND replaced > 0 AND st IN ('stable', 'enhanced') THEN 'repaired' ELSE st END AS status FROM first_status),
acted AS (SELECT *, repair AND status <> 'skipped_damage_too_extensive' AS act,
  CASE WHEN masked_fraction * 100 >= 0.1 OR masked_fraction = 0 THEN printf('%.1f%%', masked_fraction * 100) ELSE 'under 0.1%' END AS share FROM reports)
"""

FINDINGS_SQL = REPORTS_SQL + f""",
items AS (
  SELECT page_id, unnest(list_filter([
    CASE WHEN status = 'skipped_damage_too_extensive' THEN {{'level': 'warn', 'text': '{fr.TOO_EXTENSIVE}'}} END,
    CASE WHEN status = 'detected_not_repaired' THEN {{'level': 'info', 'text': '{fr.REPAIR_OFF}'}} END,
    CASE WHEN act AND flatten THEN {{'level': 'ok', 'text': '{fr.FLATTENED}'}} END,
    CASE WHEN g > 0 THEN {{'level': 'warn', 'text': printf('{fr.GLARE_TEXT}', g::VARCHAR, CASE g WHEN 1 THEN '' ELSE 's' END, CASE g WHEN 1 THEN 'it' ELSE 'them' END, share)}} END,
    CASE WHEN s > 0 AND NOT (act AND fill) THEN {{'level': 'info', 'text': printf('{fr.SHADOW_LEFT}', s::VARCHAR, CASE s WHEN 1 THEN '' ELSE 's' END)}} END,
    CASE WHEN s > 0 AND act AND fill THEN {{'level': 'warn', 'text': printf('{fr.SHADOW_FILLED}', s::VARCHAR, CASE s WHEN 1 THEN ' was' ELSE 's were' END)}} END,
    CASE WHEN g = 0 AND s = 0 AND status IN ('stable', 'enhanced') THEN {{'level': 'ok', 'text': '{fr.NOTHING_INVENTED}'}} END,
    CASE WHEN nodes > 0 THEN {{'level': 'info', 'text': printf('{fr.ORDER_MAPPED}', nodes::VARCHAR)}} END], lambda i: i IS NOT NULL)) AS item,
    generate_subscripts(list_filter([status = 'skipped_damage_too_extensive', status = 'detected_not_repaired', act AND flatten, g > 0,
      s > 0 AND NOT (act AND fill), s > 0 AND act AND fill, g = 0 AND s = 0 AND status IN ('stable', 'enhanced'), nodes > 0], lambda b: b), 1) - 1 AS position
  FROM acted)
SELECT page_id, position, item.level AS level, item.text AS text FROM items"""


def batch_results(spark, sf_dir):
    o = t.table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("batch"), F.col("o_orderkey").cast("string").alias("source"),
        (F.col("o_orderstatus") != "P").alias("ok"), F.when(F.col("o_orderstatus") == "P", "not a regular file").alias("error"),
        F.floor("o_totalprice").cast("bigint").alias("ms"))


def timing_quantiles(spark, sf_dir):
    """Page timings per customer, sketched in two runs that are merged afterwards."""
    o = t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.floor("o_totalprice").cast("bigint").alias("ms"),
                                                (F.col("o_orderstatus") == "F").alias("early"))
    runs = pg.batch_sketches(o, "customer", "early")
    return pg.batch_quantiles(runs, "customer")


def _with_columns(ordered):
    return ordered.withColumn("column", F.floor(F.col("x") / 500))


def _density(spark, sf_dir):
    out = pg.block_density(region_table(spark, sf_dir).select("page_id", "x", "y", "w", "h"),
                           pg.ink_pixels(pixels(spark, sf_dir)))
    return out.select("page_id", "x", "y", "w", "h", "ink", "density")


QUERIES = {
    "page_clip_stats": lambda s, d: pg.clip_stats(pixels(s, d)),
    "page_paper_at_clip": lambda s, d: pg.clip_stats(pixels(s, d), hi=130).select("page_id", "paper_at_clip"),
    "page_histogram": lambda s, d: pg.histogram(pixels(s, d)),
    "page_masked_fraction": lambda s, d: pg.masked_fractions(pixels(s, d).withColumn("m", (F.col("v") >= 240).cast("int"))),
    "page_otsu": lambda s, d: pg.otsu(pg.histogram(pixels(s, d))),
    "page_ink": lambda s, d: pg.ink_pixels(pixels(s, d)),
    "page_mask_spans": spans,
    "page_span_edges": lambda s, d: pg.span_edges(spans(s, d), tile=4),
    "page_regions": lambda s, d: pg.regions(spans(s, d), band_rows=4).drop("component"),
    "page_regions_one_band": lambda s, d: region_table(s, d).drop("component"),
    "page_top_regions": lambda s, d: pg.top_regions(region_table(s, d), 3).drop("component"),
    "page_cap_blocks": lambda s, d: pg.cap_blocks(blocks(s, d), 3).select("page_id", "x", "y", "w", "h", "area"),
    "page_widest_gap_x": lambda s, d: pg.widest_gap(blocks(s, d), "x"),
    "page_widest_gap_y": lambda s, d: pg.widest_gap(blocks(s, d), "y"),
    "page_naive_order": lambda s, d: pg.naive_order(blocks(s, d)).select("page_id", "order", "x", "y", "w", "h"),
    "page_column_switches": lambda s, d: pg.column_switches(_with_columns(pg.naive_order(blocks(s, d)))),
    "page_reading_order": lambda s, d: pg.reading_order(blocks(s, d), "gutter_first", 9),
    "page_reading_order_widest": lambda s, d: pg.reading_order(blocks(s, d), "widest", 9),
    "page_shown_nodes": lambda s, d: pg.page_nodes(pg.reading_order(blocks(s, d), "gutter_first", 9), 4).select("page_id", "order", "x", "y"),
    "page_block_density": _density,
    "page_ink_f1": lambda s, d: pg.ink_f1(pixels(s, d).where("v >= 120"), pixels(s, d).where("v >= 140"), (1, 0, 8, 7)).select(
        "page_id", "both", "pred", "truth", F.round("f1", 9).alias("f1")),
    "video_reference_frame": lambda s, d: pg.reference_frame(sharpness(s, d)),
    "video_sample_frames": lambda s, d: pg.sample_frames(frames(s, d)).select("video_id", "frame", "stride"),
    "video_composite": lambda s, d: pg.composite(samples(s, d), reference(s, d)),
    "video_composite_summary": lambda s, d: pg.composite_summary(pg.composite(samples(s, d), reference(s, d))),
    "report_status": lambda s, d: report_rows(s, d).select("page_id", "status"),
    "report_read": lambda s, d: report_files(s, d).select(
        "page_id", "status", "masked_fraction", F.size("glare_regions").alias("g"), "repair.inpainted_pixels"),
    "report_findings": lambda s, d: rsrc.with_findings(report_files(s, d)),
    "report_percent": lambda s, d: report_inputs(s, d).select("page_id", fr.pct(F.col("masked_fraction")).alias("share")),
    "report_odd_sizes": lambda s, d: t.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", fr.odd(F.col("l_quantity") / 4, 3).alias("kernel")),
    "batch_summary": lambda s, d: pg.batch_summary(batch_results(s, d), "batch"),
    "batch_quantiles": timing_quantiles,
    "batch_failures": lambda s, d: pg.batch_failures(batch_results(s, d)),
}


def _sql(axis="x"):
    return BLOCKS_SQL.replace("{axis}", axis).replace("{size}", "w" if axis == "x" else "h")


ORACLE = {
    "page_clip_stats": PIXELS_SQL + """
SELECT page_id, count(*) AS total_pixels, count(*) FILTER (WHERE v >= 250) AS clipped_glare_pixels,
       count(*) FILTER (WHERE v <= 5) AS clipped_shadow_pixels, quantile_cont(v, 0.5) >= 250 AS paper_at_clip
FROM pixels GROUP BY page_id""",
    "page_paper_at_clip": PIXELS_SQL + "SELECT page_id, quantile_cont(v, 0.5) >= 130 AS paper_at_clip FROM pixels GROUP BY page_id",
    "page_histogram": PIXELS_SQL + "SELECT * FROM hist",
    "page_masked_fraction": PIXELS_SQL + """
SELECT page_id, count(*) FILTER (WHERE v >= 240) AS masked_pixels, count(*) AS total_pixels,
       round_even(count(*) FILTER (WHERE v >= 240) / count(*), 6) AS masked_fraction FROM pixels GROUP BY page_id""",
    "page_otsu": PIXELS_SQL + "SELECT * FROM otsu",
    "page_ink": PIXELS_SQL + "SELECT page_id, y, x FROM pixels JOIN otsu USING (page_id) WHERE (v <= threshold) <> inverted",
    "page_mask_spans": PIXELS_SQL + "SELECT page_id, y, x0, x1 FROM spans",
    "page_span_edges": PIXELS_SQL + "SELECT page_id, a, b FROM links",
    "page_regions": PIXELS_SQL + "SELECT page_id, x, y, w, h, area FROM regions",
    "page_regions_one_band": PIXELS_SQL + "SELECT page_id, x, y, w, h, area FROM regions",
    "page_top_regions": PIXELS_SQL + """
SELECT page_id, x, y, w, h, area, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, y, x, component) AS rank FROM regions) WHERE rank <= 3""",
    "page_cap_blocks": _sql() + """
SELECT page_id, x, y, w, h, area FROM kept WHERE k <= 3""",
    "page_widest_gap_x": _sql("x") + "SELECT page_id, gap, cut FROM widest",
    "page_widest_gap_y": _sql("y") + "SELECT page_id, gap, cut FROM widest",
    "page_naive_order": _sql() + 'SELECT page_id, "order", x, y, w, h FROM naive',
    "page_column_switches": _sql() + """
SELECT page_id, count(*) FILTER (WHERE moved) AS switches FROM (
  SELECT page_id, coalesce(lag(x // 500) OVER (PARTITION BY page_id ORDER BY "order") <> x // 500, false) AS moved FROM naive) GROUP BY page_id""",
    "page_reading_order": _sql().replace("WITH", "WITH RECURSIVE", 1) + ORDER_SQL.replace("{rule}", ""),
    "page_reading_order_widest": _sql().replace("WITH", "WITH RECURSIVE", 1) + ORDER_SQL.replace("{rule}", "AND gx >= gy"),
    "page_shown_nodes": 'SELECT page_id, "order", x, y FROM (' + _sql().replace("WITH", "WITH RECURSIVE", 1) + ORDER_SQL.replace(
        "{rule}", "") + ') WHERE "order" < 4',
    "page_block_density": PIXELS_SQL + """,
boxes AS (SELECT DISTINCT page_id, x, y, w, h FROM regions),
ink AS (SELECT page_id, y AS py, x AS px FROM pixels JOIN otsu USING (page_id) WHERE (v <= threshold) <> inverted)
SELECT b.page_id, b.x, b.y, b.w, b.h, count(px) AS ink, round_even(count(px) / (b.w * b.h), 4) AS density
FROM boxes b LEFT JOIN ink i ON i.page_id = b.page_id AND px >= b.x AND px < b.x + b.w AND py >= b.y AND py < b.y + b.h
GROUP BY b.page_id, b.x, b.y, b.w, b.h""",
    "page_ink_f1": PIXELS_SQL + """
SELECT page_id, count(*) FILTER (WHERE v >= 140) AS both, count(*) AS pred, count(*) FILTER (WHERE v >= 140) AS truth,
       round(2 * count(*) FILTER (WHERE v >= 140) / (count(*) + count(*) FILTER (WHERE v >= 140)), 9) AS f1
FROM pixels WHERE v >= 120 AND x >= 1 AND y < 7 GROUP BY page_id""",
    "video_reference_frame": SAMPLES_SQL + "SELECT page_id AS video_id, reference FROM refs",
    "video_sample_frames": """
WITH f AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame,
                  greatest(1, count(*) OVER (PARTITION BY user_id) // 14) AS stride FROM events)
SELECT video_id, frame, stride FROM f WHERE frame < 900 AND frame % stride = 0 AND frame // stride < 14""",
    "video_composite": SAMPLES_SQL + "SELECT page_id, y, x, channel, v, replaced, frames_used FROM composed",
    "video_composite_summary": SAMPLES_SQL + """,
cells2 AS (SELECT page_id, y, x, bool_or(replaced) AS replaced, max(frames_used) AS frames_used FROM composed GROUP BY ALL)
SELECT page_id, max(frames_used) AS frames_used, round_even(count(*) FILTER (WHERE replaced) / count(*), 6) AS replaced_fraction,
       max(frames_used) < 3 AS fallback FROM cells2 GROUP BY page_id""",
    "report_status": REPORTS_SQL + "SELECT page_id, status FROM reports",
    "report_read": REPORTS_SQL + "SELECT page_id, status, masked_fraction, g, CASE WHEN act THEN mask_px ELSE 0 END AS inpainted_pixels FROM acted",
    "report_findings": FINDINGS_SQL,
    "report_percent": REPORTS_SQL + "SELECT page_id, share FROM acted",
    "report_odd_sizes": """
SELECT l_orderkey, l_linenumber, l_partkey, n + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS kernel
FROM (SELECT *, greatest(round_even(l_quantity / 4, 0)::INTEGER, 3) AS n FROM lineitem)""",
    "batch_summary": """
SELECT o_orderpriority AS batch, count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'P') AS sealed,
       count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, sum(floor(o_totalprice)::BIGINT)::BIGINT AS total_ms FROM orders GROUP BY 1""",
    "batch_quantiles": """
SELECT o_custkey AS customer, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.9) AS p90, quantile_disc(ms, 0.99) AS p99
FROM (SELECT o_custkey, floor(o_totalprice)::BIGINT AS ms FROM orders) GROUP BY 1""",
    "batch_failures": "SELECT o_orderkey::VARCHAR AS source, 'not a regular file' AS error FROM orders WHERE o_orderstatus = 'P'",
}
