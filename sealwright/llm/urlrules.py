"""URL filters: stated rules first, then combinations of URL tokens that FP-growth mines from labelled URLs.

All of it is built-in functions, joins and groupings. Stated and mined rules lie in one inverted index: a stated rule
under the token of its host, a mined one under the rarest token of its combination. A URL looks up its tokens and the
rules found are checked in full, so a URL meets only rules that share a token with it.

Mining reads all labelled URLs with all their tokens. FP-growth lists every frequent combination, 2^n of a URL with n
frequent tokens; where a URL has more than ``WIDTH``, combinations are built level by level instead, without those that a
shorter one beats anyway, and the rules are the same. Kept rules reach ``SUPPORT`` and ``CONFIDENCE``, and no shorter combination with the same
verdict is as sure.

Defined results: a null URL, or one without ``://``, has empty host and path and no rule but may carry mined tokens of
none, so it gets the default verdict, allow. Rows that repeat a page_id and URL come out as often as they occur. With no
labelled URLs nothing is mined. Ties between mined rules: surer, then better supported, then shorter, then the least text.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import broadcast_if_small, stage

# The stated rules, verdict and host/path prefix.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

SUPPORT, CONFIDENCE = 0.005, 0.9
#: Frequent tokens of a URL up to which FP-growth lists all their combinations.
WIDTH = 12
#: Host labels from the right that become tokens of mined rules.
HOST_DEPTH = 3
#: Copies of one row are counted in so many groups, so that no task has to put out all of them.
SHARES = 32
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column, depth: int) -> Column:
    """The last one to ``depth`` labels of a host, joined by dots."""
    labels = F.split(host, r"\.")
    most = F.least(F.size(labels), F.lit(depth))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), most), lambda k: F.array_join(F.slice(labels, -k, k), ".")))


def host_tokens(url: Column, depth: int) -> Column:
    return F.transform(_suffixes(host_of(url), depth), lambda s: F.concat(F.lit("host "), s))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host suffixes, path segments (runs of digits as #), file ending, query keys,
    and whether there is a fragment. No tokens without ``://``."""
    text = F.coalesce(url, F.lit(""))
    named = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(f"{kind} "), v))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    shaped = F.transform(segments, lambda s: F.regexp_replace(s, "[0-9]+", "#"))
    ending = F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(text, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "[&;]"), lambda p: F.substring_index(p, "=", 1)), lambda k: k != "")
    scheme = F.translate(F.regexp_extract(text, r"(?s)^(.*?)://", 1), _CAPITALS, _SMALL)
    found = F.array_distinct(F.concat(
        F.array(F.concat(F.lit("scheme "), scheme)), host_tokens(url, HOST_DEPTH), named("path", shaped),
        F.when(ending != "", F.array(F.concat(F.lit("ending "), ending))).otherwise(F.array().cast("array<string>")),
        named("query", keys),
        F.when(F.contains(text, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))))
    return F.when(F.contains(text, F.lit("://")), found).otherwise(F.array().cast("array<string>"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(verdict, rule) of stated rules as a table."""
    if not rules:
        return spark.range(0).select(F.lit("").alias("verdict"), F.lit("").alias("rule"))
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


# ---- index ---------------------------------------------------------------------------------------

_COLUMNS = ("token", "stated", "rule_path", "needs", "sure", "support", "rule", "verdict")


def _stated_index(rules: DataFrame) -> DataFrame:
    """Stated rules under the token of their host; the whole length of a rule is its weight."""
    host, path = F.substring_index("rule", "/", 1), F.expr("substring(rule, instr(rule, '/'))")
    return rules.select(
        F.concat(F.lit("host "), F.translate(host, _CAPITALS, _SMALL)).alias("token"), F.lit(True).alias("stated"), path.alias("rule_path"),
        F.array().cast("array<string>").alias("needs"), F.length("rule").cast("double").alias("sure"),
        F.lit(0.0).alias("support"), "rule", "verdict")


def _default_index(spark: SparkSession) -> DataFrame:
    """One entry that every URL finds, below all others."""
    return spark.range(1).select(
        F.lit("").alias("token"), F.lit(False).alias("stated"), F.lit("").alias("rule_path"), F.array().cast("array<string>").alias("needs"),
        F.lit(-1.0).alias("sure"), F.lit(0.0).alias("support"), F.lit("").alias("rule"), F.lit("allow").alias("verdict"))


def _often(least: int) -> Column:
    """Whether one of the two verdicts falls on at least so many rows."""
    return F.greatest(F.col("bad"), F.col("n") - F.col("bad")) >= least


def _grown(known: DataFrame, support: float, confidence: float) -> DataFrame:
    """Sure combinations of tokens by FP-growth: needs, verdict, sure, support."""
    baskets = known.select(F.concat("tokens", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    label = F.element_at("consequent", 1)
    return model.associationRules.where(label.startswith("=")).select(
        F.array_sort("antecedent").alias("needs"), F.substring(label, 2, 5).alias("verdict"),
        F.col("confidence").alias("sure"), "support")


def _by_levels(baskets: DataFrame, counted: DataFrame, least: int, confidence: float, total: int) -> DataFrame:
    """As ``_grown``, but without combinations that a shorter one surely beats: those as frequent as a part of them, and
    those with a part that has one verdict only. What holds such a part is not looked at, so many tokens that come
    together cost no more than a few."""
    mixed = (F.col("bad") > 0) & (F.col("bad") < F.col("n"))
    numbered = stage(baskets.withColumn("id", F.monotonically_increasing_id()), "numbered-baskets")
    level = counted.select(F.array("token").alias("needs"), "n", "bad")
    live = level.where(mixed)
    held = numbered.select("id", F.explode("basket").alias("token")).select("id", F.array("token").alias("needs")).join(
        live.select("needs"), "needs", "left_semi")
    found, size = level, 1
    while not live.isEmpty():
        stem = held.select("id", F.slice("needs", 1, size - 1).alias("stem"), F.element_at("needs", -1).alias("last"))
        wider = stem.join(stem.withColumnRenamed("last", "next"), ["id", "stem"]).where("last < next").select(
            "id", F.concat("stem", F.array("last", "next")).alias("needs"))
        size += 1
        wider = stage(wider, f"combinations{size}")
        often = stage(wider.join(numbered.select("id", "n", "bad"), "id").groupBy("needs").agg(
            F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(_often(least)), f"counted{size}")
        parts = often.select("needs", "n", F.explode("needs").alias("t")).select("needs", "n", F.array_remove("needs", F.col("t")).alias("part"))
        free = parts.join(live.select(F.col("needs").alias("part"), F.col("n").alias("more")), "part").where("more > n").groupBy(
            "needs").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == size).select("needs")
        level = stage(often.join(free, "needs", "left_semi"), f"level{size}")
        found, live = found.unionByName(level), level.where(mixed)
        held = wider.join(live.select("needs"), "needs", "left_semi")
    sides = F.array(*[F.struct(F.lit(v).alias("verdict"), hits.alias("hits")) for v, hits in (
        ("allow", F.col("n") - F.col("bad")), ("block", F.col("bad")))])
    return found.select("needs", "n", F.inline(sides)).where((F.col("hits") >= least) & (F.col("hits") / F.col("n") >= confidence)).select(
        "needs", "verdict", (F.col("hits") / F.col("n")).alias("sure"), (F.col("hits") / total).alias("support"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, width: int = WIDTH) -> DataFrame:
    """Mined rules as index rows, from (url, verdict) rows; verdict is allow or block, others are left out. FP-growth
    mines them unless a URL has more than ``width`` frequent tokens; both ways give the same rules."""
    spark = labelled.sparkSession
    known = labelled.where(F.col("verdict").isin("allow", "block")).select(url_tokens(F.col("url")).alias("tokens"), "verdict")
    sizes = {r["verdict"]: r["n"] for r in known.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    none = spark.range(0).select(*[c.alias(n) for c, n in zip(
        (F.lit(""), F.lit(False), F.lit(""), F.array().cast("array<string>"), F.lit(0.0), F.lit(0.0), F.lit(""), F.lit("")), _COLUMNS)])
    if not total:
        return none
    least = max(1, math.ceil(support * total))
    counted = stage(known.select(F.explode("tokens").alias("token"), (F.col("verdict") == "block").cast("bigint").alias("bad")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")).where(_often(least)), "tokens")
    frequent = counted.agg(F.collect_list("token").alias("frequent"))
    shapes = known.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "block").alias("bad"))
    baskets = stage(shapes.crossJoin(F.broadcast(frequent)).select(
        F.array_sort(F.array_intersect("tokens", "frequent")).alias("basket"), "n", "bad").groupBy("basket").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad")), "baskets")
    widest = baskets.agg(F.max(F.size("basket")).alias("w")).first()["w"] or 0
    if not widest:
        return none
    found = _grown(known, support, confidence) if widest <= width else _by_levels(baskets, counted, least, confidence, total)
    rules = stage(found, "mined")
    # most longer rules go by the rule they have without one token
    within = rules.select("needs", "verdict", "sure", F.explode("needs").alias("t")).select(
        "needs", "verdict", "sure", F.array_remove("needs", F.col("t")).alias("fewer"))
    shorter = rules.select(F.col("needs").alias("fewer"), "verdict", F.col("sure").alias("as_sure"))
    beaten = within.join(shorter, ["fewer", "verdict"]).where("as_sure >= sure").select("needs", "verdict").distinct()
    rules = stage(rules.join(beaten, ["needs", "verdict"], "left_anti"), "minimal")
    # the rarest token of a combination, the least of equally many
    posted = rules.select("*", F.explode("needs").alias("token")).join(counted.select("token", "n"), "token").groupBy(
        "needs", "verdict", "sure", "support").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    # a rule goes if a shorter one within it says the same and is as sure; both meet under the shorter one's token
    longer = posted.select(F.explode("needs").alias("token"), F.col("needs").alias("all"), F.col("verdict").alias("same"),
                           F.col("sure").alias("less"))
    beaten = longer.join(posted, "token").where(
        (F.col("verdict") == F.col("same")) & (F.size("needs") < F.size("all")) & (F.col("sure") >= F.col("less"))
        & (F.size(F.array_except("needs", "all")) == 0)).select(F.col("all").alias("needs"), F.col("same").alias("verdict")).distinct()
    kept = posted.join(beaten, ["needs", "verdict"], "left_anti")
    return kept.select("token", F.lit(False).alias("stated"), F.lit("").alias("rule_path"), "needs", "sure", "support",
                       F.array_join("needs", " & ").alias("rule"), "verdict")


# ---- matching --------------------------------------------------------------------------------------

def match(pages: DataFrame, index: DataFrame, deepest: int) -> DataFrame:
    """(page_id, url, stated, rule, verdict) of every row of ``pages`` by the best entry of ``index``.

    ``deepest`` is the number of labels of the deepest stated host. Rows are grouped once, by page and URL; looking up
    and choosing keep that partitioning.
    """
    url = F.col("url")
    grouped = pages.select("page_id", F.col("url").cast("string").alias("url")).groupBy(
        "page_id", "url", F.pmod(F.spark_partition_id(), F.lit(SHARES)).alias("share")).agg(F.count(F.lit(1)).alias("copies"))
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), url_tokens(url), host_tokens(url, max(deepest, 1))))
    looked = grouped.select("*", path_of(url).alias("path"), tokens.alias("tokens")).select(
        "*", F.explode("tokens").alias("token")).join(broadcast_if_small(index), "token")
    fits = F.startswith("path", "rule_path") & (F.size(F.array_except("needs", "tokens")) == 0)
    # stated before mined; the rest as the heading says
    weight = F.struct((~F.col("stated")).alias("a"), (-F.col("sure")).alias("b"), (-F.col("support")).alias("c"),
                      F.size("needs").alias("d"), F.col("rule").alias("e"))
    chosen = looked.where(fits).groupBy("page_id", "url", "share", "copies").agg(
        F.min_by(F.struct("stated", "rule", "verdict"), weight).alias("by"))
    return chosen.select("page_id", "url", "by.*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).drop("copy")


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, rules: DataFrame | None = None,
                support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``page_id``, ``url``, ``host``, ``path``, ``rule`` (of a stated rule, else null), ``mined`` (the combination that
    decided, else null) and ``verdict`` of every row of ``pages``; other columns are not read.

    ``labelled`` has (url, verdict) rows to mine from. Without it the URLs that a stated rule judges are the labelled
    ones, so that mined rules carry the stated verdicts to hosts that no rule names.
    """
    spark = pages.sparkSession
    stated = stage(_stated_index(rule_table(spark) if rules is None else rules), "stated-rules")
    deepest = stated.agg(F.max(F.size(F.split("token", r"\."))).alias("n")).first()["n"] or 1
    default = _default_index(spark)
    if labelled is None:
        labelled = stage(match(pages, stated.unionByName(default), deepest).where("stated").select("url", "verdict"), "labelled-urls")
    index = stage(stated.unionByName(mine(labelled, support, confidence)).unionByName(default), "url-rules")
    out = match(pages, index, deepest)
    named = F.when(F.col("rule") != "", F.col("rule"))
    return out.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                      F.when(F.col("stated"), named).alias("rule"), F.when(~F.col("stated"), named).alias("mined"), "verdict")
