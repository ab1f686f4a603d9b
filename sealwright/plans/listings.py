"""Registered queries over product catalogues and repository API dumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import apidumps as api, catalogue as cat
from ..sources import apidumps as asrc, catalogue as csrc
from . import tables as t

_files: dict = {}


def _written(spark, sf_dir, name, write):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _files:
        path = t.scratch(spark, name)
        write(path)
        _files[key] = path
    return _files[key]


# ---- catalogue --------------------------------------------------------------------------

def products(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("tier"))


def prices(spark, sf_dir):
    p = t.table(spark, sf_dir, "part").where("p_type <> 'PROMO'")
    return p.select(F.col("p_partkey").alias("product_id"), F.rint(F.col("p_retailprice") * 100).cast("bigint").alias("amount"),
                    F.lit("usd").alias("currency"))


def features(spark, sf_dir):
    li = t.table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("product_id"), F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("feature")).distinct()


CATALOGUE_SQL = """
WITH products AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS tier FROM part),
prices AS (SELECT p_partkey AS product_id, round_even(p_retailprice * 100, 0)::BIGINT AS amount, 'usd' AS currency FROM part WHERE p_type <> 'PROMO'),
features AS (SELECT DISTINCT l_partkey AS product_id, l_returnflag || ' ' || l_linestatus AS feature FROM lineitem)
"""


def catalogue_csv(spark, sf_dir):
    """The catalogue as quoted CSV, with names that need quoting and ';'-joined features."""
    def write(path):
        p = t.table(spark, sf_dir, "part")
        p.select(F.col("p_partkey").cast("string").alias("product_id"),
                 F.concat(F.lit('the "'), "p_name", F.lit('", '), "p_brand").alias("product_name"),
                 F.rint(F.col("p_retailprice") * 100).cast("bigint").alias("amount"),
                 F.concat_ws(";", "p_type", "p_brand", "p_size").alias("features")).write.mode("errorifexists").option(
            "header", True).option("quote", '"').option("escape", '"').csv(path)
    return csrc.read_catalogue_csv(spark, _written(spark, sf_dir, "catalogue-csv", write))


def merchant_feed(spark, sf_dir):
    def write(path):
        t.table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
            F.concat(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit(" USD")).alias("price")).write.mode(
            "errorifexists").option("header", True).option("sep", "\t").csv(path)
    return csrc.read_catalogue_csv(spark, _written(spark, sf_dir, "merchant-feed", write), sep="\t")


def catalogue_json(spark, sf_dir):
    def write(path):
        p = t.table(spark, sf_dir, "part")
        price = F.struct(F.concat(F.lit("price_"), F.col("p_partkey").cast("string")).alias("id"),
                         F.rint(F.col("p_retailprice") * 100).cast("bigint").alias("unit_amount"),
                         F.lit("usd").alias("currency"), F.lit("one_time").alias("type"))
        one = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"),
                       F.col("p_type").alias("description"), F.create_map(F.lit("tier"), F.col("p_brand")).alias("metadata"),
                       F.when(F.col("p_size") > 5, F.array(price)).alias("prices"), F.array("p_type", "p_brand").alias("features"))
        p.select(F.array(one).alias("products")).write.mode("errorifexists").json(path)
    return csrc.read_catalogue_json(spark, _written(spark, sf_dir, "catalogue-json", write), multi_line=False)


def _json_rows(spark, sf_dir):
    prod, price, feat = catalogue_json(spark, sf_dir)
    counted = feat.groupBy("product_id").agg(F.count(F.lit(1)).alias("features"))
    return prod.join(price, "product_id", "left").join(counted, "product_id").select(
        "product_id", "name", "tier", F.coalesce("amount", F.lit(-1)).alias("amount"), "features")


def shifted_copy(spark, sf_dir):
    """A catalogue copy with other prices for small parts, without promotions and one brand renamed."""
    p = t.table(spark, sf_dir, "part")
    return p.where("p_type <> 'PROMO'").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
        F.when(F.col("p_brand") == "Brand#7", "Brand#70").otherwise(F.col("p_brand")).alias("brand"),
        (F.col("p_size") + F.when(F.col("p_size") < 10, 1).otherwise(0)).alias("size"))


def base_copy(spark, sf_dir):
    p = t.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
                    F.col("p_size").alias("size"))


COPIES_SQL = """
WITH a AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, p_size AS size FROM part),
b AS (SELECT p_partkey AS product_id, p_name AS name, CASE p_brand WHEN 'Brand#7' THEN 'Brand#70' ELSE p_brand END AS brand,
             p_size + CASE WHEN p_size < 10 THEN 1 ELSE 0 END AS size FROM part WHERE p_type <> 'PROMO')
"""


# ---- repository dumps -------------------------------------------------------------------

def _stamp(col, shift=0):
    return F.date_format(F.col(col).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(shift)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _dump_rows(spark, sf_dir, kind):
    c = F.col
    if kind == "runs":
        conv = t.table(spark, sf_dir, "conversations").where("turn = 0")
        return conv.select(
            c("conv_id").alias("id"), F.concat(F.lit("run "), c("role")).alias("name"),
            F.when(F.length("text") < 60, "in_progress").otherwise("completed").alias("status"),
            F.when(F.length("text") > 200, "failure").when(F.length("text") >= 60, "success").alias("conclusion"),
            F.when(c("conv_id") % 3 == 0, "main").otherwise("work").alias("head_branch"),
            F.sha1(c("conv_id").cast("string")).alias("head_sha"), F.lit("2024-01-01T00:00:00Z").alias("run_started_at"),
            F.concat(F.lit("2024-01-"), F.lpad((c("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("updated_at"),
            F.lit("u").alias("html_url"))
    if kind == "jobs":
        step = lambda name, bad: F.struct(F.lit(name).alias("name"), F.lit("completed").alias("status"),
                                          F.when(bad, "failure").otherwise("success").alias("conclusion"))
        return t.table(spark, sf_dir, "conversations").where("conv_id % 6 <> 1").select(
            c("conv_id").alias("run_id"), F.concat_ws("-", "role", "turn").alias("name"), F.lit("completed").alias("status"),
            F.when(F.length("text") > 200, "failure").otherwise("success").alias("conclusion"),
            F.array(step("checkout", F.lit(False)), step("test", F.length("text") > 200)).alias("steps"))
    if kind == "releases":
        asset = lambda ext, mul: F.struct(F.concat("p_name", F.lit(ext)).alias("name"), (c("p_partkey") * mul + 17).alias("size"),
                                          c("p_size").cast("bigint").alias("download_count"), F.lit("u").alias("browser_download_url"))
        return t.table(spark, sf_dir, "part").select(
            F.concat(F.lit("v"), c("p_partkey").cast("string")).alias("tag_name"), c("p_name").alias("name"),
            (c("p_size") < 10).alias("draft"), (c("p_size") > 40).alias("prerelease"),
            F.concat(F.lit("2024-02-"), F.lpad((c("p_size") % 28 + 1).cast("string"), 2, "0")).alias("published_at"),
            F.lit("u").alias("html_url"), F.array(asset(".zip", 3_000_000), asset(".sha256", 0)).alias("assets"))
    if kind in ("pulls", "issues"):
        o = t.table(spark, sf_dir, "orders")
        common = [c("o_orderkey").alias("number"), F.concat(F.lit("Order "), c("o_orderkey").cast("string")).alias("title"),
                  F.when(c("o_orderstatus") == "O", "open").otherwise("closed").alias("state"),
                  F.struct(F.concat(F.lit("user"), c("o_custkey").cast("string")).alias("login")).alias("user"),
                  F.array(F.struct(c("o_orderpriority").alias("name"))).alias("labels"),
                  _stamp("o_orderdate").alias("created_at"), F.lit("u").alias("html_url")]
        if kind == "issues":
            return o.select(*common, F.array(F.struct(F.lit("a").alias("login"))).alias("assignees"),
                            F.when(c("o_custkey") % 2 == 0, F.struct(F.lit("m1").alias("title"))).alias("milestone"),
                            F.when(c("o_orderkey") % 4 == 0, F.struct(F.lit("x").alias("url"))).alias("pull_request"))
        return o.select(*common, F.struct(F.lit("work").alias("ref"), F.sha1(c("o_orderkey").cast("string")).alias("sha")).alias("head"),
                        F.struct(F.lit("main").alias("ref")).alias("base"), (c("o_orderstatus") == "P").alias("draft"),
                        _stamp("o_orderdate", 12).alias("updated_at"), (c("o_orderstatus") == "F").alias("merged"),
                        (c("o_custkey") % 2 == 0).alias("mergeable"),
                        c("o_custkey").alias("additions"), F.lit(1).alias("deletions"), F.lit(2).alias("changed_files"))
    if kind == "reviews":
        return t.table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").select(
            c("l_orderkey").alias("number"), F.struct(F.concat(F.lit("r"), c("l_suppkey").cast("string")).alias("login")).alias("user"),
            F.when(c("l_returnflag") == "A", "APPROVED").otherwise("COMMENTED").alias("state"), _stamp("l_shipdate").alias("submitted_at"))
    if kind == "checks":
        return t.table(spark, sf_dir, "lineitem").where("l_orderkey % 4 <> 0").select(
            F.sha1(c("l_orderkey").cast("string")).alias("head_sha"), F.concat(F.lit("check "), c("l_linenumber").cast("string")).alias("name"),
            F.lit("completed").alias("status"), F.when(c("l_quantity") > 45, "failure").otherwise("success").alias("conclusion"))
    if kind == "branches":
        return t.table(spark, sf_dir, "supplier").select(
            c("s_name").alias("name"), F.struct(F.sha1("s_name").alias("sha")).alias("commit"), (c("s_acctbal") > 0).alias("protected"))
    if kind == "repos":
        return t.table(spark, sf_dir, "supplier").select(
            c("s_name").alias("full_name"), F.concat(F.lit("parts of "), c("s_name")).alias("description"),
            F.lit("main").alias("default_branch"), c("s_suppkey").cast("bigint").alias("forks_count"),
            F.lit("2024-01-01").alias("created_at"), F.lit("2024-02-01").alias("pushed_at"), F.lit("h").alias("homepage"),
            F.concat(F.lit("u/"), c("s_name")).alias("html_url"), c("s_nationkey").cast("bigint").alias("stargazers_count"),
            F.lit(0).cast("bigint").alias("open_issues_count"), (c("s_acctbal") < 0).alias("private"))
    if kind == "languages":
        return t.table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(
            c("s_name").alias("full_name"), F.create_map(F.lit("Rust"), c("s_suppkey") * 10, F.lit("Python"), c("s_suppkey") + 1).alias("languages"))
    if kind == "tree":
        return t.table(spark, sf_dir, "orders").select(
            F.when(c("o_orderstatus") == "F", "tree").otherwise("blob").alias("type"),
            F.concat(F.when(c("o_custkey") % 2 == 0, "vault/").otherwise("other/"), c("o_orderkey").cast("string"),
                     F.when(c("o_orderpriority") == "5-LOW", ".txt").otherwise(".arcr")).alias("path"), c("o_custkey").alias("size"))
    raise ValueError(kind)


def dump(spark, sf_dir, kind):
    path = _written(spark, sf_dir, f"dump-{kind}",
                    lambda p: t.packed(_dump_rows(spark, sf_dir, kind)).json(p))
    return asrc.read_api_dump(spark, kind, path)


def _joined(col):
    return F.array_join(col, ",")


QUERIES = {
    "catalogue_rows": lambda s, d: cat.catalogue(products(s, d), prices(s, d), features(s, d)).select(
        "product_id", "name", "tier", F.coalesce("amount", F.lit(-1)).alias("amount"), F.coalesce("feature", F.lit("none")).alias("feature")),
    "catalogue_feature_counts": lambda s, d: cat.feature_counts(products(s, d), prices(s, d), features(s, d)).select(
        "product_id", "name", F.coalesce("amount", F.lit(-1)).alias("amount"), "features"),
    "catalogue_csv": lambda s, d: catalogue_csv(s, d).select(
        "product_id", "product_name", F.col("amount").cast("bigint").alias("amount"), F.size("features").alias("features"),
        F.element_at("features", 1).alias("first_feature")),
    "catalogue_feed": lambda s, d: merchant_feed(s, d).select("id", "title", csrc.feed_price(F.col("price")).alias("p")).select(
        "id", "title", "p.cents", "p.currency"),
    "catalogue_json": _json_rows,
    "catalogue_drift": lambda s, d: cat.catalogue_drift(base_copy(s, d), shifted_copy(s, d)),
    "catalogue_drift_columns": lambda s, d: cat.drift_columns(
        base_copy(s, d), shifted_copy(s, d), "product_id", ["brand", "size"]).select(
        "product_id", "present", "column", "a", F.coalesce("b", F.lit("none")).alias("b")),
    "repo_runs": lambda s, d: api.project_api("runs", api.filter_api("runs", dump(s, d, "runs"), branch="main", status="failure")).select(
        "id", "name", "status", "branch", "sha", "updated"),
    "repo_runs_latest": lambda s, d: api.project_api("runs", api.filter_api("runs", dump(s, d, "runs"), limit=api.RUNS_LIMIT)).select(
        "id", "status", "sha", "updated"),
    "repo_run_detail": lambda s, d: api.run_detail(dump(s, d, "runs"), dump(s, d, "jobs")).select(
        "id", "branch", *[F.coalesce(k, F.lit("none")).alias(k) for k in ("job", "job_conclusion", "step", "step_conclusion")],
        F.coalesce("step_no", F.lit(-1)).alias("step_no")),
    "repo_releases": lambda s, d: api.project_api("releases", api.filter_api("releases", dump(s, d, "releases"))).select(
        "tag", "name", "prerelease", "published", F.size("assets").alias("assets")),
    "repo_release_assets": lambda s, d: api.release_assets(api.filter_api("releases", dump(s, d, "releases"), include_drafts=True)).select(
        "tag", "name", "size_mb", "downloads"),
    "repo_pulls": lambda s, d: api.project_api("pulls", api.filter_api("pulls", dump(s, d, "pulls"), state="open")).select(
        "number", "title", "author", "branch", "draft", "updated", _joined("labels").alias("labels")),
    "repo_pulls_latest": lambda s, d: api.project_api("pulls", api.filter_api("pulls", dump(s, d, "pulls"), state="all", limit=10)).select(
        "number", "state", "updated"),
    "repo_issues": lambda s, d: api.project_api("issues", api.filter_api("issues", dump(s, d, "issues"), state="open", label="1-URGENT")).select(
        "number", "title", "author", F.coalesce("milestone", F.lit("none")).alias("milestone"), "created", _joined("labels").alias("labels")),
    "repo_branches": lambda s, d: api.project_api("branches", dump(s, d, "branches")),
    "repo_pull_items": lambda s, d: api.pr_detail(dump(s, d, "pulls"), dump(s, d, "reviews"), dump(s, d, "checks")).select(
        "number", "author", "branch", "base", "merged", "mergeable", _joined("labels").alias("labels"), "url",
        *[F.coalesce(k, F.lit("none")).alias(k) for k in ("item", "item_name", "item_state", "item_at")]),
    "repo_pull_counts": lambda s, d: api.pr_counts(dump(s, d, "pulls"), dump(s, d, "reviews"), dump(s, d, "checks")),
    "repo_languages": lambda s, d: api.repo_languages(dump(s, d, "repos"), dump(s, d, "languages")).withColumns({
        "language": F.coalesce("language", F.lit("none")), "bytes": F.coalesce("bytes", F.lit(0))}),
    "repo_tree_vaults": lambda s, d: api.tree_vaults(dump(s, d, "tree"), "vault/"),
}

_RUNS_SQL = """
WITH runs AS (
  SELECT conv_id AS id, 'run ' || role AS name, CASE WHEN length(text) < 60 THEN 'in_progress' ELSE 'completed' END AS status,
         CASE WHEN length(text) > 200 THEN 'failure' WHEN length(text) >= 60 THEN 'success' END AS conclusion,
         CASE WHEN conv_id % 3 = 0 THEN 'main' ELSE 'work' END AS branch, substr(sha1(conv_id::VARCHAR), 1, 7) AS sha,
         '2024-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS updated
  FROM conversations WHERE turn = 0)
"""
_PULLS_SQL = """
WITH pulls AS (
  SELECT o_orderkey AS number, 'Order ' || o_orderkey AS title, CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'closed' END AS state,
         'user' || o_custkey AS author, o_orderpriority AS labels, o_orderstatus, o_custkey,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created, strftime(o_orderdate + INTERVAL 12 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS updated
  FROM orders)
"""

ORACLE = {
    "catalogue_rows": CATALOGUE_SQL + """
SELECT product_id, name, tier, coalesce(amount, -1) AS amount, coalesce(feature, 'none') AS feature
FROM products LEFT JOIN prices USING (product_id) LEFT JOIN features USING (product_id)""",
    "catalogue_feature_counts": CATALOGUE_SQL + """
SELECT p.product_id, name, coalesce(amount, -1) AS amount, coalesce(n, 0) AS features
FROM products p LEFT JOIN prices USING (product_id) LEFT JOIN (SELECT product_id, count(*) AS n FROM features GROUP BY 1) f USING (product_id)""",
    "catalogue_csv": """
SELECT p_partkey::VARCHAR AS product_id, 'the "' || p_name || '", ' || p_brand AS product_name,
       round_even(p_retailprice * 100, 0)::BIGINT AS amount, 3 AS features, p_type AS first_feature FROM part""",
    "catalogue_feed": """
SELECT p_partkey::VARCHAR AS id, p_name AS title, (p_retailprice::DECIMAL(18,2) * 100)::BIGINT AS cents, 'usd' AS currency FROM part""",
    "catalogue_json": """
SELECT p_partkey::VARCHAR AS product_id, p_name AS name, p_brand AS tier,
       CASE WHEN p_size > 5 THEN round_even(p_retailprice * 100, 0)::BIGINT ELSE -1 END AS amount, 2 AS features FROM part""",
    "catalogue_drift": COPIES_SQL + """
SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'b' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "catalogue_drift_columns": COPIES_SQL + """
SELECT product_id, present, "column", a, coalesce(b, 'none') AS b FROM (
  SELECT a.product_id, CASE WHEN b.product_id IS NULL THEN 'only_a' ELSE 'both' END AS present, 'brand' AS "column", a.brand AS a, b.brand AS b
  FROM a LEFT JOIN b USING (product_id)
  UNION ALL
  SELECT a.product_id, CASE WHEN b.product_id IS NULL THEN 'only_a' ELSE 'both' END, 'size', a.size::VARCHAR, b.size::VARCHAR
  FROM a LEFT JOIN b USING (product_id)) WHERE a IS DISTINCT FROM b""",
    "repo_runs": _RUNS_SQL + """
SELECT id, name, status, branch, sha, updated FROM runs WHERE branch = 'main' AND (status = 'failure' OR conclusion = 'failure')""",
    "repo_runs_latest": _RUNS_SQL + "SELECT id, status, sha, updated FROM runs ORDER BY updated DESC, id LIMIT 10",
    "repo_run_detail": _RUNS_SQL + """
SELECT r.id, branch, coalesce(c.role || '-' || c.turn, 'none') AS job,
       CASE WHEN c.text IS NULL THEN 'none' WHEN length(c.text) > 200 THEN 'failure' ELSE 'success' END AS job_conclusion,
       CASE WHEN c.text IS NULL THEN -1 ELSE step_no END AS step_no,
       CASE WHEN c.text IS NULL THEN 'none' WHEN step_no = 0 THEN 'checkout' ELSE 'test' END AS step,
       CASE WHEN c.text IS NULL THEN 'none' WHEN step_no = 1 AND length(c.text) > 200 THEN 'failure' ELSE 'success' END AS step_conclusion
FROM runs r CROSS JOIN (SELECT unnest([0, 1]) AS step_no) s
LEFT JOIN conversations c ON c.conv_id = r.id AND c.conv_id % 6 <> 1
WHERE c.text IS NOT NULL OR step_no = 0""",
    "repo_releases": """
SELECT 'v' || p_partkey AS tag, p_name AS name, p_size > 40 AS prerelease,
       '2024-02-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') AS published, 2 AS assets FROM part WHERE NOT p_size < 10""",
    "repo_release_assets": """
SELECT 'v' || p_partkey AS tag, p_name || ext AS name, printf('%.1f', (p_partkey * mul + 17) / 1048576) AS size_mb, p_size AS downloads
FROM part, (VALUES ('.zip', 3000000), ('.sha256', 0)) AS a(ext, mul)""",
    "repo_pulls": _PULLS_SQL + "SELECT number, title, author, 'work' AS branch, false AS draft, updated, labels FROM pulls WHERE state = 'open'",
    "repo_pulls_latest": _PULLS_SQL + "SELECT number, state, updated FROM pulls ORDER BY updated DESC, number LIMIT 10",
    "repo_issues": _PULLS_SQL + """
SELECT number, title, author, CASE WHEN o_custkey % 2 = 0 THEN 'm1' ELSE 'none' END AS milestone, created, labels
FROM pulls WHERE state = 'open' AND labels = '1-URGENT' AND number % 4 <> 0""",
    "repo_branches": "SELECT s_name AS name, substr(sha1(s_name), 1, 7) AS sha, s_acctbal > 0 AS protected FROM supplier",
    "repo_pull_items": _PULLS_SQL + """,
items AS (
  SELECT l_orderkey AS number, 'review' AS item, 'r' || l_suppkey AS item_name,
         CASE l_returnflag WHEN 'A' THEN 'APPROVED' ELSE 'COMMENTED' END AS item_state,
         strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS item_at FROM lineitem WHERE l_orderkey % 3 <> 0
  UNION ALL
  SELECT l_orderkey, 'check', 'check ' || l_linenumber, CASE WHEN l_quantity > 45 THEN 'failure' ELSE 'success' END, 'none'
  FROM lineitem WHERE l_orderkey % 4 <> 0)
SELECT p.number, author, 'work' AS branch, 'main' AS base, o_orderstatus = 'F' AS merged, o_custkey % 2 = 0 AS mergeable, labels,
       'u' AS url, coalesce(item, 'none') AS item, coalesce(item_name, 'none') AS item_name,
       coalesce(item_state, 'none') AS item_state, coalesce(item_at, 'none') AS item_at
FROM pulls p LEFT JOIN items USING (number)""",
    "repo_pull_counts": _PULLS_SQL + """
SELECT number, title, state, count(l_orderkey) FILTER (WHERE number % 3 <> 0) AS reviews,
       count(*) FILTER (WHERE l_returnflag = 'A' AND number % 3 <> 0) AS approvals,
       count(l_orderkey) FILTER (WHERE number % 4 <> 0) AS checks,
       count(*) FILTER (WHERE l_quantity > 45 AND number % 4 <> 0) AS failed_checks
FROM pulls LEFT JOIN lineitem ON l_orderkey = number GROUP BY number, title, state""",
    "repo_languages": """
SELECT s_name AS full_name, 'parts of ' || s_name AS description, 'main' AS default_branch, s_nationkey AS stars,
       s_suppkey AS forks, 0 AS open_issues, s_acctbal < 0 AS private, '2024-01-01' AS created, '2024-02-01' AS pushed,
       'h' AS homepage, 'u/' || s_name AS url, coalesce(language, 'none') AS language,
       CASE language WHEN 'Rust' THEN s_suppkey * 10 WHEN 'Python' THEN s_suppkey + 1 ELSE 0 END AS bytes
FROM supplier LEFT JOIN (SELECT unnest(['Rust', 'Python']) AS language) ON s_suppkey % 5 <> 0""",
    "repo_tree_vaults": """
SELECT CASE WHEN o_custkey % 2 = 0 THEN 'vault/' ELSE 'other/' END || o_orderkey || '.arcr' AS path, o_custkey AS size_bytes
FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 2 = 0 AND o_orderpriority <> '5-LOW'""",
}
