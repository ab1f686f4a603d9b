"""Projections, filters and joins over repository API dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


RUNS_LIMIT = 10


def _short(sha: str) -> Column:
    return F.substring(F.col(sha), 1, 7)


def _names(col: str, field: str = "name") -> Column:
    return F.transform(col, lambda x: x[field])


def project_api(kind: str, df: DataFrame) -> DataFrame:
    """The fields of each kind that reports show."""
    c = F.col
    if kind == "runs":
        return df.select("id", "name", "status", "conclusion", c("head_branch").alias("branch"),
                         _short("head_sha").alias("sha"), c("run_started_at").alias("started"),
                         c("updated_at").alias("updated"), c("html_url").alias("url"))
    if kind == "pulls":
        return df.select("number", "title", "state", c("user.login").alias("author"), c("head.ref").alias("branch"),
                         _names("labels").alias("labels"), "draft", c("created_at").alias("created"),
                         c("updated_at").alias("updated"), c("html_url").alias("url"))
    if kind == "issues":
        return df.select("number", "title", "state", c("user.login").alias("author"), _names("labels").alias("labels"),
                         _names("assignees", "login").alias("assignees"), c("milestone.title").alias("milestone"),
                         c("created_at").alias("created"), c("html_url").alias("url"))
    if kind == "branches":
        return df.select("name", _short("commit.sha").alias("sha"), "protected")
    if kind == "releases":
        return df.select(c("tag_name").alias("tag"), "name", "draft", "prerelease", c("published_at").alias("published"),
                         c("html_url").alias("url"), "assets")
    raise ValueError(f"unknown kind: {kind}")


def size_mb(size: Column) -> Column:
    """Megabytes with one decimal, without thousands separators."""
    return F.replace(F.format_number(size / 1048576, 1), F.lit(","), F.lit(""))


def release_assets(releases: DataFrame) -> DataFrame:
    """One row per downloadable asset."""
    return project_api("releases", releases).select("tag", "published", F.explode("assets").alias("a")).select(
        "tag", "published", F.col("a.name").alias("name"), size_mb(F.col("a.size")).alias("size_mb"),
        F.col("a.download_count").alias("downloads"), F.col("a.browser_download_url").alias("url"))


def filter_api(kind: str, df: DataFrame, branch: str | None = None, status: str | None = None,
               state: str | None = None, label: str | None = None, include_drafts: bool = False,
               limit: int | None = None) -> DataFrame:
    """Filters of the list reports on raw dumps; ``limit`` takes the latest by update time.

    Issue dumps include pull requests, which are left out; releases leave drafts out.
    """
    c = F.col
    if kind == "runs":
        df = df.where(c("head_branch") == branch) if branch else df
        # a status filter also matches the conclusion
        df = df.where((c("status") == status) | (c("conclusion") == status)) if status else df
    if kind in ("pulls", "issues") and state not in (None, "all"):
        df = df.where(c("state") == state)
    if kind == "issues":
        df = df.where(c("pull_request").isNull())
        df = df.where(F.exists("labels", lambda x: x["name"] == label)) if label else df
    if kind == "releases" and not include_drafts:
        df = df.where(~c("draft"))
    if limit is not None:
        latest = {"runs": "updated_at", "pulls": "updated_at", "issues": "created_at", "releases": "published_at"}.get(kind)
        tie = {"runs": "id", "pulls": "number", "issues": "number", "releases": "tag_name", "branches": "name"}[kind]
        order = [F.desc(latest)] if latest else []
        df = df.orderBy(*order, tie).limit(limit)
    return df


def run_detail(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Runs with their jobs and steps, one row per step; a run may have any number of jobs, one without jobs
    keeps a row of its own."""
    c = F.col
    steps = jobs.select("run_id", c("name").alias("job"), c("status").alias("job_status"),
                        c("conclusion").alias("job_conclusion"), F.posexplode_outer("steps").alias("step_no", "s")).select(
        c("run_id").alias("id"), "job", "job_status", "job_conclusion", "step_no", c("s.name").alias("step"),
        c("s.status").alias("step_status"), c("s.conclusion").alias("step_conclusion"))
    base = project_api("runs", runs)
    return base.join(steps, "id").unionByName(_childless(base, steps, "id"), allowMissingColumns=True)


def _childless(parents: DataFrame, children: DataFrame, *keys: str) -> DataFrame:
    """Parents no child names. Children are counted down to their keys before the shuffle, so a parent with
    very many of them weighs no more than others."""
    return parents.join(children.select(*keys).distinct(), list(keys), "left_anti")


def pr_detail(pulls: DataFrame, reviews: DataFrame, checks: DataFrame) -> DataFrame:
    """Pull requests with reviews (by number) and checks (by head commit), one row per item; a request without
    either keeps a row of its own."""
    c = F.col
    base = pulls.select("number", "title", "state", c("user.login").alias("author"), c("head.sha").alias("head_sha"),
                        c("head.ref").alias("branch"), c("base.ref").alias("base"), "merged", "mergeable",
                        _names("labels").alias("labels"), "additions", "deletions", "changed_files",
                        c("html_url").alias("url"))
    seen = reviews.select("number", F.lit("review").alias("item"), c("user.login").alias("item_name"),
                          c("state").alias("item_state"), c("submitted_at").alias("item_at"))
    ran = checks.select("head_sha", F.lit("check").alias("item"), c("name").alias("item_name"),
                        F.coalesce("conclusion", "status").alias("item_state"), F.lit(None).cast("string").alias("item_at"))
    alone = _childless(_childless(base, seen, "number"), ran, "head_sha")
    return base.join(seen, "number").unionByName(base.join(ran, "head_sha")).unionByName(alone, allowMissingColumns=True)


def pr_counts(pulls: DataFrame, reviews: DataFrame, checks: DataFrame) -> DataFrame:
    """Per pull request: reviews, approvals, checks and failed checks. Both children are counted
    before they are joined."""
    c = F.col
    seen = reviews.groupBy("number").agg(F.count(F.lit(1)).alias("reviews"),
                                         F.count_if(c("state") == "APPROVED").alias("approvals"))
    ran = checks.groupBy("head_sha").agg(F.count(F.lit(1)).alias("checks"),
                                         F.count_if(c("conclusion") == "failure").alias("failed_checks"))
    joined = pulls.select("number", "title", "state", c("head.sha").alias("head_sha")).join(seen, "number", "left").join(
        ran, "head_sha", "left")
    return joined.select("number", "title", "state", *[F.coalesce(k, F.lit(0)).alias(k)
                                                       for k in ("reviews", "approvals", "checks", "failed_checks")])


def repo_languages(repos: DataFrame, languages: DataFrame) -> DataFrame:
    """Repositories with bytes per language, one row per language; one without languages keeps a row of its own."""
    c = F.col
    spread = languages.select("full_name", F.explode_outer("languages").alias("language", "bytes"))
    base = repos.select("full_name", "description", "default_branch", c("stargazers_count").alias("stars"),
                        c("forks_count").alias("forks"), c("open_issues_count").alias("open_issues"), "private",
                        c("created_at").alias("created"), c("pushed_at").alias("pushed"), "homepage",
                        c("html_url").alias("url"))
    return base.join(spread, "full_name", "left")


def tree_vaults(tree: DataFrame, prefix: str = "", suffix: str = ".arcr") -> DataFrame:
    """Vault files in a repository tree listing."""
    return tree.where((F.col("type") == "blob") & F.col("path").endswith(suffix) & F.col("path").startswith(prefix)).select(
        "path", F.col("size").alias("size_bytes"))
