"""Licences issued from checkout events, and trial clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import licences as fx
from ..session import broadcast_if_small
from .joins import skew_join
from .ordered import Running, bucket_of, prefix_scan


def paid_sessions(events: DataFrame) -> DataFrame:
    """Completed or later-paid sessions with a well-formed id."""
    return events.where(F.col("type").isin(*fx.PAID_TYPES) & fx.is_session_id(F.col("session_id"))
                        & F.col("payment_status").isin(*fx.PAID_STATES))


def drop_stale(events: DataFrame) -> DataFrame:
    """Events whose signature stamp is within tolerance of the receiving clock."""
    stamp = fx.webhook_stamp(F.col("signature_header"), F.unix_seconds(F.col("recv_ts")))
    return events.where(stamp["fresh"])


def with_plan(sessions: DataFrame, plans: DataFrame, product: str) -> DataFrame:
    """Adds plan, seats and months: the payment link decides, then the session's metadata;
    sessions of neither kind are not ours and are dropped.

    ``product`` prefixes the metadata keys. The plan table is broadcast after its size is checked.
    """
    linked = plans.select("payment_link", F.struct("plan", "seats", "months").alias("linked"))
    joined = sessions.join(broadcast_if_small(linked), "payment_link", "left")
    return _chosen(joined, product)


def _chosen(joined: DataFrame, product: str) -> DataFrame:
    md = lambda key: F.nullif(F.try_element_at("metadata", F.lit(f"{product}_{key}")), F.lit(""))
    stated = F.when(md("plan").isNotNull(), F.struct(
        md("plan").alias("plan"), F.coalesce(md("seats").try_cast("int"), F.lit(1)).alias("seats"),
        md("months").try_cast("int").alias("months")))
    return (joined.withColumn("_chosen", F.coalesce("linked", stated)).where(F.col("_chosen").isNotNull())
            .select("*", "_chosen.plan", "_chosen.seats", "_chosen.months").drop("linked", "_chosen"))


def licence_columns(sessions: DataFrame, product: str, *more: Column) -> DataFrame:
    """Licence payloads of planned sessions. The id is taken from the session digest, so a rerun
    of a lost task issues the same one."""
    c = F.col
    issued = F.to_date("recv_ts")
    filled = lambda col: F.nullif(col, F.lit(""))
    seats = F.coalesce(F.nullif("seats", F.lit(0)), F.lit(1)) * F.coalesce(F.nullif("quantity", F.lit(0)), F.lit(1))
    return sessions.select(
        F.lit(1).alias("v"), F.lit(product).alias("product"),
        F.concat(F.lit("lic_"), F.substring(F.sha2("session_id", 256), 1, 16)).alias("id"),
        F.coalesce(filled(c("plan")), F.lit("pro")).alias("plan"),
        F.coalesce(filled(c("customer_details.email")), c("customer_email"), F.lit("")).alias("email"),
        F.coalesce(c("customer_details.name"), F.lit("")).alias("name"), seats.alias("seats"), issued.alias("issued"),
        fx.licence_expiry(issued, c("months"), c("mode")).alias("expires"), c("session_id").alias("order"), *more)


def build_licenses(events: DataFrame, plans: DataFrame, product: str) -> DataFrame:
    """One licence per paid session of ours, from its earliest event; retries combine map-side."""
    planned = with_plan(paid_sessions(events), plans, product)
    row = F.struct(*planned.columns)
    first = planned.groupBy(F.col("session_id").alias("_sid")).agg(
        F.min_by(row, F.struct("recv_ts", "type")).alias("row")).select("row.*")
    return licence_columns(first, product)


def lookup_license(requests: DataFrame, issued: DataFrame) -> DataFrame:
    """Licence of a requested session: ``found``, ``not ready`` or ``bad session id``."""
    found = issued.select(F.col("order").alias("session_id"), F.col("id").alias("licence_id"))
    joined = skew_join(requests, found, ["session_id"], "left")
    return joined.withColumn("answer", F.when(~fx.is_session_id(F.col("session_id")), "bad session id")
                             .when(F.col("licence_id").isNull(), "not ready").otherwise("found"))


def license_verdicts(keys: DataFrame, product: str, today) -> DataFrame:
    """Adds ``verdict`` and the unpacked payload to rows with a ``key``."""
    out = keys.withColumn("_u", fx.unpack_key(F.col("key")))
    return out.select(*keys.columns, fx.licence_verdict(F.col("_u"), product, today).alias("verdict"),
                      F.col("_u.payload").alias("payload"))


def trial_clock(observations: DataFrame) -> DataFrame:
    """Trial state after every observation: the clock starts once and never runs backwards.

    Needs install_id, arrival (unique integer order) and observed_ms. Bucketed, so an install with
    very many observations is not sorted in one task.
    """
    bucketed = observations.withColumn("_bucket", bucket_of(F.col("arrival")))
    scanned = prefix_scan(bucketed, ["install_id"], "_bucket", "arrival", [
        Running("started_ms", "first", F.col("observed_ms")), Running("last_seen_ms", "max", F.col("observed_ms"))])
    c = F.col
    return scanned.drop("_bucket").withColumns({
        "active": fx.trial_active(c("started_ms"), c("last_seen_ms")),
        "days_left": fx.trial_days_left(c("started_ms"), c("last_seen_ms")),
        "ends": fx.trial_end_date(c("started_ms"))})


def trial_state(observations: DataFrame) -> DataFrame:
    """Current trial state per install: two combinable aggregates."""
    state = observations.groupBy("install_id").agg(
        F.min_by("observed_ms", "arrival").alias("started_ms"), F.max("observed_ms").alias("last_seen_ms"))
    c = F.col
    return state.withColumns({
        "active": fx.trial_active(c("started_ms"), c("last_seen_ms")),
        "days_left": fx.trial_days_left(c("started_ms"), c("last_seen_ms")),
        "ends": fx.trial_end_date(c("started_ms"))})


def entitlements(owned: DataFrame, trials: DataFrame) -> DataFrame:
    """What each install may do. ``owned``: install_id, plan, source, licensee, expires."""
    states = trials.select("install_id", "active", "ends")
    c = F.col
    joined = states.join(owned, "install_id", "full_outer")
    right = fx.resolve_entitlement(F.coalesce(c("plan"), F.lit("free")), F.coalesce(c("source"), F.lit("none")),
                                   c("licensee"), c("expires"), c("active"), c("ends"))
    return joined.select("install_id", right.alias("e")).select("install_id", "e.*")
