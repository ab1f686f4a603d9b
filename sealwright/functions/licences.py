"""Licence keys, plans, expiry and trial rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import LICENCE_PAYLOAD

# Fixed values
KEY_PREFIX = "ARC1"
MAX_KEY_CHARS = 4096
SESSION_PATTERN = "^cs_(test|live)_[A-Za-z0-9]{10,200}$"
PAID_TYPES = ("checkout.session.completed", "checkout.session.async_payment_succeeded")
PAID_STATES = ("paid", "no_payment_required")
TOLERANCE_SECONDS = 300
GRACE_DAYS = 14
SUBSCRIPTION_MONTHS = 12
TRIAL_DAYS = 180
DAY_MS = 86_400_000


# ---- keys -------------------------------------------------------------------------------

def base64url(raw: Column) -> Column:
    return F.rtrim(F.translate(F.regexp_replace(F.base64(raw), "\\s", ""), "+/", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    """Bytes, or null when the text does not decode."""
    plain = F.translate(F.rtrim(text, F.lit("=")), "-_", "+/")
    padding = F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int"))
    return F.try_to_binary(F.concat(plain, padding), F.lit("base64"))


def encode_key(payload_json: Column, signature: Column) -> Column:
    return F.concat_ws(".", F.lit(KEY_PREFIX), base64url(F.encode(payload_json, "UTF-8")), base64url(signature))


def unpack_key(key: Column) -> Column:
    """struct(fault, json, payload): ``malformed`` by shape, ``damaged`` when nothing decodes.

    White space inside a key is ignored. Signatures are not checked here.
    """
    k = F.regexp_replace(F.coalesce(key, F.lit("")), "\\s", "")
    parts = F.split(k, "\\.")
    shaped = (k != "") & (F.length(k) <= MAX_KEY_CHARS) & (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == KEY_PREFIX)
    raw = F.when(shaped, from_base64url(F.get(parts, F.lit(1))))
    signature = F.when(shaped, from_base64url(F.get(parts, F.lit(2))))
    text = F.decode(raw, "UTF-8")
    broken = text.isNull() | signature.isNull() | F.try_parse_json(text).isNull()
    fault = F.when(~shaped, "malformed").when(broken, "damaged")
    return F.struct(fault.alias("fault"), text.alias("json"), F.from_json(text, LICENCE_PAYLOAD).alias("payload"))


def licence_verdict(unpacked: Column, product: str, today: Column) -> Column:
    """First failing rule, in order; a licence is still good on its last day."""
    payload = unpacked["payload"]
    expires = payload["expires"]
    has_expiry = expires.isNotNull() & (expires != "")
    date = F.try_to_date(F.when(expires.rlike(r"^\d{4}-\d{2}-\d{2}$"), expires), "yyyy-MM-dd")
    ours = (payload["v"] == "1") & (payload["product"] == product)
    return (F.when(unpacked["fault"].isNotNull(), unpacked["fault"])
            .when(~F.coalesce(ours, F.lit(False)), "wrong_product")
            .when(has_expiry & date.isNull(), "bad_expiry")
            .when(has_expiry & (date < today), "expired").otherwise("valid"))


# ---- entitlements -----------------------------------------------------------------------

def entitlement(plan: Column, source: Column, licensee: Column, expires: Column) -> Column:
    """Plan, where it comes from, and the three rights that follow from the plan."""
    pro = plan == "pro"
    return F.struct(plan.alias("plan"), source.alias("source"), licensee.alias("licensee"), expires.alias("expires"),
                    pro.alias("clean_export"), pro.alias("seal"), pro.alias("batch"))


def resolve_entitlement(owned_plan: Column, owned_source: Column, licensee: Column, expires: Column,
                        trial_active: Column, trial_ends: Column) -> Column:
    """A purchase wins, then a running trial, then whatever is owned."""
    trial = F.coalesce(trial_active, F.lit(False)) & (owned_plan != "pro")
    none = F.lit(None).cast("string")
    return entitlement(F.when(trial, "pro").otherwise(owned_plan), F.when(trial, "trial").otherwise(owned_source),
                       F.when(trial, "").otherwise(F.coalesce(licensee, F.lit(""))),
                       F.when(trial, trial_ends).when(owned_plan == "pro", expires).otherwise(none))


def trial_ends_ms(started: Column) -> Column:
    return started + F.lit(TRIAL_DAYS * DAY_MS)


def trial_active(started: Column, last_seen: Column) -> Column:
    return last_seen < trial_ends_ms(started)


def trial_days_left(started: Column, last_seen: Column) -> Column:
    """Whole days, rounded up."""
    left = F.floor((trial_ends_ms(started) - last_seen + F.lit(DAY_MS - 1)) / F.lit(DAY_MS))
    return F.when(trial_active(started, last_seen), left).otherwise(0)


def trial_end_date(started: Column) -> Column:
    return F.date_format(F.timestamp_millis(trial_ends_ms(started)), "yyyy-MM-dd")


# ---- checkout ---------------------------------------------------------------------------

def add_months_overflow(day: Column, months: Column) -> Column:
    """Calendar months with overflow: 31 January + 1 month is 3 March, not the 28 February
    ``add_months`` gives."""
    return F.date_add(F.add_months(F.trunc(day, "MM"), months), F.dayofmonth(day) - 1)


def licence_expiry(issued: Column, months: Column, mode: Column) -> Column:
    """Paid period plus grace; null for purchases without one."""
    term = F.coalesce(F.nullif(months, F.lit(0)), F.when(mode == "subscription", SUBSCRIPTION_MONTHS))
    return F.date_add(add_months_overflow(issued, term), GRACE_DAYS)


def webhook_stamp(header: Column, now_seconds: Column) -> Column:
    """struct(t, signatures, fresh). A header may carry several v1 signatures."""
    items = F.transform(F.split(header, ","), lambda i: F.split(i, "="))

    def named(name: str) -> Column:
        return F.transform(F.filter(items, lambda i: F.get(i, F.lit(0)) == name),
                           lambda i: F.coalesce(F.get(i, F.lit(1)), F.lit("")))
    stamps = named("t")
    t = F.get(stamps, F.size(stamps) - 1)
    signatures = F.filter(named("v1"), lambda s: s != "")
    seconds = F.when(t.rlike(r"^\d{1,18}$"), t).cast("bigint")
    fresh = (seconds.isNotNull() & (F.size(signatures) > 0)
             & (F.abs(now_seconds - seconds) <= TOLERANCE_SECONDS))
    return F.struct(seconds.alias("t"), signatures.alias("signatures"), F.coalesce(fresh, F.lit(False)).alias("fresh"))


def is_session_id(col: Column) -> Column:
    return F.coalesce(col.rlike(SESSION_PATTERN), F.lit(False))
