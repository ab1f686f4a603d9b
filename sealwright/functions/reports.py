"""Page report texts and rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Repair defaults.
GLARE_LEVEL = 250
SHADOW_LEVEL = 5
MAX_MASKED_FRACTION = 0.30

# Wording of findings.
TOO_EXTENSIVE = ("Over 30.0% of the page is blown out, so nothing was changed. "
                 "Retake the photo at an angle to the light.")
REPAIR_OFF = "Repair is off: damage is reported, pixels are untouched."
FLATTENED = "Shadows and uneven lighting were evened out across the page."
GLARE_TEXT = ("%s glare spot%s found. Faded text around %s was restored. The blown-out centre (%s of the page)"
              " held no data and was filled smoothly. Text that was there cannot be recovered from this photo;"
              " turn on “Show filled areas” to see where.")
SHADOW_LEFT = ("%s solid black area%s left untouched. These are often redactions, photos or scanner edges."
               " You can fill them if they are shadows.")
SHADOW_FILLED = "%s solid black area%s filled, as you asked."
NOTHING_INVENTED = "No blown-out or blacked-out areas: nothing was invented."
ORDER_MAPPED = "Reading order mapped: %s text blocks."


def pct(share: Column) -> Column:
    """One decimal per cent, half-even on the exact value; tiny shares read ``under 0.1%``."""
    v = share * 100
    return F.when((v >= 0.1) | (v == 0), F.concat(F.format_number(v, 1), F.lit("%"))).otherwise("under 0.1%")


def odd(value: Column, minimum: Column | int) -> Column:
    """Half-even rounded, at least ``minimum``, then the next odd number."""
    low = minimum if isinstance(minimum, Column) else F.lit(minimum)
    n = F.greatest(F.rint(value.cast("double")).cast("int"), low.cast("int"))
    return n + F.when(n % 2 == 0, 1).otherwise(0)


def masked_fraction(masked: Column, total: Column) -> Column:
    return F.bround(masked / total, 6)


def page_status(fraction: Column, mask_pixels: Column, shadow_pixels: Column, repair: Column,
                pixels_changed: Column, replaced_fraction: Column | None = None,
                max_fraction: float = MAX_MASKED_FRACTION) -> Column:
    """Status of a page. The cut-off is compared with the rounded fraction, strictly greater.

    ``pixels_changed`` says whether lighting steps altered any pixel. For video pages a replaced
    share above zero turns stable and enhanced into repaired.
    """
    found = (mask_pixels > 0) | (shadow_pixels > 0)
    base = (F.when(~repair, F.when(found, "detected_not_repaired").otherwise("stable"))
            .when(F.bround(fraction, 6) > max_fraction, "skipped_damage_too_extensive")
            .when(mask_pixels > 0, "repaired").when(pixels_changed, "enhanced").otherwise("stable"))
    if replaced_fraction is None:
        return base
    lifted = repair & (F.coalesce(replaced_fraction, F.lit(0.0)) > 0) & base.isin("stable", "enhanced")
    return F.when(lifted, "repaired").otherwise(base)


def _item(when: Column, level: str, text: Column) -> Column:
    return F.when(when, F.struct(F.lit(level).alias("level"), text.alias("text")))


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def findings(status: Column, flattened: Column, shadow_filled: Column, glare_regions: Column,
             shadow_regions: Column, fraction: Column, nodes: Column) -> Column:
    """Ordered array of (level, text) about one page. Region arguments are counts."""
    g, s = glare_regions, shadow_regions
    glare = F.format_string(GLARE_TEXT, g.cast("string"), _plural(g, "", "s"), _plural(g, "it", "them"), pct(fraction))
    left = F.format_string(SHADOW_LEFT, s.cast("string"), _plural(s, "", "s"))
    filled = F.format_string(SHADOW_FILLED, s.cast("string"), _plural(s, " was", "s were"))
    rules = F.array(
        _item(status == "skipped_damage_too_extensive", "warn", F.lit(TOO_EXTENSIVE)),
        _item(status == "detected_not_repaired", "info", F.lit(REPAIR_OFF)),
        _item(flattened, "ok", F.lit(FLATTENED)),
        _item(g > 0, "warn", glare),
        _item((s > 0) & ~shadow_filled, "info", left),
        _item((s > 0) & shadow_filled, "warn", filled),
        _item((g == 0) & (s == 0) & status.isin("stable", "enhanced"), "ok", F.lit(NOTHING_INVENTED)),
        _item(nodes > 0, "info", F.format_string(ORDER_MAPPED, nodes.cast("string"))))
    return F.filter(rules, lambda r: r.isNotNull())
