"""Column functions for coercion, categories, quality filters and range checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: package prefixes and their categories in event tables
EVENT_APPS = {
    "com.facebook.katana": "SOCIAL", "com.instagram.android": "SOCIAL", "com.twitter.android": "SOCIAL", "com.snapchat.android": "SOCIAL", "com.tiktok": "SOCIAL", "com.reddit": "SOCIAL",
    "com.whatsapp": "COMMUNICATION", "com.google.android.apps.messaging": "COMMUNICATION", "com.facebook.orca": "COMMUNICATION", "org.telegram": "COMMUNICATION", "com.skype": "COMMUNICATION",
    "com.discord": "COMMUNICATION", "com.spotify.music": "MUSIC", "com.apple.Music": "MUSIC", "com.pandora": "MUSIC", "com.youtube": "ENTERTAINMENT", "com.netflix": "ENTERTAINMENT",
    "com.google.android.youtube": "ENTERTAINMENT", "com.amazon.avod": "ENTERTAINMENT", "com.google.android.gm": "PRODUCTIVITY", "com.microsoft.office": "PRODUCTIVITY",
    "com.google.android.apps.docs": "PRODUCTIVITY", "com.android.chrome": "BROWSER", "org.mozilla.firefox": "BROWSER", "com.apple.mobilesafari": "BROWSER",
}
#: fixed values: substrings and their categories in hourly tables
HOURLY_APPS = {
    "com.facebook.katana": "SOCIAL", "com.instagram.android": "SOCIAL", "com.twitter.android": "SOCIAL", "com.snapchat.android": "SOCIAL", "com.tiktok.": "SOCIAL", "com.reddit": "SOCIAL",
    "com.whatsapp": "COMMUNICATION", "com.google.android.apps.messaging": "COMMUNICATION", "com.facebook.orca": "COMMUNICATION", "org.telegram": "COMMUNICATION", "com.skype": "COMMUNICATION",
    "com.discord": "COMMUNICATION", "com.spotify.music": "ENTERTAINMENT", "com.netflix": "ENTERTAINMENT", "com.youtube": "ENTERTAINMENT", "com.google.android.youtube": "ENTERTAINMENT",
    "com.game": "GAME", "com.google.android.apps.docs": "PRODUCTIVITY", "com.microsoft": "PRODUCTIVITY", "com.health": "HEALTH",
}
#: fixed values: motion flags in the order of their priority
MOTION_ORDER = ("automotive", "walking", "running", "cycling", "stationary", "unknown")
YES, NO = ("true", "yes", "1", "1.0"), ("false", "no", "0", "0.0")


def number(c: Column) -> Column:
    """Double, or null if it is not a number."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def truth(c: Column) -> Column:
    """Three-valued boolean of a string, number or boolean: anything unknown is null."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*YES), True).when(text.isin(*NO), False)


def padded_id(c: Column, width: int = 3) -> Column:
    """Digits of an id (quotes and spaces dropped), padded with zeros; longer ids stay as they are."""
    plain = F.regexp_replace(c.cast("string"), "[\\s\"']", "")
    return F.when(F.length(plain) >= width, plain).otherwise(F.lpad(plain, width, "0"))


def platform_of_device(device: Column) -> Column:
    return F.when(device.rlike("^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$"), "ios").when(device.rlike("^[0-9A-Fa-f]{16}$"), "android").otherwise("unknown")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    """Great-circle distance in units of ``radius``; null with any null (least and greatest would skip it)."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.when(a.isNotNull(), 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))))


def _first_rule(rules: dict[str, str], hit, otherwise: Column) -> Column:
    out = None
    for key, category in rules.items():
        out = F.when(hit(key), category) if out is None else out.when(hit(key), category)
    return out.otherwise(otherwise)


def app_category_event(app: Column) -> Column:
    """Category of the first prefix that fits."""
    return _first_rule(EVENT_APPS, app.startswith, F.lit("OTHER"))


def app_category_hourly(app: Column) -> Column:
    """Category of the first substring that fits; no name and the system itself are SYSTEM."""
    low = F.lower(app)
    return F.when(app.isNull() | F.trim(low).isin("nan", "android", ""), "SYSTEM").otherwise(_first_rule(HOURLY_APPS, low.contains, F.lit("OTHER")))


def motion_class(flags: dict[str, Column]) -> Column:
    """One class from flags by priority; automotive clears stationary."""
    out = None
    for name in MOTION_ORDER:
        hit = F.coalesce(flags[name] == 1, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def light_class(lux: Column) -> Column:
    return F.when(lux < 10, "dark").when(lux < 500, "indoor").when(lux.isNotNull(), "outdoor")


def good_fix(lat: Column, lon: Column, accuracy: Column, limit: float = 500.0, null_accuracy: bool = True) -> Column:
    """A usable position: both coordinates, not (0, 0), accurate enough; a missing accuracy passes or not."""
    fits = F.coalesce(accuracy <= limit, F.lit(null_accuracy))
    return lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0)) & fits


def z_phrase(z: Column) -> Column:
    """Words for a z-score."""
    up = z > 0
    # fixed values: bounds and phrases
    share = (
        F.when(z > 2.5, "top 1% of your hours").when(z > 2.0, "top 3% of your hours").when(z > 1.5, "top 7% of your hours").when(z > 1.0, "top 16% of your hours")
        .when(z < -2.0, "bottom 3% of your hours").when(z < -1.5, "bottom 7% of your hours").otherwise("")
    )
    return (
        F.when(F.abs(z) < 0.5, "within typical range")
        .when(F.abs(z) < 1.0, F.when(up, "slightly elevated").otherwise("slightly below typical"))
        .when(F.abs(z) < 2.0, F.when(up, "elevated").otherwise("below typical"))
        .when(z.isNotNull(), F.concat(F.when(up, "very elevated").otherwise("very low"), F.lit(" - "), share))
    )


def receptive(desire: Column, availability: Column) -> Column:
    return (desire >= 5) & F.lower(F.trim(availability.cast("string"))).isin("yes", "1", "true")


def clamp(c: Column, low: float, high: float) -> Column:
    """``c`` within its range; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold (null counts as not holding), joined by commas."""
    return F.concat_ws(",", *(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()))


def present(named: dict[str, Column]) -> Column:
    """Names of the non-null columns, joined by commas."""
    return F.concat_ws(",", *(F.when(c.isNotNull(), F.lit(name)) for name, c in named.items()))


def capped_parts(parts: dict[str, Column], limit: float = 1440.0, digits: int = 1) -> dict[str, Column]:
    """Parts scaled so that their sum keeps to ``limit``; rounded only where scaled."""
    total = reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0.0)) for p in parts.values()))
    return {name: F.when(total > limit, F.round(p * limit / total, digits)).otherwise(p) for name, p in parts.items()}


def argmax_name(named: dict[str, Column]) -> Column:
    """Name of the greatest column; ties go to the first."""
    top = F.greatest(*named.values())
    out = None
    for name, c in named.items():
        out = F.when(c == top, name) if out is None else out.when(c == top, name)
    return out
