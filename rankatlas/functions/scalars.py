"""Scalar functions of the ranking library, all native columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must agree on these word lists, patterns and constants.
LEGAL_WORDS = ("llc", "inc", "corp", "ltd", "co", "company", "corporation", "incorporated", "limited")
EARTH_MILES = 3958.8
MILES_PER_DEGREE = 69.0
JUNK_SENDERS = ("noreply", "no-reply", "donotreply", "mailer-daemon", "postmaster", "webmaster", "test", "user", "username", "your-?email", "name")
JUNK_PREFIXES = (r"admin@example\.", r"email@example\.")
JUNK_DOMAINS = (r"@example\.(com|org|net)$", r"@sentry\.", r"@wixpress\.", r"@googleapis\.")
ASSET_ENDINGS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "css", "js", "woff", "woff2", "ttf", "eot", "mp4", "mp3", "pdf")
BLOCK_MARKERS = ("unusual traffic", "captcha", "our systems have detected", "sorry/index", "recaptcha")
GOOGLE_GROUP = ("google_search", "google_maps", "google_local")
#: White space as page texts have it, no-break and other Unicode spaces included; the same without brackets, to stand in a class.
BLANKS = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BLANK = f"[{BLANKS}]"
PHONE_PATTERN = rf"\(?\d{{3}}\)?[{BLANKS}.-]?\d{{3}}[{BLANKS}.-]?\d{{4}}"
STREET_PATTERN = rf"\d+{BLANK}+[A-Za-z][A-Za-z0-9_{BLANKS}]{{3,40}}(?:St|Ave|Blvd|Dr|Rd|Way|Ln|Ct|Pl|Pkwy|Hwy)\.?"
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A body that uses a value more than once, or once for each item of an array, with the value worked out once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_name(name: Column) -> Column:
    """Lower case, legal words and all but ASCII word characters removed, single spaces. Word edges are ASCII ones."""
    low = F.lower(name)
    bare = F.regexp_replace(low, rf"(?<![a-z0-9_])(?:{'|'.join(LEGAL_WORDS)})(?![a-z0-9_])", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, rf"[^a-z0-9_{BLANKS}]", ""), rf"{BLANK}+", " "))


def normalize_phone(phone: Column) -> Column:
    """E.164 for ten digits, or eleven that start with 1; else null."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).when((F.length(digits) == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits))


def format_phone(phone: Column) -> Column:
    """(AAA) BBB-CCCC of a US number; anything else as it is."""
    return F.regexp_replace(phone, r"^\+?1?(\d{3})(\d{3})(\d{4})$", r"($1) $2-$3")


def url_host(url: Column) -> Column:
    """Host of a URL, by the parser or else by pattern; null without one."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@\s]+)", 1), F.lit("")))


def url_origin(url: Column) -> Column:
    """scheme://host[:port] in lower case; null for what has no host."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+)", 1), F.lit("")))


def non_empty(text: Column) -> Column:
    """The trimmed text, or null if nothing is left."""
    return F.nullif(F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", ""), F.lit(""))


def normalize_domain(url: Column) -> Column:
    """Lower-case host without a leading www; https is assumed where the text doesn't start with http."""
    full = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(F.lower(url_host(full)), r"^www\.", "")


def website_url(url: Column) -> Column:
    """A trimmed http(s) URL, https assumed; null for other schemes and for what has no host."""
    t = F.trim(url)
    full = F.when(t.rlike(r"^(?i)[a-z][a-z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), t))
    return F.when(full.rlike(r"^(?i)https?://") & url_host(full).isNotNull() & (t != ""), full)


def unwrap_redirect(url: Column) -> Column:
    """The target in a uddg parameter, decoded; the URL itself if it has none."""
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    return F.coalesce(F.try_url_decode(F.try_parse_url(full, F.lit("QUERY"), F.lit("uddg"))), url)


def names_close(a: Column, b: Column, most: int = 3) -> Column:
    """Whether two names are within an edit distance; the distance stops counting beyond it."""
    return F.levenshtein(a, b, most).between(0, most)


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2))
    return 2 * EARTH_MILES * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def miles_to_lat(miles: Column) -> Column:
    return miles / MILES_PER_DEGREE


def miles_to_lng(miles: Column, lat: Column) -> Column:
    return miles / (MILES_PER_DEGREE * F.cos(F.radians(lat)))


def compact_number(text: Column) -> Column:
    """1.9K, 2M or 1,234 as an integer; null if it isn't one."""
    t = F.regexp_replace(F.trim(text), ",", "")
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)([KkMm]?)$", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(t, r"^(\d+(?:\.\d+)?)([KkMm]?)$", 2))
    return F.round(number * F.when(unit == "K", 1000).when(unit == "M", 1000000).otherwise(1)).cast("long")


def rating_of_label(label: Column) -> Column:
    return F.regexp_extract(label, r"(\d+(?:\.\d+)?) out of 5", 1).try_cast("double")


def reviews_of_label(label: Column) -> Column:
    return compact_number(F.regexp_extract(label, r"([\d.,]+[KkMm]?) (?:user )?reviews?", 1))


def valid_rating(rating: Column) -> Column:
    """A rating over 0 and up to 5; else null."""
    r = rating.try_cast("double")
    return F.when((r > 0) & (r <= 5), r)


def category_of_line(line: Column) -> Column:
    """The last of two or more parts between middle dots, unless it is a price."""
    parts = F.split(line, "·")
    last = F.trim(F.element_at(parts, -1))
    return F.when((F.size(parts) > 1) & ~last.startswith("$") & (last != ""), last)


def us_phone(text: Column) -> Column:
    """The first US phone number in a text, in E.164."""
    return normalize_phone(F.regexp_extract(text, PHONE_PATTERN, 0))


def street_address(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, STREET_PATTERN, 0)), F.lit(""))


def email_valid(email: Column) -> Column:
    junk = "|".join([f"^(?:{'|'.join(JUNK_SENDERS)})@", *(f"^{p}" for p in JUNK_PREFIXES), *JUNK_DOMAINS, rf"\.(?:{'|'.join(ASSET_ENDINGS)})$"])
    shape = r"^[^@]+@[^@]*\.[^@.]{2,}$"
    return F.coalesce(F.length(email).between(5, 254) & email.rlike(shape) & ~email.rlike(f"(?i){junk}"), F.lit(False))


def emails_in(text: Column) -> Column:
    """All addresses in a text, lower case, as they come."""
    return F.transform(F.regexp_extract_all(text, F.lit(EMAIL_PATTERN), F.lit(0)), F.lower)


def is_blocked_page(html: Column) -> Column:
    low = F.lower(html)
    return F.coalesce(F.array_contains(F.array(*(low.contains(m) for m in BLOCK_MARKERS)), True), F.lit(False))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(100 * done / total)).otherwise(0).cast("int")


def rank_band(rank: Column) -> Column:
    return F.when(rank.isNull(), "not found").when(rank <= 3, "1-3").when(rank <= 7, "4-7").when(rank <= 15, "8-15").otherwise("16+")


def engine_family(engine: Column, strict: bool = True) -> Column:
    """google, bing or other; not strict: all that isn't bing is google."""
    other = F.when(engine.isin(*GOOGLE_GROUP), "google").otherwise("other") if strict else F.lit("google")
    return F.when(engine.startswith("bing"), "bing").otherwise(other)

