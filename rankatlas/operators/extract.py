"""Extraction from stored pages: listings, links, e-mails, JSON-LD. Rules are data: selectors, attributes and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankatlas.functions import urls
from rankatlas.functions.scalars import BLANK, compact_number, email_valid, emails_in, let, non_empty, normalize_phone, street_address, unwrap_redirect, url_host, url_origin, us_phone, valid_rating, website_url
from rankatlas.operators.html import AT, CUT, READ, attribute, first_match, in_order, matches, read_elements, read_items, text_of

# What a contact link's target or text holds, as whole words.
CONTACT_WORDS = ("contact", "about", "team", "staff", "connect", "reach", "get-in-touch", "support")


def _read(pages: DataFrame, html: str) -> DataFrame:
    """Pages with their elements, read here unless the caller has done it by read_elements()."""
    return pages if READ in pages.columns else read_elements(pages, html)


def _others(pages: DataFrame, html: str) -> list[Column]:
    return [F.col(f"`{c}`") for c in pages.columns if c not in (html, READ)]


def visible_text(html: Column) -> Column:
    """A fragment without scripts, styles and tags; a tag becomes a blank. Entities stay; text_of() of an element has them decoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->|<[^>]+>", " "), rf"{BLANK}+", " "))


def harvest_emails(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct valid addresses of each page, in the order of mail links, shown text, JSON-LD, meta tags, raw HTML.

    Text and attributes are decoded and hidden elements left out; of JSON-LD the texts under email,
    contactPoint, author, creator and member count, at any depth. A null page has none.
    """
    every = F.col("_page.elements")
    mail = F.transform(F.filter(every, lambda e: (e["tag"] == "a") & F.coalesce(attribute(e, "href").startswith("mailto:"), F.lit(False))), lambda e: F.lower(F.trim(F.substring_index(F.replace(attribute(e, "href"), F.lit("mailto:"), F.lit("")), "?", 1))))
    meta = F.filter(every, lambda e: matches(e, "meta[property*=email], meta[name*=email], meta[itemprop=email]"))
    of = lambda texts: F.flatten(F.transform(texts, emails_in))
    found = F.array_distinct(F.concat(mail, emails_in(F.col("_page.seen")), of(F.col("_page.mails")), of(F.transform(meta, lambda e: F.coalesce(attribute(e, "content"), F.lit("")))), emails_in(F.coalesce(F.col(html), F.lit("")))))
    return _read(pages, html).withColumn("emails", F.filter(found, email_valid)).drop(*([] if READ in pages.columns else [READ]))


def _base(url: str) -> Column:
    """What a page's references are resolved against: its base element's target, or its own URL."""
    return F.coalesce(F.when(F.col("_page.base").isNotNull(), urls.resolve(F.col(url), F.col("_page.base"))), F.col(url))


def links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """A row a link: page url, position, href, label, and the target resolved against the page, in normal form."""
    anchors = F.filter(F.col("_page.elements"), lambda e: (e["tag"] == "a") & attribute(e, "href").isNotNull())
    each = F.transform(anchors, lambda e: F.struct(attribute(e, "href").alias("href"), text_of(e).alias("label")))
    rows = _read(pages, html).select(F.col(url).alias("url"), _base(url).alias("base"), F.posexplode(each).alias("position", "a"))
    return rows.select("url", "position", "a.href", "a.label", urls.origin(F.col("url")).alias("origin"), urls.normalized(urls.resolve(F.col("base"), F.col("a.href"))).alias("target"))


def contact_links(pages: DataFrame, most: int = 5, html: str = "html", url: str = "url") -> DataFrame:
    """Up to `most` distinct links of a page's own site that look like contact pages: url, target, position, nth.

    A page is one row from start to end, so pages that share a URL stay apart.
    """
    word = rf"(?i)(?<![a-z0-9_])(?:{'|'.join(CONTACT_WORDS)})(?![a-z0-9_])"
    hit = lambda e: (e["tag"] == "a") & F.coalesce(attribute(e, "href").rlike(word) | (attribute(e, "href").isNotNull() & text_of(e).rlike(word)), F.lit(False))
    read = _read(pages, html).withColumn("hits", F.transform(F.filter(F.col("_page.elements"), hit), lambda e: attribute(e, "href")))
    # few of a page's links get here, and only they are resolved
    rows = read.filter(F.size("hits") > 0).select(F.col(url).alias("url"), _base(url).alias("base"), urls.origin(F.col(url)).alias("origin"), "hits")
    own = lambda base, home, hits: F.filter(F.transform(hits, lambda h: urls.normalized(urls.resolve(base, h))), lambda t: F.coalesce(urls.origin(t) == home, F.lit(False)))
    first = rows.select("url", F.posexplode(F.slice(F.array_distinct(own(F.col("base"), F.col("origin"), F.col("hits"))), 1, most)).alias("position", "target"))
    return first.select("url", "target", "position", (F.col("position") + 1).alias("nth"))


def resolve_enrichment(candidates: DataFrame, harvested: DataFrame, most: int = 3) -> DataFrame:
    """Each candidate's first address: of its home page, else of the first of its contact pages that has any.

    candidates: business_id, url as it was given. harvested: home (a website_url()), step (0: home
    page, then contact pages in order), emails. status is no_website, invalid_url, error (nothing was
    fetched), no_email_found or success.
    """
    site = candidates.withColumn("home", website_url(F.col("url")))
    full = harvested.filter((F.col("step") <= most) & (F.size("emails") > 0)).groupBy("home").agg(F.min_by("emails", "step").alias("all_emails"))
    seen = harvested.select("home").distinct().withColumn("fetched", F.lit(True))
    out = site.join(full, "home", "left").join(seen, "home", "left")
    status = F.when(non_empty(F.col("url")).isNull(), "no_website").when(F.col("home").isNull(), "invalid_url").when(F.col("fetched").isNull(), "error").when(F.col("all_emails").isNull(), "no_email_found").otherwise("success")
    return out.select("business_id", "url", status.alias("status"), F.get("all_emails", F.lit(0)).alias("email"), "all_emails")


def enrichment_log(resolved: DataFrame, now: Column, source: str = "website") -> DataFrame:
    """A log row an enrichment, with what it added as JSON."""
    added = F.when(F.col("status") == "success", F.to_json(F.struct("email", F.col("all_emails").alias("allEmails"))))
    return resolved.select("business_id", F.lit(source).alias("source"), "status", added.alias("data_added"), now.alias("created_at"))


def apply_enrichment(businesses: DataFrame, resolved: DataFrame, now: Column) -> DataFrame:
    """Businesses with the addresses found and when they were enriched; without a website, or with one that isn't an URL, that stays as it was."""
    found = resolved.select("business_id", F.col("email").alias("__email"), (~F.col("status").isin("no_website", "invalid_url")).alias("__done"))
    out = businesses.join(found, "business_id", "left")
    new = {"email": F.coalesce("__email", "email"), "last_enriched_at": F.when(F.col("__done"), now).otherwise(F.col("last_enriched_at"))}
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in businesses.columns))


def _chain(text: Column, patterns: str | list[str]) -> Column:
    """The first pattern's first group that isn't empty."""
    tried = [patterns] if isinstance(patterns, str) else patterns
    return F.coalesce(*(non_empty(visible_text(F.regexp_extract(text, p, 1))) for p in tried))


def _in_order(items: Column, kind: str) -> Column:
    """A page's items by first place, each name once."""
    return let(items, lambda rows: let(F.transform(rows, lambda x: x[kind]), lambda names: F.filter(rows, lambda x, i: F.array_position(names, x[kind]) == i + 1)))


def extract_listings(pages: DataFrame, item: str | list[str], rules: dict[str, str | list[str]], html: str = "html", context: int = 1000) -> DataFrame:
    """Listings of each page by patterns over its markup: the item pattern's first group is the name; each rule looks in the text after it.

    Of several item patterns the first that a page holds counts, of several patterns of a field the
    first that finds something. A rule looks at the `context` characters after its item and no
    further, however long the page is. Names repeat only once a page, the first place counts, and
    ranks follow the order on the page. A page is a row from start to end: pages alike in all
    columns stay apart, and nothing is shuffled.
    """
    items = [item] if isinstance(item, str) else item
    cut = lambda p: F.split(F.regexp_replace(html, p, "\u0001$1\u0002"), "\u0001")
    parts = F.coalesce(*(F.when(F.col(html).rlike(p), cut(p)) for p in items)) if len(items) > 1 else cut(items[0])
    found = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.struct(F.trim(F.substring_index(x, "\u0002", 1)).alias("name"), F.substring(F.substring_index(x, "\u0002", -1), 1, context).alias("after")))
    rows = pages.select(*_others(pages, html), F.posexplode(_in_order(F.filter(found, lambda x: x["name"] != ""), "name")).alias("nth", "x"))
    fields = {f: _chain(F.col("x.after"), pattern) if isinstance(pattern, list) else F.nullif(F.regexp_extract("x.after", pattern, 1), F.lit("")) for f, pattern in rules.items()}
    return rows.select(*_others(pages, html), (F.col("nth") + 1).alias("rank"), "x.name", *(v.alias(f) for f, v in fields.items()), us_phone(F.col("x.after")).alias("phone"))


#: Local results: what an item's name is; of a page, the first that it holds.
LOCAL_NAMES = [".lm_entry_title, .listing_title, a.titleLink", "[role=heading]", "h2, h3"]
#: Fields of an item, each a chain of selector, attribute (or text) and pattern; the first that finds something counts.
LOCAL_FIELDS = {
    "rating_text": [("[aria-label*=out of 5]", "aria-label", r"(\d+(?:\.\d+)?) out of 5"), (".csrc, .rating-value, .yi40Hd", "text", r"(\d\.?\d?)")],
    "review_text": [("[aria-label*=review]", "aria-label", r"(?i)([\d,.]+[km]?)\s*(?:user )?reviews?"), (".reviewCount, .ratingCount, .RDApEe", "text", r"([\d,.]+[KkMm]?)")],
    "address": [(".lm_entry_address, .listing_address, .address", "text", "")],
    "phone_text": [(".lm_entry_phone, .listing_phone, .phone", "text", "")],
    "category": [(".lm_entry_categories, .categories", "text", "")],
    "website": [("a.website", "href", ""), ("a[href^=http]", "href", "")],
}
PLACE_IDS = ("data-entityid", "data-cid")


def _field(elements: Column, chain: list[tuple[str, str, str]], page: Column) -> Column:
    def take(kind: str, pattern: str):
        def value(e: Column) -> Column:
            raw = text_of(e, page) if kind == "text" else attribute(e, kind)
            return non_empty(F.regexp_extract(raw, pattern, 1) if pattern else raw)

        return value

    return F.coalesce(*(first_match(elements, [selector], take(kind, pattern)) for selector, kind, pattern in chain))


def extract_local(pages: DataFrame, html: str = "html", names: list[str] = LOCAL_NAMES, fields: dict = LOCAL_FIELDS) -> DataFrame:
    """Local results of each page, typed: rank, name, address, phone, rating (over 0 and up to 5), reviews, category, website, place_id.

    An item reaches from its name to the next one's. Text is decoded. Without an address of its own
    an item has the first street in its text, without a phone the first US number there. The place
    id is of the element around the name or of one in the item. Names repeat only once a page.
    """
    chains = [x for chain in fields.values() for x in chain]
    marks = [f"[{x}]" for x in PLACE_IDS]
    others, item = _others(pages, html), F.col(CUT)
    rows = read_items(pages, names, [*(s for s, _, _ in chains), *marks], [s for s, kind, _ in chains if kind == "text"], PLACE_IDS, following=True, html=html)
    ids = lambda e: F.coalesce(*(attribute(e, x) for x in PLACE_IDS))
    found = {f: _field(item["elements"], chain, item) for f, chain in fields.items()}
    rows = rows.select(*others, AT, text_of(item["head"], item).alias("_name"), F.struct(item["after"].alias("after"), F.coalesce(item["near"], first_match(item["elements"], marks, ids)).alias("place_id"), *(v.alias(f) for f, v in found.items())).alias("_x")).filter(F.col("_name") != "")
    address = F.coalesce("_x.address", street_address(F.col("_x.after")))
    phone = F.coalesce(normalize_phone(F.col("_x.phone_text")), us_phone(F.col("_x.after")))
    fields_of = F.struct(F.col("_name").alias("name"), address.alias("address"), phone.alias("phone"), valid_rating(F.col("_x.rating_text")).alias("rating"), compact_number(F.col("_x.review_text")).alias("reviews"), "_x.category", "_x.website", "_x.place_id")
    ranked = in_order(rows.select(*others, AT, "_name", fields_of.alias("_x")), "_x", once="_name")
    return ranked.select(*others, F.col("_nth").alias("rank"), "_x.*")


#: Organic results: the block (of a page, the first that it holds), its link, its snippet.
ORGANIC = {
    "block": ["div.result, li.result, article.result", "div.web-result", "div.results_links", "[data-nrn=result]", ".b_algo", "div.g, [data-sokoban-container]"],
    "link": ["a.result__a", "a[href]"],
    "snippet": [".result__snippet", ".result__body", ".b_caption", ".VwiC3b, .st, .aCOpRe, [data-sncf]"],
}


def extract_organic(pages: DataFrame, rules: dict[str, list[str]] = ORGANIC, html: str = "html") -> DataFrame:
    """Organic results of each page: position, title, url (redirects unwrapped), domain, snippet (or empty), all decoded.

    A block without a title or without an http(s) target is none and takes no position.
    """
    others, item = _others(pages, html), F.col(CUT)
    rows = read_items(pages, rules["block"], [*rules["link"], *rules["snippet"]], html=html)
    text = lambda e: text_of(e, item)
    pick = lambda e: F.when(attribute(e, "href").isNotNull(), F.struct(unwrap_redirect(F.trim(attribute(e, "href"))).alias("url"), text(e).alias("title")))
    link, snippet = first_match(item["elements"], rules["link"], pick), first_match(item["elements"], rules["snippet"], text)
    # what is no result is null, so that nothing is worked out once for a filter and again for its rows
    good = let(link, lambda x: F.when(x["url"].startswith("http") & (x["title"] != ""), F.struct(x["title"].alias("title"), x["url"].alias("url"), F.coalesce(snippet, F.lit("")).alias("snippet"))))
    return in_order(rows.select(*others, AT, good.alias("_r")), "_r").select(*others, F.col("_nth").alias("position"), "_r.title", "_r.url", F.lower(url_host(F.col("_r.url"))).alias("domain"), "_r.snippet")


#: Types of JSON-LD documents that are businesses.
BUSINESS_TYPES = ("LocalBusiness", "Restaurant")


def extract_jsonld(pages: DataFrame, html: str = "html", types: tuple[str, ...] = BUSINESS_TYPES) -> DataFrame:
    """Businesses in a page's JSON-LD by their @type: single or in lists, graphs and item lists at any depth, in order.

    Values are read as they come: numbers may be strings, and an address or a place a list, of which
    the first counts, or an address a text. What isn't what it should be is null.
    """
    rows = _read(pages, html).select(*_others(pages, html), F.posexplode(F.col("_page.things")).alias("nth", "thing")).withColumn("v", F.try_parse_json("thing"))

    def text(*paths: str) -> Column:
        return F.coalesce(*(non_empty(F.try_variant_get("v", p, "string")) for p in paths))

    inner = lambda outer, name: text(f"$.{outer}.{name}", f"$.{outer}[0].{name}")
    number = lambda outer, name, kind: inner(outer, name).try_cast(kind)
    kind = F.try_variant_get("v", "$['@type']", "string")
    plain = F.when(F.schema_of_variant("v").isNotNull() & (F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.address", "variant")), F.lit("")) == "STRING"), text("$.address"))
    named = rows.filter(text("$.name").isNotNull() & kind.rlike(rf"(?<![A-Za-z0-9_])(?:{'|'.join(types)})(?![A-Za-z0-9_])"))
    return named.select(*_others(pages, html), kind.alias("type"), text("$.name").alias("name"), normalize_phone(text("$.telephone", "$.telephone[0]")).alias("phone"), text("$.url").alias("website"), F.coalesce(inner("address", "streetAddress"), plain).alias("address"), inner("address", "addressLocality").alias("city"), inner("address", "addressRegion").alias("state"), inner("address", "postalCode").alias("zip"), number("geo", "latitude", "double").alias("lat"), number("geo", "longitude", "double").alias("lng"), number("aggregateRating", "ratingValue", "double").alias("rating"), number("aggregateRating", "reviewCount", "bigint").alias("review_count"))


#: Questions that people also ask, and related searches: selector, and attributes that hold the text, or else the element's own.
QUESTIONS = (".related-question-pair, div[data-q], div[data-lk]", ("data-q", "data-lk"))
RELATED = ("div.s75CSd a, #brs a, a.k8XOCe", ())


def extract_related(pages: DataFrame, rule: tuple[str, tuple[str, ...]] = QUESTIONS, html: str = "html") -> DataFrame:
    """Questions (or, with RELATED, searches) of each page in order, each text once: position, text."""
    selector, attributes = rule
    others, item = _others(pages, html), F.col(CUT)
    rows = read_items(pages, [selector], ["span"] if attributes else [], nested=True, html=html)
    text = lambda e: text_of(e, item)
    own = first_match(item["elements"], ["span"], lambda e: non_empty(text(e))) if attributes else text(item["head"])
    texts = rows.select(*others, AT, F.coalesce(*(non_empty(attribute(item["head"], a)) for a in attributes), own).alias("_text")).filter(F.col("_text") != "")
    return in_order(texts.withColumn("_once", F.col("_text")), "_text", once="_once").select(*others, (F.col("_nth") - 1).alias("position"), F.col("_text").alias("text"))


def listings_from_snippets(organic: DataFrame, page: list[str] | None = None) -> DataFrame:
    """Businesses of organic results whose snippet holds a valid US phone: name, address, phone, website (the result's origin), ranked in order.

    `page` names the columns that tell pages apart; without it all columns that aren't the result's do.
    """
    keep = [c for c in organic.columns if c not in ("position", "title", "url", "domain", "snippet")]
    key = keep if page is None else page
    if not key:
        raise ValueError("ranks are within a page: name the columns that tell pages apart")
    found = organic.withColumn("phone", us_phone(F.col("snippet"))).filter("phone is not null")
    order = Window.partitionBy(*key).orderBy("position")
    return found.select(*keep, F.row_number().over(order).alias("rank"), F.col("title").alias("name"), street_address(F.col("snippet")).alias("address"), "phone", url_origin(F.col("url")).alias("website"))


def website_quality(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    modern = F.col(url).startswith("https://") & F.lower(html).rlike(r"<meta[^>]*viewport")
    return pages.withColumn("website_quality", F.when(F.coalesce(F.length(html), F.lit(0)) == 0, "none").when(modern, "modern").otherwise("outdated"))
