"""Queries over pages that Spark builds from the tables, so that SQL knows what they hold: entities, nesting, JSON-LD, links, white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankatlas.functions import scalars as S
from rankatlas.operators import catalog as C
from rankatlas.operators import extract as X
from rankatlas.plans.catalogue import query

_ID = "CAST(business_id AS VARCHAR)"


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def _kinds(*kinds: Column) -> Column:
    """One of these for each business, by its id."""
    return F.element_at(F.array(*kinds), (F.col("business_id") % len(kinds) + 1).cast("int"))


@query(f"SELECT business_id, CASE WHEN business_id % 7 IN (2, 6) THEN '' ELSE 'info@shop' || {_ID} || '.example' END AS emails FROM business", "business")
def i1_encoded_emails(v):
    """An address a page: in a mail link, in text, hidden, in nested JSON-LD, in a meta tag, split by an inline element, in a script; all encoded."""
    n = F.col("business_id").cast("string")
    at = lambda sign: _text("info", sign, "shop", n, ".example")
    kinds = _kinds(
        _text("<a href='mailto:", at("&#64;"), "?subject=x'>write</a>"),
        _text("<p>at&nbsp;", at("&commat;"), "&nbsp;</p>"),
        _text("<div hidden><p>", at("&#64;"), "</p></div>"),
        _text('<script type="application/ld+json">[{"contactPoint":[{"member":{"email":"mailto:', at("\\u0040"), '"}}]}]</script>'),
        _text('<meta itemprop="email" content="', at("&#x40;"), '">'),
        _text("<p><b>info&#64;</b>shop<i>", n, "</i>.example</p>"),
        _text("<script>var x = '", at("&#64;"), "'</script>"),
    )
    return X.harvest_emails(v.business.select("business_id", _text("<html><body>", kinds, "</body>").alias("html"))).select("business_id", F.array_join("emails", ",").alias("emails"))


@query(f"SELECT business_id, nth, CASE nth WHEN 1 THEN site || CASE WHEN business_id % 2 = 0 THEN '/a/b/about?x=1&y=' ELSE '/a/base/about?x=1&y=' END || {_ID} WHEN 2 THEN site || '/team' ELSE site || '/deep/support#top' END AS target FROM (SELECT business_id, 'https://www.shop' || CAST(business_id % 90 AS VARCHAR) || '.example' AS site FROM business) CROSS JOIN (VALUES (1), (2), (3)) t(nth)", "business")
def i2_built_links(v):
    """Links with entities, dot segments, default ports and, on every second page, a base element; other sites and other links between them."""
    n = F.col("business_id").cast("string")
    host = _text("www.Shop", (F.col("business_id") % 90).cast("string"), ".example")
    links = [
        '<a href="contact/../about?x=1&amp;y=', n, '">Us</a><a href="./contact/../about?x=1&amp;y=', n, '">again</a><a href="/preaching">no</a>',
        '<a href="https://else.example/contact">other</a><a href="/./x/../team">People</a><a href="HTTPS://', host, ':443/deep/support#top"><b>Sup</b>port</a>',
    ]
    base = F.when(F.col("business_id") % 2 == 1, F.lit('<head><base href="../base/"></head>')).otherwise("")
    pages = v.spread("business", "business_id").select("business_id", _text("https://", host, "/a/b/", n).alias("url"), _text(base, *links).alias("html"))
    found = X.contact_links(pages)
    return found.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("business_id"), "nth", "target")


@query("SELECT CAST(area_id AS STRING) || '/' || category AS page, CAST(row_number() OVER (PARTITION BY area_id, category ORDER BY business_id) AS INT) AS rank, 'Tom & ' || name AS name, CASE WHEN business_id % 3 = 0 THEN CAST(business_id AS VARCHAR) || ' Old Oak Ave' ELSE address END AS address, '+1' || phone AS phone, rating, reviews::BIGINT AS reviews, 'id' || CAST(business_id AS VARCHAR) AS place_id FROM business", "business")
def i4_decoded_local(v):
    """Results with entities in names and numbers, an id on the element around them, and a street in the text where there is no address."""
    n = F.col("business_id").cast("string")
    phone = F.regexp_replace("phone", r"^(...)(...)", "($1)&nbsp;$2&#160;")
    address = F.when(F.col("business_id") % 3 == 0, _text("<p>at ", n, " Old&nbsp;Oak Ave</p>")).otherwise(_text('<div class="a address">', F.col("address"), "</div>"))
    rating = F.coalesce(_text('<i aria-label="Rated ', F.col("rating").cast("string"), ' out of 5"></i>'), F.lit(""))
    item = _text('<li data-entityid="id', n, '"><h3>Tom &amp; <b>', F.col("name"), "</b></h3>", rating, '<span class="reviewCount">(', F.col("reviews").cast("string"), ")</span>", address, F.coalesce(phone, F.lit("")), "</li>")
    pages = v.business.groupBy(F.concat_ws("/", "area_id", "category").alias("page_name")).agg(F.concat(F.lit("<ul>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("business_id"), item.alias("item")))), lambda x: x["item"]), ""), F.lit("</ul>")).alias("html"))
    return X.extract_local(pages).select(F.col("page_name").alias("page"), "rank", "name", F.regexp_replace("address", S.BLANK, " ").alias("address"), "phone", "rating", "reviews", "place_id")


@query("SELECT business_id, name, address, state, '3' || lpad(CAST(business_id % 10000 AS VARCHAR), 4, '0') AS zip, lat, lng, rating, reviews::BIGINT AS review_count FROM business", "business")
def i5_numbers_as_strings(v):
    """Documents in graphs of item lists whose numbers are strings, with address lines; a text or a list for an address by turns."""
    zipped = _text("3", F.lpad((F.col("business_id") % 10000).cast("string"), 4, "0"))
    place = F.struct(F.col("address").alias("streetAddress"), F.col("state").alias("addressRegion"), zipped.alias("postalCode"))
    same = [F.lit("LocalBusiness").alias("@type"), F.col("name"), F.struct(F.col("lat").cast("string").alias("latitude"), F.col("lng").alias("longitude")).alias("geo"), F.struct(F.col("rating").cast("string").alias("ratingValue"), F.col("reviews").cast("string").alias("reviewCount")).alias("aggregateRating")]
    one, listed = F.to_json(F.struct(*same, place.alias("address"))), F.to_json(F.struct(*same, F.array(place).alias("address")))
    wrapped = _text('{"@graph":[{"@type":"ItemList","itemListElement":[{"@type":"ListItem","position":1,"item":', F.when(F.col("business_id") % 2 == 0, one).otherwise(listed), "}]}]}")
    html = _text('<script type="application/ld+json">', wrapped, "</script>")
    return X.extract_jsonld(v.business.select("business_id", html.alias("html"))).select("business_id", "name", "address", "state", "zip", "lat", "lng", "rating", "review_count")


@query("SELECT area_id, CAST(row_number() OVER (PARTITION BY area_id ORDER BY first) - 1 AS INT) AS position, text FROM (SELECT area_id, 'where & why ' || category AS text, min(business_id) AS first FROM business GROUP BY ALL)", "business")
def i7_questions(v):
    """Questions in either attribute or as the element's text, by turns."""
    kind = _kinds(_text('<div data-q="where &amp; why ', F.col("category"), '"></div>'), _text('<div data-lk="where &#38; why ', F.col("category"), '"></div>'), _text('<div class="x related-question-pair"><span>where &amp; <b>why</b>&nbsp;', F.col("category"), "</span></div>"))
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("business_id"), kind.alias("k")))), lambda x: x["k"]), "")
    return X.extract_related(v.business.groupBy("area_id").agg(html.alias("html"))).select("area_id", "position", "text")


@query(f"SELECT business_id, regexp_replace(lower(name), '[^a-z0-9_]', '', 'g') || ' old pizza' AS name, '+1' || phone AS phone, {_ID} || ' Old Oak Ave' AS street FROM business", "business")
def h1_unicode_blanks(v):
    """H1, H13 and H14 where no-break and other Unicode spaces stand between the words."""
    n = F.col("business_id").cast("string")
    name = _text("\u00a0", F.col("name"), "\u2003Old\u3000LLC\u00a0Pizza\ufeff")
    phone = _text("call\u00a0", F.regexp_replace("phone", r"^(...)(...)", "($1)\u00a0$2\u202f"), "\u00a0now")
    street = _text("at\u00a0", n, "\u00a0Old\u00a0Oak\u2009Ave")
    return v.business.select("business_id", S.normalize_name(name).alias("name"), S.us_phone(phone).alias("phone"), F.regexp_replace(S.street_address(street), S.BLANK, " ").alias("street"))


@query("SELECT business_id FROM business WHERE business_id % 4 <> 1 AND (business_id % 3 <> 0) AND business_id % 5 <> 0", "business")
def b19_fetched_pages(v):
    """Pages by content type, status and size: images, errors and too long ones don't count, what is unknown does."""
    kind = F.element_at(F.array(F.lit("text/html; charset=utf-8"), F.lit("image/png"), F.lit(None).cast("string"), F.lit("Application/XHTML+xml")), (F.col("business_id") % 4 + 1).cast("int"))
    status = F.when(F.col("business_id") % 3 == 0, 404).when(F.col("business_id") % 3 == 1, 200)
    html = F.when(F.col("business_id") % 5 == 0, F.repeat(F.lit("x"), 101)).otherwise("<html>")
    return C.usable_pages(v.business.select("business_id", kind.alias("content_type"), status.alias("status"), html.alias("html")), most=100).select("business_id")


@query(f"SELECT business_id, 'https://shop.example/' || {_ID} AS url, length(name) + 7 AS chars FROM business", "business")
def a3_stored_pages(v):
    """Pages that were stored as Parquet, read back by read_pages()."""
    import uuid

    from rankatlas.operators.lineage import shared_folder
    from rankatlas.sources.tables import append, read_pages

    path = f"{shared_folder(v.spark)}/pages-{uuid.uuid4().hex}"
    pages: DataFrame = v.business.select("business_id", _text("https://shop.example/", F.col("business_id").cast("string")).alias("url"), _text("<p>", F.col("name"), "</p>").alias("html"))
    append(pages, path)
    return read_pages(v.spark, path).select("business_id", "url", F.length("html").alias("chars"))
