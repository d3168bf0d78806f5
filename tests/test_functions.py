import pytest
from pyspark.sql import functions as F

from rankatlas.functions import scalars as S


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string").select(column(F.col("x")).alias("y")).collect()
    return [r.y for r in rows]


@pytest.mark.parametrize(
    ("f", "cases"),
    [
        (S.normalize_name, {"Joe's Pizza, LLC": "joes pizza", "Café & Co.": "caf", "éco x": "x", None: None}),
        (S.normalize_phone, {"(561) 526-3512": "+15615263512", "15615263512": "+15615263512", "5263512": None}),
        (S.format_phone, {"+15615263512": "(561) 526-3512", "12": "12"}),
        (S.normalize_domain, {"https://www.Example.com/x": "example.com", "example.com": "example.com", "httpbin.org": None}),
        (S.compact_number, {"160": 160, "1K": 1000, "1.9K": 1900, "3.1K": 3100, "1M": 1000000, "1,234": 1234, "abc": None}),
        (S.rating_of_label, {"Rated 4.8 out of 5, 160 user reviews": 4.8}),
        (S.reviews_of_label, {"Rated 4.8 out of 5, 160 user reviews": 160}),
        (S.category_of_line, {"4.8 (160) · $10–20 · Pizza": "Pizza", "4.8 (160) · $10–20": None, "x": None}),
        (S.email_valid, {"noreply@x.com": False, "logo@2x.png": False, "a@example.com": False, "x@sentry.io": False, "joe@shop.de": True, "a@b": False, None: False}),
        (S.unwrap_redirect, {"//d.example/l/?uddg=https%3A%2F%2Fa.b%2Fc&x=1": "https://a.b/c", "https://a.b": "https://a.b"}),
        (S.website_url, {" shop.de ": "https://shop.de", "ftp://x.y": None, "": None}),
        (S.us_phone, {"call (561) 526-3512 now": "+15615263512", "none": None}),
        (S.valid_rating, {"4.5": 4.5, "0": None, "7": None, "x": None}),
        (S.is_blocked_page, {"<b>Unusual Traffic</b>": True, "<b>fine</b>": False, None: False}),
    ],
)
def test_golden(spark, f, cases):
    assert one(spark, f, *cases) == list(cases.values())


def test_distance_and_names(spark):
    row = spark.range(1).select(S.haversine_miles(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"), S.names_close(F.lit("joes pizza"), F.lit("joe pizza")).alias("c"), S.names_close(F.lit("joes pizza"), F.lit("burger")).alias("n")).first()
    assert abs(row.d - 69.0941) < 1e-3 and row.c and not row.n
