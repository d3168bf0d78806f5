"""Scalar functions and the grid as functions of a session's SQL; their bodies are expressions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from rankatlas.functions.scalars import BLANK, BLANKS, BLOCK_MARKERS, EARTH_MILES, EMAIL_PATTERN, LEGAL_WORDS, MILES_PER_DEGREE, PHONE_PATTERN

_DIGITS = "regexp_replace(x, '[^0-9]', '')"
_HALF = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2)"

#: Name: parameters, type, body.
FUNCTIONS = {
    "normalize_name": ("x STRING", "STRING", rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(x), r'(?<![a-z0-9_])(?:{'|'.join(LEGAL_WORDS)})(?![a-z0-9_])', ''), r'[^a-z0-9_{BLANKS}]', ''), r'{BLANK}+', ' '))"),
    "normalize_phone": ("x STRING", "STRING", f"CASE WHEN length({_DIGITS}) = 10 THEN '+1' || {_DIGITS} WHEN length({_DIGITS}) = 11 AND startswith({_DIGITS}, '1') THEN '+' || {_DIGITS} END"),
    "us_phone": ("x STRING", "STRING", f"normalize_phone(regexp_extract(x, r'{PHONE_PATTERN}', 0))"),
    "emails_in": ("x STRING", "ARRAY<STRING>", f"transform(regexp_extract_all(x, r'{EMAIL_PATTERN}', 0), m -> lower(m))"),
    "is_blocked_page": ("x STRING", "BOOLEAN", "coalesce(" + " OR ".join(f"contains(lower(x), '{m}')" for m in BLOCK_MARKERS) + ", false)"),
    "haversine_miles": ("lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE", "DOUBLE", f"2 * {EARTH_MILES} * atan2(sqrt({_HALF}), sqrt(1 - ({_HALF})))"),
    "miles_to_lat": ("miles DOUBLE", "DOUBLE", f"miles / {MILES_PER_DEGREE}"),
    "miles_to_lng": ("miles DOUBLE, lat DOUBLE", "DOUBLE", f"miles / ({MILES_PER_DEGREE} * cos(radians(lat)))"),
    "rank_band": ("x INT", "STRING", "CASE WHEN x IS NULL THEN 'not found' WHEN x <= 3 THEN '1-3' WHEN x <= 7 THEN '4-7' WHEN x <= 15 THEN '8-15' ELSE '16+' END"),
}
GRID = f"""CREATE OR REPLACE TEMPORARY FUNCTION grid_points(lat DOUBLE, lng DOUBLE, radius DOUBLE, n INT)
RETURNS TABLE (grid_row INT, grid_col INT, point_lat DOUBLE, point_lng DOUBLE)
RETURN SELECT r, c, round(lat + radius / {MILES_PER_DEGREE} - r * (2 * radius / {MILES_PER_DEGREE} / (n - 1)), 7),
  round(lng - radius / ({MILES_PER_DEGREE} * cos(radians(lat))) + c * (2 * radius / ({MILES_PER_DEGREE} * cos(radians(lat))) / (n - 1)), 7)
FROM (SELECT explode(sequence(0, n - 1)) AS r) CROSS JOIN (SELECT explode(sequence(0, n - 1)) AS c)"""


def register(spark: SparkSession) -> list[str]:
    """Registers all of them as temporary functions; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.sql(GRID)
    return [*FUNCTIONS, "grid_points"]
