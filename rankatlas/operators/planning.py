"""Grids, scan plans, progress and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankatlas.functions.scalars import miles_to_lat, miles_to_lng
from rankatlas.operators.numbering import numbered

TERMINAL = ("completed", "failed", "cancelled")


def check_grid(n: int, strict: bool = True) -> None:
    if n not in ((3, 5, 7, 9) if strict else range(3, 10)):
        raise ValueError("grid size must be 3, 5, 7 or 9")


def expand_points(df: DataFrame, n: int = 7, strict: bool = True) -> DataFrame:
    """N by N points around each row's lat, lng over its radius_miles; row 0 is north, column 0 west."""
    check_grid(n, strict)
    cell = F.sequence(F.lit(0), F.lit(n - 1))
    grid = df.withColumn("grid_row", F.explode(cell)).withColumn("grid_col", F.explode(cell))
    up, right = miles_to_lat(F.col("radius_miles")), miles_to_lng(F.col("radius_miles"), F.col("lat"))
    return grid.withColumns({"point_lat": F.round(F.col("lat") + up - F.col("grid_row") * (2 * up / (n - 1)), 7), "point_lng": F.round(F.col("lng") - right + F.col("grid_col") * (2 * right / (n - 1)), 7)})


def expand_scan_plan(areas: DataFrame, categories: DataFrame, keywords: DataFrame, engines: list[str], known: tuple[str, ...], per_category: int | None = None) -> DataFrame:
    """Active areas by active categories' keywords (its own name if it has none) by known engines; the dimensions are small by their nature."""
    words = keywords.withColumn("nth", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("priority"), "keyword")))
    if per_category:
        words = words.filter(F.col("nth") <= per_category)
    terms = categories.filter("is_active").join(words, F.col("slug") == F.col("category"), "left").select("slug", F.coalesce("keyword", "slug").alias("keyword"), F.coalesce("priority", F.lit(1)).alias("priority"))
    engine = F.explode(F.array(*(F.lit(e) for e in engines if e in known)))
    return areas.filter("is_active").select("area_id").crossJoin(terms).withColumn("engine", engine)


def estimate_plan(plan: DataFrame, costs: dict[str, tuple[float, int]], points: int = 49) -> DataFrame:
    """Tasks, hours and days at the daily cap for each engine of a plan."""
    seconds, cap = (F.create_map(*(F.lit(x) for e, c in costs.items() for x in (e, c[i]))) for i in (0, 1))
    tasks = plan.groupBy("engine").agg((F.count("*") * points).alias("tasks"))
    return tasks.withColumns({"hours": F.round(F.col("tasks") * seconds[F.col("engine")] / 3600, 4), "days": F.ceil(F.col("tasks") / cap[F.col("engine")])})


def queue_order(plan: DataFrame) -> DataFrame:
    """Each engine's order of work: highest priority first, then as planned. An engine's work is numbered in many tasks."""
    return numbered(plan, ["engine"], [F.desc("priority"), "area_id", "slug", "keyword"], "turn").withColumn("turn", (F.col("turn") + 1).cast("int"))


def scan_progress(points: DataFrame, keys: list[str]) -> DataFrame:
    """Done, failed and all points of each scan, and the whole percent done; failed points are not done."""
    done, total = F.count_if(F.col("status") == "completed"), F.count("*")
    return points.groupBy(*keys).agg(done.alias("points_done"), F.count_if(F.col("status") == "failed").alias("points_failed"), total.alias("points_total"), F.round(100 * done / total).cast("int").alias("percent"))


def reduce_status(progress: DataFrame, status: Column | None = None, minutes: Column | None = None, limit: int = 30) -> DataFrame:
    """The status that follows from progress: done, nothing left, out of time, or running. Terminal states stay."""
    left = F.col("points_total") - F.col("points_done") - F.col("points_failed")
    new = F.when(F.col("points_done") >= F.col("points_total"), "completed").when(left == 0, "failed")
    if minutes is not None:
        new = new.when(minutes > limit, "failed")
    new = new.otherwise("running")
    if status is not None:
        new = F.when(status.isin(*TERMINAL), status).otherwise(new)
    message = F.when((new == "failed"), F.concat(F.lit("Only "), F.col("points_done"), F.lit("/"), F.col("points_total"), F.lit(" points completed")))
    return progress.withColumns({"new_status": new, "message": message})


def recovery_plan(points: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points to run again, and the scans that have none and so are complete."""
    again = points.filter(F.col("status") == "pending")
    return again, points.select(*keys).distinct().join(again.select(*keys).distinct(), keys, "left_anti")


def pending_depth(points: DataFrame) -> DataFrame:
    """Waiting points for each engine and, with a null engine, overall."""
    return points.filter(F.col("status") == "pending").rollup("engine").agg(F.count("*").alias("depth"))


def cancel(scans: DataFrame) -> DataFrame:
    """Cancelled, except what has ended."""
    return scans.withColumn("status", F.when(F.col("status").isin(*TERMINAL), F.col("status")).otherwise("cancelled"))


# The seed areas (name, state, latitude, longitude, radius in miles).
SEED_AREAS = [
    ("Delray Beach", "FL", 26.4615, -80.0728, 3.0),
    ("Boca Raton", "FL", 26.3683, -80.1289, 3.0),
    ("Boynton Beach", "FL", 26.5254, -80.0662, 3.0),
]
# The seed categories (name, slug, parent's slug, keywords by falling priority).
SEED_CATEGORIES = [
    ("IT Consulting", "it-consulting", None, ["IT consulting", "tech consulting near me", "computer consulting", "IT support small business", "technology consultant"]),
    ("Web Development", "web-development", None, ["web developer near me", "website development", "custom software development", "web design", "app development near me"]),
    ("SEO Services", "seo-services", None, ["SEO services near me", "SEO company", "local SEO", "search engine optimization", "SEO agency"]),
    ("Computer Repair", "computer-repair", None, ["computer repair near me", "laptop repair", "PC repair", "computer fix near me", "tech repair"]),
    ("Managed IT Services", "managed-it-services", None, ["managed IT services", "managed service provider", "IT managed services near me", "MSP near me"]),
    ("Restaurants", "restaurants", None, ["restaurants near me", "best restaurants", "food near me", "dinner near me", "lunch spots"]),
    ("Pizza", "pizza", "restaurants", ["pizza near me", "best pizza", "pizza delivery", "pizzeria near me"]),
    ("Mexican Restaurants", "mexican-restaurants", "restaurants", ["mexican food near me", "mexican restaurant", "tacos near me", "best mexican food"]),
    ("Italian Restaurants", "italian-restaurants", "restaurants", ["italian restaurant near me", "italian food", "pasta near me", "best italian restaurant"]),
    ("Fast Food", "fast-food", "restaurants", ["fast food near me", "drive through near me", "quick food", "cheap eats near me"]),
    ("Coffee Shops", "coffee-shops", "restaurants", ["coffee near me", "coffee shop", "cafe near me", "best coffee"]),
    ("Bars & Nightlife", "bars-nightlife", "restaurants", ["bars near me", "happy hour near me", "sports bar", "cocktail bar near me"]),
]


def seed_dimensions(spark, areas=SEED_AREAS, categories=SEED_CATEGORIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Areas, the category tree and its keywords; a keyword's priority falls along its list. Small by nature."""
    area = spark.createDataFrame(areas, "name string, state string, lat double, lng double, radius_miles double")
    category = spark.createDataFrame(categories, "name string, slug string, parent string, keywords array<string>")
    return area, category.drop("keywords"), keyword_priorities(category)


def keyword_priorities(categories: DataFrame) -> DataFrame:
    """category, keyword and priority from slugs with lists of keywords: the first of n has priority n, the last 1."""
    keyword = categories.select(F.col("slug").alias("category"), F.posexplode("keywords").alias("index", "keyword"), F.size("keywords").alias("n"))
    return keyword.select("category", "keyword", (F.col("n") - F.col("index")).alias("priority"))


def plan_schedules(schedules: DataFrame, areas: DataFrame, plan: DataFrame) -> DataFrame:
    """Each schedule's part of a plan: the areas, categories (`slugs`) and engines that it lists; empty lists mean all."""
    listed = lambda c, v: F.coalesce(F.size(c) <= 0, F.lit(True)) | F.coalesce(F.array_contains(c, F.col(v)), F.lit(False))
    rows = expand_schedules(schedules, areas).join(schedules.select("schedule_id", "slugs", "engines"), "schedule_id").join(plan, "area_id")
    return rows.filter(listed("slugs", "slug") & listed("engines", "engine")).drop("slugs", "engines")


def expand_schedules(schedules: DataFrame, areas: DataFrame, column: str = "area_ids") -> DataFrame:
    """A row for each schedule and area; an empty list means all active ones, which the schedules' own job sends along."""
    listed = schedules.filter(F.size(column) > 0).select("schedule_id", F.explode(column).alias("area_id"))
    every = schedules.filter((F.size(column) <= 0) | F.col(column).isNull()).select("schedule_id").crossJoin(areas.filter("is_active").select("area_id"))
    return listed.unionByName(every)


def eta(progress: DataFrame, started: Column, now: Column) -> DataFrame:
    """When a scan will be done if it goes on as it went; null before its first point."""
    per_point = (now - started) / F.col("points_done")
    return progress.withColumn("eta", F.when(F.col("points_done") > 0, started + per_point * F.col("points_total")))


def timeouts(scans: DataFrame, now: Column, single: int = 30, batch: int = 360) -> DataFrame:
    """Running scans that began over `single` minutes ago, or `batch` for those of a batch, have failed, with a message; others stay.

    scans: status, started (seconds since 1970), in_batch.
    """
    limit = F.when(F.col("in_batch"), batch).otherwise(single)
    over = (F.col("status") == "running") & (now - F.col("started") > limit * 60)
    return scans.withColumns({"status": F.when(over, "failed").otherwise(F.col("status")), "message": F.when(over, F.concat(F.lit("Timed out after "), limit, F.lit(" minutes")))})


def quick_plan(areas: DataFrame, categories: DataFrame, keywords: DataFrame, businesses: DataFrame, engine: str, known: tuple[str, ...]) -> DataFrame:
    """The plan of a quick scan: our own businesses' categories and areas, the first five keywords of each, one engine."""
    own = businesses.filter("is_mine")
    plan = expand_scan_plan(areas.join(own.select("area_id"), "area_id", "left_semi"), categories.join(own.select(F.col("category").alias("slug")), "slug", "left_semi"), keywords, [engine], known, per_category=5)
    return plan


def scan_counts(scans: DataFrame, today: Column) -> DataFrame:
    """Pending, running and completed today."""
    return scans.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "running").alias("running"), F.count_if((F.col("status") == "completed") & (F.col("day") == today)).alias("completed_today"))
