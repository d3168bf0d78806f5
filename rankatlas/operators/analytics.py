"""Metrics over ranking facts (one best rank for each point and business) and review snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankatlas.functions.scalars import rank_band

SCAN = ["area_id", "keyword", "engine", "scan_month"]


def best_ranks(rankings: DataFrame) -> DataFrame:
    """One row a point and business: repeated pages and re-runs leave the best rank."""
    return rankings.groupBy("point_id", "business_id").agg(F.min("rank").alias("rank"))


def rank_trend(facts: DataFrame) -> DataFrame:
    return facts.groupBy("business_id", *SCAN).agg(F.round(F.avg("rank"), 4).alias("avg_rank"), F.min("rank").alias("best"), F.max("rank").alias("worst"))


def geo_heatmap(facts: DataFrame, points: DataFrame, business: int, scan: int | None = None, businesses: DataFrame | None = None) -> DataFrame:
    """Each cell of each key's latest scan, or of a given one, with the best rank of a business there, or null; with its name if businesses are given."""
    key = ["area_id", "keyword", "engine"]
    ranks = facts.filter(F.col("business_id") == business).select("point_id", "rank")
    if scan is None:
        chosen = points.join(points.groupBy(*key).agg(F.max("scan_month").alias("scan_month")), [*key, "scan_month"])
    else:
        chosen = points.filter(F.col("scan_month") == scan)
    cells = chosen.join(ranks, "point_id", "left").groupBy(*key, "scan_month", "grid_row", "grid_col").agg(F.min("rank").alias("rank"))
    if businesses is None:
        return cells
    named = businesses.filter(F.col("business_id") == business).select("business_id", "name")
    # an id has one row; a cell without a rank keeps a null name
    return cells.withColumn("business_id", F.when(F.col("rank").isNotNull(), F.lit(business))).join(named, "business_id", "left")


def _share(top: Column, all_: Column) -> Column:
    return F.round(100 * top / all_, 4)


def solv(facts: DataFrame, points: DataFrame, keys: list[str], within: int = 3) -> DataFrame:
    """Share of local voice: of a key's completed points, those where a business ranks in the first three; with its gauge."""
    total = points.filter(F.col("status") == "completed").groupBy(*keys).agg(F.count("*").alias("points"))
    ended = points.filter(F.col("status") == "completed").select("point_id")
    done = facts.filter(F.col("status") == "completed") if "status" in facts.columns else facts.join(ended, "point_id", "left_semi")
    top = done.filter(F.col("rank") <= within).groupBy("business_id", *keys).agg(F.count("*").alias("top_points"))
    out = top.join(total, keys).withColumn("solv", _share(F.col("top_points"), F.col("points")))
    return out.withColumn("gauge", F.when(F.col("solv") >= 70, "green").when(F.col("solv") >= 40, "yellow").otherwise("red"))


def solv_trend(shares: DataFrame, keys: list[str]) -> DataFrame:
    """Share against the scan before."""
    order = Window.partitionBy("business_id", *keys).orderBy("scan_month")
    return shares.withColumn("before", F.lag("solv").over(order)).withColumn("change", F.round(F.col("solv") - F.col("before"), 4))


def quick_stats(facts: DataFrame) -> DataFrame:
    """For each business: points in the first three, mean, best and worst rank and how many points have them."""
    ranks = facts.groupBy("business_id", "rank").agg(F.count("*").alias("n"))  # few rows a business, whatever its points
    total, weighted = F.sum("n"), F.sum(F.col("rank") * F.col("n"))
    top = F.coalesce(F.sum(F.when(F.col("rank") <= 3, F.col("n"))), F.lit(0))
    return ranks.groupBy("business_id").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"), top.alias("top_points"), F.round(weighted / total, 4).alias("avg_rank"), F.min_by("n", "rank").alias("n_best"), F.max_by("n", "rank").alias("n_worst"))


def band_histogram(facts: DataFrame) -> DataFrame:
    return facts.groupBy("engine", rank_band(F.col("rank")).alias("band")).agg(F.count("*").alias("points"))


def cross_engine(facts: DataFrame, engines: list[str], gap: float = 1.0) -> DataFrame:
    """Mean rank by keyword with a column for each engine; an opportunity where the worst is `gap` behind the best."""
    wide = facts.groupBy("business_id", "keyword").pivot("engine", engines).agg(F.round(F.avg("rank"), 4))
    names = {e: "e" + "".join(ch for ch in e if ch.isdigit()) for e in engines}
    wide = wide.select("business_id", "keyword", *(F.col(f"`{e}`").alias(n) for e, n in names.items()))
    return wide.withColumn("opportunity", F.coalesce(F.greatest(*names.values()) - F.least(*names.values()) >= gap, F.lit(False)))


def competitor_comparison(facts: DataFrame, businesses: DataFrame) -> DataFrame:
    own = facts.groupBy("business_id").agg(F.round(F.avg("rank"), 4).alias("avg_rank"), F.countDistinct("keyword").alias("keywords"), F.countDistinct("area_id").alias("areas"), F.countDistinct("engine").alias("engines"))
    return businesses.filter("is_mine or is_competitor").join(own, "business_id", "left").select("business_id", "name", "is_mine", "avg_rank", "keywords", "areas", "engines", "reviews", "rating")


def competitor_profile(facts: DataFrame, businesses: DataFrame, velocity: DataFrame, momentum: DataFrame, engines: list[str]) -> DataFrame:
    """competitor_comparison() with each engine's mean rank, review velocity and ranking momentum."""
    wide = facts.groupBy("business_id").pivot("engine", engines).agg(F.round(F.avg("rank"), 4))
    wide = wide.select("business_id", *(F.col(f"`{e}`").alias("e" + "".join(c for c in e if c.isdigit())) for e in engines))
    out = competitor_comparison(facts, businesses)
    for more in (wide, velocity.select("business_id", "velocity"), momentum.select("business_id", "momentum")):
        out = out.join(more, "business_id", "left")
    return out


def market_overview(facts: DataFrame, businesses: DataFrame, k: int = 3) -> DataFrame:
    """For each area and keyword: businesses, mean rating, and the k best by mean rank, then reviews, then id."""
    means = facts.groupBy("area_id", "keyword", "business_id").agg(F.avg("rank").alias("mean"))
    full = means.join(businesses.select("business_id", "reviews", "rating"), "business_id")
    order = Window.partitionBy("area_id", "keyword").orderBy("mean", F.desc("reviews"), "business_id")
    counts = full.groupBy("area_id", "keyword").agg(F.count("*").alias("businesses"), F.round(F.avg("rating"), 4).alias("avg_rating"))
    # a filter on the number alone lets each task drop all but its own k before the shuffle
    top = full.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
    first = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "business_id"))), lambda x: x["business_id"].cast("string")), ",")
    return counts.join(top.groupBy("area_id", "keyword").agg(first.alias("top")), ["area_id", "keyword"])


def keyword_area_matrix(facts: DataFrame, areas: list[int]) -> DataFrame:
    wide = facts.groupBy("business_id", "keyword").pivot("area_id", areas).agg(F.min("rank"))
    return wide.select("business_id", "keyword", *(F.col(f"`{a}`").alias(f"a{a}") for a in areas))


def keyword_area_ranks(facts: DataFrame) -> DataFrame:
    """The matrix of all areas as rows: best rank of a business, keyword and area."""
    return facts.groupBy("business_id", "keyword", "area_id").agg(F.min("rank").alias("rank"))


def geo_dominance(facts: DataFrame, points: DataFrame, businesses: DataFrame) -> DataFrame:
    """Each area: our best share of voice against the best competitor's, and whose area it is.

    Shares under 40 hold no area; two of 40 or more within 10 points contest it.
    """
    shares = solv(facts, points, ["area_id"]).join(businesses.select("business_id", "is_mine", "is_competitor"), "business_id")
    best = shares.groupBy("area_id").agg(F.max(F.when(F.col("is_mine"), F.col("solv"))).alias("mine"), F.max(F.when(F.col("is_competitor"), F.col("solv"))).alias("theirs"))
    a, b = F.coalesce("mine", F.lit(0.0)), F.coalesce("theirs", F.lit(0.0))
    kind = F.when((a < 40) & (b < 40), "neither").when((a >= 40) & (b >= 40) & (F.abs(a - b) <= 10), "contested").when(a > b, "mine").otherwise("competitor")
    return best.withColumn("holder", kind)


def geo_gap(facts: DataFrame) -> DataFrame:
    """A business's best and worst area for a keyword, and the opportunity in the gap."""
    means = facts.groupBy("business_id", "keyword", "area_id").agg(F.avg("rank").alias("mean"))
    ends = means.groupBy("business_id", "keyword").agg(F.count("*").alias("areas"), F.min("mean").alias("lo"), F.max("mean").alias("hi")).filter("areas > 1")
    gap = F.col("hi") - F.col("lo")
    return ends.select("business_id", "keyword", "areas", F.round(gap, 4).alias("gap"), F.when(gap >= 10, "high").when(gap >= 5, "medium").otherwise("low").alias("opportunity"))


def competitor_gap(facts: DataFrame, businesses: DataFrame) -> DataFrame:
    """By area and keyword, our best mean rank against the best competitor's, and the opportunity in it.

    High: ten ranks behind, or not ranked where a competitor is in the first three; medium: five behind.
    """
    means = facts.groupBy("area_id", "keyword", "business_id").agg(F.avg("rank").alias("mean")).join(businesses.select("business_id", "is_mine", "is_competitor"), "business_id")
    best = means.groupBy("area_id", "keyword").agg(F.min(F.when(F.col("is_mine"), F.col("mean"))).alias("mine"), F.min(F.when(F.col("is_competitor"), F.col("mean"))).alias("theirs")).filter("theirs is not null")
    gap = F.col("mine") - F.col("theirs")
    kind = F.when((gap >= 10) | (F.col("mine").isNull() & (F.col("theirs") <= 3)), "high").when(gap >= 5, "medium").otherwise("low")
    return best.select("area_id", "keyword", F.round("mine", 4).alias("mine"), F.round("theirs", 4).alias("theirs"), F.round(gap, 4).alias("gap"), kind.alias("opportunity"))


def keyword_gap(facts: DataFrame, businesses: DataFrame) -> DataFrame:
    """Keyword and area pairs where a competitor ranks and we don't."""
    theirs = facts.join(businesses.filter("is_competitor"), "business_id", "left_semi").select("area_id", "keyword").distinct()
    mine = facts.join(businesses.filter("is_mine"), "business_id", "left_semi")
    return theirs.join(mine, ["area_id", "keyword"], "left_anti")


def compare_scans(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two scans cell by cell: improved, declined, new, lost or unchanged."""
    cells = ["business_id", "grid_row", "grid_col"]
    x, y = (d.groupBy(*cells).agg(F.min("rank").alias(n)) for d, n in ((a, "before"), (b, "after")))
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "lost").when(F.col("after") < F.col("before"), "improved").when(F.col("after") > F.col("before"), "declined").otherwise("unchanged")
    return x.join(y, cells, "full_outer").withColumn("change", change)


def scan_changes(compared: DataFrame) -> DataFrame:
    """How many cells of each business improved, declined, are new, lost or unchanged."""
    kinds = ("improved", "declined", "new", "lost", "unchanged")
    return compared.groupBy("business_id").agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds))


def rank_alerts(facts: DataFrame, least: float = 3) -> DataFrame:
    """Mean rank moved by `least` or more since the scan before."""
    means = facts.groupBy("business_id", "keyword", "engine", "scan_month").agg(F.avg("rank").alias("mean"))
    before = F.lag("mean").over(Window.partitionBy("business_id", "keyword", "engine").orderBy("scan_month"))
    return means.withColumn("change", F.col("mean") - before).filter(F.abs("change") >= least).select("business_id", "keyword", "engine", "scan_month", F.round("change", 4).alias("change"))


def ranking_momentum(facts: DataFrame, step: float = 0.5) -> DataFrame:
    """Newest against oldest mean rank of a business's last three scans; lower is better."""
    means = facts.groupBy("business_id", "scan_month").agg(F.avg("rank").alias("mean"))
    last = means.withColumn("nth", F.row_number().over(Window.partitionBy("business_id").orderBy(F.desc("scan_month")))).filter("nth <= 3")
    ends = last.groupBy("business_id").agg(F.count("*").alias("scans"), F.max_by("mean", "scan_month").alias("new"), F.min_by("mean", "scan_month").alias("old"))
    move = F.col("new") - F.col("old")
    return ends.select("business_id", "scans", F.round(move, 4).alias("move"), F.when(move < -step, "rising").when(move > step, "falling").otherwise("stable").alias("momentum"))


def latest_scan(points: DataFrame) -> DataFrame:
    """Latest and previous scan of each key."""
    months = points.select("area_id", "keyword", "engine", "scan_month").distinct()
    order = Window.partitionBy("area_id", "keyword", "engine").orderBy(F.desc("scan_month"))
    return months.withColumn("nth", F.row_number().over(order)).groupBy("area_id", "keyword", "engine").agg(F.max(F.when(F.col("nth") == 1, F.col("scan_month"))).alias("latest"), F.max(F.when(F.col("nth") == 2, F.col("scan_month"))).alias("previous"))


def top_k(facts: DataFrame, businesses: DataFrame, k: int = 5) -> DataFrame:
    """Each area's k best by mean rank, then most reviews, then id."""
    means = facts.groupBy("area_id", "business_id").agg(F.avg("rank").alias("mean")).join(businesses.select("business_id", "reviews"), "business_id", "left")
    order = Window.partitionBy("area_id").orderBy("mean", F.desc_nulls_last("reviews"), "business_id")
    return means.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).select("area_id", "business_id", F.round("mean", 4).alias("avg_rank"), "nth")


def point_leaders(facts: DataFrame, k: int | None = 3) -> DataFrame:
    """The first k at each point, or all, as one list in rank order."""
    order = Window.partitionBy("point_id").orderBy("rank", "business_id")
    top = facts.withColumn("nth", F.row_number().over(order))
    top = top if k is None else top.filter(F.col("nth") <= k)
    return top.groupBy("point_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "business_id"))), lambda x: x["business_id"].cast("string")), ",").alias("leaders"))


def latest_ranks(facts: DataFrame) -> DataFrame:
    """Each business's mean rank in its latest scan of an engine and keyword."""
    means = facts.groupBy("business_id", "engine", "keyword", "scan_month").agg(F.round(F.avg("rank"), 4).alias("avg_rank"))
    order = Window.partitionBy("business_id", "engine", "keyword").orderBy(F.desc("scan_month"))
    return means.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def trend_arrow(facts: DataFrame) -> DataFrame:
    means = facts.groupBy("business_id", "engine", "scan_month").agg(F.avg("rank").alias("mean"))
    before = F.lag("mean").over(Window.partitionBy("business_id", "engine").orderBy("scan_month"))
    move = F.round(F.col("mean") - before, 6)
    return means.select("business_id", "engine", "scan_month", F.when(move < 0, "up").when(move > 0, "down").when(move == 0, "flat").alias("arrow"))


def source_badges(facts: DataFrame, engines: list[str]) -> DataFrame:
    return facts.groupBy("business_id").agg(*(F.max(F.col("engine") == e).alias("has" + "".join(c for c in e if c.isdigit())) for e in engines))


def ad_signal(rankings: DataFrame) -> DataFrame:
    return rankings.groupBy("business_id").agg(F.count_if(F.col("result_type") == "ads").alias("ads"), F.count("*").alias("results"))


def profile_completeness(businesses: DataFrame, fields: list[str]) -> DataFrame:
    have = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return businesses.select("business_id", have.alias("filled"), F.when(have == len(fields), "complete").otherwise("partial").alias("profile"))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    order = Window.partitionBy("business_id", "source").orderBy(F.desc("captured"), F.desc("snapshot_id"))
    return reviews.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("business_id", "source", "snapshot_id", "rating", "review_count")


def review_deltas(reviews: DataFrame) -> DataFrame:
    before = F.lag("review_count").over(Window.partitionBy("business_id", "source").orderBy("captured", "snapshot_id"))
    return reviews.select("snapshot_id", "business_id", "source", "captured", (F.col("review_count") - before).alias("delta"))


def month_of(seconds: Column) -> Column:
    """Months since the year 0 of seconds since 1970, in UTC whatever the session's zone is."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int"))
    return F.year(day) * 12 + F.month(day)


def reviews_per_month(reviews: DataFrame) -> DataFrame:
    """New reviews in each month, drops left out."""
    gains = review_deltas(reviews).filter("delta > 0")
    return gains.groupBy("business_id", month_of(F.col("captured")).alias("month")).agg(F.sum("delta").alias("gained"))


def review_velocity(reviews: DataFrame, months: float = 3, days: int = 90) -> DataFrame:
    """Reviews gained a month over a trailing frame at each business's last snapshot, and its class."""
    frame = Window.partitionBy("business_id").orderBy("captured").rangeBetween(-days * 86_400, 0)
    order = Window.partitionBy("business_id").orderBy(F.desc("captured"), F.desc("snapshot_id"))
    seen = reviews.withColumns({"least": F.min("review_count").over(frame), "first": F.min("captured").over(Window.partitionBy("business_id")), "nth": F.row_number().over(order)}).filter("nth = 1")
    rate = F.round((F.col("review_count") - F.col("least")) / months, 4)
    old = F.col("captured") - F.col("first") >= days * 86_400
    kind = F.when(rate > 5, "accelerating").when(rate >= 1, "stable").when((rate == 0) & old, "stale").otherwise("slowing")
    return seen.select("business_id", rate.alias("rate"), kind.alias("velocity"))


def enrichment_summary(log: DataFrame) -> DataFrame:
    """A row a run, or one row: how enrichments went, and the distinct addresses they found, in the order of the log's created_at, or sorted where it has none."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    run = F.col("run_id") if "run_id" in log.columns else F.lit(0)
    counts = log.groupBy(run.alias("_run")).agg(F.count("*").alias("total"), is_("success").alias("enriched"), is_("no_email_found").alias("processed_without"), is_("no_website", "invalid_url").alias("skipped"), is_("error").alias("failed"))
    if "email" in log.columns:
        at = F.col("created_at") if "created_at" in log.columns else F.lit(0)
        # each address once, at its first time, before addresses are gathered
        first = log.filter("email IS NOT NULL").groupBy(run.alias("_of"), "email").agg(F.min(at).alias("at"))
        listed = first.groupBy("_of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "email"))), lambda x: x["email"]), ",").alias("emails"))
        counts = counts.join(listed, F.col("_run").eqNullSafe(F.col("_of")), "left").drop("_of")
    else:
        counts = counts.withColumn("emails", F.lit(None).cast("string"))
    return counts.withColumnRenamed("_run", "run_id") if "run_id" in log.columns else counts.drop("_run")


def discovery_stats(resolved: DataFrame) -> DataFrame:
    """Observations by how they were matched."""
    return resolved.groupBy("match_type").agg(F.count("*").alias("observations"), F.countDistinct("business_id").alias("businesses"))


def weaknesses(businesses: DataFrame, few_reviews: int = 50, stale: int = 500) -> DataFrame:
    """Flags of what a business lacks, as one sorted list."""
    flags = {"few_reviews": F.col("reviews") < few_reviews, "no_https": ~F.coalesce(F.col("website").startswith("https://"), F.lit(False)), "no_phone": F.col("phone").isNull(), "stale": F.col("last_seen") < stale}
    found = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in sorted(flags.items()))), lambda x: x.isNotNull())
    return businesses.select("business_id", F.array_join(found, ",").alias("weaknesses"))


def enrichment_priority(businesses: DataFrame, facts: DataFrame, hours: int = 720) -> DataFrame:
    """Tier of each business: ours, competitors, those ranked in the first five, never enriched, long ago, the rest."""
    top = facts.filter("rank <= 5").select("business_id").distinct().withColumn("top", F.lit(True))
    tier = F.when(F.col("is_mine"), 1).when(F.col("is_competitor"), 2).when(F.col("top"), 3).when(F.col("enriched_hours").isNull(), 4).when(F.col("enriched_hours") > hours, 5).otherwise(6)
    return businesses.join(top, "business_id", "left").select("business_id", tier.alias("tier"))


def first_non_empty(*arrays: Column) -> Column:
    """The first array that has an element."""
    return F.coalesce(*(F.when(F.size(a) > 0, a) for a in arrays))
