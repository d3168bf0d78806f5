"""Lists, filters, lookups and joins over the dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(df: DataFrame) -> DataFrame:
    return df.filter("is_active")


def filter_businesses(df: DataFrame, category=None, city=None, state=None, is_mine=None, is_competitor=None, min_rating=None, has_phone=None, has_website=None) -> DataFrame:
    """Active businesses by optional parts, all of which must hold; false for has_phone or has_website filters nothing."""
    out = active(df)
    if category is not None:
        out = out.filter(F.col("category") == category)
    if city is not None:
        out = out.filter(F.lower("city") == F.lower(F.lit(city)))
    if state is not None:
        out = out.filter(F.col("state") == state)
    if is_mine is not None:
        out = out.filter(F.col("is_mine") == is_mine)
    if is_competitor is not None:
        out = out.filter(F.col("is_competitor") == is_competitor)
    if min_rating is not None:
        out = out.filter(F.col("rating") >= min_rating)
    if has_phone:
        out = out.filter(F.col("phone").isNotNull())
    if has_website:
        out = out.filter(F.col("website").isNotNull())
    return out


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == value)


def in_ids(df: DataFrame, column: str, ids) -> DataFrame:
    """Rows whose value is listed: in a Python list, or in a table's column of that name, which is joined and may be large."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(column), column, "left_semi")
    return df.filter(F.col(column).isin(list(ids)))


def remaining(df: DataFrame, done: DataFrame, column: str) -> DataFrame:
    """Distinct values that aren't done yet; nulls stay."""
    return df.select(column).distinct().join(done.select(column), column, "left_anti")


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns, by name, so that a scan reads no others."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def with_flag(df: DataFrame, members: DataFrame, key: str, name: str) -> DataFrame:
    """Whether a row's key is among the members."""
    marks = members.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def newest(df: DataFrame, created: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(created), key)


def last_seen_first(df: DataFrame, key: str = "business_id") -> DataFrame:
    return df.orderBy(F.desc("last_seen"), key)


def by_name(df: DataFrame, key: str, name: str = "name") -> DataFrame:
    return df.orderBy(name, key)


def ordered_points(points: DataFrame) -> DataFrame:
    return points.orderBy("grid_row", "grid_col", "point_id")


def filter_scans(points: DataFrame, status=None, engine=None, area=None, keyword=None) -> DataFrame:
    """By optional parts, all of which must hold."""
    out = points
    for c, v in (("status", status), ("engine", engine), ("area_id", area), ("keyword", keyword)):
        if v is not None:
            out = out.filter(F.col(c) == v)
    return out


def filter_trend(facts: DataFrame, business=None, keyword=None, area=None, engine=None, start=None, end=None) -> DataFrame:
    """Facts by optional keys and a range of scan months, both ends in."""
    out = filter_scans(facts, engine=engine, area=area, keyword=keyword)
    if business is not None:
        out = out.filter(F.col("business_id") == business)
    if start is not None:
        out = out.filter(F.col("scan_month") >= start)
    return out if end is None else out.filter(F.col("scan_month") <= end)


def usable_pages(pages: DataFrame, most: int = 5 * 1024 * 1024, html: str = "html") -> DataFrame:
    """HTML or plain text of at most `most` bytes whose status, if it is there, is under 400; with its size."""
    out = pages.withColumn("bytes", F.octet_length(html).cast("long")).filter(F.col("bytes") <= most)
    if "content_type" in pages.columns:
        out = out.filter(F.coalesce(F.lower("content_type").rlike("text/html|text/plain|application/xhtml"), F.lit(True)))
    return out.filter("status is null or status < 400") if "status" in pages.columns else out


def review_history(reviews: DataFrame, limit: int = 100) -> DataFrame:
    """Each business's newest snapshots."""
    order = Window.partitionBy("business_id").orderBy(F.desc("captured"), F.desc("snapshot_id"))
    return reviews.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit)


def scans_with_dims(points: DataFrame, areas: DataFrame, categories: DataFrame) -> DataFrame:
    """Scans beside their area and category; either may be missing."""
    return points.join(areas.select("area_id", "area"), "area_id", "left").join(categories.select(F.col("slug").alias("category"), "parent"), "category", "left")


def businesses_with_category(businesses: DataFrame, categories: DataFrame) -> DataFrame:
    return businesses.join(categories.select(F.col("slug").alias("category"), F.col("parent").alias("category_parent"), F.col("is_active").alias("category_active")), "category", "left")


def search(df: DataFrame, text: str, limit: int = 50, order: str = "last_seen", key: str = "business_id") -> DataFrame:
    """Active rows that hold the text in name, address, city or website without case, or in the phone as it is; latest first."""
    low = text.lower()
    hit = F.col("phone").contains(text)
    for c in ("name", "address", "city", "website"):
        hit = F.coalesce(F.lower(c).contains(low), F.lit(False)) | F.coalesce(hit, F.lit(False))
    return active(df).filter(hit).orderBy(F.desc(order), key).limit(limit)


def page(df: DataFrame, number: int, limit: int, order: list[Column]) -> DataFrame:
    """Offset paging; the order should end in a unique key."""
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def page_after(df: DataFrame, limit: int, by: str, key: str, last: tuple) -> DataFrame:
    """Keyset paging for deep pages: the rows after (by, key), by descending."""
    return df.filter((F.col(by) < last[0]) | ((F.col(by) == last[0]) & (F.col(key) > last[1]))).orderBy(F.desc(by), key).limit(limit)


def page_counts(df: DataFrame, limit: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.ceil(F.col("total") / limit))


def ranked_by(df: DataFrame, facts: DataFrame, engine: str) -> DataFrame:
    """Businesses that an engine has ranked."""
    return df.join(facts.filter(F.col("engine") == engine), "business_id", "left_semi")


def enrichment_candidates(df: DataFrame, hours: int = 168, only_missing: bool = True, limit: int = 500, ids=None, categories: list[str] | None = None) -> DataFrame:
    """Active, with a website, without e-mail, never enriched or long ago; the longest ago first, never before all."""
    out = active(df).filter("website is not null")
    if only_missing:
        out = out.filter("email is null")
    if ids is not None:
        out = in_ids(out, "business_id", ids)
    if categories is not None:
        out = in_ids(out, "category", categories)
    return out.filter(F.col("enriched_hours").isNull() | (F.col("enriched_hours") > hours)).orderBy(F.desc_nulls_first("enriched_hours"), "business_id").limit(limit)


def category_overview(categories: DataFrame, keywords: DataFrame, businesses: DataFrame | None = None) -> DataFrame:
    """Each category with its active children, its businesses if they are given, and its keywords, most wanted first; a small dimension's lists."""
    children = active(categories).filter("parent is not null").groupBy(F.col("parent").alias("slug")).agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("children"), F.count("*").alias("n_children"))
    words = keywords.groupBy(F.col("category").alias("slug")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "keyword"))), lambda x: x["keyword"]), ",").alias("keywords"), F.count("*").alias("n_keywords"))
    out = categories.join(children, "slug", "left").join(words, "slug", "left")
    counts = [F.coalesce("n_children", F.lit(0)).alias("n_children"), "keywords", F.coalesce("n_keywords", F.lit(0)).alias("n_keywords")]
    if businesses is not None:
        out = out.join(businesses.groupBy(F.col("category").alias("slug")).agg(F.count("*").alias("n_businesses")), "slug", "left")
        counts.append(F.coalesce("n_businesses", F.lit(0)).alias("n_businesses"))
    return out.select("slug", "parent", "children", *counts)


def category_closure(categories: DataFrame) -> DataFrame:
    """ancestor, descendant, depth over all levels of the tree; a category is its own ancestor at depth 0.

    Spark ends the recursion with an error, not a cut result, if the tree holds a cycle.
    """
    return categories.sparkSession.sql(
        """WITH RECURSIVE tree AS (
          SELECT slug AS ancestor, slug AS descendant, 0 AS depth FROM {c}
          UNION ALL SELECT c.parent, t.descendant, t.depth + 1 FROM tree t JOIN {c} c ON t.ancestor = c.slug WHERE c.parent IS NOT NULL)
        SELECT ancestor, descendant, depth FROM tree""",
        c=categories,
    )


def nearby(df: DataFrame, miles: float, k: int) -> DataFrame:
    """For each business of ours, the k nearest others within some miles; see geo.nearest()."""
    from rankatlas.operators.geo import nearest

    places = df.select(F.col("business_id").alias("id"), "lat", "lng", "is_mine")
    found = nearest(places.filter("is_mine"), places, miles, k)
    return found.select(F.col("id").alias("ours"), F.col("other").alias("business_id"), "nth", F.round("miles", 4).alias("miles"))


def rank_history(facts: DataFrame, limit: int = 100) -> DataFrame:
    """Each business's newest rankings."""
    order = Window.partitionBy("business_id").orderBy(F.desc("scan_month"), "point_id")
    return facts.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit)


def scan_results(facts: DataFrame, points: DataFrame, names: DataFrame) -> DataFrame:
    """A row a point: its results in rank order as one JSON array."""
    ranked = facts.join(names.select("business_id", "name"), "business_id").groupBy("point_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "business_id", "name")))).alias("results"), F.count("*").alias("n_results"))
    return points.join(ranked, "point_id", "left").select("point_id", "grid_row", "grid_col", "results", F.coalesce("n_results", F.lit(0)).alias("n_results"))


def fk_violations(child: DataFrame, parent: DataFrame, column: str, key: str) -> DataFrame:
    """Values of a foreign key that no parent has; nulls are fine."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti").groupBy(column).agg(F.count("*").alias("violations"))


def all_fk_violations(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """fk_violations() of all keys whose tables are given, with the key's name; keys are (child, column, parent, parent's column)."""
    parts = [fk_violations(tables[c], tables[p], column, key).select(F.lit(f"{c}.{column}").alias("key"), F.col(column).cast("string").alias("value"), "violations") for c, column, p, key in keys if c in tables and p in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unique_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    full = df.dropna(subset=columns)
    return full.groupBy(*columns).agg(F.count("*").alias("copies")).filter("copies > 1")


def validate(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the rest with their messages as `column: message`, joined; an unknown result breaks a rule."""
    messages = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{c}: {text}")) for c, (text, ok) in rules.items())), lambda m: m.isNotNull())
    marked = df.withColumn("errors", F.concat_ws(", ", messages))
    return marked.filter("errors = ''").drop("errors"), marked.filter("errors <> ''")


def set_null(df: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is gone keep all but the reference."""
    dead = gone.select(F.col(key).alias(column)).distinct().withColumn("__gone", F.lit(True))
    out = df.join(dead, column, "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column)))
    return out.select(*(F.col(f"`{c}`") for c in df.columns))


def rule(column: Column, kind: str, *more) -> tuple[str, Column]:
    """Message and test of a common rule: uuid; nonempty; int or length (low, high); array (not empty); enum (values)."""
    if kind == "uuid":
        return "must be a UUID", column.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    if kind == "nonempty":
        return "must not be empty", F.length(column) > 0
    if kind == "int":
        return f"must be from {more[0]} to {more[1]}", column.between(*more)
    if kind == "length":
        return f"must have {more[0]} to {more[1]} characters", F.length(column).between(*more)
    if kind == "array":
        return "must have an element", F.size(column) > 0
    if kind == "enum":
        return "must be one of " + ", ".join(more), column.isin(*more)
    raise ValueError(f"no rule {kind}")


def cascade_delete(scans: DataFrame, points: DataFrame, rankings: DataFrame, gone: DataFrame, key: str = "scan_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scans, points and rankings without those under the given scans."""
    dead = points.join(gone, key, "left_semi").select("point_id")
    return scans.join(gone, key, "left_anti"), points.join(gone, key, "left_anti"), rankings.join(dead, "point_id", "left_anti")


def system_stats(**tables: DataFrame) -> DataFrame:
    """Counts of tables, in all and active, one row a table."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), (F.count_if("is_active") if "is_active" in df.columns else F.lit(None).cast("long")).alias("active")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
