"""Declared schemas of the ten tables, for read_table(); ids are strings, times UTC."""

from __future__ import annotations

_PLACE = "latitude decimal(10,7), longitude decimal(10,7)"

# Names and types of the columns of the tables that the library reads and writes.
SCHEMAS = {
    "service_area": "id string, name string, state string, center_lat decimal(10,7), center_lng decimal(10,7), radius_miles decimal(5,2), is_active boolean, created_at timestamp",
    "category": "id string, name string, slug string, parent_id string, is_active boolean, created_at timestamp",
    "category_keyword": "id string, category_id string, keyword string, priority int, is_active boolean",
    "business": f"id string, name string, normalized_name string, category_id string, address string, city string, state string, zip string, {_PLACE}, phone string, website string, email string, place_id string, types array<string>, hours map<string,string>, service_options map<string,boolean>, attributes string, rating decimal(2,1), review_count int, is_mine boolean, is_competitor boolean, is_active boolean, first_seen_at timestamp, last_seen_at timestamp, last_enriched_at timestamp",
    "review_snapshot": "id string, business_id string, source string, rating decimal(2,1), review_count int, captured_at timestamp",
    "scan": "id string, service_area_id string, category_id string, engine string, keyword string, grid_size int, status string, points_total int, points_done int, started_at timestamp, completed_at timestamp, error string, created_at timestamp",
    "scan_point": f"id string, scan_id string, grid_row int, grid_col int, {_PLACE}, status string, raw_html string, scanned_at timestamp",
    "scan_ranking": "id string, scan_point_id string, business_id string, rank_position int, result_type string, captured_at timestamp",
    "enrichment_log": "id string, business_id string, source string, status string, data_added string, error string, created_at timestamp",
    "scan_schedule": "id string, name string, cron string, area_ids array<string>, category_ids array<string>, engine_ids array<string>, grid_size int, is_active boolean, created_at timestamp",
}

# Child table and column, parent table, and what becomes of the child when the parent goes.
FOREIGN_KEYS = [
    ("category", "parent_id", "category", "set null"),
    ("category_keyword", "category_id", "category", "restrict"),
    ("business", "category_id", "category", "set null"),
    ("review_snapshot", "business_id", "business", "restrict"),
    ("scan", "service_area_id", "service_area", "restrict"),
    ("scan", "category_id", "category", "restrict"),
    ("scan_point", "scan_id", "scan", "cascade"),
    ("scan_ranking", "scan_point_id", "scan_point", "cascade"),
    ("scan_ranking", "business_id", "business", "restrict"),
    ("enrichment_log", "business_id", "business", "restrict"),
]
