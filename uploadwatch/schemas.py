"""Schemas of what operators take and return."""

from __future__ import annotations

EXTRA = "struct<view_count:bigint,duration_secs:int,content_id_match:boolean,fingerprint_match_level:string,account_age_days:int>"
#: seq is a detection's place in its input; ties are settled by it.
DETECTION = (
    f"platform string, url string, title string, channel_id string, channel_name string, snapshot_html string, detected_at string, query_used string, extra {EXTRA}, seq bigint"
)
PAGES = "query string, html string, seq bigint"
FETCHED = "url string, html string"
OFFENDER = (
    "permanent_id string, platform string, display_name string, profile_url string, tier string, status string, violation_count int, first_seen string, last_seen string, notes string, evidence_urls array<string>"
)
REGISTRY_TABLE = "permanent_id string, platform string, display_name string, profile_url string, tier string, status string, violation_count string, first_seen string, last_seen string, notes string"
DETECTIONS_TABLE = (
    "cluster_id string, platform string, permanent_id string, display_name string, profile_url string, content_url string, content_title string, score int, verdict string, status string, "
    "first_detected string, last_detected string, violation_count int, tier string, snapshot_url string, notes string"
)
RUN_LOG = (
    "run_id string, started_at string, finished_at string, duration_seconds double, detections_found int, clusters_after_dedup int, confirmed_count int, likely_count int, possible_count int, ignored_count int, "
    "platforms_crawled string, errors string"
)
STATS = (
    "detections_raw int, clusters_after_dedup int, confirmed_count int, likely_count int, possible_count int, ignored_count int, errors array<string>, platforms_crawled array<string>, "
    "duration_seconds double, sheet_write_errors int"
)
CHECK = "struct<name:string,status:string,message:string,detail:map<string,string>>"


def names(schema: str) -> list[str]:
    """Column names of a flat schema."""
    return [part.split()[0] for part in schema.split(", ")]
