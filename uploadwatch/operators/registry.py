"""The registry of offenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uploadwatch import config, schemas

KEY = ["platform", "permanent_id"]


def tier(violations: Column) -> Column:
    out = F.lit(config.LAST_TIER)
    for least, name in reversed(config.TIERS):
        out = F.when(violations >= least, name).otherwise(out)
    return out


def key(platform: Column, permanent_id: Column) -> Column:
    return F.concat_ws(":", platform, permanent_id)


def fold(evidence: DataFrame) -> DataFrame:
    """One row per offender of evidence (platform, permanent_id, display_name, profile_url, url, detected_at, seq).

    seq is the order of processing.  The fold is associative, so partial aggregation applies.
    """
    ordered = F.array_sort(F.collect_set(F.struct("url_seq", "url")))
    first = evidence.groupBy(*KEY, "url").agg(
        F.min("seq").alias("url_seq"), F.count("*").alias("n"), F.min_by("detected_at", "seq").alias("first_at"), F.max("detected_at").alias("last_at"),
        F.max(F.struct("seq", "display_name", "profile_url")).alias("latest"),
    )
    return first.groupBy(*KEY).agg(
        F.sum("n").cast("int").alias("n"), F.min_by("first_at", "url_seq").alias("first_at"), F.max("last_at").alias("last_at"), F.max("latest").alias("latest"), F.transform(ordered, lambda x: x["url"]).alias("urls")
    )


def upsert(existing: DataFrame, evidence: DataFrame, count_known_urls: bool = True) -> DataFrame:
    """The registry after evidence: every piece counts, also one whose address is known, unless count_known_urls is off.

    New offenders start active with the first piece's time as first_seen.  Known ones keep status, notes and
    first_seen, take name and address of the last piece, the later last_seen, and new addresses at the end.
    """
    if not count_known_urls:
        known = existing.select(*KEY, F.explode("evidence_urls").alias("url"))
        evidence = evidence.join(known, [*KEY, "url"], "left_anti")
    new = fold(evidence)
    old = existing.select(*(F.col(c).alias(f"_{c}") if c not in KEY else F.col(c) for c in schemas.names(schemas.OFFENDER)))
    joined = old.join(new, KEY, "full")
    met, fresh = F.col("n").isNotNull(), F.col("_violation_count").isNull()
    violations = (F.coalesce("_violation_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int")
    empty = F.array().cast("array<string>")
    columns = {
        "permanent_id": F.col("permanent_id"), "platform": F.col("platform"),
        "display_name": F.when(met, F.col("latest.display_name")).otherwise(F.col("_display_name")),
        "profile_url": F.when(met, F.col("latest.profile_url")).otherwise(F.col("_profile_url")),
        "tier": F.when(met, tier(violations)).otherwise(F.col("_tier")),
        "status": F.when(fresh, "active").otherwise(F.col("_status")),
        "violation_count": violations,
        "first_seen": F.when(fresh, F.col("first_at")).otherwise(F.col("_first_seen")),
        "last_seen": F.greatest("_last_seen", "last_at"),
        "notes": F.coalesce("_notes", F.lit("")),
        "evidence_urls": F.array_distinct(F.concat(F.coalesce("_evidence_urls", empty), F.coalesce("urls", empty))),
    }
    return joined.select(*(v.alias(k) for k, v in columns.items()))


def prior_violations(registry: DataFrame) -> DataFrame:
    """platform, permanent_id, prior: active offenders alone count."""
    return registry.filter("status = 'active'").select(*KEY, F.col("violation_count").alias("prior"))


def lookup(registry: DataFrame, platform: str, permanent_id: str) -> DataFrame:
    return registry.filter((F.col("platform") == platform) & (F.col("permanent_id") == permanent_id))


def list_active(registry: DataFrame, platform: str | None = None) -> DataFrame:
    """Latest first."""
    active = registry.filter("status = 'active'")
    return (active.filter(F.col("platform") == platform) if platform else active).orderBy(F.desc("last_seen"), *KEY)


def update_status(registry: DataFrame, platform: str, permanent_id: str, status: str, run_ts: str) -> DataFrame:
    """Changes a status and notes the change; the same status again changes nothing.

    ValueError for an unknown status, KeyError for an unknown offender.
    """
    if status not in config.STATUSES:
        raise ValueError(f"status {status!r} is none of {', '.join(config.STATUSES)}")
    if lookup(registry, platform, permanent_id).isEmpty():
        raise KeyError(f"{platform}:{permanent_id}")
    changes = (F.col("platform") == platform) & (F.col("permanent_id") == permanent_id) & (F.col("status") != status)
    note = F.concat(F.lit(f"[{run_ts}] "), F.col("status"), F.lit(f" → {status}"))
    notes = F.concat_ws(" | ", F.nullif(F.col("notes"), F.lit("")), note)
    return registry.withColumns({"notes": F.when(changes, notes).otherwise(F.col("notes")), "status": F.when(changes, status).otherwise(F.col("status"))})


def export_for_legal(registry: DataFrame, permanent_id: str, order: str = "platform") -> DataFrame:
    """package: one JSON object with all that is held on an offender, of whatever platform; KeyError if none.

    order names the column that says which of several records comes first.
    """
    found = registry.filter(F.col("permanent_id") == permanent_id).orderBy(order).limit(1)
    if found.isEmpty():
        raise KeyError(permanent_id)
    return found.select(legal_package().alias("package"))


def legal_package() -> Column:
    fields = ("permanent_id", "platform", "display_name", "profile_url", "first_seen", "last_seen", "violation_count", "tier", "status", "evidence_urls", "notes")
    return F.to_json(F.struct(*fields, F.size("evidence_urls").alias("evidence_count")))


def to_rows(registry: DataFrame) -> DataFrame:
    """As the registry table keeps it: all text, addresses of evidence left out."""
    return registry.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in schemas.names(schemas.REGISTRY_TABLE)))


def from_rows(rows: DataFrame) -> DataFrame:
    """Typed records of table rows; wholly empty rows are skipped, and of one key the last row counts (column sheet_row, if there)."""
    names = schemas.names(schemas.REGISTRY_TABLE)
    given = rows.filter(F.concat_ws("", *names) != "")
    if "sheet_row" in rows.columns:
        given = given.groupBy(*KEY).agg(F.max_by(F.struct(*(c for c in names if c not in KEY)), "sheet_row").alias("_r")).select(*KEY, "_r.*")
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in names}
    typed = text | {"status": F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("active")), "violation_count": F.coalesce(F.col("violation_count").try_cast("int"), F.lit(0))}
    return given.select(*(typed[c].alias(c) for c in names), F.array().cast("array<string>").alias("evidence_urls"))


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], schemas.OFFENDER)
