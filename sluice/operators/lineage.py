"""Lineage, retention, provenance, purges and expiry as DataFrame queries.

Tables: ``lineage_records`` and ``purge_events``, plain parquet, partitioned by route. Parquet has no delete, so a purge
returns the rows to keep (an anti join) and the evidence to append; ``rewrite`` puts them in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import values as V
from sluice.operators.envelope import compile_on

RECORDS = (
    "id string, route_name string, subject_id string, message_body string, message_headers string, metadata string, route_version string, contract_version string, "
    "principal string, retention_policy string, created_at timestamp, processed_at timestamp, expires_at timestamp"
)
PURGES = "id string, event_type string, subject_id string, purged_count bigint, reason string, purged_at timestamp, expires_at timestamp"
#: Days a record lives under the policy that always exists, and evidence of a purge.
DEFAULT_DAYS, EVIDENCE_DAYS = 30, 365
CSV_HEADER = ("id", "route_name", "subject_id", "route_version", "contract_version", "retention_policy", "created_at", "processed_at", "expires_at")


def resolve_retention(df: DataFrame, policies: dict[str, int], expr: str | None = None, static: str | None = None) -> Column:
    """Policy name: by expression, else static, else default; an unknown name is the default. ``policies``: days by name."""
    name = F.lit(static).cast("string")
    if expr:
        v = compile_on(df, expr)
        if not v.missing:
            name = F.coalesce(V.text(v), name)
    known = name.isin(list(policies)) if policies else F.lit(False)
    return F.when(F.coalesce(known, F.lit(False)), name).otherwise("default")


def retention_days(policy: Column, policies: dict[str, int]) -> Column:
    out = F.lit(policies.get("default", DEFAULT_DAYS))
    for name, days in policies.items():
        out = F.when(policy == name, F.lit(days)).otherwise(out)
    return out


def extract_subject(df: DataFrame, expr: str) -> tuple[Column, Column]:
    """(subject id, error): a string or null; other types are an error."""
    v = compile_on(df, expr)
    if v.string:
        return v.col, F.lit(None).cast("string")
    if v.missing:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    if v.variant:
        kind = F.schema_of_variant(v.col)
        return F.when(kind == "STRING", V.text(v)), F.when(v.col.isNotNull() & ~kind.isin("STRING", "VOID"), F.lit("subject id is not a string"))
    return F.lit(None).cast("string"), F.when(v.col.isNotNull(), F.lit("subject id is not a string"))


def lineage_rows(df: DataFrame, policies: dict[str, int] | None = None, retention_expr: str | None = None, retention: str | None = None, subject_expr: str | None = None, processed_at: Column | None = None) -> DataFrame:
    """A lineage record of each message. Its id hashes route, correlation id and body, so a repeated run makes the same
    ids; the resolver's policy sets the expiry."""
    policies = policies or {}
    policy = resolve_retention(df, policies, retention_expr, retention)
    subject = extract_subject(df, subject_expr)[0] if subject_expr else F.lit(None).cast("string")
    m = F.col("metadata")
    body = F.to_json("body") if not df.schema["body"].dataType.simpleString() == "string" else F.col("body")
    when = F.col("metadata.ingested_at")
    return df.select(
        F.sha2(F.concat_ws("|", m["route"], m["correlation_id"], body).cast("binary"), 256).alias("id"),
        m["route"].alias("route_name"),
        F.coalesce(subject, F.lit("")).alias("subject_id"),
        body.alias("message_body"),
        F.to_json("headers").alias("message_headers"),
        F.to_json("metadata").alias("metadata"),
        m["route_version"].alias("route_version"),
        m["contract_version"].alias("contract_version"),
        F.to_json(m["principal"]).alias("principal"),
        policy.alias("retention_policy"),
        when.alias("created_at"),
        (when if processed_at is None else processed_at).alias("processed_at"),
        F.timestamp_add("DAY", retention_days(policy, policies), when).alias("expires_at"),
    )


def by_subject(records: DataFrame, subject: str, limit: int | None = None) -> DataFrame:
    """All of a subject's records, oldest first; with a limit the newest ones, newest first."""
    out = records.where(F.col("subject_id") == subject)
    return out.orderBy("created_at", "id") if limit is None else out.orderBy(F.desc("created_at"), "id").limit(limit)


def by_route(records: DataFrame, route: str, since=None, until=None, limit: int | None = None) -> DataFrame:
    out = records.where(F.col("route_name") == route)
    out = out if since is None else out.where(F.col("created_at") >= F.lit(since))
    out = out if until is None else out.where(F.col("created_at") <= F.lit(until))
    return out.orderBy("created_at", "id") if limit is None else out.orderBy(F.desc("created_at"), "id").limit(limit)


def in_range(records: DataFrame, since, until) -> DataFrame:
    return records.where(F.col("created_at").between(F.lit(since), F.lit(until))).orderBy("created_at", "id")


def count_by_subject(records: DataFrame) -> DataFrame:
    return records.groupBy("subject_id").agg(F.count("*").alias("records"))


def provenance(records: DataFrame, ids: DataFrame) -> DataFrame:
    """All records of the subjects that messages ``ids`` (id) belong to, with ``origin``: the message asked for."""
    asked = ids.select(F.col("id").alias("origin")).distinct()
    subjects = records.select("id", "subject_id").join(asked, F.col("id") == F.col("origin")).where("subject_id <> ''").select("origin", "subject_id").distinct()
    return records.join(subjects, "subject_id")


def expired(records: DataFrame, until) -> DataFrame:
    return records.where(F.col("expires_at") <= F.lit(until)).orderBy("expires_at", "id")


def purge(records: DataFrame, subjects: DataFrame, reason: str, purged_at, event_type: str = "purge") -> tuple[DataFrame, DataFrame]:
    """(records to keep, evidence) of purging ``subjects`` (subject_id)."""
    s = subjects.select("subject_id").where("subject_id <> ''").distinct()
    keep = records.join(s, "subject_id", "left_anti").select(records.columns)
    gone = records.join(s, "subject_id", "left_semi").groupBy("subject_id").agg(F.count("*").alias("purged_count"))
    at = F.lit(purged_at).cast("timestamp")
    events = gone.select(
        F.sha2(F.concat_ws("|", F.lit(event_type), "subject_id", at.cast("string")).cast("binary"), 256).alias("id"),
        F.lit(event_type).alias("event_type"),
        "subject_id",
        "purged_count",
        F.lit(reason).alias("reason"),
        at.alias("purged_at"),
        F.timestamp_add("DAY", F.lit(EVIDENCE_DAYS), at).alias("expires_at"),
    )
    return keep, events


def reap(records: DataFrame, now, whole_subjects: bool = True) -> tuple[DataFrame, DataFrame]:
    """(records to keep, evidence): all rows of each subject that has an expired row, as the reaper does; with
    ``whole_subjects=False`` the expired rows alone. Rows without a subject are never reaped."""
    due = records.where((F.col("expires_at") <= F.lit(now)) & (F.col("subject_id") != ""))
    if whole_subjects:
        return purge(records, due.select("subject_id"), "retention expired", now, "retention")
    keep = records.where(~((F.col("expires_at") <= F.lit(now)) & (F.col("subject_id") != "")))
    _, events = purge(due, due.select("subject_id"), "retention expired", now, "retention")
    return keep, events


def expiring_evidence(events: DataFrame, now, lead_days: int) -> DataFrame:
    """Purge evidence that expires within the lead time."""
    return events.where(F.col("expires_at").between(F.lit(now), F.timestamp_add("DAY", F.lit(lead_days), F.lit(now)))).orderBy("expires_at", "id")


def purge_events_in(events: DataFrame, since, until) -> DataFrame:
    return events.where(F.col("purged_at").between(F.lit(since), F.lit(until))).orderBy("purged_at", "id")


def export_csv(records: DataFrame, since, until) -> DataFrame:
    """The CSV export's columns as text, times in RFC 3339."""
    t = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    return in_range(records, since, until).select(*(t(c) if c.endswith("_at") else F.coalesce(c, F.lit("")).alias(c) for c in CSV_HEADER))


def export_ndjson(records: DataFrame, since, until) -> DataFrame:
    """(value): a whole record a line as JSON, all columns, times in RFC 3339; nulls are left out."""
    t = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return in_range(records, since, until).select(F.to_json(F.struct(*(t(c) if c.endswith("_at") else F.col(c) for c in names))).alias("value"))


def rewrite(df: DataFrame, path: str) -> None:
    """Writes a table beside its old version and swaps the folders, so that a failed write loses nothing."""
    spark = df.sparkSession
    new = f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").parquet(new)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.old")
    fs.delete(old, True)
    if fs.exists(p):
        fs.rename(p, old)
    fs.rename(jvm.org.apache.hadoop.fs.Path(new), p)
    fs.delete(old, True)


def openlineage_events(df: DataFrame, namespace: str, contract_fields: list[dict] | None = None, event_time: Column | None = None) -> DataFrame:
    """An OpenLineage run event of each message, as JSON."""
    m = F.col("metadata")
    facet = F.array(*(F.struct(F.lit(f["name"]).alias("name"), F.lit(f["type"]).alias("type"), F.lit(f["nullable"]).alias("nullable")) for f in contract_fields or ())) if contract_fields else F.lit(None).cast("array<struct<name:string,type:string,nullable:boolean>>")
    when = F.date_format(m["ingested_at"] if event_time is None else event_time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    event = F.struct(
        F.lit("COMPLETE").alias("eventType"),
        when.alias("eventTime"),
        F.struct(m["correlation_id"].alias("runId")).alias("run"),
        F.struct(F.lit(namespace).alias("namespace"), m["route"].alias("name")).alias("job"),
        F.struct(m["route_version"].alias("routeVersion"), m["contract_version"].alias("contractVersion"), facet.alias("fields")).alias("facets"),
    )
    return df.select(F.to_json(event).alias("event"))
