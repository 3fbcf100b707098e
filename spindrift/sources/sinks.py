"""Sinks: JSON payloads, guarded writes that report what they did with each row, and fan-out."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.values import is_retryable_status

#: Schema names of payloads; a deployment names its own.
WEBHOOK_SCHEMA, EMBED_SCHEMA = "notification.library_scanned.v1", "notification.embed.library_scanned.v1"


def webhook_payload(event: dict[str, Column], summary: Column, keys: Column) -> Column:
    """An event, its summary and the names of its payload's members."""
    return F.to_json(F.struct(F.lit(WEBHOOK_SCHEMA).alias("schema"), summary.alias("summary"), F.struct(*(c.alias(k) for k, c in event.items())).alias("event"), keys.alias("payload_keys")))


def embed_payload(event: dict[str, Column], summary: Column, keys: Column) -> Column:
    """The same event as one embed of named fields."""
    listed = F.when(F.size(keys) == 0, "none").otherwise(F.array_join(keys, ", "))
    rows = (("Event", event["event_kind"], True), ("Subject", F.concat_ws(" ", event["subject_kind"], event["subject_id"]), True), ("Attempt", event["attempt"].cast("string"), True), ("Occurred at", event["occurred_at"], False), ("Payload keys", listed, False))
    fields = F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(i).alias("inline")) for n, v, i in rows))
    embeds = F.array(F.struct(F.lit("Library scanned").alias("title"), fields.alias("fields")))
    return F.to_json(F.struct(F.lit(EMBED_SCHEMA).alias("schema"), summary.alias("content"), embeds.alias("embeds")))


def provenance(request_id: Column, title: Column, year: Column, language: Column, candidate: dict[str, Column], origin: str = "metadata") -> Column:
    """Where a written value comes from: the request, its query and the chosen candidate."""
    query = F.struct(title.alias("title"), year.alias("year"), language.alias("language"))
    return F.to_json(F.struct(F.lit(origin).alias("origin"), request_id.alias("request_id"), query.alias("query"), F.struct(*(c.alias(k) for k, c in candidate.items())).alias("selected_candidate")))


def response(query: dict[str, Column], execution: Column, candidates: Column) -> Column:
    """The answer to a query: the query, its sources' execution and its candidates."""
    return F.to_json(F.struct(F.struct(*(c.alias(k) for k, c in query.items())).alias("query"), execution.alias("provider_execution"), candidates.alias("candidates")))


def guarded(rows: DataFrame, target_valid: Column, allowed: Column, payload: Column) -> DataFrame:
    """Adds write_status (submitted, skipped or failed), its reason, and what would be written.

    In this order: the target is validated, the payload prepared, access checked.
    """
    status = F.when(~target_valid, "failed").when(payload.isNull(), "skipped").when(~allowed, "failed").otherwise("submitted")
    reason = F.when(~target_valid, "invalid_target").when(payload.isNull(), "no_candidates").when(~allowed, "permission_denied")
    marked = rows.withColumns({"write_status": status, "write_reason": reason})
    return marked.withColumn("submission", F.when(F.col("write_status") == "submitted", payload))


def write_submitted(rows: DataFrame, path: str) -> DataFrame:
    """Writes the submitted rows as Parquet, and counts all rows by status.

    For streams, call it in ``foreachBatch`` with a path for each batch.
    """
    rows.where("write_status = 'submitted'").write.mode("append").parquet(path)
    return rows.groupBy("write_status", "write_reason").count()


COMMITS = "epoch long, attempt string"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, attempt): which write of each epoch counts."""
    try:
        return spark.read.schema(COMMITS).option("recursiveFileLookup", True).parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def write_once(rows: DataFrame, path: str, epoch: int) -> bool:
    """Writes an epoch's submitted rows, unless that epoch is written already; says whether it did.

    The rows of an attempt go to a folder of their own; then one small file names the
    attempt that counts.  A run that ends between the two leaves rows that no commit
    names, and the epoch is written again; one that ends after it changes nothing
    when it is repeated.  For streams, call it in ``foreachBatch``.  One writer at a time.
    """
    spark = rows.sparkSession
    if not commits(spark, path).where(F.col("epoch") == epoch).isEmpty():
        return False
    attempt = uuid.uuid4().hex
    rows.where("write_status = 'submitted'").write.parquet(f"{path}/rows/epoch={epoch}/attempt={attempt}")
    commit(spark, path, epoch, attempt)
    return True


def commit(spark: SparkSession, path: str, epoch: int, attempt: str) -> None:
    spark.createDataFrame([(epoch, attempt)], COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/of={epoch}")


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all committed epochs, with epoch; schema: that of the rows.  Folders of other attempts are pruned by the join."""
    rows = spark.read.schema(f"{schema}, {COMMITS}").parquet(f"{path}/rows")
    return rows.join(commits(spark, path), ["epoch", "attempt"], "left_semi").drop("attempt")


def fan_out(sends: DataFrame, order: str = "ordinal") -> DataFrame:
    """What sending each event to its providers in order does: the first failure ends the event's sending.

    sends: event_id, ordinal, provider, http_status (what the provider answers; NULL: disabled).
    """
    failing = F.col("http_status").isNotNull() & ~F.col("http_status").between(200, 299)
    first = sends.where(failing).groupBy("event_id").agg(F.min(order).alias("failed_at"))
    joined = sends.join(first, "event_id", "left")
    before = F.col("failed_at").isNull() | (F.col(order) < F.col("failed_at"))
    status = F.when(F.col(order) > F.col("failed_at"), "not_sent").when(F.col("http_status").isNull(), "disabled").when(before, "sent").otherwise("failed")
    retryable = F.when(status == "failed", is_retryable_status(F.col("http_status")))
    return joined.withColumns({"provider_status": status, "retryable": retryable}).drop("failed_at")
