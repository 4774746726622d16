"""Structured Streaming jobs over landed files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from taxflow.functions import normalize as N
from taxflow.operators import merge
from taxflow.sources.versions import Versions
from taxflow.staging import staged

#: Company change events; every scalar is text until it is normalised.
EVENT_SCHEMA = "event_type string, organization_id string, id string, cnpj string, razao_social string, updated_at string, updatedAt string, deleted_at string, deletedAt string"
_START = "0001-01-01"


def typed_events(batch: DataFrame) -> DataFrame:
    """(organization_id, external_id, cnpj, razao_social, kind UPSERT/DELETE, deleted_at, at, seq) of change events.

    ``at`` is the time of the event: of a deletion the first of its four times, of an upsert the first of its two; ``seq`` is the place in the
    batch, which tells the order of events without a time, the last of all, and of equal times.
    """
    updated = F.coalesce(N.parse_datetime("updated_at"), N.parse_datetime("updatedAt"))
    gone = F.coalesce(N.parse_datetime("deleted_at"), N.parse_datetime("deletedAt"), updated)
    kind = F.when(F.lower("event_type").contains("delete"), "DELETE").otherwise("UPSERT")
    return batch.select(
        F.col("organization_id").try_cast("long").alias("organization_id"), N.trim_to_null("id").alias("external_id"), N.normalize_cnpj("cnpj").alias("cnpj"), N.trim_to_null("razao_social").alias("razao_social"),
        kind.alias("kind"), F.when(kind == "DELETE", gone).alias("deleted_at"), F.when(kind == "DELETE", gone).otherwise(updated).alias("at"), F.monotonically_increasing_id().alias("seq"),
    )


def resolve_identities(target: DataFrame, events: DataFrame) -> DataFrame:
    """Events (with ``order_``) and ``own_``, the cnpj of the company that each means at its time; null where there is none.

    A deletion means the company of its cnpj if that exists by then, in the table or through an earlier upsert of the batch; else the one
    that bears its external id by then.  One join on the cnpj and one on the id, which only meets the spans of time in which a company bore it.
    """
    keys = ["organization_id", "cnpj"]
    upserts = events.where("kind = 'UPSERT' AND cnpj IS NOT NULL")
    start = F.struct(F.lit(_START).cast("timestamp").alias("at"), F.lit(-1).cast("long").alias("seq"))
    names = target.select(*keys, "external_id", start.alias("since_")).unionByName(upserts.select(*keys, "external_id", F.col("order_").alias("since_")))
    in_order = Window.partitionBy(*keys).orderBy("since_")
    names = names.withColumn("external_id", F.last("external_id", ignorenulls=True).over(in_order)).withColumn("until_", F.lead("since_").over(in_order))
    born = names.groupBy(*keys).agg(F.min("since_").alias("born_"))
    deletions = events.where("kind = 'DELETE'").join(born.hint("merge"), keys, "left")
    hit = F.coalesce(F.col("born_") < F.col("order_"), F.lit(False))
    by_cnpj = deletions.where(hit).withColumn("own_", F.col("cnpj"))
    spans = names.where("external_id IS NOT NULL").select("organization_id", F.col("external_id").alias("id_"), F.col("cnpj").alias("named_"), "since_", "until_")
    rest = deletions.where(~hit).alias("d").join(
        spans.hint("merge").alias("n"),
        (F.col("d.organization_id") == F.col("n.organization_id")) & (F.col("d.external_id") == F.col("n.id_")) & (F.col("n.since_") < F.col("d.order_")) & (F.col("n.until_").isNull() | (F.col("d.order_") < F.col("n.until_"))),
        "left",
    )
    by_id = rest.groupBy(*[F.col(f"d.{c}").alias(c) for c in events.columns]).agg(F.min("n.named_").alias("own_"))
    columns = [*events.columns, "own_"]
    return events.where("kind = 'UPSERT'").withColumn("own_", F.col("cnpj")).select(*columns).unionByName(by_cnpj.select(*columns)).unionByName(by_id.select(*columns))


def apply_company_events(target: DataFrame, events: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(next, ops) of the registry for typed events, applied in the order of their times.

    ``target``: organization_id, cnpj, external_id, razao_social, active, deleted_at, sync_status, event_at.  Idempotent: an event that
    isn't newer than the row's ``event_at`` changes nothing.  One operation a company, that of its last event (CREATED, UPDATED, DELETED,
    ALREADY_DELETED; STALE if none is newer), one NOT_FOUND for each deletion that no company fits at its time, and one REJECTED for each
    upsert without a cnpj.  A company that is created and deleted in one batch is kept as deleted.
    """
    keys = ["organization_id", "cnpj"]
    order = F.struct(F.coalesce("at", F.lit("9999-12-31").cast("timestamp")).alias("at"), F.col("seq").alias("seq"))
    found = resolve_identities(target, events.withColumn("order_", order))
    lost = found.where("own_ IS NULL").select("organization_id", "cnpj", F.when(F.col("kind") == "DELETE", "NOT_FOUND").otherwise("REJECTED").alias("op"))
    old = target.select(*keys, "event_at", F.lit(True).alias("known_"))
    mine = found.where("own_ IS NOT NULL").withColumn("cnpj", F.col("own_")).join(old.hint("merge"), keys, "left")
    fresh = ~F.coalesce(F.col("event_at") >= F.col("at"), F.lit(False))
    upsert = fresh & (F.col("kind") == "UPSERT")
    last = lambda c, when: F.max_by(c, F.when(when, F.col("order_")))
    new = mine.groupBy(*keys).agg(
        last("kind", fresh).alias("kind"), last("at", fresh).alias("at"), last("deleted_at", fresh).alias("gone_at"), last("kind", fresh & (F.col("kind") == "UPSERT")).alias("upsert"),
        last("external_id", upsert & F.col("external_id").isNotNull()).alias("new_id"), last("razao_social", upsert & F.col("razao_social").isNotNull()).alias("new_name"), F.lit(True).alias("is_"),
    )
    both = target.withColumn("was_", F.lit(True)).join(new.hint("merge"), keys, "full_outer")
    is_, was, gone = F.col("is_").isNotNull(), F.col("was_").isNotNull(), F.col("kind") == "DELETE"
    done = ~F.col("active") & F.col("sync_status").eqNullSafe(F.lit(merge.DELETED)) & F.col("upsert").isNull()
    op = F.when(~is_, None).when(F.col("kind").isNull(), "STALE").when(gone & was & done, "ALREADY_DELETED").when(gone, "DELETED").when(~was, "CREATED").otherwise("UPDATED")
    both = both.withColumn("op", op)
    live = F.col("op").isin("CREATED", "UPDATED")
    out = F.col("op").isin("DELETED", "ALREADY_DELETED")
    after = both.select(
        *keys, F.coalesce("new_id", "external_id").alias("external_id"), F.coalesce("new_name", "razao_social").alias("razao_social"),
        F.when(live, True).when(out, False).otherwise(F.col("active")).alias("active"),
        F.when(out, F.coalesce("gone_at", now)).when(live, None).otherwise(F.col("deleted_at")).alias("deleted_at"),
        F.when(live, merge.SYNCED).when(out, merge.DELETED).otherwise(F.col("sync_status")).alias("sync_status"),
        F.when(live | out, F.coalesce("at", "event_at")).otherwise(F.col("event_at")).alias("event_at"),
    )
    return after, both.where("op IS NOT NULL").select(*keys, "op").unionByName(lost)


def start_company_stream(spark: SparkSession, in_dir: str, apply: Callable[[DataFrame, int], None], checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """Hand the typed events of each batch to ``apply(batch, batch_id)``; a batch may come twice, so it must be idempotent."""
    events = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(in_dir)
    return events.writeStream.foreachBatch(lambda df, i: apply(typed_events(df), i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_registry_stream(spark: SparkSession, in_dir: str, table_root: str, checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """Keep the versions of a registry (``Versions(spark, table_root)``, which the caller begins) from change events.

    Each batch reads the latest version and commits the next one under its own number, so a batch that is run again changes nothing.
    """
    versions = Versions(spark, table_root)

    def write(batch: DataFrame, batch_id: int) -> None:
        number, before = versions.latest()
        after, _ = apply_company_events(before, staged(batch, "company-events"), F.current_timestamp())
        versions.commit(after.select(*before.columns), number, f"batch {batch_id}")

    return start_company_stream(spark, in_dir, write, checkpoint, files_per_trigger)


def file_events(spark: SparkSession, in_dir: str) -> DataFrame:
    """A stream of (path, size, modified_at, sha256) of files that land."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(in_dir)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("sha256"))


def stale_runs(runs: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    return runs.where((F.col("status") == "RUNNING") & (F.col("started_at") < now - F.expr(f"interval {int(minutes)} minutes")))
