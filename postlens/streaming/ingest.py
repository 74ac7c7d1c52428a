"""K1-K3: the periodic ingest as a Structured Streaming query.

Every micro-batch runs ``ingest_batch``: fingerprint gate -> validation ->
clean -> label -> append new posts -> append new topics -> commit the
fingerprint.  Each append is an anti-join against the store, so replaying a
batch after a failure (or a lost executor) adds nothing twice; the
fingerprint is written last, so a failed batch is retried, not skipped.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlens.operators import ingest, quality, topics
from postlens.schemas import POST_COLUMNS, STORED_COLUMNS, TOPICS
from postlens.session import scratch, settings
from postlens.sources import store
from postlens.sources.work import work_table


# Keyed state beside the memory of the executors.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class BatchRejected(RuntimeError):
    """Raised in ``on_fail='stop'`` mode when a batch fails validation."""


@dataclass
class IngestConfig:
    posts_path: str
    topics_path: str
    state_path: str
    rules: DataFrame
    source: str = "posts"
    on_fail: str = "report"          # 'report' keeps going, 'stop' raises
    as_of: dt.datetime | None = None
    model: topics.ModelFn | None = None   # instead of the rule table; then both paths below are needed
    answers_path: str | None = None       # answers by what was shown: a replay asks nothing twice
    quarantine_path: str | None = None    # answers that hold no usable JSON, a folder per batch
    log: list = field(default_factory=list)


def ingest_batch(spark: SparkSession, batch: DataFrame, batch_id: int, cfg: IngestConfig) -> dict:
    """K2 for one batch; returns a small report dict (no data rows).

    The batch is read several times, mostly a few columns of it: it is written once, compressed, as a work table.
    """
    batch = work_table(batch.select(*POST_COLUMNS), "micro-batch")
    changed, fp = ingest.batch_changed(spark, batch, cfg.state_path, cfg.source)
    report = {"batch_id": batch_id, "changed": changed, "n": int(fp["n"])}
    if not changed:
        cfg.log.append(report)
        return report
    as_of = cfg.as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    checks = quality.quality_report(batch, "incremental").collect()
    bad_rows = quality.row_violations(batch, as_of).limit(1).count()
    valid = bad_rows == 0 and all(r["passed"] for r in checks)
    report["valid"] = valid
    if not valid and cfg.on_fail == "stop":
        raise BatchRejected(f"batch {batch_id} failed validation: {[r.asDict() for r in checks]}")
    # Cleaned once (a work table): both appends and the labeller read it.
    cleaned = topics.stored_clean(batch)
    report["posts_added"] = ingest.append_new(spark, cleaned.select(*STORED_COLUMNS), cfg.posts_path,
                                              ingest.POST_KEYS)
    labelled, report["rejected"] = _labelled(batch, cleaned, batch_id, cfg)
    labelled = labelled.select(*[f.name for f in TOPICS.fields])
    report["topics_added"] = ingest.append_new(spark, labelled, cfg.topics_path, ingest.TOPIC_KEYS, TOPICS)
    ingest.commit_fingerprint(spark, cfg.state_path, cfg.source, batch_id, fp)
    cfg.log.append(report)
    return report


def _labelled(batch: DataFrame, cleaned: DataFrame, batch_id: int, cfg: IngestConfig) -> tuple[DataFrame, int]:
    """Topics of a batch by the rules or by the model, and how many answers were set aside."""
    if cfg.model is None:
        return topics.topics_direct(batch, cfg.rules, clean=cleaned), 0
    batched = work_table(topics.batch_posts(cleaned), "batched")
    faq, rejected = topics.answered(batched, cfg.model, cfg.answers_path)
    aside = f"{cfg.quarantine_path}/_batch={int(batch_id)}"  # the batch's own: a replay replaces it
    rejected.write.mode("overwrite").parquet(aside)
    return topics.enrich(faq, batched), batch.sparkSession.read.schema(rejected.schema).parquet(aside).count()


def start_ingest(spark: SparkSession, posts_stream: DataFrame, cfg: IngestConfig, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """K1: run ``ingest_batch`` per micro-batch; default trigger every 15 minutes."""
    trigger = trigger or {"processingTime": "15 minutes"}

    def fn(df: DataFrame, epoch_id: int) -> None:
        with scratch(spark, "ingest"):
            ingest_batch(spark, df, epoch_id, cfg)

    return (posts_stream.writeStream.foreachBatch(fn)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def dedup_batch(spark: SparkSession, batch: DataFrame, batch_id: int, path: str, keys: list[str]) -> None:
    """K3 without a stream (a backfill, batch by batch): its rows whose ``keys`` (nulls equal) no earlier batch stored, each once.

    Exact for rows of any age and order.  The batch owns the folder ``_batch=<id>``:
    a replay compares with the other batches only and replaces its own rows.
    """
    digest = ingest.row_digest(keys)
    fresh = batch.dropDuplicates(keys).withColumn("_digest", digest)
    if store.store_exists(spark, path):
        known = spark.read.parquet(path).filter(f"_batch <> {int(batch_id)}").select("_digest").distinct()
        fresh = fresh.join(known, "_digest", "left_anti")
    work_table(fresh, "fresh").write.mode("overwrite").parquet(f"{path}/_batch={int(batch_id)}")


def start_dedup(spark: SparkSession, posts_stream: DataFrame, path: str, keys: list[str], checkpoint: str,
                trigger: dict | None = None) -> StreamingQuery:
    """K3: repeat removal against everything ever seen, row by row.

    The digests seen are a keyed state (RocksDB, on the executors' disks, its changes
    saved with the checkpoint): a micro-batch looks up its own digests only, whatever
    came before, and reads nothing that was written.  There is no watermark, so
    a repeat is found however old it is.  State and output commit with the batch, so
    a replay neither adds nor loses rows.
    """
    fresh = posts_stream.withColumn("_digest", F.unhex(ingest.row_digest(keys))).dropDuplicates(["_digest"]).drop("_digest")
    with settings(spark, **STATE):
        return (fresh.writeStream.format("parquet").option("path", path).option("compression", "zstd").option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(**(trigger or {"processingTime": "15 minutes"})).start())
