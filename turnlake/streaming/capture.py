"""Live capture (X1) with replay-safe ingest.

Turn events ``(event_id, session_id, role, text, ts, line[, cwd])`` arrive as files (or any
streaming source).  Each micro-batch is turned into records with the same column functions
as batch ingest (envelopes, tags, validation) and appended by ``foreachBatch``:

* user prompts lose their context tags; those left empty are dropped, as the prompt hook does;
* an event without an id gets one made from its fields;
* within the batch, repeats of an id are dropped (earliest time, then lowest line, then text kept);
* ids stored before are skipped, so re-running a batch after a failure, or replaying input files, stores every id
  once (no late-data rule can drop a new record).  They are looked up in an id index beside the sink, laid out by a
  hash of the id and sorted: a batch reads the parts that its own ids fall into, never the sink;
* the index is appended after the sink, in the same batch.  An empty file named by the batch is there from its
  beginning to its end; where one is left, the index is first repaired from the sink's rows of that batch on
  (``seq`` holds the batch, so older files are skipped by their statistics).  A sink without an index gets one from
  all its rows;
* ``seq`` = batch id * 2^32 + position in the batch ordered by (ts, line), so insertion order
  is stable under retries;
* rejected rows (S11) go to a side table with their reason.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import ASSISTANT_EVENT, USER_EVENT, envelope
from ..functions.text import strip_context
from ..schema import RECORD_COLUMNS
from ..session import checkpointed
from ..sources.records import uuid_like, with_seq
from ..sources.validate import with_reject_reason

ID_PARTS = 16  # of the id index
BROADCAST_BATCH_IDS = 2_000_000  # ids of one micro-batch broadcast for the replay check

TURN_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ts", T.LongType()),  # Unix seconds
        T.StructField("line", T.LongType()),  # order inside the session
        T.StructField("cwd", T.StringType()),
    ]
)


def events_to_records(events: DataFrame) -> DataFrame:
    """Turn events -> record columns (without ``seq``): user turns as prompt envelopes without context tags,
    none for a prompt that has nothing else, assistant turns as Stop envelopes (tag ``response``),
    anything else as a plain note.  Events without an id get a uuid of their fields."""
    role = F.col("role")
    events = events.withColumn("_p", strip_context(F.coalesce("text", F.lit(""))))
    events = events.where((role != "user") | role.isNull() | (F.length("_p") > 0))
    made = uuid_like(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("session_id", "role", "text", "ts", "line")],
                     salt="event")
    text = (
        F.when(role == "user", envelope(USER_EVENT, F.col("_p"), F.col("session_id"), F.col("cwd")))
        .when(role == "assistant", envelope(ASSISTANT_EVENT, F.col("text"), F.col("session_id"), F.col("cwd")))
        .otherwise(F.col("text"))
    )
    tags = (
        F.when(role == "user", F.array(F.lit("prompt"), F.lit("capture")))
        .when(role == "assistant", F.array(F.lit("response"), F.lit("capture")))
        .otherwise(F.array(F.lit("note")))
    )
    return events.select(
        F.lit("").alias("ns"), F.coalesce("event_id", made).alias("id"), text.alias("text"),
        F.lit(None).cast("array<float>").alias("vector"), F.col("ts").cast("bigint").alias("timestamp"),
        tags.alias("tags"), F.col("line"),
    )


def _existing_ids(spark: SparkSession, sink: str) -> DataFrame | None:
    """Ids stored so far with their batch; None where there is no table yet.  Any other read error is raised: taking it
    for an empty table would store the batch twice."""
    try:
        return spark.read.parquet(sink).select("id", "seq")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def id_part(col: str = "id"):
    """The part of the id index that an id is in."""
    return F.pmod(F.xxhash64(col), F.lit(ID_PARTS)).cast("int")


class IdIndex:
    """The ids of a sink, by part, with the marks of batches begun (see the module's text)."""

    def __init__(self, spark: SparkSession, sink: str):
        self.spark, self.sink, self.path = spark, sink, f"{sink.rstrip('/')}-ids"
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _begun(self) -> list[int]:
        """Batches that were begun and not ended."""
        folder = self._at("_begun")
        found = self._fs.listStatus(folder) if self._fs.exists(folder) else []
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def begin(self, batch_id: int) -> None:
        """Before a batch is looked up: the index holds all that the sink holds."""
        cut_off, ready = self._begun(), self._fs.exists(self._at("_ready"))
        if cut_off or not ready:
            stored = _existing_ids(self.spark, self.sink)
            if stored is not None:
                self.append(stored.where(F.col("seq") >= (cut_off[0] << 32)) if ready else stored)
        self._fs.create(self._at(f"_begun/{int(batch_id)}"), True).close()

    def end(self) -> None:
        """After a batch's rows and ids are written."""
        self._fs.create(self._at("_ready"), True).close()
        for batch in self._begun():
            self._fs.delete(self._at(f"_begun/{batch}"), False)

    def append(self, ids: DataFrame) -> None:
        rows = ids.select("id", id_part().alias("part"))
        rows.repartition("part").sortWithinPartitions("part", "id").write.mode("append").partitionBy("part").parquet(f"{self.path}/ids")

    def read(self, parts: list[int]) -> DataFrame:
        """The stored ids of some parts."""
        if not self._fs.exists(self._at("ids")):
            return self.spark.createDataFrame([], "id string, part int")
        return self.spark.read.schema("id string, part int").parquet(f"{self.path}/ids").where(F.col("part").isin(parts))


def write_batch(batch: DataFrame, batch_id: int, sink: str, rejects: str | None = None) -> None:
    """The ``foreachBatch`` body (also usable on a static frame)."""
    spark = batch.sparkSession
    recs = events_to_records(batch)
    checked = with_reject_reason(recs)
    if rejects:
        bad = checked.where(F.col("reject_reason").isNotNull())
        # a folder for each batch: a batch that is run again replaces its own rejects
        bad.drop("line").write.mode("overwrite").parquet(f"{rejects}/batch={int(batch_id)}")
    good = checked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    first = Window.partitionBy("id").orderBy("timestamp", "line", "text")
    good = good.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").persist()
    held = good
    index = IdIndex(spark, sink)
    index.begin(int(batch_id))
    counts = {r["part"]: r["n"] for r in good.groupBy(id_part().alias("part")).agg(F.count("*").alias("n")).collect()}
    if counts:  # ID_PARTS numbers at most
        existing = index.read(sorted(counts)).select("id")
        if sum(counts.values()) <= BROADCAST_BATCH_IDS:
            # the index is only scanned, never shuffled: ids of this micro-batch are
            # broadcast (size checked above), the few already stored come back, then leave
            seen = existing.join(F.broadcast(good.select("id")), "id", "left_semi")
            good = good.join(seen, "id", "left_anti")  # tiny: AQE broadcasts it at run time
        else:  # a very large micro-batch: plain shuffled anti join
            good = good.join(existing, "id", "left_anti")
    try:
        if counts:
            ordered = checkpointed(good.orderBy("timestamp", "line"))  # one partitioning for both jobs of the numbering
            numbered = with_seq(ordered, F.lit(int(batch_id)) * F.lit(1 << 32))
            numbered.select(*RECORD_COLUMNS).write.mode("append").parquet(sink)
            # the whole batch: ids stored before are there twice then, which no lookup minds
            index.append(held.select("id"))
        index.end()
    finally:
        held.unpersist()


def capture_stream(events: DataFrame, sink: str, checkpoint: str, rejects: str | None = None, trigger: dict | None = None):
    """Start X1/X2 on a streaming frame of turn events; returns the StreamingQuery."""
    w = events.writeStream.foreachBatch(lambda df, bid: write_batch(df, bid, sink, rejects)).option(
        "checkpointLocation", checkpoint
    )
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
