"""Incremental runs of the batch operators.

Tables that later batches ask again are partitioned by what they are asked for (a tenant's day, a day, a bucket of
codes) and, within that, by the number of the batch that wrote. A batch reads the folders that its own rows touch and no
others, so that its input doesn't grow with the history; running it again replaces what it wrote.

- `ticket_stream`, `answered_stream`: new tickets become outcomes (`tickets`) and unreadable receipts (`quarantine`).
  With answers as a second source, tickets that need one wait (`waiting`) and are decided when it comes; answers may
  come before, with or after their ticket (`answers`).
- `items_stream`: a query of its own that follows the outcomes and keeps the item table as they stand now. If items can't
  be written, outcomes go on, and a later run makes up for it.
- `dedup_stream`, `claims_stream`: the first writer wins over all time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillstream.operators import decision, reads
from tillstream.operators.ingest import KEY, current_state, first_of_each, with_payload
from tillstream.sources.shared import MOST_SENT, exists, folder, remove

OUTCOME = "tenant_id string, captured_at string, ticket_id string, port string, status string, parsed_by string, reason string, " + f"candidate {decision.CANDIDATE}, version bigint"
TICKET = "tenant_id string, captured_at string, ticket_id string, port string, raw_text string"
ANSWER = "tenant_id string, captured_at string, ticket_id string, response_text string"
FOLDERS = ("tenant", "year", "month", "day")
#: Folders that are asked for one by one; more are found by a join that prunes the scan.
MOST_FOLDERS = 1000
#: Buckets of codes that were given away.
BUCKETS = 256


def run_available(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Works through all that is there now, batch by batch, and ends."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def source(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _schema(spark: SparkSession, columns: StructType | str, folders: tuple[str, ...]) -> StructType:
    out = StructType([*spark.createDataFrame([], columns).schema.fields])
    for c in folders:
        out = out.add(c, "string")
    return out.add("batch", "long")


def write_batch(rows: DataFrame, n: int, path: str, folders: tuple[str, ...]) -> None:
    """The rows of a batch, into its own folder within each of theirs."""
    rows = rows.withColumn("batch", F.lit(n).cast("long")).repartition(*folders)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders, "batch").parquet(path)


def read_table(spark: SparkSession, path: str, columns: StructType | str, folders: tuple[str, ...]) -> DataFrame:
    """All that batches wrote, with folders and batch; no table yet is an empty one."""
    schema = _schema(spark, columns, folders)
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def history(spark: SparkSession, path: str, columns: StructType | str, folders: tuple[str, ...], touched: DataFrame, before: int | None = None) -> DataFrame:
    """What the touched folders (rows of their names, distinct) hold, of batches before one if it is given. Up to
    MOST_FOLDERS are listed and read by name; of more, the scan is pruned by a join."""
    schema = _schema(spark, columns, folders)
    few = touched.select(*folders).limit(MOST_FOLDERS + 1).collect()
    if len(few) <= MOST_FOLDERS:
        there = [p for p in (f"{path}/{folder(spark, folders, tuple(r))}" for r in few) if exists(spark, p)]
        rows = spark.read.schema(schema).option("basePath", path).parquet(*there) if there else spark.createDataFrame([], schema)
    else:
        keys = touched.select(*folders).where(F.coalesce(F.col(folders[0]), F.lit("")) >= "")  # a filter lets the scan be pruned
        rows = read_table(spark, path, columns, folders).join(F.broadcast(keys) if keys.count() <= MOST_SENT else keys, list(folders), "left_semi")
    return rows if before is None else rows.where(F.col("batch") < before)


def current_tickets(spark: SparkSession, out: str, folders: tuple[str, ...], paths: list[str]) -> DataFrame:
    """The current state of the tickets in some folders of the outcomes."""
    schema = _schema(spark, OUTCOME, folders)
    rows = spark.read.schema(schema).option("basePath", f"{out}/tickets").parquet(*paths) if paths else spark.createDataFrame([], schema)
    return current_state(rows.drop(*folders, "batch"))


def ticket_page(spark: SparkSession, out: str, tenant: str, limit: object = None, status: str | None = None, after: tuple[str, str] | None = None, folders: tuple[str, ...] = FOLDERS) -> DataFrame:
    """A page of the outcomes, newest first, that reads few of a tenant's folders."""
    return reads.page_walk(spark, f"{out}/tickets", lambda paths: current_tickets(spark, out, folders, paths), tenant, limit, status, after, folders[1:])


def transform_stream(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Applies a batch operator to each micro-batch."""
    run_available(stream, lambda rows, n: step(rows).write.mode("overwrite").parquet(f"{out}/batch={n}"), checkpoint)


def dedup_stream(stream: DataFrame, out: str, checkpoint: str) -> None:
    """First writer wins over all time: exact, against the keys that earlier batches accepted on the days of this one.
    What is written are keys and arrival, in folders by day and batch."""
    run_available(stream, lambda rows, n: dedup_batch(rows, n, out), checkpoint)


def dedup_batch(rows: DataFrame, n: int, out: str) -> None:
    rows = rows.select(*KEY, "arrival_seq", F.substring("captured_at", 1, 10).alias("day"))
    columns = StructType([f for f in rows.schema.fields if f.name != "day"])
    seen = history(rows.sparkSession, out, columns, ("day",), rows.select("day").distinct(), n)
    new = first_of_each(rows, seen).withColumn("day", F.substring("captured_at", 1, 10))
    write_batch(new, n, out, ("day",))


def claims_stream(stream: DataFrame, codes: DataFrame, out: str, checkpoint: str) -> None:
    """Activation claims, first wins: a code that an earlier batch gave away is no longer free. Outcomes are in `outcomes`,
    by batch; codes given away in `won`, by bucket."""
    run_available(stream, lambda rows, n: claims_batch(rows, n, codes, out), checkpoint)


def claims_batch(rows: DataFrame, n: int, codes: DataFrame, out: str) -> None:
    bucket = F.pmod(F.xxhash64("code"), F.lit(BUCKETS)).cast("string").alias("bucket")
    asked = rows.select("code", bucket).distinct()
    gone = history(rows.sparkSession, f"{out}/won", "code string", ("bucket",), asked.select("bucket").distinct(), n).select("code")
    free = codes.join(asked.select("code"), "code", "left_semi").join(gone, "code", "left_anti")
    reads.claims(rows, free).write.mode("overwrite").parquet(f"{out}/outcomes/batch={n}")
    own = rows.sparkSession.read.parquet(f"{out}/outcomes/batch={n}")
    write_batch(own.where("outcome = 'won'").select("code", bucket), n, f"{out}/won", ("bucket",))


def pending(events: DataFrame) -> DataFrame:
    """New tickets of the change log that wait to be parsed; other changes, also those that parsing itself makes, are none."""
    return events.where("event = 'INSERT' and status = 'pending'")


def ticket_stream(stream: DataFrame, tenants: DataFrame, answers: DataFrame | None, out: str, checkpoint: str, folders: tuple[str, ...] = FOLDERS) -> None:
    """New tickets become outcomes; answers are a table that is there in full, or None."""
    run_available(stream, lambda rows, n: ticket_batch(rows, n, tenants, answers, out, folders), checkpoint)


def ticket_batch(events: DataFrame, n: int, tenants: DataFrame, answers: DataFrame | None, out: str, folders: tuple[str, ...] = FOLDERS) -> None:
    _write_outcomes(decision.decide(pending(events), tenants, answers), n, out, folders)


def _foldered(rows: DataFrame, folders: tuple[str, ...]) -> DataFrame:
    kept = [c for c in rows.columns if c not in FOLDERS]
    return decision.foldered(rows.select(*kept)).select(*kept, *folders)


def _write_outcomes(decided: DataFrame, n: int, out: str, folders: tuple[str, ...], then: Callable[[DataFrame], None] | None = None, parsers: str = decision.VERSION) -> None:
    """Outcomes of a batch, and its unreadable receipts with the version of the parsers that could not read them: each row of
    `quarantine` is an attempt."""
    decided = _foldered(decided.withColumn("version", F.lit(n).cast("long")), folders).persist()
    try:
        write_batch(decided, n, f"{out}/tickets", folders)
        decision.quarantine(decided).withColumn("parsers", F.lit(parsers)).write.mode("overwrite").parquet(f"{out}/quarantine/batch={n}")
        if then is not None:
            then(decided)
    finally:
        decided.unpersist()


def answered_stream(tickets: DataFrame, answers: DataFrame, tenants: DataFrame, out: str, checkpoint: str, folders: tuple[str, ...] = FOLDERS) -> None:
    """New tickets (a change log) and a model's answers from two sources; each trigger takes what either has."""
    both = tickets.withColumn("kind", F.lit("ticket")).unionByName(answers.withColumn("kind", F.lit("answer")), allowMissingColumns=True)
    run_available(both, lambda rows, n: answered_batch(rows, n, tenants, out, folders), checkpoint)


def answered_batch(rows: DataFrame, n: int, tenants: DataFrame, out: str, folders: tuple[str, ...] = FOLDERS) -> None:
    """Decides the new tickets, and those that wait for one of the new answers. A ticket's first answer counts (of several in one
    batch the least); one that is not waited for changes nothing."""
    spark = rows.sparkSession
    new = _foldered(pending(rows.where("kind = 'ticket'")).select(*KEY, "port", "raw_text"), folders)
    said = _foldered(rows.where("kind = 'answer'").select(*KEY, "response_text"), folders)
    write_batch(said, n, f"{out}/answers", folders)
    of_new, of_said = (x.select(*folders).distinct() for x in (new, said))
    before = lambda table, columns, touched: history(spark, f"{out}/{table}", columns, folders, touched, n)
    # the tickets that waited when the batch began and that got an answer now
    state = current_state(before("tickets", OUTCOME, of_said).drop(*folders, "batch"), "status")
    text = before("waiting", TICKET, of_said).join(said.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.max_by(F.struct("port", "raw_text"), "batch").alias("t")).select(*KEY, "t.*")
    waited = text.join(state.where("status = 'pending'").select(*KEY), KEY, "left_semi").join(new.select(*KEY), KEY, "left_anti")
    early = before("answers", ANSWER, of_new).select(*KEY, "response_text", "batch")
    answers = early.unionByName(said.select(*KEY, "response_text", F.lit(n).cast("long").alias("batch")))
    first = answers.groupBy(*KEY).agg(F.min(F.struct("batch", "response_text"))["response_text"].alias("response_text"))
    todo = new.select(*KEY, "port", "raw_text").unionByName(waited)

    def wait(decided: DataFrame) -> None:
        mine = decided.where("status = 'pending'").select(*KEY, *folders).distinct()
        write_batch(new.select(*KEY, "port", "raw_text").join(mine, KEY), n, f"{out}/waiting", folders)

    _write_outcomes(decision.decide(todo, tenants, first), n, out, folders, wait)


def requeue(spark: SparkSession, n: int, tenants: DataFrame, payloads: DataFrame, out: str, folders: tuple[str, ...] = FOLDERS, parsers: dict | None = None, version: str = decision.VERSION, most: int = 5) -> None:
    """Takes quarantined receipts up again, as batch n, with parsers of another version: those that are still quarantined, that this
    version has not tried, and that have had fewer attempts than `most`. Their texts come from the raw table (payloads)."""
    ledger = attempts(spark, out, n).where((F.col("attempts") < most) & ~F.array_contains("tried", version))
    open_ = _foldered(ledger.select(*KEY), folders).persist()
    try:
        if open_.isEmpty():  # the batch has no rows, for which no text need be moved
            return _write_outcomes(spark.createDataFrame([], OUTCOME).drop("version"), n, out, folders, parsers=version)
        state = current_state(history(spark, f"{out}/tickets", OUTCOME, folders, open_.select(*folders).distinct(), n).drop(*folders, "batch"), "status", "port")
        again = state.where("status = 'quarantined'").select(*KEY, "port").join(open_.select(*KEY), KEY, "left_semi")
        _write_outcomes(decision.decide(with_payload(again, payloads), tenants, None, parsers), n, out, folders, parsers=version)
    finally:
        open_.unpersist()


def attempts(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """Keys that were ever quarantined: how many attempts failed, and the versions of the parsers that made them."""
    schema = _schema(spark, "tenant_id string, captured_at string, ticket_id string, reason string, parsers string", ())
    rows = spark.read.schema(schema).parquet(f"{out}/quarantine") if exists(spark, f"{out}/quarantine") else spark.createDataFrame([], schema)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy(*KEY).agg(F.count("*").alias("attempts"), F.collect_set("parsers").alias("tried"))


def items_stream(spark: SparkSession, out: str, items: str | None, checkpoint: str, folders: tuple[str, ...] = FOLDERS, files_per_batch: int = 10_000) -> None:
    """Keeps the item table in step with the outcomes in out. Without a place for items, or outcomes, there is nothing to do."""
    if items is None or not exists(spark, f"{out}/tickets"):
        return
    schema = _schema(spark, OUTCOME, folders)
    # a batch of tickets that ran again has other files under the same names of folders
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("ignoreMissingFiles", "true").parquet(f"{out}/tickets")
    run_available(new, lambda rows, n: items_batch(rows.select(*folders).distinct(), out, items, folders), checkpoint)


def items_batch(touched: DataFrame, out: str, items: str, folders: tuple[str, ...] = FOLDERS) -> None:
    """Writes the items of the touched folders anew from the current state of their tickets; those that have none any
    more go. Running it again changes nothing, and an item table that is lost can be made from the outcomes."""
    spark, touched = touched.sparkSession, touched.persist()  # few rows of many files, asked for twice
    state = current_state(history(spark, f"{out}/tickets", OUTCOME, folders, touched).drop(*folders, "batch"))
    rows = decision.flatten(state).persist()
    try:
        rows.repartition(*folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(items)
        same = reduce(lambda a, b: a & b, (F.col(f"t.{c}").eqNullSafe(F.col(f"r.{c}")) for c in folders))
        bare = touched.alias("t").join(rows.select(*folders).distinct().alias("r"), same, "left_anti")
        for r in bare.toLocalIterator():  # as the writer's own commit does for the folders that it fills
            remove(spark, f"{items}/{folder(spark, folders, tuple(r))}")
    finally:
        rows.unpersist()
        touched.unpersist()
