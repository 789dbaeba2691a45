"""Storage metadata as views over the tables of a folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Volumes that the part, order and chunk keys are dealt to.
VOLUMES = 25
#: Rows of lineitem for each task that copies of chunks are dealt to, and tasks from which their number is fixed.
TASK_ROWS, FEW_TASKS = 250_000, 8


class Views:
    """Each property reads only the columns its view needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tasks(self) -> int:
        """Tasks for what goes over all copies: their number grows with the copies, so that the share of one does not."""
        return self.table("lineitem").count() // TASK_ROWS + 1

    def dealt(self, rows: DataFrame, key: str, both: bool = False) -> DataFrame:
        """Rows dealt by a key. A few tasks are left to Spark, which may join small ones; many are not, as it would join them until each holds a fixed share of all.

        What meets rows that are not dealt takes as many tasks as Spark's shuffles at least, or Spark would deal it again; `both`: all that meets is dealt here.
        """
        if self.tasks < FEW_TASKS:
            return rows.repartition(key)
        return rows.repartition(self.tasks if both else max(self.tasks, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), key)

    @property
    def volumes(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("long").alias("volume_id"), F.col("n_name").alias("name"), (1 + F.col("n_regionkey") % 3).cast("long").alias("factor"), (1 + F.col("n_regionkey") % 2).cast("long").alias("min_copies"), (F.col("n_nationkey") == 0).alias("system")
        )

    @property
    def drives(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("drive_id"), F.col("s_nationkey").cast("long").alias("node"), F.element_at(F.array(*map(F.lit, ("hot", "warm", "cold"))), (key % 3 + 1).cast("int")).alias("tier"),
            F.when(key % 10 == 0, 0).otherwise(1_000_000).cast("long").alias("capacity_bytes"), F.when(key % 7 == 0, "draining").when(key % 7 == 1, "standby").otherwise("active").alias("state"),
        )

    @property
    def chunks(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(key.alias("chunk_id"), F.sha2(key.cast("string"), 256).alias("hash"), (key % VOLUMES).alias("volume_id"), F.floor(F.col("o_totalprice") / 150).cast("long").alias("stored_size"), (key % 11 != 0).alias("committed"), (key % 13 == 0).alias("active_writes"))

    @property
    def locations(self) -> DataFrame:
        # dealt by chunk once: the distinct rows, copies per chunk and joins on it need no further shuffle
        return self.dealt(self.copies, "chunk_id").distinct()

    @property
    def copies(self) -> DataFrame:
        """chunk_id, drive_id, as often as a copy is named."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("drive_id"))

    @property
    def sized_locations(self) -> tuple[DataFrame, DataFrame]:
        """Chunks and locations, both dealt by chunk to the same tasks, so that they meet there without a further shuffle."""
        return self.dealt(self.chunks, "chunk_id", both=True), self.dealt(self.copies, "chunk_id", both=True).distinct()

    @property
    def references(self) -> DataFrame:
        """file_id, chunk_id, as often as a file names a chunk."""
        return self.table("lineitem").select(F.col("l_partkey").alias("file_id"), F.col("l_orderkey").alias("chunk_id"))

    @property
    def file_chunks(self) -> DataFrame:
        return self.references.distinct()

    @property
    def files(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("file_id"), (key % VOLUMES).alias("volume_id"), (F.col("p_size") % 2 == 0).alias("detached"), F.date_add(F.lit("1997-12-01").cast("date"), F.col("p_size")).cast("timestamp_ntz").alias("created_at"),
            F.concat(F.lit("/"), "p_brand", F.lit("/"), "p_type", F.lit("/"), key.cast("string")).alias("path"),
        )

    @property
    def backups(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_orderkey") % VOLUMES).alias("volume_id"), F.col("o_orderdate").alias("created_at"))

    @property
    def shards(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(F.expr("o_orderkey div 6").alias("stripe_id"), (key % 6).alias("idx"), key.alias("chunk_id"))

    @property
    def snapshot(self) -> DataFrame:
        old = self.files.where("created_at < timestamp_ntz'1998-01-01 00:00:00'").select("file_id")
        return self.file_chunks.join(old, "file_id", "left_semi")

    @property
    def keys(self) -> DataFrame:
        return self.table("pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("key"))

    @property
    def content(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("file_id"), "source", F.coalesce("text", F.lit("")).alias("text"))

    @property
    def access(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("hash"), "ts")

    @property
    def audit(self) -> DataFrame:
        return self.table("events").select("ts", F.col("event_id").alias("id"), "event_type", F.col("user_id").alias("actor_uid"), "value")

    @property
    def envelopes(self) -> DataFrame:
        return self.table("events").select((F.col("user_id") % 3).alias("node"), "event_id", "ts")

    @property
    def received(self) -> DataFrame:
        """What arrived of each node's numbered events: one event in seventeen is lost."""
        seq = F.row_number().over(Window.partitionBy("node").orderBy("ts", "event_id")).cast("long")
        return self.envelopes.withColumn("seq", seq).where("event_id % 17 <> 0").select("node", "seq")

    @property
    def claims(self) -> DataFrame:
        start = (F.col("l_linenumber") * 10).cast("long")
        return self.table("lineitem").select(
            (F.col("l_partkey") % 500).alias("path"), start.alias("start"), F.when(F.col("l_partkey") % 50 == 0, 1 << 40).otherwise(start + F.col("l_quantity").cast("long")).alias("end"), (F.col("l_suppkey") % 3 == 0).alias("exclusive")
        )

    @property
    def jobs(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("expires_at"))

    @property
    def objects(self) -> DataFrame:
        """Files with owner, mode and a list of access entries (permissions as bits 4, 2, 1)."""
        key, size = F.col("p_partkey"), F.col("p_size").cast("long")
        kind = "array<struct<kind: string, id: bigint, bits: bigint>>"
        entry = lambda cond, name, id_, bits: F.when(cond, F.array(F.struct(F.lit(name).alias("kind"), id_.alias("id"), bits.alias("bits")))).otherwise(F.array().cast(kind))
        return self.table("part").select(
            key.alias("object_id"), (key % 7).alias("uid"), (key % 5).alias("gid"), (key * 37 % 512).alias("mode"), (key % VOLUMES).alias("volume_id"),
            F.concat(entry(key % 3 == 0, "user", size % 8, size % 8), entry(key % 4 == 0, "group", size % 6, F.expr("p_partkey div 8") % 8), entry(key % 5 == 0, "mask", F.lit(None).cast("long"), F.expr("p_partkey div 64") % 8)).alias("entries"),
        )

    @property
    def requests(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_partkey").alias("object_id"), (F.col("l_suppkey") % 8).alias("uid"), (F.col("l_linenumber") % 6).cast("long").alias("gid"), F.element_at(F.array(F.lit(4), F.lit(2), F.lit(1)), (F.col("l_orderkey") % 3 + 1).cast("int")).cast("long").alias("want"))

    @property
    def locks(self) -> DataFrame:
        """Locks on directories and files of the tree that documents make up, by event."""
        key = F.col("event_id")
        path = F.concat(F.lit("/src"), (key % 20).cast("string"), F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/d"), (key % 7).cast("string"))), F.when(key % 4 != 1, F.lit("")).otherwise(F.concat(F.lit("/f"), (key % 50).cast("string"))))
        return self.table("events").select(key.alias("lock_id"), path.alias("path"), (key % 2 == 0).alias("deep"), (F.col("user_id") % 4 == 0).alias("exclusive"), F.col("user_id").alias("holder"), (F.col("ts") + F.expr("interval 10 days")).alias("expires_at"))

    @property
    def targets(self) -> DataFrame:
        key = F.col("doc_id")
        return self.table("documents").select(key.alias("target_id"), F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/d"), (key % 7).cast("string"), F.lit("/f"), (key % 50).cast("string")).alias("path"))

    @property
    def ranges(self) -> DataFrame:
        """Byte-range locks of clients on files: two files an order, so that groups stay small."""
        start = (F.col("l_linenumber") * 10).cast("long")
        return self.table("lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_suppkey").alias("client"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), (F.col("l_partkey") % 3 == 0).alias("exclusive"))

    @property
    def stats(self) -> DataFrame:
        """Access counts of chunks: all-time hourly counts summed, last access."""
        return self.table("events").groupBy(F.col("user_id").alias("chunk_id")).agg(F.count("*").alias("daily"), F.max("ts").alias("last"))

    @property
    def escalations(self) -> DataFrame:
        key = F.col("event_id")
        return self.table("events").select(key.alias("id"), F.col("event_type").alias("category"), F.when(key % 3 == 0, "pending").when(key % 3 == 1, "resolved").otherwise("expired").alias("status"), F.when(key % 4 == 0, "critical").otherwise("warning").alias("severity"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 3 days")).alias("expires_at"))
