"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

The ledger holds one row per canonical key: bucket, key, number of copies, earliest representative (smallest id).
A ledger lasts: it lies in a folder, batches are applied to it by separate programs, and ids that were delivered before are recognised.
A batch of new records is first freed of known ids, then aggregated by key (combined on the map side, so a key that owns a third of
the batch costs one row per task), then joined, full outer, with the buckets it touches. Counts are added and the smaller
id is kept. Only these narrow rows are ever shuffled, never the texts.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm.records import canonical_key, exchanged
from gramloom.tables import cut, shared_folder

#: Buckets of a ledger whose size isn't told.
BUCKETS = 16
#: Tasks that write one bucket.
WRITERS = 4
#: A key with more than this share of all records is joined by broadcast: there are fewer than 1 / share of them.
HOT = 0.001

LEDGER = "bucket int, key binary, copies bigint, first_id bigint"


def keyed(records: DataFrame, key: str = "doc_id", arrived: str = "loaded_at") -> DataFrame:
    """(id, key, arrived) of each record, one for an id delivered twice (the earliest). Records without an id are left out."""
    own = exchanged(records.where(F.col(key).isNotNull()))
    narrow = own.select(F.col(key).alias("id"), canonical_key(F.col("class_label"), F.col("example_sequence")).alias("key"), F.col(arrived).alias("arrived"))
    return narrow.groupBy("id").agg(F.min("key").alias("key"), F.min("arrived").alias("arrived"))


def update(ledger: DataFrame, batch: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The ledger's rows after a batch of (id, key): those of the touched buckets. Empty batches touch none."""
    own = batch.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    new = own.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "key", "n", "id")
    joined = ledger.join(new, ["bucket", "key"], "full_outer")
    return joined.select("bucket", "key", (F.coalesce("copies", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("copies"), F.least("first_id", "id").alias("first_id"))


class Ledger:
    """A ledger in a folder that all executors share: it can be opened again by another program, and each batch is applied to it once.

    Counts lie in ``counts/<n>``, the ids of all records taken in so far in ``ids/<n>``, both by bucket; ``states/<n>`` says, after batch n, in which version each bucket of
    counts is. A batch is written aside first and is part of the ledger only with its state file, so that a program may die at any time; what it left behind is written
    over. One program writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        """Opens a ledger, or makes one of ``buckets`` buckets (fixed for good; see :func:`buckets_for`)."""
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        numbers = [int(name) for name in self._names("states") if name.isdigit()]
        if numbers:
            row = json.loads(spark.read.text(f"{self.path}/states/{max(numbers)}").first()["value"])
            self.n, self.buckets = max(numbers), row["buckets"]
            self.versions: dict[int, set[int]] = {int(k): set(v) for k, v in row["versions"].items()}
        else:
            self.n, self.buckets, self.versions = 0, buckets or BUCKETS, {}

    def _names(self, folder: str) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        # an unfinished state has no success mark
        return [s.getPath().getName() for s in self._fs.listStatus(place) if self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if self._fs.exists(place) else []

    def counts(self, wanted: set[int] | None = None) -> DataFrame:
        """(bucket, key, copies, first_id), of some buckets or of all."""
        out = self.spark.createDataFrame([], LEDGER)
        for version, own in sorted(self.versions.items()):
            some = own if wanted is None else own & wanted
            if some:
                rows = self.spark.read.schema(LEDGER).parquet(f"{self.path}/counts/{version}")
                out = out.unionByName(rows if some == own == set(range(self.buckets)) else rows.where(F.col("bucket").isin(*some)))
        return out

    def ids(self) -> DataFrame:
        """(bucket, id) of all records taken in so far."""
        schema = "bucket int, id bigint"
        names = [f"{self.path}/ids/{i}" for i in range(1, self.n + 1)]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def apply(self, batch: DataFrame) -> int:
        """Takes in a batch of (id, key); the number of the state after it. Ids that came before, in any batch, change nothing.

        Only the buckets of counts that new records touch are read and rewritten; new ids are added. ``WRITERS`` tasks write a bucket.
        """
        n = self.n + 1
        own = batch.groupBy("id").agg(F.min("key").alias("key")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int"))
        known = self.ids()
        new = own.join(known, ["bucket", "id"], "left_anti") if self.n else own
        new = cut(new)
        new.select("bucket", "id").write.mode("overwrite").parquet(f"{self.path}/ids/{n}")
        keyed_rows = new.select("id", "key").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))
        touched = {r["bucket"] for r in keyed_rows.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
        if touched:
            update(self.counts(touched), keyed_rows, self.buckets).repartition("bucket", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(WRITERS))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts/{n}")
            self.versions = {v: own - touched for v, own in self.versions.items() if own - touched} | {n: touched}
        state = json.dumps({"buckets": self.buckets, "versions": {v: sorted(own) for v, own in self.versions.items()}})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/states/{n}")
        self.n = n
        return n


def buckets_for(records: int) -> int:
    """Buckets of a new ledger: a power of two, so that about a million records fall into one."""
    return 1 << max(4, math.ceil(math.log2(max(1, records / 1_000_000))))


def fold(spark: SparkSession, records: DataFrame, cuts: list, path: str | None = None) -> DataFrame:
    """The counts of a ledger after ``records`` (id, key, arrived), taken in as batches that end before each of ``cuts``, and one after the last.

    Without a ``path`` the ledger is a new one in the shared folder. A record without a time of arrival is in the first batch.
    """
    ledger = Ledger(spark, path or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}", buckets_for(records.count()))
    edges = [None, *cuts, None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        batch = records
        if low is not None:
            batch = batch.where(F.col("arrived") >= F.lit(low))
        if high is not None:
            batch = batch.where((F.col("arrived") < F.lit(high)) | (F.col("arrived").isNull() if low is None else F.lit(False)))
        ledger.apply(batch.select("id", "key"))
    return ledger.counts()


def batch_cuts(records: DataFrame, batches: int = 3) -> list:
    """Times that cut the records into batches of equal length in time: two numbers from one small aggregate."""
    low, high = records.agg(F.min("arrived"), F.max("arrived")).first()
    if low is None or low == high:
        return []
    return [low + (high - low) * i / batches for i in range(1, batches)]


def copies(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """(first_id, copy_id): each record that is not the representative of its key.

    Keys so frequent that they'd overload a task are fewer than 1 / ``HOT``; their ledger rows, and only
    theirs, are broadcast. All other keys go through a shuffled join.
    """
    many = ledger.where("copies > 1").select("key", "copies", "first_id")
    total = ledger.agg(F.sum("copies").alias("total"))
    many = many.crossJoin(F.broadcast(total))
    hot = many.where(F.col("copies") > HOT * F.col("total")).where("copies > 1000").select("key", "first_id")
    light = many.where(~((F.col("copies") > HOT * F.col("total")) & (F.col("copies") > 1000))).select("key", "first_id")
    marked = records.select("id", "key").join(F.broadcast(hot.withColumnRenamed("first_id", "hot_id")), "key", "left")
    near = marked.where("hot_id is not null").select(F.col("hot_id").alias("first_id"), "id")
    far = marked.where("hot_id is null").select("id", "key").join(light, "key").select("first_id", "id")
    return near.unionByName(far).where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def deduplicate(spark: SparkSession, records: DataFrame, batches: int = 3) -> tuple[DataFrame, DataFrame]:
    """The keyed records and their ledger, both in the shared folder."""
    own = cut(keyed(records))
    return own, fold(spark, own, batch_cuts(own, batches))
