"""Row sets with versions: replaced only where nobody changed them meanwhile, and restored from their snapshots.

Items: id, owner (an invoice or a specification), position, and any other
columns.  Snapshots: owner, version, action, snapshot (its items as JSON).  An
action takes many owners at once; an owner's items are one document, and meet
in one row.  The tables themselves are kept by ``commit``: a result becomes the
next version only if its base is still the newest one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspan.sources.shared import written


class Conflict(Exception):
    """Another writer has committed since the base was read."""


def dense_ids(rows: DataFrame, *order: Column | str, after: int = 0) -> DataFrame:
    """``rows`` with id: ``after`` + 1, + 2, ... in ``order``.

    Rows are dealt by ranges of the order; each range counts for itself, behind
    the sizes of the ranges before it, so that no task sees all rows.
    """
    placed = written(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "dense")
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", (F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + after).alias("before"))  # one row a partition
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return placed.join(F.broadcast(before), "range").withColumn("id", (F.col("before") + own).cast("long")).drop("range", "before")


def _packed(items: DataFrame) -> DataFrame:
    """(owner, snapshot, digest) of each owner's items, in order of their ids; ids count."""
    other = sorted(c for c in items.columns if c not in ("owner", "id"))
    whole = F.to_json(F.sort_array(F.collect_list(F.struct("id", *other))), {"ignoreNullFields": "false"})
    return items.groupBy("owner").agg(whole.alias("snapshot")).withColumn("digest", F.sha2("snapshot", 256))


def digests(items: DataFrame) -> DataFrame:
    """(owner, digest): what a later replacement is held against."""
    return _packed(items).select("owner", "digest")


def with_snapshots(snapshots: DataFrame, items: DataFrame, owners: DataFrame, action: str) -> DataFrame:
    """``snapshots`` and one more, a version above the last, of every one of ``owners``' items; of owners without items none."""
    last = snapshots.groupBy("owner").agg(F.max("version").alias("last"))
    now = _packed(items.join(owners.select("owner").distinct(), "owner", "left_semi"))
    new = now.join(last, "owner", "left").select("owner", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"), F.lit(action).alias("action"), "snapshot")
    return snapshots.select("owner", "version", "action", "snapshot").unionByName(new)


def replaced(items: DataFrame, snapshots: DataFrame, base: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, snapshots, conflicts) after ``new`` rows (items without id) have taken the place of the items of all owners of ``base`` (owner, digest).

    An owner whose items are no longer those of its digest keeps them and is
    named in conflicts; an owner that had no items has a null digest.  Replaced
    items go to the snapshots first.  New rows get ids behind all others.
    """
    now = base.join(digests(items).withColumnRenamed("digest", "now"), "owner", "left").withColumn("free", F.col("digest").eqNullSafe(F.col("now")))
    free = now.where("free").select("owner")
    came = dense_ids(new.join(free, "owner", "left_semi"), "owner", "position", after=items.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    kept = items.join(free, "owner", "left_anti").select(*items.columns)
    return kept.unionByName(came.select(*items.columns)), with_snapshots(snapshots, items, free, "before_reparse"), now.where("NOT free").select("owner")


def restored(items: DataFrame, snapshots: DataFrame, chosen: DataFrame, new_ids: bool = True) -> tuple[DataFrame, DataFrame]:
    """(items, snapshots) after the owners of ``chosen`` (owner, version) have gone back to a version; what they had goes to the snapshots first.

    Items come back under new ids behind all others (invoices), or under their
    own (specifications).  A version that is not there changes nothing.
    """
    shape = StructType([f for f in items.schema if f.name != "owner"])
    found = snapshots.join(chosen, ["owner", "version"], "left_semi").select("owner", "version", "snapshot").dropDuplicates(["owner", "version"])
    back = found.select("owner", F.inline(F.from_json("snapshot", f"array<{shape.simpleString()}>")))
    if new_ids:
        back = dense_ids(back.withColumnRenamed("id", "old_id"), "owner", "old_id", after=items.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    owners = found.select("owner")
    return items.join(owners, "owner", "left_anti").select(*items.columns).unionByName(back.select(*items.columns)), with_snapshots(snapshots, items, owners, "before_rollback")


# --- the tables ---------------------------------------------------------------------------


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def newest(spark: SparkSession, folder: str) -> int:
    """The number of the last commit; 0 if there is none."""
    path, files = _files(spark, folder)
    return max([0, *[int(s.getPath().getName()) for s in files.listStatus(path)]]) if files.exists(path) else 0


def commit(spark: SparkSession, folder: str, base: int, **tables: DataFrame) -> int:
    """Makes ``tables`` the version after ``base`` and returns its number; raises ``Conflict``, and changes nothing, if there is one already.

    Rows are written first, beside what is there; then the version's file is
    created, which the file system grants to one writer only.
    """
    name = uuid.uuid4().hex
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/data/{name}/{table}")
    path, files = _files(spark, folder)
    jvm = spark.sparkContext._jvm
    try:
        if newest(spark, folder) != base:
            raise Conflict(f"{folder}: version {base} is not the newest one")
        out = files.create(jvm.org.apache.hadoop.fs.Path(path, f"{base + 1:012d}"), False)
    except Exception as e:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/data/{name}"), True)
        if isinstance(e, Conflict) or "FileAlreadyExists" in str(e):
            raise Conflict(f"{folder}: version {base + 1} is another writer's") from e
        raise
    out.write(bytearray(json.dumps({"data": name}).encode()))
    out.close()
    return base + 1


def version(spark: SparkSession, folder: str, number: int, table: str) -> DataFrame:
    """A table as of a commit."""
    name = json.loads(spark.read.text(f"{folder}/commits/{number:012d}").first()[0])["data"]
    return spark.read.parquet(f"{folder}/data/{name}/{table}")
