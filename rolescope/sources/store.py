"""Tables on plain Parquet: merge, replace, skip, artifacts.

A table is a folder of numbered versions and a pointer file that names what holds. A table with a key is parted by a hash of
it, and the pointer names a folder for each part: merging and replacing groups reads and writes only the parts that the new
rows fall into. A writer makes new folders and swaps the pointer last, so readers see the old table or the new one and a failed
writer leaves no trace.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from .settings import identifier

_POINTER = "_CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


# Keys of the tables of the pipeline.
KEYS = {"profiles": ("resume_id",), "jobs": ("job_id",), "profile_vectors": ("resume_id",), "job_vectors": ("job_id",), "retrievals": ("job_id",), "rankings": ("job_id",)}


class Table:
    """A versioned Parquet table below ``root``. ``key`` parts it into ``parts`` by a hash of these columns."""

    def __init__(self, spark: SparkSession, root: str, name: str, partition_by: tuple[str, ...] = (), key: tuple[str, ...] = (), parts: int = 32):
        if key and partition_by:
            raise ValueError("a table is parted by a key or by columns")
        self.spark, self.path, self.partition_by, self.key, self.parts = spark, f"{root.rstrip('/')}/{identifier(name)}", partition_by, key, parts

    def _state(self) -> dict | None:
        """What holds: ``version``, ``schema`` and the folder of each part (one folder for a table without a key)."""
        fs, p, jvm = _fs(self.spark, f"{self.path}/{_POINTER}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            state = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        self.parts = state["of"]  # a table keeps the number of parts it was made with
        return state

    def version(self) -> str | None:
        state = self._state()
        return state and state["version"]

    def exists(self) -> bool:
        return self._state() is not None

    def _read(self, state: dict, parts: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.path}/{folder}" for part, folder in sorted(state["parts"].items()) if parts is None or part in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """Rows of the version that holds; ValueError if the table was never written."""
        state = self._state()
        if state is None:
            raise ValueError(f"no table at {self.path}")
        return self._read(state)

    def create(self, schema) -> None:
        """Empty table, unless there is one."""
        if not self.exists():
            self.replace(self.spark.createDataFrame([], schema))

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.key)), F.lit(self.parts)).cast("int")

    def _parts_of(self, rows: DataFrame) -> list[str]:
        """Parts that rows fall into: at most ``parts`` numbers."""
        return sorted(str(r[0]) for r in rows.select(self._part()).distinct().collect())

    def replace(self, df: DataFrame, keep: int = 2) -> None:
        """Make ``df``, which may read this table, the table. The pointer is swapped by an atomic rename; folders that none of the
        last ``keep`` versions names are deleted."""
        self._write(df, None, keep)

    def _write(self, df: DataFrame, touched: list[str] | None, keep: int = 2) -> None:
        """Write ``df`` as the rows of the ``touched`` parts, of all if None; other parts stay as they are."""
        state = self._state()
        version = f"v-{1 + (int(state['version'].split('-')[1]) if state else 0):08d}-{uuid.uuid4().hex[:8]}"
        fs, folder, jvm = _fs(self.spark, f"{self.path}/{version}")
        held = {} if touched is None or state is None else {k: v for k, v in state["parts"].items() if k not in touched}
        if self.key:
            df.withColumn("_part", self._part()).repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/{version}")
            found = [x.getPath().getName() for x in fs.listStatus(folder) if x.isDirectory()]
            held |= {name.split("=")[1]: f"{version}/{name}" for name in found if name.startswith("_part=")}
        else:
            (df.write.partitionBy(*self.partition_by) if self.partition_by else df.write).parquet(f"{self.path}/{version}")
            held = {"0": version}
        history = ([] if state is None else state["history"] + [sorted(state["parts"].values())])[-(keep - 1) :] if keep > 1 else []
        self._point({"version": version, "schema": json.loads(df.schema.json()), "parts": held, "of": self.parts, "history": history})
        used = {f.split("/")[0] for f in held.values()} | {f.split("/")[0] for older in history for f in older}
        for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path)):
            name = x.getPath().getName()
            if name.startswith("v-") and name < version and name not in used:
                fs.delete(x.getPath(), True)

    def _point(self, state: dict) -> None:
        fs, p, jvm = _fs(self.spark, f"{self.path}/{_POINTER}.{uuid.uuid4().hex}")
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(p, jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_POINTER}"), options)

    def merge(self, rows: DataFrame, keys: list[str], now: Column | None = None, order: list[Column] | None = None) -> None:
        """Insert or update by key; see ``merged``. With a table key among ``keys`` only the parts of the new rows are read and
        written."""
        state = self._state()
        if state is None:
            self.replace(merged(None, rows, keys, now, order))
        elif self.key and set(self.key) <= set(keys):
            touched = self._parts_of(rows)
            if touched:
                self._write(merged(self._read(state, touched), rows, keys, now, order), touched)
        else:
            self.replace(merged(self._read(state), rows, keys, now, order))

    def replace_groups(self, rows: DataFrame, group: str, touched: DataFrame | None = None) -> None:
        """Replace all rows of the groups in ``rows``, and of those in ``touched``, which may have no rows any more. Of a table whose
        key is the group only their parts are read and written."""
        state = self._state()
        if state is None:
            self.replace(rows)
            return
        changed = (rows.select(group) if touched is None else rows.select(group).unionByName(touched.select(group))).distinct()
        parts = self._parts_of(changed) if self.key == (group,) else None
        if parts != []:
            self._write(self._read(state, parts).join(changed, group, "left_anti").unionByName(rows), parts)


def opened(spark: SparkSession, root: str, name: str) -> Table:
    """A table of the pipeline, parted by its key."""
    return Table(spark, root, name, key=KEYS[name])


def merged(stored: DataFrame | None, rows: DataFrame, keys: list[str], now: Column | None = None, order: list[Column] | None = None) -> DataFrame:
    """Stored rows with new ones merged in: a key that is there takes the new values and keeps ``created_at``, a new key
    is added, ``updated_at`` is now.

    Of new rows with one key the first in ``order`` holds. A full outer join on the keys, no other shuffle. Keys that
    hold a null are no keys and are left out.
    """
    stamp = F.current_timestamp() if now is None else now
    new = rows.drop("created_at", "updated_at")
    for k in keys:
        new = new.where(F.col(k).isNotNull())
    w = Window.partitionBy(*keys).orderBy(*(order or [F.xxhash64(*new.columns)]))
    new = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("_new", F.lit(True))
    if stored is None:
        return new.drop("_new").withColumn("created_at", stamp).withColumn("updated_at", stamp)
    old = stored.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in stored.columns if c not in keys))
    joined = new.join(old, keys, "full_outer")
    fresh = F.coalesce("_new", F.lit(False))
    values = []
    for c in [c for c in stored.columns if c not in keys and c not in ("created_at", "updated_at")]:
        values.append(F.when(fresh, F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) if c in new.columns else F.col(f"_old_{c}").alias(c))
    return joined.select(*keys, *values, F.coalesce("_old_created_at", stamp).alias("created_at"), F.when(fresh, stamp).otherwise(F.col("_old_updated_at")).alias("updated_at"))


def first_of_stem(files: DataFrame, overwrite: bool = False) -> DataFrame:
    """One file for each stem: the first by path, or the last if files are overwritten."""
    order = F.col("path").desc() if overwrite else F.col("path").asc()
    w = Window.partitionBy("_stem").orderBy(order)
    return files.withColumn("_stem", text.stem(F.col("path"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_stem")


def not_yet_written(files: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Files whose key was not written before."""
    return files.join(written.select(key).distinct(), key, "left_anti")


def without_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children that still have a parent: what a cascading delete leaves."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in a folder for each value of ``by`` if given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_with_manifest(df: DataFrame, path: str, summary: DataFrame) -> None:
    """JSON lines of ``df``, and beside them ``<path>.manifest.json`` with the one row of ``summary``, the columns and the time."""
    write_json(df, path)
    columns = F.array(*map(F.lit, df.columns))
    summary.select("*", columns.alias("columns"), F.current_timestamp().alias("written_at")).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.manifest.json")


def ranking_artifact(ranking: DataFrame, top: int = 10) -> DataFrame:
    """``job_id`` and JSON array of a job's first ``top`` rows without their job id: at most ``top`` rows a group."""
    first = ranking.where(F.col("ranking_rank") <= top)
    fields = [c for c in first.columns if c != "job_id"]
    keys = [c for c in ("ranking_rank", "resume_id") if c in fields]

    def before(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for k in reversed(keys):  # a row may hold maps, which have no order
            out = F.when(x[k] < y[k], -1).when(x[k] > y[k], 1).otherwise(out)
        return out

    rows = F.array_sort(F.collect_list(F.struct("ranking_rank", *(c for c in fields if c != "ranking_rank"))), before)
    return first.groupBy("job_id").agg(F.to_json(rows).alias("ranking"))


def write_lines(lines: DataFrame, path: str, order: str = "line_no", column: str = "line") -> None:
    """Text file of ordered lines; sorted across tasks, one file at the end."""
    lines.orderBy(order).select(column).coalesce(1).write.mode("overwrite").text(path)
