"""A table of results that several runs append to, without rereading what is there.

Data lies in folders that are written once; ``_commits`` holds one small file per snapshot, which names the folders
that make up the table at that point. A write becomes visible by putting the next snapshot under its number, which
succeeds for one writer only; the other rereads and tries again. Folders of writers that stopped half-way are
never named and so never read. On a file system whose rename neither is atomic nor refuses an existing target
(plain object stores) only one writer may be active.

Small folders are merged by levels: eight of a kind become one of the next level, in which each key stands once per
job, in buckets by a hash of the key. So the number of folders grows with the logarithm of the number of runs, every row
is rewritten as often, and a reader that knows its keys opens their buckets only.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MERGED_AT_ONCE = 8
BUCKET_ROWS = 1_000_000
MOST_TRIES = 50
MOST_LISTED = 100
# Columns that the table adds to those of its rows: who wrote them, and the snapshot that the writer had seen.
ADDED = T.StructType([
    T.StructField("job", T.StringType()), T.StructField("run", T.IntegerType()), T.StructField("seen", T.LongType())
])


@dataclass(frozen=True)
class Part:
    """One folder of the table: rows of a group (such as a scorer and a class version), of one run or merged from several.

    ``jobs`` names all jobs with rows in it, unless they are too many to be listed (None).
    """

    folder: str
    group: str
    jobs: tuple[str, ...] | None
    run: int | None
    level: int
    buckets: int
    rows: int


class ResultsTable:
    """``columns`` are those of the appended rows; ``keys`` tell what one result stands for within a group."""

    def __init__(self, spark: SparkSession, path: str, columns: T.StructType, keys: Sequence[str] = ("id",)):
        self.spark, self.path, self.columns, self.keys = spark, path.rstrip("/"), columns, list(keys)

    # ------------------------------------------------------------- snapshots

    def snapshot(self) -> tuple[int, list[Part]]:
        """Number and parts of the latest snapshot; 0 and none before the first commit."""
        number = max((int(name[:-5]) for name in self._names("_commits") if name.endswith(".json")), default=0)
        if not number:
            return 0, []
        held = self._file_system().open(self._path(f"_commits/{number:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
        finally:
            held.close()
        return number, [Part(**{**part, "jobs": part["jobs"] and tuple(part["jobs"])}) for part in json.loads(text)]

    def commit(self, change: Callable[[list[Part]], list[Part] | None]) -> bool:
        """Put the next snapshot, as ``change`` makes it from the latest; False if it gives none any more."""
        for _ in range(MOST_TRIES):
            number, parts = self.snapshot()
            after = change(parts)
            if after is None:
                return False
            if self._put(number + 1, after):
                return True
        raise RuntimeError(f"{MOST_TRIES} other writers came first at {self.path}")

    def _put(self, number: int, parts: list[Part]) -> bool:
        files, target = self._file_system(), self._path(f"_commits/{number:012d}.json")
        draft = self._path(f"_commits/.{uuid.uuid4().hex}")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps([asdict(part) for part in parts]).encode()))
        out.close()
        jvm = self.spark._jvm
        if files.getUri().getScheme() == "file":
            # A hard link, unlike a local rename, never replaces a file.
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                files.delete(draft, False)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, target, options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            files.delete(draft, False)
            return False
        return True

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _file_system(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files, path = self._file_system(), self._path(folder)
        return [found.getPath().getName() for found in files.listStatus(path)] if files.exists(path) else []

    def unnamed_folders(self) -> list[str]:
        """Data folders that the latest snapshot does not name: replaced, merged, or left by a writer that stopped."""
        named = {part.folder for part in self.snapshot()[1]}
        return sorted(name for name in self._names("data") if name not in named)

    # --------------------------------------------------------------- writing

    def write(self, rows: DataFrame, group: str, job: str, run: int) -> Part:
        """Write rows of a run; nobody sees them before ``add``."""
        seen, _ = self.snapshot()
        folder = uuid.uuid4().hex
        own = rows.select(*self.columns.names, F.lit(job).alias("job"), F.lit(run).cast("int").alias("run"), F.lit(seen).cast("long").alias("seen"))
        own.write.parquet(f"{self.path}/data/{folder}")
        return Part(folder, group, (job,), run, 0, 1, self.spark.read.schema(ADDED).parquet(f"{self.path}/data/{folder}").count())

    def add(self, part: Part) -> None:
        """Make a written part visible, in place of what an earlier attempt at the same run left."""

        def change(parts: list[Part]) -> list[Part]:
            kept = [p for p in parts if (p.group, p.jobs, p.run, p.level) != (part.group, part.jobs, part.run, 0)]
            return kept + [part] if part.rows else kept

        self.commit(change)

    def append(self, rows: DataFrame, group: str, job: str, run: int) -> None:
        self.add(self.write(rows, group, job, run))

    def merge(self, group: str, everything: bool = False) -> bool:
        """Merge the lowest level of a group that has eight parts, or all its parts, into one; False if none is due.

        Of each key the last row of each job is kept: the highest run, and of one run the attempt that saw most.
        Parts that others add meanwhile stay as they are; if others merged or replaced one of these, nothing changes.
        """
        mine = [p for p in self.snapshot()[1] if p.group == group]
        if everything:
            chosen = mine if len(mine) > 1 else []
        else:
            levels = [[p for p in mine if p.level == level] for level in sorted({p.level for p in mine})]
            chosen = next((parts for parts in levels if len(parts) >= MERGED_AT_ONCE), [])
        if not chosen:
            return False
        folder, buckets = uuid.uuid4().hex, 1 + sum(p.rows for p in chosen) // BUCKET_ROWS
        kept = last_rows(self._read(chosen), [*self.keys, "job"], ["run", "seen"])
        kept = kept.withColumn("_bucket", self._bucket(buckets)).repartition(buckets, "_bucket")
        kept.write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        rows = self.spark.read.schema(ADDED).parquet(f"{self.path}/data/{folder}").count()
        jobs = None if any(p.jobs is None for p in chosen) else tuple(sorted({j for p in chosen for j in p.jobs}))
        merged = Part(folder, group, jobs if jobs and len(jobs) <= MOST_LISTED else None, None, 1 + max(p.level for p in chosen), buckets, rows)

        def change(parts: list[Part]) -> list[Part] | None:
            return [p for p in parts if p not in chosen] + [merged] if set(chosen) <= set(parts) else None

        return self.commit(change)

    # --------------------------------------------------------------- reading

    def read(
        self, group: str | None = None, without_job: str | None = None, without_run: tuple[str, int] | None = None, asked: DataFrame | None = None
    ) -> DataFrame:
        """Rows of the latest snapshot: the table's columns, then job, run and the snapshot the writer saw.

        ``group`` opens its folders only. ``without_job`` leaves out all of a job, ``without_run`` one run of it. With
        ``asked``, a table of keys, merged folders are opened only where buckets may hold one of them; the rows
        are then a superset of those with an asked key.
        """
        parts = [p for p in self.snapshot()[1] if group is None or p.group == group]
        if without_job is not None:
            parts = [p for p in parts if p.jobs != (without_job,)]
        if without_run is not None:
            parts = [p for p in parts if (p.jobs, p.run) != ((without_run[0],), without_run[1])]
        found = self._read(parts, asked)
        if without_job is not None:
            found = found.where(F.col("job") != without_job)
        if without_run is not None:
            found = found.where((F.col("job") != without_run[0]) | (F.col("run") != without_run[1]))
        return found

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _read(self, parts: Iterable[Part], asked: DataFrame | None = None) -> DataFrame:
        schema = T.StructType([*self.columns.fields, *ADDED.fields])
        in_buckets = T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])
        plain = [f"{self.path}/data/{p.folder}" for p in parts if p.level == 0]
        found = [self.spark.read.schema(schema).parquet(*plain)] if plain else []
        wanted: dict[int, list[int]] = {}
        for part in parts:
            if part.level:
                rows = self.spark.read.schema(in_buckets).parquet(f"{self.path}/data/{part.folder}")
                if asked is not None and part.buckets > 1:
                    if part.buckets not in wanted:
                        # At most one number per bucket.
                        keys = asked.select(*[F.col(k).cast(self.columns[k].dataType).alias(k) for k in self.keys])
                        held = keys.select(self._bucket(part.buckets).alias("b")).distinct().collect()
                        wanted[part.buckets] = [r["b"] for r in held]
                    rows = rows.where(F.col("_bucket").isin(wanted[part.buckets]))
                found.append(rows.drop("_bucket"))
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], schema)


def last_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in the order of the given columns."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).where(F.col("_n") == 1).drop("_n")
