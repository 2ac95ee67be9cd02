"""Tables that change by atomic commits: numbered manifests over folders of Parquet.

A commit writes its rows to a folder of its own and then the next manifest, which lists the folders that make up the table.  The
manifest is written under another name and renamed without overwriting, so that it is there whole or not at all, and of two
writers that follow the same manifest one gets its number and the other :class:`Conflict`.  A folder that no manifest lists (of a
writer that was lost, or lost the race) isn't part of the table.  Readers see the manifest that they have read, whatever is
committed meanwhile.

The rename is atomic on file systems that promise it (HDFS, and object stores with conditional writes); on a local disk the
check for an existing manifest and the rename are two steps.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.joins import side
from ..functions.tables import local_table

DELETED, SEGMENT, MONTH, BUCKET = "__deleted", "__segment", "__month", "__bucket"


class Conflict(RuntimeError):
    """Another writer has committed first."""


class Log:
    """Numbered manifests below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("log").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of the manifests, ascending; none where nothing has been committed.  Any other failure to list is raised."""
        fs, log = self._fs(), self._path("log")
        if not fs.exists(log):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "_")

    def read(self, number: int) -> dict:
        try:
            text = self.spark.read.text(f"{self.root}/log/{number:012d}.json", wholetext=True).first()[0]
        except AnalysisException as e:
            raise ValueError(f"{self.root} has no manifest {number}") from e
        return json.loads(text)

    def last(self) -> tuple[int, dict] | None:
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else None

    def commit(self, number: int, manifest: dict) -> None:
        """Writes manifest ``number``, or raises :class:`Conflict` where it is there already."""
        jvm, fs = self.spark._jvm, self._fs()
        fs.mkdirs(self._path("log"))
        torn, whole = self._path(f"log/_{uuid.uuid4().hex}"), self._path(f"log/{number:012d}.json")
        out = fs.create(torn, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
            files.rename(fs.makeQualified(torn), fs.makeQualified(whole), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(torn, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"manifest {number} of {self.root} has been written by another") from e
            raise

    def drop(self, folder: str) -> None:
        self._fs().delete(self._path(folder), True)

    def folders(self) -> list[str]:
        fs, data = self._fs(), self._path("data")
        return [f"data/{s.getPath().getName()}" for s in fs.listStatus(data)] if fs.exists(data) else []


class KeyedTable:
    """A table of one row a key, kept as a base and deltas.

    ``month``: a column of epoch seconds whose month partitions every folder; :meth:`older` reads only the months that it may need.
    ``buckets``: by so many hashes of the key every folder is partitioned (too); :meth:`rows_of` reads only those of its keys.  A key's
    row is that of its last delta; a delta may also delete keys.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | str, key: str, month: str | None = None, buckets: int | None = None):
        self.spark, self.log, self.key, self.month, self.buckets = spark, Log(spark, root), key, month, buckets
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)])

    def version(self) -> int:
        """Number of the last manifest, 0 where there is none: a table that isn't there is empty."""
        found = self.log.numbers()
        return found[-1] if found else 0

    def _segments(self, version: int) -> list[str]:
        return self.log.read(version)["segments"] if version else []

    def _read(self, folder: str) -> DataFrame:
        fields = [*self.schema.fields, T.StructField(DELETED, T.BooleanType()), *([T.StructField(MONTH, T.StringType())] if self.month else []), *([T.StructField(BUCKET, T.IntegerType())] if self.buckets else [])]
        return self.spark.read.schema(T.StructType(fields)).parquet(f"{self.log.root}/{folder}")

    def _of_month(self, c: Column) -> Column:
        return F.coalesce(F.date_format(F.timestamp_seconds(c), "yyyy-MM"), F.lit("none"))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        folder, by = f"data/{uuid.uuid4().hex}", []
        if self.month:
            rows, by = rows.withColumn(MONTH, self._of_month(F.col(self.month))), [*by, MONTH]
        if self.buckets:
            rows, by = rows.withColumn(BUCKET, self._bucket()), [*by, BUCKET]
        (rows.hint("rebalance", *by) if by else rows).write.partitionBy(*by).parquet(f"{self.log.root}/{folder}")
        return folder

    def _latest(self, folders: list[str], only: Column) -> DataFrame:
        """The rows of the last delta of each key, deletions among them."""
        every = None
        for i, folder in enumerate(folders):
            rows = self._read(folder).where(only).select(*self.schema.names, DELETED).withColumn(SEGMENT, F.lit(i))
            every = rows if every is None else every.unionAll(rows)
        if len(folders) == 1:
            return every.drop(SEGMENT)
        own = F.struct(*self.schema.names, DELETED)
        return every.groupBy(F.col(self.key).alias("__key")).agg(F.max_by(own, SEGMENT).alias("r")).select("r.*")

    def load(self, version: int | None = None) -> DataFrame:
        """All rows as of a version (the last by default); the base isn't shuffled where the deltas' keys are few."""
        return self._load(version, F.lit(True))

    def _load(self, version: int | None, only: Column) -> DataFrame:
        segments = self._segments(self.version() if version is None else version)
        if not segments:
            return local_table(self.spark, [], self.schema)
        base = self._read(segments[0]).where(only & ~F.col(DELETED)).select(*self.schema.names)
        if len(segments) == 1:
            return base
        new = self._latest(segments[1:], only)
        kept = base.join(side(new.select(self.key)), self.key, "left_anti").select(*self.schema.names)
        return kept.unionAll(new.where(~F.col(DELETED)).select(*self.schema.names))

    def rows_of(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of ``keys`` (the key column, distinct), from the buckets that they are in."""
        only = F.lit(True)
        if self.buckets:
            some = [r.b for r in keys.select(self._bucket().alias("b")).distinct().collect()]  # ``buckets`` at most
            only = F.col(BUCKET).isin(some)
        return self._load(version, only).join(side(keys.select(self.key)), self.key, "left_semi").select(*self.schema.names)

    def changed_keys(self, since: int) -> DataFrame:
        """Keys of the deltas after version ``since``; a compaction since then is an error."""
        before, now = self._segments(since), self._segments(self.version())
        if now[: len(before)] != before:
            raise ValueError(f"{self.log.root} has been compacted since version {since}")
        found = local_table(self.spark, [], self.schema).select(self.key)
        for folder in now[len(before) :]:
            found = found.unionAll(self._read(folder).select(self.key))
        return found.distinct()

    def older(self, until: int, version: int | None = None) -> DataFrame:
        """Rows whose month column is at most ``until`` (seconds), from the months up to its; later deltas are asked for keys alone."""
        segments = self._segments(self.version() if version is None else version)
        if not segments:
            return local_table(self.spark, [], self.schema)
        last = F.date_format(F.timestamp_seconds(F.lit(until)), "yyyy-MM")
        found = None
        for i, folder in enumerate(segments):
            rows = self._read(folder).where((F.col(MONTH) <= last) & (F.col(self.month) <= until) & ~F.col(DELETED)).select(*self.schema.names)
            later = None
            for other in segments[i + 1 :]:
                keys = self._read(other).select(self.key)
                later = keys if later is None else later.unionAll(keys)
            if later is not None:
                rows = rows.join(side(later.distinct()), self.key, "left_anti").select(*self.schema.names)
            found = rows if found is None else found.unionAll(rows)
        return found

    def note(self, version: int | None = None) -> dict | None:
        """What a commit was told to note; a compaction keeps it."""
        version = self.version() if version is None else version
        return self.log.read(version).get("note") if version else None

    def commit(self, rows: DataFrame | None = None, deleted: DataFrame | None = None, follows: int | None = None, note: dict | None = None) -> int:
        """Adds a delta of ``rows`` (new or changed, one a key) without the keys of ``deleted``; returns the new version.

        ``follows``: the version that the rows were made from (the last by default); another commit since then is a conflict.
        ``note`` is kept in the manifest; without one, that of the version before is.
        """
        follows = self.version() if follows is None else follows
        every = rows.select(*self.schema.names).withColumn(DELETED, F.lit(False)) if rows is not None else None
        if deleted is not None:
            gone = deleted.select(*[F.col(self.key) if f.name == self.key else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(True).alias(DELETED))
            every = gone if every is None else every.unionAll(gone)
        if every is None:
            raise ValueError("nothing to commit")
        folder = self._write(every)
        n = self._read(folder).agg(F.count("*").alias("rows"), F.count_distinct(self.key).alias("keys")).first()
        if n.rows != n["keys"]:
            raise ValueError(f"{n.rows} rows have {n['keys']} keys; a key needs one row")
        self.log.commit(follows + 1, {"segments": [*self._segments(follows), folder], "note": note or self.note(follows)})
        return follows + 1

    def update(self, change: Callable[[int], tuple[DataFrame | None, DataFrame | None]], attempts: int = 5, note: dict | None = None) -> int:
        """Commits what ``change(version)`` returns, anew from the newer version where another writer was first."""
        for _ in range(attempts - 1):
            follows = self.version()
            try:
                return self.commit(*change(follows), follows, note)
            except Conflict:
                continue
        follows = self.version()
        return self.commit(*change(follows), follows, note)

    def compact(self) -> int:
        """Commits the table as one base; the rows stay the same."""
        follows = self.version()
        folder = self._write(self.load(follows).withColumn(DELETED, F.lit(False)))
        self.log.commit(follows + 1, {"segments": [folder], "note": self.note(follows)})
        return follows + 1

    def vacuum(self, keep: int = 2) -> int:
        """Drops folders that none of the last ``keep`` manifests lists; returns their number.  No writer may be at work."""
        used = {f for n in self.log.numbers()[-keep:] for f in self.log.read(n)["segments"]}
        gone = [f for f in self.log.folders() if f not in used]
        for f in gone:
            self.log.drop(f)
        return len(gone)


class Published:
    """Builds with increasing versions: the current one, and the one before it to fall back on."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.log = spark, Log(spark, root)

    @staticmethod
    def _digest(df: DataFrame) -> Column:
        return F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")

    def publish(self, df: DataFrame, version: int) -> None:
        """``df`` becomes current and what was current previous, in one commit; a version that doesn't increase is refused."""
        last = self.log.last()
        now = last[1]["current"] if last else None
        if now is not None and version <= now["version"]:
            raise ValueError(f"version {version} does not follow {now['version']}")
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.log.root}/{folder}")
        written = self.spark.read.schema(df.schema).parquet(f"{self.log.root}/{folder}")
        r = written.agg(F.count("*").alias("n"), self._digest(written).alias("digest")).first()
        build = {"version": version, "folder": folder, "entry_count": r.n, "digest": r.digest, "schema": df.schema.json()}
        self.log.commit(last[0] + 1 if last else 1, {"current": build, "previous": now})

    def manifest(self, slot: str = "current") -> dict | None:
        last = self.log.last()
        return last[1][slot] if last else None

    def _load(self, build: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(build["schema"]))
        df = self.spark.read.schema(schema).parquet(f"{self.log.root}/{build['folder']}")
        if df.agg(self._digest(df)).first()[0] != build["digest"]:
            raise ValueError(f"version {build['version']} of {self.log.root} is damaged")
        return df

    def load(self, version: int | None = None) -> tuple[int, DataFrame] | None:
        """(version, rows): the given one, or the current one, or the previous where the current one is damaged or gone."""
        if version is not None:
            for n in reversed(self.log.numbers()):
                if (build := self.log.read(n)["current"])["version"] == version:
                    return version, self._load(build)
            raise ValueError(f"{self.log.root} has no version {version}")
        last = self.log.last()
        if last is None:
            return None
        now, before = last[1]["current"], last[1]["previous"]
        try:
            return now["version"], self._load(now)
        except (ValueError, PySparkException):
            if before is None:
                raise
            return before["version"], self._load(before)
