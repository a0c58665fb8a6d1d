"""Reading and writing tables: Parquet and JSON sources, atomic versioned overwrite, key-wise upsert."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .commits import CommitLog, refuse_if_read_only
from .schemas import conform


def read(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet or versioned table, conformed to ``schema`` if given; the columns that are not used are never read."""
    if schema is not None and exists(spark, f"{path}/versions"):
        return VersionedTable(spark, path, schema).read()
    df = spark.read.parquet(path)
    return conform(df, schema) if schema else df


def writable(spark: SparkSession, path: str, schema: T.StructType) -> VersionedTable:
    """The versioned table at ``path``; a plain Parquet table that is there becomes its first version."""
    refuse_if_read_only(spark)
    table = VersionedTable(spark, path, schema)
    if not exists(spark, f"{path}/versions") and exists(spark, path):
        table.overwrite(read(spark, path, schema))
    return table


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for what all machines must see. Where it names none, a temporary one on this
    machine will do if Spark runs on it alone; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="siftspark-")
    return _own_folders[context.applicationId]


_own_folders: dict[str, str] = {}


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver has, as a relation that Spark plans with their true size."""
    fields = T.StructType.fromDDL(schema)
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=fields.names), fields)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores, if its scan has fewer: for work that costs more than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settled(df: DataFrame) -> DataFrame:
    """The rows of ``df``, which are known to be few, computed once: what is built on them plans as over a literal table."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file at any path that Spark can write."""
    refuse_if_read_only(spark)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of any database whose driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits from a JSON file: a list of hits, an object with ``hits``, or one hit."""
    df = spark.read.option("multiLine", True).json(path)
    return df.select(F.explode("hits").alias("h")).select("h.*") if "hits" in df.columns else df


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def vector_dims(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The distinct lengths of the vectors."""
    return vectors.select(F.size(column).cast("long").alias("dims")).distinct()


class VersionedTable:
    """A table of segments: one written whole, and after it one for each upsert, holding the new rows only.

    Every version is a pointer file that lists its segments (``CommitLog``), so a reader always finds a whole version, and a
    write that fails leaves the version before. Of two upserts at once the one that commits later is the later segment; a
    whole overwrite replaces what is there when it commits. Where ``MERGE`` segments of a size follow each other they are merged into one,
    so a row is rewritten as often as the logarithm of the table's size."""

    #: Segments of like size that are merged, and how sizes are told apart.
    MERGE = 4

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, guard: Callable[[], None] | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.log = CommitLog(spark, root, guard)

    def current(self) -> tuple[list[str], list[str]]:
        """The segments of the newest version, oldest first, and the key columns by which they are merged."""
        state = self.log.newest()[1] or {"segments": [], "keys": []}
        return state["segments"], state["keys"]

    def _written(self, df: DataFrame, keys: list[str] | None = None) -> str:
        """Writes a segment; by ``keys``, if given, in ranges of the first key and with a bloom filter of it, so that a lookup of a
        key skips the files and row groups that cannot have it."""
        refuse_if_read_only(self.spark)
        name = f"s-{uuid.uuid4().hex}"
        out = df.select(*self.schema.names)
        if keys:
            out = out.repartitionByRange(keys[0]).sortWithinPartitions(*keys)
            writer = out.write.option(f"parquet.bloom.filter.enabled#{keys[0]}", "true")
        else:
            writer = out.write
        writer.parquet(f"{self.root}/{name}")
        return name

    def _segment(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}")

    def _bytes(self, name: str) -> int:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()

    def _merged(self, segments: list[str], keys: list[str]) -> DataFrame:
        if len(segments) == 1:
            return self._segment(segments[0])
        for i, name in enumerate(segments[1:], 1):
            more = self._segment(name).withColumn("_nth", F.lit(i))
            late = more if i == 1 else late.unionByName(more)
        # of each key the row of the newest segment; all but one written whole have one for each key
        others = F.struct("_nth", *(c for c in self.schema.names if c not in keys))
        newest = late.groupBy(*keys).agg(F.max(others).alias("_row")).select(*keys, "_row.*").select(*self.schema.names)
        return upsert(self._segment(segments[0]), newest, keys, distinct=True)

    def read(self) -> DataFrame:
        segments, keys = self.current()
        return self._merged(segments, keys) if segments else self.spark.createDataFrame([], self.schema)

    def overwrite(self, df: DataFrame, keys: list[str] | None = None) -> None:
        name = self._written(df, keys)
        self.log.commit(lambda _: {"segments": [name], "keys": keys or []})

    def upsert(self, new: DataFrame, keys: list[str]) -> None:
        """Rows of ``new``, one for each key (see ``one_row``), replace those of equal keys."""
        new = one_row(conform(new, self.schema), keys)
        had = self.current()[1]
        if had and had != keys:
            raise ValueError(f"{self.root} is kept by {had}, not by {keys}")
        name = self._written(new, keys)
        self.log.commit(lambda state: {"segments": [*(state or {"segments": []})["segments"], name], "keys": keys})
        self.compact()

    def compact(self) -> None:
        """Merges the newest segments while ``MERGE`` of them, or more, are of like size."""
        while True:
            segments, keys = self.current()
            size = [self._bytes(x) for x in segments]
            run = 1
            while run < len(segments) and size[-run - 1] < self.MERGE * max(sum(size[-run:]), 1):
                run += 1
            if run < self.MERGE:
                return
            old = segments[-run:]
            merged = self._written(self._merged(old, keys), keys)
            if not self.log.commit(lambda state: replaced(state, old, merged)):
                return

    def lookup(self, key: str, values: list) -> DataFrame:
        """The rows of a few values of the first key column: the filter reaches the scan of every segment, which skips what
        cannot have them."""
        segments, keys = self.current()
        if not segments or keys[:1] != [key]:
            return self.read().where(F.col(key).isin(values))
        parts = [self._segment(x).where(F.col(key).isin(values)).withColumn("_nth", F.lit(i)) for i, x in enumerate(segments)]
        rows = functools.reduce(DataFrame.unionByName, parts)
        if len(segments) == 1:
            return rows.drop("_nth")
        others = F.struct("_nth", *(c for c in self.schema.names if c not in keys))
        return rows.groupBy(*keys).agg(F.max(others).alias("_row")).select(*keys, "_row.*").select(*self.schema.names)

    def vacuum(self, keep: int = 2, grace: float = 3600.0) -> None:
        """Removes all but the newest ``keep`` versions, and older segments that none of these has."""
        self.log.vacuum(lambda state: set(state["segments"]), keep, grace)


def replaced(state: dict | None, old: list, new: object) -> dict | None:
    """The state with the run ``old`` of its segments replaced by ``new``; None if they are not there any more."""
    segments = (state or {"segments": []})["segments"]
    for i in range(len(segments) - len(old) + 1):
        if segments[i : i + len(old)] == old:
            return state | {"segments": [*segments[:i], new, *segments[i + len(old) :]]}
    return None


def one_row(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: of several the one that is greatest in its other columns, compared in turn, nulls least."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, distinct: bool = False) -> DataFrame:
    """``old`` with the rows of ``new``, one for each key, in place of those of equal keys; ``distinct``: ``new`` has no key
    twice."""
    new = new if distinct else one_row(new, keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def update(old: DataFrame, new: DataFrame, key: str, columns: list[str], keep_old: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with ``columns`` from the row of equal key in ``new``; those in ``keep_old`` only where new is not null."""
    fresh = new.select(F.col(key), F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in columns))
    got = old.join(fresh, key, "left")
    value = {c: F.coalesce(f"_{c}", c) if c in keep_old else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return got.select(*(value[c].alias(c) if c in value else F.col(c) for c in old.columns))
