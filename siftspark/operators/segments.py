"""Upkeep of a text index: segments with tombstones, merged by level, as in a log-structured merge tree.

An upsert or deletion writes one segment: the postings, lengths and vocabulary of the new rows only, and the ids that it makes
dead in older segments. Counts of rows and tokens are kept in the commits, so that BM25's ``N`` and average length cost
nothing; document frequencies come from the living occurrences of a query's terms. Readers join the few occurrences that
they found with the tombstones. Segments of like size are merged when there are ``MERGE`` of them, so each row is
rewritten as often as the logarithm of the index; dead rows go when they are merged with what made them dead.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.commits import CommitConflict, CommitLog, refuse_if_read_only
from ..sources.tables import replaced
from .lexical import Index, build_index, listed, opened, postings_schema, read_index, write_postings, write_vocabulary, written_lengths


class SegmentedIndex:
    #: Segments of like size that are merged.
    MERGE = 4
    #: Tombstones that are sent to every task; more are joined by a shuffle.
    MOST_SENT = 1_000_000
    #: Commits that find another writer's before they give up; each does its work again.
    TRIES = 5

    def __init__(self, spark: SparkSession, root: str, fields: list[str], porter: bool = False, id_type: str = "string"):
        self.spark, self.root, self.fields, self.porter, self.id_type = spark, root.rstrip("/"), fields, porter, id_type
        self.log = CommitLog(spark, self.root)

    def segments(self) -> list[dict]:
        """Newest last: name, live rows and tokens that it added (less those it made dead), rows it holds, and whether it has any dead."""
        return (self.log.newest()[1] or {"segments": []})["segments"]

    # --- reading ------------------------------------------------------------------------------------

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], T.StructType.fromDDL(schema))
        return functools.reduce(DataFrame.unionByName, parts)

    def _part(self, found: list[dict], name: str, schema: str) -> DataFrame:
        """One table of all segments, with ``seg``."""
        columns = T.StructType.fromDDL(schema).names
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{s['name']}/{name}").select(*columns, F.lit(n).alias("seg")) for n, s in enumerate(found)]
        return self._union(parts, f"{schema}, seg int")

    def _dead(self, found: list[dict]) -> DataFrame:
        """(id, until): dead in the segments below ``until``."""
        schema = f"id {self.id_type}"
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{s['name']}/dead").withColumn("until", F.lit(n)) for n, s in enumerate(found) if s["dead"]]
        dead = self._union(parts, f"{schema}, until int").groupBy("id").agg(F.max("until").alias("until"))
        return F.broadcast(dead) if sum(s["held"] - s["rows"] for s in found) <= self.MOST_SENT else dead

    def _live(self, rows: DataFrame, found: list[dict]) -> DataFrame:
        if not any(s["dead"] for s in found):
            return rows
        return rows.alias("o").join(self._dead(found).alias("d"), (F.col("o.id") == F.col("d.id")) & (F.col("o.seg") < F.col("d.until")), "left_anti")

    def lengths(self, found: list[dict] | None = None) -> DataFrame:
        """(id, dl, hash, seg) of the living rows."""
        found = self.segments() if found is None else found
        return self._live(self._part(found, "lengths", f"id {self.id_type}, dl long, hash long"), found)

    def read(self) -> Index:
        """The index as it stands."""
        found = self.segments()
        postings = self._part(found, "postings", postings_schema(self.id_type))
        vocabulary = self._part(found, "vocabulary", "term string, stem string").select("term", "stem").distinct() if self.porter else None
        dead = self._dead(found) if any(s["dead"] for s in found) else None
        stats = sum(s["rows"] for s in found), sum(s["tokens"] for s in found)
        return Index(postings, self.lengths(found).select("id", "dl"), self.porter, vocabulary, dead, stats)

    # --- writing ------------------------------------------------------------------------------------

    def _write(self, postings: DataFrame, lengths: Callable[[str], DataFrame], dead: DataFrame | None) -> dict:
        """``lengths`` gives (id, dl, hash), for the path where the postings are."""
        refuse_if_read_only(self.spark)
        name = f"s-{uuid.uuid4().hex}"
        path = f"{self.root}/{name}"
        write_postings(postings, path)
        if self.porter:
            write_vocabulary(self.spark, path)
        lengths(path).select("id", "dl", "hash").write.mode("overwrite").parquet(f"{path}/lengths")
        if dead is not None:
            dead.write.parquet(f"{path}/dead")
        held = self.spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        return {"name": name, "rows": held["n"], "tokens": held["tokens"], "held": held["n"], "dead": dead is not None}

    def _rows(self, text: DataFrame) -> tuple[DataFrame, Callable[[str], DataFrame]]:
        """The postings of ``text``, one row for each id, and its lengths, as ``_write`` takes them."""
        told = F.xxhash64(*(F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in self.fields))
        rows = text.select(F.col("id").cast(self.id_type).alias("id"), *self.fields)
        return build_index(rows, self.fields).postings, lambda path: written_lengths(rows.select("id", told.alias("hash")), path)

    def _change(self, text: DataFrame | None, gone: DataFrame) -> None:
        """Commits a segment with ``text``, which makes the living among the ids ``gone`` dead."""
        segment = None
        for _ in range(self.TRIES):
            version, state = self.log.newest()
            found = (state or {"segments": []})["segments"]
            dying = self.lengths(found).join(gone.select(F.col("id").cast(self.id_type).alias("id")).distinct(), "id", "left_semi")
            less = dying.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
            if text is None and not less["n"]:
                return
            if segment is None:
                empty = self.spark.createDataFrame([], T.StructType.fromDDL(", ".join(f"`{c}` {'string' if c != 'id' else self.id_type}" for c in ["id", *self.fields])))
                segment = self._write(*self._rows(empty if text is None else text), None)
            dead = less["n"] > 0
            if dead:
                dying.select("id").write.mode("overwrite").parquet(f"{self.root}/{segment['name']}/dead")
            new = segment | {"rows": segment["held"] - less["n"], "tokens": segment["tokens"] - less["tokens"], "dead": dead}
            # what is dead was read at this version, so only the next will do
            if self.log.put(version + 1, {"segments": [*found, new]}):
                return self.compact()
        raise CommitConflict(f"{self.root} changed {self.TRIES} times while a segment was written")

    def upsert(self, text: DataFrame) -> None:
        """Rows of ``text`` (id and fields, one row for each id) are new or replace those of equal ids."""
        self._change(text, text.select("id"))

    def delete(self, ids: DataFrame) -> None:
        """The rows of ``ids`` (id) are no longer found; unknown ids do nothing."""
        self._change(None, ids)

    def refresh(self, text: DataFrame) -> dict[str, int]:
        """Makes the index that of ``text``: rows whose fields have another hash than when they were indexed are indexed anew, those
        that are gone are deleted. Texts are hashed, but only changed ones are split and written."""
        told = F.xxhash64(*(F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in self.fields))
        have = self.lengths().select("id", F.col("hash").alias("had"))
        rows = text.withColumn("id", F.col("id").cast(self.id_type)).withColumn("hash", told)
        changed = rows.join(have, "id", "left").where("had is null or had <> hash").select("id", *self.fields).persist()
        gone = have.join(rows.select("id"), "id", "left_anti").select("id").persist()
        out = {"indexed": changed.count(), "deleted": gone.count()}
        if out["indexed"] or not self.segments():
            self.upsert(changed)
        if out["deleted"]:
            self.delete(gone)
        changed.unpersist()
        gone.unpersist()
        return out

    def compact(self) -> None:
        """Merges the newest segments while ``MERGE`` of them, or more, are of like size."""
        while True:
            found = self.segments()
            size = [max(s["held"], 1) for s in found]
            run = 1
            while run < len(found) and size[-run - 1] < self.MERGE * sum(size[-run:]):
                run += 1
            if run < self.MERGE:
                return
            old = found[-run:]
            whole = run == len(found)
            lengths = self.lengths(old)
            postings = self._part(old, "postings", postings_schema(self.id_type)).where("term is not null")
            if any(s["dead"] for s in old):
                postings = listed(self._live(opened(postings, "term", "field", "seg"), old))
            # what they made dead in older segments stays dead there
            dead = None if whole or not any(s["dead"] for s in old) else self._dead(old).select("id")
            merged = self._write(postings.drop("seg"), lambda _: lengths, dead)
            merged |= {"rows": sum(s["rows"] for s in old), "tokens": sum(s["tokens"] for s in old)}
            if not self.log.commit(lambda state: replaced(state, old, merged)):
                return

    def vacuum(self, keep: int = 2, grace: float = 3600.0) -> None:
        """Removes segments that none of the newest ``keep`` versions has."""
        self.log.vacuum(lambda state: {s["name"] for s in state["segments"]}, keep, grace)


def open_index(spark: SparkSession, path: str, fields: list[str], porter: bool, id_type: str = "string") -> Index:
    """The index at ``path``, kept in segments or written whole."""
    kept = SegmentedIndex(spark, path, fields, porter, id_type)
    return kept.read() if kept.segments() else read_index(spark, path)
