"""Collections of notes as partitioned tables in the shared file system."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.operators import notes as notes_ops
from recallgrid.sources.stages import stage

PARTITIONS = 256
SALTS = 4


class CollectionExists(ValueError):
    """A collection of that name is there already."""


@dataclass(frozen=True)
class Collection:
    """Notes of all conversations under one path.

    Rows are placed by a hash of the conversation, so the number of folders is
    fixed however many conversations there are, and a conversation's notes are
    found by reading one folder.  Changes rewrite only the folders that hold a
    changed note: the new rows are staged first and then replace those folders
    (dynamic partition overwrite).  A job that dies on the way can be run again,
    as every change gives the same rows when repeated.  A folder whose last note
    goes keeps one row without an id, which readers leave out.
    """

    spark: SparkSession
    path: str
    partitions: int = PARTITIONS

    def exists(self) -> bool:
        try:
            self.spark.read.parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return False
            raise
        return True

    def bucket(self, conv: Column) -> Column:
        return F.pmod(F.xxhash64(conv.cast("string")), F.lit(self.partitions)).cast("int")

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """All notes, or those of some folders; the others are not listed in the plan."""
        return self._rows(buckets).drop("bucket")

    def _rows(self, buckets: Sequence[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path).filter(F.col("id").isNotNull())
        return rows if buckets is None else rows.filter(F.col("bucket").isin(list(buckets)))

    def conversation(self, conv_id: str) -> DataFrame:
        """Notes of one conversation; the other folders are not read."""
        at = self.bucket(F.lit(conv_id))
        return self._rows().filter(
            (F.col("bucket") == at) & (F.col("conv_id").cast("string") == conv_id)
        ).drop("bucket")

    def _place(self, notes: DataFrame) -> DataFrame:
        return notes.withColumn("bucket", self.bucket(F.col("conv_id")))

    def buckets_of(self, conversations: DataFrame) -> list[int]:
        """The folders of these conversations (``conv_id``): at most as many numbers as folders."""
        return self._numbers(self._place(conversations.select("conv_id")))

    def _numbers(self, placed: DataFrame) -> list[int]:
        return sorted(placed.agg(F.collect_set("bucket")).first()[0])

    def _holding(self, wanted: DataFrame) -> list[int]:
        """The folders that hold one of the ids; only ids are read, and only folders of ``conv_id`` where given."""
        stored = self._rows(self.buckets_of(wanted) if "conv_id" in wanted.columns else None)
        return self._numbers(stored.select("bucket", "id").join(wanted.select("id").distinct(), "id", "left_semi"))

    def create(self, like: DataFrame) -> None:
        """An empty collection: one file in the first folder holds the schema."""
        like.limit(0).write.mode("errorifexists").parquet(f"{self.path}/bucket=0")

    def add(self, notes: DataFrame, key: Sequence[str] = ("id",)) -> list[int]:
        """Append the notes whose key the collection does not hold yet; returns the folders concerned.

        Of several new rows with one key the last is kept, by sequence number and
        then by content.  Only keys in the folders of these notes are read, so an
        append costs what its conversations hold, and repeating one changes nothing.
        """
        order = F.struct(*[F.col(c) for c in ("seq", "content") if c in notes.columns], F.xxhash64(*notes.columns))
        last = notes.groupBy(*key).agg(F.max_by(F.struct(*notes.columns), order).alias("_note"))
        new = self._place(last.select("_note.*"))
        touched = self.buckets_of(notes)
        if self.exists():
            stored = self._rows(touched).select("bucket", *key)
            new = new.join(stored, ["bucket", *key], "left_anti")
        self._write(new, "append")
        return touched

    def _write(self, placed: DataFrame, mode: str) -> None:
        # At most SALTS files a folder and write; sorted, so that row groups can be skipped.
        salt = F.pmod(F.xxhash64("id"), F.lit(SALTS))
        dealt = placed.repartition(F.col("bucket"), salt).sortWithinPartitions("bucket", "conv_id")
        writer = dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(self.path)

    def _rewrite(self, buckets: list[int], change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the notes of these folders by ``change`` of them."""
        if not buckets:
            return buckets
        new = stage(change(self._rows(buckets)), "rewritten")
        # Every folder keeps a row, since only folders that are written to are replaced.
        numbers = self.spark.createDataFrame([(b,) for b in buckets], "bucket int")
        empty = numbers.join(new.select("bucket").distinct(), "bucket", "left_anti")
        marks = empty.select(*[F.col(c) if c == "bucket" else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns])
        self._write(new.unionByName(marks), "overwrite")
        return buckets

    def update(self, changes: DataFrame, encode: Callable[[Column], Column] | None = None) -> list[int]:
        """Set the non-null fields of ``changes`` (one row per id); returns the folders rewritten.

        A ``conv_id`` in ``changes`` only says where to look: notes stay in their
        conversation.  Unknown ids change nothing.
        """
        fields = changes.drop("conv_id", "bucket")
        return self._rewrite(self._holding(changes), lambda old: notes_ops.update_notes(old, fields, encode))

    def delete(self, ids: DataFrame) -> list[int]:
        """Remove the notes with these ids; returns the folders rewritten."""
        return self._rewrite(self._holding(ids), lambda old: notes_ops.delete_notes(old, ids))

    def consolidate(
        self, log: DataFrame, version: str = "version", encode: Callable[[Column], Column] | None = None
    ) -> list[int]:
        """Rebuild the notes from themselves and the changes logged since; returns the folders rewritten.

        The many small files that appends left in those folders become at most ``SALTS``.
        """
        changes = notes_ops.latest_changes(log.drop("conv_id"), version)
        return self._rewrite(self._holding(log), lambda old: notes_ops.update_notes(old, changes, encode))

    def snapshot(self, path: str) -> Collection:
        """An independent copy under another path, in one distributed pass."""
        copy = Collection(self.spark, path, self.partitions)
        if copy.exists():
            raise CollectionExists(f"{path} already exists")
        self._rows().write.partitionBy("bucket").parquet(path)
        return copy


def open_collection(
    spark: SparkSession,
    path: str,
    extend: bool = False,
    like: DataFrame | None = None,
    partitions: int = PARTITIONS,
) -> Collection:
    """Open or create a collection.

    An existing one is opened only with ``extend``; otherwise that is an error.
    A new one is created with the schema of ``like`` if given, and else by the
    first ``add``.
    """
    collection = Collection(spark, path, partitions)
    if collection.exists():
        if not extend:
            raise CollectionExists(f"{path} already exists")
    elif like is not None:
        collection.create(like)
    return collection
