"""A table of points that takes small changes without being rewritten: merged on read.

The table is a folder of segments and numbered commits. A commit names the live segments, each with a sequence number: rows (points) or tombstones (documents whose older points are gone). A change writes only its own rows as a new segment and commits the list with it added; a reader takes, of each point, the row of the greatest sequence number, unless a later tombstone names its document. Writers meet at the commit alone: the one that comes second takes the newer list and commits again, its rows stay as they are.

Compaction merges neighbouring segments of one size tier into one, which keeps their order; a tombstone goes when nothing older than it is left. Old commits stay readable until ``vacuum``.

With ``indexed`` fields a large segment is dealt to files along a Z-order of them, and each segment keeps the least and greatest value of every file. A read with bounds on these fields opens only the files of the oldest segment that can hold such rows; later segments are read whole, as a newer version of a point that no longer fits must still hide the older one. Keys and owners of a large segment have Parquet Bloom filters.

Reading shuffles no segment as a whole for the sake of small changes: the oldest segment is met by the keys of the later ones and by the tombstones with anti-joins, which the planner broadcasts where those are small and sorts where they are not.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from . import commits

#: Segments of a size tier that are merged into one, and how often a commit is tried again.
FAN, TRIES = 4, 50
SEQUENCE = "sequence_"


@dataclass(frozen=True)
class Segment:
    kind: str  # rows or gone
    folder: str
    sequence: int
    rows: int
    size: int

    @property
    def tier(self) -> int:
        return int(math.log(max(self.size, 1), FAN))


def _load(text: str) -> list[Segment]:
    return [Segment(**s) for s in json.loads(text)["segments"]]


def _text(segments: list[Segment], what: str) -> str:
    return json.dumps({"what": what, "segments": [vars(s) for s in segments]})


@dataclass(frozen=True)
class Deltas:
    """The table in ``root``; ``key`` names a point, ``owner`` the column that tombstones name."""

    root: str
    key: str = "point_id"
    owner: str = "doc_id"
    indexed: tuple[str, ...] = ()

    # -- reading

    def exists(self, spark: SparkSession) -> bool:
        return bool(commits.numbers(spark, self.root))

    def versions(self, spark: SparkSession) -> list[int]:
        return commits.numbers(spark, self.root)

    def segments(self, spark: SparkSession, version: int | None = None) -> list[Segment]:
        """The live segments of a version (the newest), oldest first."""
        if version is not None:
            return _load(commits.read(spark, self.root, version))
        found = commits.last(spark, self.root)
        if found is None:
            raise FileNotFoundError(f"no table in {self.root}")
        return _load(found[1])

    def read(self, spark: SparkSession, version: int | None = None, within: dict[str, tuple] | None = None) -> DataFrame:
        """The points as of a version (the newest). ``within`` gives indexed fields bounds (low, high), both included, null where open; rows outside them are left out, rows without a value too."""
        unknown = set(within or {}) - set(self.indexed)
        if unknown:
            raise ValueError(f"not indexed: {', '.join(sorted(unknown))}")
        found = self._resolve(spark, self.segments(spark, version), within).drop(SEQUENCE)
        for name, (low, high) in (within or {}).items():
            found = found.where(F.col(name).isNotNull() & (F.lit(True) if low is None else F.col(name) >= low) & (F.lit(True) if high is None else F.col(name) <= high))
        return found

    def files(self, spark: SparkSession, segment: Segment, within: dict[str, tuple] | None = None) -> list[str]:
        """The files of a segment that can hold rows within the bounds; all of them where nothing is known of them."""
        stats = f"{self.root}/_stats/{segment.folder}"
        fs, p = commits.store(spark, stats)
        if not within or not fs.exists(p):
            return [f"{self.root}/{segment.folder}"]
        found = spark.read.parquet(stats)
        for name, (low, high) in within.items():
            known = F.col(f"low_{name}").isNotNull()
            found = found.where(known & (F.lit(True) if high is None else F.col(f"low_{name}") <= high) & (F.lit(True) if low is None else F.col(f"high_{name}") >= low))
        return [f"{self.root}/{segment.folder}/{r.file}" for r in found.select("file").collect()]

    def _rows(self, spark: SparkSession, segments: list[Segment], *columns: str, paths: list[str] | None = None) -> DataFrame:
        """The rows of several segments in one scan, each with its segment's sequence number. Columns that came later are null in older segments."""
        whole = [f"{self.root}/{s.folder}" for s in segments]
        reader = spark.read.option("mergeSchema", "true")
        if paths == []:  # no file can hold such rows
            return reader.parquet(*whole).where("false").select(*(columns or ["*"]), F.lit(0).cast("long").alias(SEQUENCE))
        df = reader.parquet(*(paths or whole))
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        known = F.create_map(*[F.lit(x) for s in segments for x in (s.folder, s.sequence)])
        return df.select(*(columns or ["*"]), F.element_at(known, folder).cast("long").alias(SEQUENCE))

    def _resolve(self, spark: SparkSession, segments: list[Segment], within: dict[str, tuple] | None = None) -> DataFrame:
        rows, gone = ([s for s in segments if s.kind == k] for k in ("rows", "gone"))
        base, later = rows[:1], rows[1:]
        out = self._rows(spark, base, paths=self.files(spark, base[0], within))
        if later:
            keys = self._rows(spark, later, self.key).select(self.key).distinct()
            newest = Window.partitionBy(self.key).orderBy(F.desc(SEQUENCE))
            change = self._rows(spark, later).withColumn("place_", F.row_number().over(newest)).where("place_ = 1").drop("place_")
            out = out.join(keys, self.key, "left_anti").unionByName(change, allowMissingColumns=True)
        if gone:
            tombs = self._rows(spark, gone).groupBy(self.owner).agg(F.max(SEQUENCE).alias("gone_")).withColumnRenamed(self.owner, "owner_")
            out = out.join(tombs, (F.col(self.owner) == F.col("owner_")) & (F.col("gone_") > F.col(SEQUENCE)), "left_anti")
        return out

    # -- writing

    def _write(self, df: DataFrame, kind: str, large: bool = False) -> Segment:
        """A new segment; its sequence number is given at the commit. A ``large`` one, which may be the oldest, is made for skipping: clustered, with bounds of its files and Bloom filters."""
        folder = f"{kind}-{uuid.uuid4().hex}"
        spark, keep = df.sparkSession, [f for f in self.indexed if large and f in df.columns]
        writer = (self._clustered(df, keep) if keep else df).write.mode("errorifexists")
        for c in {self.key, self.owner} & set(df.columns) if large else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.root}/{folder}")
        if keep:
            file = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
            bounds = [x for f in keep for x in (F.min(f).alias(f"low_{f}"), F.max(f).alias(f"high_{f}"))]
            spark.read.schema(df.schema).parquet(f"{self.root}/{folder}").groupBy(file).agg(*bounds, F.count("*").alias("n")).coalesce(1).write.parquet(f"{self.root}/_stats/{folder}")
        fs, p = commits.store(spark, f"{self.root}/{folder}")
        n = df.sparkSession.read.schema(df.schema).parquet(f"{self.root}/{folder}").count()
        return Segment(kind, folder, 0, n, fs.getContentSummary(p).getLength())

    def _clustered(self, df: DataFrame, fields: list[str]) -> DataFrame:
        """Rows in the Z-order of the fields: each field's value as one of 256 steps of its own distribution, bits taken in turn, the first field's first. Numbers and times are measured as they are, texts by their first four bytes."""
        kinds = dict(df.dtypes)
        texts = [f for f in fields if kinds[f] == "string"]
        number = {f: F.conv(F.hex(F.substring(F.encode(F.rpad(f, 4, "\0"), "UTF-8"), 1, 4)), 16, 10).cast("double") if f in texts else F.col(f).cast("timestamp").cast("double") if kinds[f].startswith(("timestamp", "date")) else F.col(f).cast("double") for f in fields}
        steps = df.select(*(F.percentile_approx(number[f], F.array(*[F.lit(i / 256) for i in range(1, 256)]), F.lit(2000)).alias(f) for f in fields)).first()
        z = F.lit(0).cast("long")
        for k, f in enumerate(fields):
            marks = F.array(*map(F.lit, steps[f] or [0.0]))  # a frequent value is there several times, so steps are quantiles
            at = number[f]
            step = F.coalesce(F.size(F.filter(marks, lambda m: m <= at)), F.lit(0)).cast("long")  # noqa: B023  used at once
            for bit in range(8):
                z = z.bitwiseOR(F.shiftleft(F.shiftright(step, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(fields) + len(fields) - 1 - k))
        return df.withColumn("z_", z).repartitionByRange("z_").sortWithinPartitions("z_").drop("z_")

    def _commit(self, spark: SparkSession, change, what: str) -> int:
        """Commit what ``change`` makes of the newest list; again with the newer one where another writer was first. A change that answers None gives up."""
        for _ in range(TRIES):
            found = commits.last(spark, self.root)
            number, have = (found[0], _load(found[1])) if found else (0, [])
            new = change(have)
            if new is None:
                return number
            try:
                commits.write(spark, self.root, number + 1, _text(new, what))
                return number + 1
            except commits.Conflict:
                continue
        raise commits.Conflict(f"{self.root}: other writers were first {TRIES} times")

    def create(self, points: DataFrame, reset: bool = False) -> bool:
        """The first version; a table that is there already stays unless ``reset``. False if it stayed."""
        spark = points.sparkSession
        if self.exists(spark) and not reset:
            return False
        new = self._write(points.dropDuplicates([self.key]), "rows", large=True)
        before = self._commit(spark, lambda have: None if have and not reset else [_at(new, _next(have))], "create")
        return bool(before)

    def change(self, points: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """One commit: the points of documents in ``gone`` leave, then ``points`` enter; those of a known key replace it. Of repeated keys in ``points`` one stays. Writes what it is given, nothing else; the number of the commit."""
        spark = (points if points is not None else gone).sparkSession
        made = []
        if gone is not None:
            made.append(self._write(gone.select(self.owner).where(F.col(self.owner).isNotNull()).distinct(), "gone"))
        if points is not None:
            made.append(self._write(points.dropDuplicates([self.key]), "rows"))

        def add(have: list[Segment]) -> list[Segment]:
            n = _next(have)
            use = [s for s in made if s.rows or (s.kind == "rows" and not have)]
            return have + [_at(s, n + i) for i, s in enumerate(use) if s.kind == "rows" or have]

        return self._commit(spark, add, "change")

    def upsert(self, points: DataFrame) -> int:
        return self.change(points=points)

    def forget(self, documents: DataFrame) -> int:
        return self.change(gone=documents)

    # -- upkeep

    def due(self, segments: list[Segment]) -> list[Segment]:
        """Neighbouring segments that should be merged: FAN or more segments of rows of which none is in a higher tier than the smallest run of them asks for, and the tombstones between them; none if nothing is due."""
        rows = [s for s in segments if s.kind == "rows"]
        for tier in sorted({s.tier for s in rows}):
            run: list[Segment] = []
            for s in rows:
                run = [*run, s] if s.tier <= tier else []
                if len(run) >= FAN and (s is rows[-1] or rows[rows.index(s) + 1].tier > tier):
                    return [s for s in segments if run[0].sequence <= s.sequence <= run[-1].sequence]
        return []

    def compact(self, spark: SparkSession, whole: bool = False) -> bool:
        """Merge what is due (or everything); false if nothing was, or another writer has merged some of it first."""
        have = self.segments(spark)
        some = have if whole else self.due(have)
        if len(some) < 2:
            return False
        oldest = some[0] == have[0]
        merged = self._write(self._resolve(spark, some).drop(SEQUENCE), "rows", large=oldest)

        def replace(now: list[Segment]) -> list[Segment] | None:
            if any(s not in now for s in some):
                return None
            keep = [s for s in some if s.kind == "gone" and not oldest]
            rest = [s for s in now if s not in some] + keep + [_at(merged, max(s.sequence for s in some if s.kind == "rows"))]
            return sorted(rest, key=lambda s: (s.sequence, s.kind))

        before = commits.last(spark, self.root)[0]
        return self._commit(spark, replace, "compact") > before

    def vacuum(self, spark: SparkSession, keep: int = 1) -> int:
        """Delete commits but the last ``keep`` and segments that none of those names; the number of segments. Not while others write: what they have not committed would go too."""
        have = commits.numbers(spark, self.root)
        live = {s.folder for n in have[-keep:] for s in self.segments(spark, n)}
        for n in have[:-keep]:
            commits.forget(spark, self.root, n)
        fs, p = commits.store(spark, self.root)
        old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith(("rows-", "gone-")) and s.getPath().getName() not in live]
        for x in old:
            fs.delete(x, True)
            store, stats = commits.store(spark, f"{self.root}/_stats/{x.getName()}")
            store.delete(stats, True)
        return len(old)


class Catalogue:
    """What is made of a table, kept until the table has changed: ``make`` gets the points of the newest version."""

    def __init__(self, table: Deltas, make: Callable[[DataFrame], DataFrame]):
        self.table, self.make = table, make
        self.version, self.held = None, None

    def stale(self, spark: SparkSession) -> bool:
        return self.version != max(self.table.versions(spark), default=None)

    def get(self, spark: SparkSession) -> DataFrame:
        """The catalogue of the newest version, made anew only where the kept one is stale."""
        newest = max(self.table.versions(spark), default=None)
        if newest is None:
            raise FileNotFoundError(f"no table in {self.table.root}")
        if newest != self.version:
            self.held, self.version = cut(self.make(self.table.read(spark, newest))), newest
        return self.held


def _next(have: list[Segment]) -> int:
    return max((s.sequence for s in have), default=0) + 1


def _at(s: Segment, sequence: int) -> Segment:
    return Segment(s.kind, s.folder, sequence, s.rows, s.size)
