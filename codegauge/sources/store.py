"""A store of tables that changes as a whole.

Rows lie in folders of one bucket of one table, each written once by one commit and never
changed. A manifest names, for every table, the folder of each bucket. A commit writes the
buckets it changes into folders of its own and then publishes the next manifest under the next
number, which is one rename that fails where that number is taken. So readers see all tables
before a commit or after it, a job killed before its rename leaves the store as it was, and of
two jobs the later one finds its number taken, and starts again from what the other published.

    <store>/manifests/0000000042.json
    <store>/data/<commit>/<table>/bucket=7/part-….parquet
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TRIES = 20
BUCKET = "bucket"


@dataclass(frozen=True)
class Table:
    """One table of a manifest: its bucket key and number, its columns, and where each bucket lies."""

    key: str
    buckets: int
    schema: str
    folders: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Manifest:
    """What a store holds after commit ``number``; 0 is the empty store."""

    number: int = 0
    tables: Mapping[str, Table] = field(default_factory=dict)


class Store:
    """The tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.root = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def _system(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Published manifests, oldest first."""
        system, folder = self._system(), self._path("manifests")
        if not system.exists(folder):
            return []
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> Manifest:
        """The latest manifest, or the one with this number."""
        if number is None:
            number = max(self.numbers(), default=0)
        if number == 0:
            return Manifest()
        held = json.loads(self.spark.sparkContext.wholeTextFiles(self._path("manifests", f"{number:010d}.json").toString(), 1).first()[1])
        return Manifest(number, {n: Table(**t) for n, t in held["tables"].items()})

    def read(self, name: str, manifest: Manifest | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as one manifest has it, or only the given buckets of it."""
        table = (manifest or self.manifest()).tables[name]
        schema = StructType.fromJson(json.loads(table.schema))
        paths = [self._path(f).toString() for b, f in table.folders.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def touched(self, keys: DataFrame, key: str, table: Table) -> list[int]:
        """Buckets that hold some of the keys, at most ``buckets`` numbers."""
        return [r[0] for r in keys.select(bucket_of(F.col(key), table.buckets)).distinct().collect()]

    def write(self, commit: str, name: str, rows: DataFrame, table: Table) -> dict[str, str]:
        """Writes rows as folders of this commit; which folder each bucket is in."""
        place = f"data/{commit}/{name}"
        dealt = rows.withColumn(BUCKET, bucket_of(F.col(table.key), table.buckets))
        # a bucket with a very large run is split by size, small ones are written in one piece
        dealt.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(self._path(place).toString())
        found = [s.getPath().getName() for s in self._system().listStatus(self._path(place)) if s.isDirectory()]
        return {n.split("=")[1]: f"{place}/{n}" for n in found if n.startswith(f"{BUCKET}=")}

    def publish(self, manifest: Manifest) -> bool:
        """Makes a manifest the latest, unless its number has been taken."""
        body = json.dumps({"tables": {n: t.__dict__ for n, t in manifest.tables.items()}})
        draft = self._path("manifests", f".draft-{uuid.uuid4().hex}")
        system = self._system()
        out = system.create(draft, False)
        out.write(bytearray(body.encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 1)
        none[0] = self._hadoop.Options.Rename.NONE
        try:
            context.rename(draft, self._path("manifests", f"{manifest.number:010d}.json"), none)
        except Py4JJavaError as failure:
            system.delete(draft, False)
            if "FileAlreadyExistsException" in failure.java_exception.getClass().getName():
                return False
            raise
        return True

    def change(self, step: Callable[[Manifest, str], Mapping[str, Table]]) -> Manifest:
        """Publishes the tables that ``step`` makes of the latest manifest, as one commit.

        ``step(manifest, commit)`` writes below that commit's name. Where another job has
        published meanwhile, it is called again on what that job left.
        """
        for _ in range(TRIES):
            before, commit = self.manifest(), uuid.uuid4().hex
            changed = step(before, commit)
            after = Manifest(before.number + 1, {**before.tables, **changed})
            if self.publish(after):
                return after
            self._system().delete(self._path("data", commit), True)
        raise RuntimeError(f"{self.root}: other jobs published first {TRIES} times")

    def replace(
        self, rows: Mapping[str, DataFrame], keys: Mapping[str, str], gone: DataFrame | None = None, buckets: int = 64
    ) -> Manifest:
        """Replaces the rows of some keys in several tables at once; new tables are added.

        A key may have many rows, which are replaced together. ``gone`` (one column, named
        like the key) names the keys whose old rows go where that is more than those of the new
        rows. Only buckets that hold changed keys are read and written.
        """

        def step(before: Manifest, commit: str) -> dict[str, Table]:
            out = {}
            for name, new in rows.items():
                key = keys[name]
                table = before.tables.get(name) or Table(key, buckets, new.schema.json())
                leaving = (new if gone is None else gone).select(key).distinct()
                touched = self.touched(leaving, key, table)
                old = self.read(name, Manifest(0, {name: table}), touched)
                merged = old.join(leaving, key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
                out[name] = self._moved(table, touched, self.write(commit, name, merged, table))
            return out

        return self.change(step)

    @staticmethod
    def _moved(table: Table, touched: list[int], written: Mapping[str, str]) -> Table:
        kept = {b: f for b, f in table.folders.items() if int(b) not in touched}
        return Table(table.key, table.buckets, table.schema, {**kept, **written})

    def delete(self, name: str, condition, references: tuple[tuple[str, str, str], ...] = (), key: str = "id") -> Manifest:
        """Deletes the rows that meet a condition and all their descendants, in one commit.

        ``references`` are (child, column, parent). Level by level only buckets are read that
        can hold a child: where a table is bucketed by the reference, those of the parents that
        go. The ids that go are written beside the data, so each level starts from files.
        """

        def step(before: Manifest, commit: str) -> dict[str, Table]:
            out: dict[str, Table] = {}
            gone: dict[str, DataFrame] = {}

            def leave(child: str, lost, stays, within: list[int] | None) -> None:
                table = before.tables[child]
                rows = self.read(child, before, within)
                place = self._path("data", commit, f"gone-{child}").toString()
                lost(rows).select(*[c for c in dict.fromkeys((key, table.key)) if c in rows.columns]).write.parquet(place)
                gone[child] = self.spark.read.parquet(place)
                touched = self.touched(gone[child], table.key, table)
                if touched:
                    kept = stays(self.read(child, before, touched)).select(*rows.columns)
                    out[child] = self._moved(table, touched, self.write(commit, child, kept, table))

            meets = F.coalesce(condition, F.lit(False))
            leave(name, lambda rows: rows.where(meets), lambda rows: rows.where(~meets), None)
            for child, column, parent in references:
                if parent not in gone or key not in gone[parent].columns or child not in before.tables:
                    continue
                ids = gone[parent].select(F.col(key).alias(column)).distinct()
                table = before.tables[child]
                within = self.touched(ids, column, table) if table.key == column else None
                leave(
                    child,
                    lambda rows, ids=ids, column=column: rows.join(ids, column, "left_semi"),
                    lambda rows, ids=ids, column=column: rows.join(ids, column, "left_anti"),
                    within,
                )
            return out

        return self.change(step)

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests before the last ``keep`` and folders that none of those name; how many folders.

        Jobs that are writing must be over: their folders are not named yet.
        """
        system = self._system()
        numbers = self.numbers()
        named = {f.split("/")[1] for n in numbers[-keep:] for t in self.manifest(n).tables.values() for f in t.folders.values()}
        for n in numbers[:-keep]:
            system.delete(self._path("manifests", f"{n:010d}.json"), False)
        data = self._path("data")
        left = [s.getPath() for s in system.listStatus(data) if s.getPath().getName() not in named] if system.exists(data) else []
        for path in left:
            system.delete(path, True)
        return len(left)


def bucket_of(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
