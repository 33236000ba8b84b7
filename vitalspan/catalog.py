"""A catalog: a folder of Parquet tables with a version, opened for reading behind a chain of guards.

A table is a list of folders that the catalog's pointer names. Rows are written beside what is there, then a new pointer
is written under the next number: what is appended rewrites nothing, a reader sees one whole version, a rewrite may read the
table it replaces, and several tables change at once in a transaction. No pointer is deleted before the next one stands, so
a crash leaves the version before. Folders that neither of the last two pointers names go with the next write.

Deleting rewrites no data either: a deletion vector, a small table of bitmaps of row positions by file, is named beside the
folders and merged when they are read. A folder is written anew once a share of its rows is dead. For tables with a date
the pointer knows the first and last date of each folder, so whoever asks for some days reads only folders that may have them.
For tables with a key each folder has a Bloom filter of its keys beside it, so that new rows are held against those folders
alone that may have one of their keys."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.operators import filters, series, workouts, writes
from vitalspan.schemas import CORPUS, INDEX, KEYWORDS


class CatalogError(RuntimeError):
    """Something about the catalog, with what to do about it."""


class NotFound(CatalogError):
    pass


class VersionMismatch(CatalogError):
    pass


class RollupMissing(CatalogError):
    pass


#: Rows of a deletion vector: bitmaps of 32,768 positions (from 1) of a file.
VECTOR = "folder string, file string, bucket long, bits binary, n long"


def _folders(state: dict) -> set[str]:
    """All folders that a pointer names."""
    vectors = {v["at"] for x in state.get("deleted", {}).values() for v in x}
    return {f for x in state["tables"].values() for f in x} | vectors | {x["at"] for x in state.get("filters", {}).values()}


class Catalog:
    #: Of the tables' layout. What migrates an older one to the next, by its version.
    VERSION = {"index": 6, "corpus": 5, "keywords": 1}
    #: Folders of a table, at most, before an append compacts them.
    FOLDERS = 200
    #: The share of dead rows from which a folder is written anew.
    DEAD = 0.3
    #: The column whose range the pointer keeps for each folder.
    DATED = {"record": "local_date", "daily_metric": "local_date"}
    #: The column that tells whether a row is held, of which each folder has a filter.
    KEYED = {"record": "dedup_key", "workout": "dedup_key"}

    def __init__(self, spark: SparkSession, path: str, kind: str = "index"):
        self.spark, self.path, self.kind = spark, path.rstrip("/"), kind
        self.schemas = {"index": INDEX, "corpus": CORPUS, "keywords": KEYWORDS}[kind]
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._path = hadoop
        self._fs = hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._pending: dict | None = None  # the state within a transaction

    # The pointer files: version, facts, and where each table is.

    def _pointers(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[8:-5]) for n in names if n.startswith("catalog-") and n.endswith(".json"))

    def _read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/catalog-{number:09d}.json", wholetext=True).first()[0])

    def _state(self) -> dict:
        if self._pending is not None:
            return self._pending
        held = self._pointers()
        if not held:
            raise NotFound(f"{self.path} isn't a catalog; create it with create=True or ingest something first")
        return self._read(held[-1])

    def _save(self, state: dict) -> None:
        if self._pending is not None:
            self._pending = state
            return
        held = self._pointers()
        fresh, target = self._path(f"{self.path}/.catalog-{uuid.uuid4().hex}"), self._path(f"{self.path}/catalog-{(held[-1] if held else 0) + 1:09d}.json")
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(fresh, target):
            raise CatalogError(f"{target} can't be written; another writer may be at it")
        named = {f for kept in (state, *map(self._read, held[-1:])) for f in _folders(kept)}
        for old in held[:-1]:
            for folder in _folders(self._read(old)) - named:
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            self._fs.delete(self._path(f"{self.path}/catalog-{old:09d}.json"), False)

    @contextlib.contextmanager
    def transaction(self) -> Iterator[None]:
        """Whatever is written within becomes visible at once at the end, or not at all. One within another is part of it."""
        if self._pending is not None:
            yield
            return
        before = self._pending = self._state()
        try:
            yield
            state = self._pending
        except BaseException:
            for folder in _folders(self._pending) - _folders(before):
                self._fs.delete(self._path(f"{self.path}/{folder}"), True)
            raise
        finally:
            self._pending = None
        if state is not before:
            self._save(state)

    @classmethod
    def open(cls, spark: SparkSession, path: str, kind: str = "index", create: bool = False) -> Catalog:
        catalog = cls(spark, path, kind)
        try:
            catalog.check_version()
        except NotFound:
            if not create:
                raise
            catalog._save({"version": cls.VERSION[kind], "kind": kind, "facts": {}, "tables": {}})
        return catalog

    @classmethod
    def open_for_read(cls, spark: SparkSession, path: str, kind: str = "index") -> Catalog:
        """There, migrated, of this version, and with a rollup if it has records."""
        catalog = cls(spark, path, kind)
        catalog.migrate()
        catalog.check_version()
        if kind == "index" and not catalog.table("record").limit(1).isEmpty() and catalog.table("daily_metric").limit(1).isEmpty():
            raise RollupMissing(f"{path} has records but no daily rollup; call rebuild_rollup() or ingest again")
        return catalog

    def check_version(self) -> None:
        held, wanted = self._state()["version"], self.VERSION[self.kind]
        if held != wanted:
            raise VersionMismatch(f"{self.path} has layout {held}, this build reads {wanted}; " + ("open it for reading to migrate it" if held < wanted else "use a newer build, or reset and ingest again"))

    def migrate(self) -> bool:
        """An older index gets the statistics of its workouts from the columns it has; an older corpus a log of refreshes."""
        state = self._state()
        if state["version"] != self.VERSION[self.kind] - 1:
            return False
        with self.transaction():
            if self.kind == "index":
                self.write("workout_stat", workouts.stat_rows(self.table("workout")))
            elif "refresh_log" not in state["tables"]:
                self.write("refresh_log", self.table("refresh_log"))
            self._save(self._state() | {"version": self.VERSION[self.kind]})
        return True

    # Tables.

    def table(self, name: str, days: list | None = None) -> DataFrame:
        """Empty, in its layout, if nothing was written yet. days: only rows of these dates (None among them: rows without one)."""
        dated = self.DATED.get(name)
        out = self._live(name, self._of_days(name, days)).drop("_folder", "_file", "_bucket", "_bit")
        if days is None:
            return out
        known = [d for d in days if d is not None]
        return out.filter((F.col(dated).isin(*known) if known else F.lit(False)) | (F.col(dated).isNull() if None in days else F.lit(False)))

    def _of_days(self, name: str, days: list | None) -> list[str]:
        """The folders of a table, or those that may have rows of these dates."""
        state = self._state()
        folders, ranges = state["tables"].get(name) or [], state.get("ranges", {})
        if days is None:
            return folders
        return [f for f in folders if f not in ranges or any(ranges[f][2] if d is None else (ranges[f][0] or "9") <= str(d) <= (ranges[f][1] or "") for d in days)]

    def may_hold(self, name: str, new: DataFrame, days: list | None = None) -> list[str]:
        """The folders that may have a row with a key of `new`: those whose filter a key passes, and those without a filter.

        The driver gets a row a folder."""
        key, folders = self.KEYED[name], self._of_days(name, days)
        known = {f: x for f, x in self._state().get("filters", {}).items() if f in folders}
        passed = {f for f in folders if f not in known}
        keys = new.select(key).distinct()
        of_size = {b: {x["at"]: f for f, x in known.items() if x["blocks"] == b} for b in {x["blocks"] for x in known.values()}}
        for blocks, held in sorted(of_size.items()):
            read = self.spark.read.schema(filters.FILTER).parquet(*[f"{self.path}/{at}" for at in held])
            placed = read.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"), "block", "bits")
            passed |= {held[r[0]] for r in filters.passing(keys, key, placed, blocks).distinct().collect()}
        return [f for f in folders if f in passed]

    def unheld(self, name: str, new: DataFrame, order: str, days: list | None = None) -> DataFrame:
        """The rows of `new` to append: of keys not held yet, the first of each in the order given. Only folders that may have
        one of the keys are read, and their keys alone. days: all dates that rows with these keys can have, if that is known."""
        held = self._live(name, self.may_hold(name, new, days)).select(self.KEYED[name])
        return writes.insert_ignore(held, new, [self.KEYED[name]], order)

    def _live(self, name: str, folders: list[str], places: bool = False) -> DataFrame:
        """Rows that no deletion vector names; with their places if asked, or where a vector was looked at."""
        vectors = self._state().get("deleted", {}).get(name, [])
        hurt = {f for v in vectors for f in v["folders"]}
        whole, rest = [f for f in folders if f not in hurt and not places], [f for f in folders if f in hurt or places]
        if not folders:
            return self.spark.createDataFrame([], self.schemas[name] + (", _folder string, _file string, _bucket long, _bit long" if places else ""))
        read = lambda names, schema: self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in names])
        if not rest:
            return read(whole, self.schemas[name])
        row = F.col("_metadata.row_index") + 1
        rows = read(rest, self.schemas[name]).select("*", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("_folder"), F.col("_metadata.file_name").alias("_file"), F.bitmap_bucket_number(row).alias("_bucket"), F.bitmap_bit_position(row).alias("_bit"))
        if vectors:
            dead = read([v["at"] for v in vectors], VECTOR).groupBy(F.col("file").alias("_file"), F.col("bucket").alias("_bucket")).agg(F.bitmap_or_agg("bits").alias("_bits"))
            rows = rows.join(dead, ["_file", "_bucket"], "left").filter(F.col("_bits").isNull() | ~filters.bit_is_set(F.col("_bits"), F.col("_bit"))).drop("_bits")
        if places:
            return rows
        rows = rows.select(*[c for c in rows.columns if not c.startswith("_")])
        return rows.unionByName(read(whole, self.schemas[name])) if whole else rows

    def _written(self, name: str, rows: DataFrame) -> str:
        """Rows in the table's layout, in a new folder; columns that it doesn't have are left out, those that are missing are null.
        Tables with a date are written in its order."""
        from pyspark.sql.types import StructType, _parse_datatype_string

        layout = _parse_datatype_string(self.schemas[name])
        assert isinstance(layout, StructType)
        folder, dated = f"{name}-{uuid.uuid4().hex[:12]}", self.DATED.get(name)
        shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in layout])
        (shaped.sortWithinPartitions(dated) if dated else shaped).write.parquet(f"{self.path}/{folder}")
        return folder

    def _placed(self, name: str, folder: str, tables: dict, deleted: dict) -> None:
        """A new state: the tables and vectors as given, and what is known of a new folder."""
        state, dated, key = self._state(), self.DATED.get(name), self.KEYED.get(name)
        named = {f for x in tables.values() for f in x}
        ranges, held = ({f: x for f, x in state.get(of, {}).items() if f in named} for of in ("ranges", "filters"))
        if dated or key:
            rows = self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{folder}")
            day = F.col(dated) if dated else F.lit(None).cast("date")
            low, high, some, n = rows.agg(F.min(day).cast("string"), F.max(day).cast("string"), F.count_if(day.isNull()) > 0, F.count("*")).first()
            if dated:
                ranges[folder] = [low, high, some]
            if key:
                at, blocks = f"filter-{uuid.uuid4().hex[:12]}", filters.blocks_for(n)
                filters.built(rows, key, blocks).write.parquet(f"{self.path}/{at}")
                held[folder] = {"at": at, "blocks": blocks}
        self._save(state | {"tables": tables, "deleted": deleted, "ranges": ranges, "filters": held})

    def write(self, name: str, rows: DataFrame) -> None:
        """The whole table."""
        folder, state = self._written(name, rows), self._state()
        self._placed(name, folder, state["tables"] | {name: [folder]}, {t: v for t, v in state.get("deleted", {}).items() if t != name})

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows beside those that are held, which stay as they are. Returns what was appended, as written.

        After FOLDERS appends a table is written anew in one piece."""
        folder, state = self._written(name, rows), self._state()
        folders = [*state["tables"].get(name, []), folder]
        self._placed(name, folder, state["tables"] | {name: folders}, state.get("deleted", {}))
        added = self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{folder}")
        if len(folders) > self.FOLDERS or len(self._state().get("deleted", {}).get(name, [])) > self.FOLDERS:
            self.write(name, self.table(name))
        return added

    def delete(self, name: str, gone: Column | DataFrame, key: list[str] | None = None) -> int:
        """How many rows went: those that meet a condition, or whose key (null is a key) is among the rows of `gone`.

        Only a deletion vector is written. The driver gets a row for each folder with such rows."""
        state = self._state()
        rows = self._live(name, state["tables"].get(name, []), places=True)
        if isinstance(gone, DataFrame):
            same = [F.col(f"h.{k}").eqNullSafe(F.col(f"g.{k}")) for k in key]
            rows = rows.alias("h").join(gone.select(*key).distinct().alias("g"), same, "left_semi")
        else:
            rows = rows.filter(gone)
        vector = f"deleted-{uuid.uuid4().hex[:12]}"
        marks = rows.groupBy(F.col("_folder").alias("folder"), F.col("_file").alias("file"), F.col("_bucket").alias("bucket")).agg(F.bitmap_construct_agg("_bit").alias("bits"), F.count("*").alias("n"))
        marks.write.parquet(f"{self.path}/{vector}")
        dead = {r[0]: r[1] for r in self.spark.read.schema(VECTOR).parquet(f"{self.path}/{vector}").groupBy("folder").agg(F.sum("n")).collect()}
        if not dead:
            self._fs.delete(self._path(f"{self.path}/{vector}"), True)
            return 0
        held = state.get("deleted", {})
        self._save(state | {"deleted": held | {name: [*held.get(name, []), {"at": vector, "folders": dead}]}})
        return sum(dead.values())

    def replace(self, name: str, rows: DataFrame, key: list[str], among: DataFrame | None = None) -> DataFrame:
        """Rows instead of those whose key comes again, or is in `among`. Returns what was written. rows may read the table."""
        held = self._state()["tables"].get(name)
        folder = self._written(name, rows)
        fresh = self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{folder}")
        with self.transaction():
            if held:
                self.delete(name, among if among is not None else fresh, key)
            state = self._state()
            self._placed(name, folder, state["tables"] | {name: [*state["tables"].get(name, []), folder]}, state.get("deleted", {}))
            self.compact(name)
        return fresh

    def compact(self, name: str, share: float | None = None) -> list[str]:
        """Folders with that share of dead rows or more are written anew, together; their names. Others stay as they are."""
        state = self._state()
        dead: dict[str, int] = {}
        for v in state.get("deleted", {}).get(name, []):
            for f, n in v["folders"].items():
                dead[f] = dead.get(f, 0) + n
        rows = {f: self.spark.read.parquet(f"{self.path}/{f}").count() for f in dead}
        old = [f for f in state["tables"].get(name, []) if f in dead and dead[f] >= (self.DEAD if share is None else share) * max(rows[f], 1)]
        many = len(state["tables"].get(name, [])) > self.FOLDERS or len(state.get("deleted", {}).get(name, [])) > self.FOLDERS
        if many:
            self.write(name, self.table(name))
        elif old:
            folder = self._written(name, self._live(name, old))
            vectors = [{"at": v["at"], "folders": {f: n for f, n in v["folders"].items() if f not in old}} for v in state["deleted"][name]]
            tables = state["tables"] | {name: [f for f in state["tables"][name] if f not in old] + [folder]}
            self._placed(name, folder, tables, state["deleted"] | {name: [v for v in vectors if v["folders"]]})
        return old

    @contextlib.contextmanager
    def scratch(self) -> Iterator[str]:
        """A folder beside the tables, for what is read several times while it is taken in; gone afterwards."""
        folder = f"{self.path}/.scratch-{uuid.uuid4().hex[:12]}"
        try:
            yield folder
        finally:
            self._fs.delete(self._path(folder), True)

    # Facts.

    def set_fact(self, key: str, value: str) -> None:
        state = self._state()
        self._save(state | {"facts": state["facts"] | {key: value}})

    def fact(self, key: str) -> str | None:
        return self._state()["facts"].get(key)

    # Upkeep.

    def rebuild_rollup(self) -> int:
        self.write("daily_metric", series.daily_rollup(self.table("record")))
        return self.table("daily_metric").count()

    def note_file(self, path: str, kind: str, sha256: str, size: int, records: int, status: str) -> None:
        """The ledger entry of a file: what it was when read, and whether all of it was."""
        row = [(path, kind, sha256, size, datetime.now(UTC).isoformat(timespec="seconds"), records, status)]
        fresh = self.spark.createDataFrame(row, self.schemas["source_file"])
        self.replace("source_file", fresh, ["path"])

    def reset(self) -> None:
        self._fs.delete(self._path(self.path), True)
