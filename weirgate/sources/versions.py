"""Tables kept as immutable versions behind one catalog name.

The name is a view over the newest version, and replacing the view is the only step that readers can see: one
catalog operation, which also carries the ids of the runs that were committed. A version is an external table
whose partitions point to folders, each written once by one run, so a version that changes few partitions or
appends rows shares the other folders with the one before it. A run that is repeated after a failure writes its
own folder again, and does nothing once it was committed. Versions beyond the newest ``keep`` are dropped with
the folders that no kept version points to, and so are the folders of attempts that never got that far.

There is one writer at a time. A reader of a version has until ``keep`` newer ones are committed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirgate.contracts import Contract, conform
from weirgate.operators.fingerprint import table_fingerprint
from weirgate.operators.governance import split_expired
from weirgate.operators.windows import newest
from weirgate.session import verify_rows, written
from weirgate.sources.keyed import matching, partitions_in
from weirgate.sources.writers import delete_path, list_folders

RUN_COLUMN = "__run"
PREFIX = "weirgate."
REMEMBERED_RUNS = 50
PARTITIONS_A_STATEMENT = 200


@dataclass(frozen=True)
class Part:
    """A folder of a version: its partition value (None where the table has no partitions), its run and its place."""

    value: object
    run: str
    folder: str


@dataclass(frozen=True)
class Staged:
    """Rows that a run has written and counted but not committed."""

    run: str
    rows: int
    df: DataFrame


class VersionedTable:
    """A catalog table at ``root``; ``partition_by`` names a column of text, whole numbers, dates or truth values.

    ``after`` is called with the name of each step once it is done.
    """

    def __init__(
        self,
        spark: SparkSession,
        name: str,
        root: str,
        partition_by: str | None = None,
        keep: int = 3,
        after: Callable[[str], None] = lambda step: None,
    ):
        if keep < 2:
            raise ValueError("at least the newest version and the one before it are kept")
        self.spark, self.name, self.root = spark, name, root.rstrip("/")
        self.partition_by, self.keep, self.after = partition_by, keep, after
        self._listed: dict[int, list[Part]] = {}  # of committed versions, which do not change

    # ---- reading ----

    def properties(self) -> dict[str, str]:
        """What the newest commit has noted; empty before the first one."""
        if not self.spark.catalog.tableExists(self.name):
            return {}
        found = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self.name}").collect()}
        return {k.removeprefix(PREFIX): v for k, v in found.items() if k.startswith(PREFIX)}

    def version(self) -> int:
        return int(self.properties().get("version", 0))

    def committed(self, run: str) -> bool:
        """Whether a run is among the newest ``REMEMBERED_RUNS`` commits."""
        return run in json.loads(self.properties().get("runs", "[]"))

    def version_of(self, run: str) -> int | None:
        """The version a run has committed, if it is remembered."""
        noted = self.properties()
        runs = json.loads(noted.get("runs", "[]"))
        return int(noted["version"]) - runs[::-1].index(run) if run in runs else None

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an older one that is kept."""
        if version is None:
            return self.spark.table(self.name)
        return self.spark.table(self._table(version)).drop(RUN_COLUMN)

    def parts(self, version: int | None = None) -> list[Part]:
        """The folders of a version, which is as many rows as it has partitions and appended runs."""
        number = self.version() if version is None else version
        if number and number not in self._listed:
            found = self.spark.read.parquet(self._manifest(number)).collect()
            self._listed[number] = [Part(r["value"], r["run"], r["folder"]) for r in found]
        return self._listed.get(number, [])

    # ---- writing ----

    def stage(self, df: DataFrame, run: str) -> Staged:
        """Write the rows of a run to its folder, in place of what an earlier attempt left there."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", run):
            raise ValueError("a run id has letters, digits, - and _ only")
        path, seen = self._data(run), Observation()
        # small partitions go to one task together, one that holds most rows to many
        dealt = df.hint("rebalance", self.partition_by) if self.partition_by else df
        writer = dealt.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        (writer.partitionBy(self.partition_by) if self.partition_by else writer).parquet(path)
        rows = seen.get["rows"]
        schema = T.StructType([f for f in df.schema if f.name != self.partition_by] + [f for f in df.schema if f.name == self.partition_by])
        back = self.spark.read.schema(schema).parquet(path).select(*df.columns)
        verify_rows(back, rows, path)
        self.after("stage")
        return Staged(run, rows, back)

    def discard(self, staged: Staged) -> None:
        delete_path(self.spark, self._data(staged.run))

    def commit(self, staged: Staged, keeping: Sequence[Part] = (), properties: Mapping[str, str] | None = None) -> int:
        """Make the staged rows and the folders kept of earlier runs the newest version; returns its number."""
        return self._commit(staged.run, staged.df.schema, [*keeping, *self._staged_parts(staged)], properties)

    def replace(self, df: DataFrame, run: str, properties: Mapping[str, str] | None = None) -> int:
        """All rows anew. ``df`` may read this table. Returns the version that holds the run."""
        if self.committed(run):
            return self.version()
        return self.commit(self.stage(df, run), (), properties)

    def append(self, df: DataFrame, run: str) -> int:
        """The rows of a run beside those of the others; repeated or failed and repeated, they are there once."""
        if self.committed(run):
            return self.version()
        columns = self.read().columns if self.version() else df.columns
        return self.commit(self.stage(df.select(*columns), run), self.parts())

    def upsert(self, changes: DataFrame, keys: Sequence[str], order: Sequence[Column], run: str) -> int:
        """Changed rows replace those of the same key; among changes of one key the first in ``order`` wins.

        Of a partitioned table only the partitions a changed key is or was in are read and written again; finding
        them reads the key columns. A NULL key equals a NULL key, a NULL partition value is a partition.
        """
        if self.committed(run):
            return self.version()
        current = self.read()
        latest = written(newest(changes, keys, order).select(*current.columns), "changes")
        if not self.partition_by:
            return self.commit(self.stage(matching(current, latest, keys, "left_anti").unionByName(latest), run))
        places = matching(current.select(*dict.fromkeys((*keys, self.partition_by))), latest, keys, "left_semi")
        touched = places.select(self.partition_by).unionByName(latest.select(self.partition_by)).distinct()
        values = {r[0] for r in touched.collect()}
        affected = current.filter(partitions_in(self.partition_by, list(values)))
        staged = self.stage(matching(affected, latest, keys, "left_anti").unionByName(latest), run)
        return self.commit(staged, [p for p in self.parts() if p.value not in values])

    def drop_partitions(self, values: Sequence, run: str) -> int:
        """A version without some partitions; no row is read or written."""
        if self.committed(run):
            return self.version()
        gone = set(values)
        return self._commit(run, self.read().schema, [p for p in self.parts() if p.value not in gone], None)

    # ---- steps ----

    def _data(self, run: str) -> str:
        return f"{self.root}/data/{run}"

    def _manifest(self, number: int) -> str:
        return f"{self.root}/versions/{number}"

    def _table(self, number: int) -> str:
        return f"{self.name}__v{number}"

    def _staged_parts(self, staged: Staged) -> list[Part]:
        if not self.partition_by:
            return [Part(None, staged.run, self._data(staged.run))]
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
        # the folders' names are escaped as a path is and not as a URI
        held = staged.df.select(F.col(self.partition_by).alias("value"), F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))).alias("folder"))
        return [Part(r["value"], staged.run, r["folder"]) for r in held.distinct().collect()]

    def _literal(self, value, kind: T.DataType) -> str:
        if value is None:
            return "NULL"
        if isinstance(kind, T.DateType):
            return f"DATE '{value}'"
        if isinstance(kind, (T.IntegralType, T.BooleanType)):
            return str(value)
        text = str(value).replace("\\", "\\\\").replace("'", "\\'")
        return f"'{text}'"

    def _commit(self, run: str, schema: T.StructType, parts: Sequence[Part], properties: Mapping[str, str] | None) -> int:
        before = self.properties()
        number = int(before.get("version", 0)) + 1
        kind = schema[self.partition_by].dataType if self.partition_by else T.StringType()
        rows = [(p.value, p.run, p.folder) for p in parts]
        form = T.StructType([T.StructField("value", kind), T.StructField("run", T.StringType()), T.StructField("folder", T.StringType())])
        self.spark.createDataFrame(rows, form).coalesce(1).write.mode("overwrite").parquet(self._manifest(number))
        self.after("manifest")
        table = self._table(number)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")  # of an attempt that failed
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        keys = [*([self.partition_by] if self.partition_by else []), RUN_COLUMN]
        by = ", ".join(f"`{k}`" for k in keys)
        self.spark.sql(f"CREATE TABLE {table} ({columns}, `{RUN_COLUMN}` string) USING parquet PARTITIONED BY ({by}) LOCATION '{self.root}/data'")
        for at in range(0, len(parts), PARTITIONS_A_STATEMENT):
            specs = []
            for p in parts[at : at + PARTITIONS_A_STATEMENT]:
                own = [f"`{self.partition_by}` = {self._literal(p.value, kind)}"] if self.partition_by else []
                own.append(f"`{RUN_COLUMN}` = '{p.run}'")
                place = p.folder.replace("\\", "\\\\").replace("'", "\\'")
                specs.append(f"PARTITION ({', '.join(own)}) LOCATION '{place}'")
            self.spark.sql(f"ALTER TABLE {table} ADD {' '.join(specs)}")
        self.after("table")
        runs = [*json.loads(before.get("runs", "[]")), run][-REMEMBERED_RUNS:]
        noted = dict(properties or {}) | {"version": str(number), "runs": json.dumps(runs)}
        listed = ", ".join(f"'{PREFIX}{k}' = '{v}'" for k, v in noted.items())
        names = ", ".join(f"`{f.name}`" for f in schema)
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} TBLPROPERTIES ({listed}) AS SELECT {names} FROM {table}")
        self._listed[number] = list(parts)
        self.after("view")
        self._expire(number)
        return number

    def expire(self) -> None:
        """Drop versions beyond the newest ``keep``, and folders that none of the kept ones points to."""
        self._expire(self.version())

    def _expire(self, current: int) -> None:
        kept = range(max(1, current - self.keep + 1), current + 1)
        used = {p.folder.split("://")[-1].removeprefix("file:") for n in kept for p in self.parts(n)}
        used = {"/" + f.lstrip("/") for f in used}
        for name in list_folders(self.spark, f"{self.root}/versions"):
            if int(name) not in kept:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(int(name))}")
                delete_path(self.spark, self._manifest(int(name)))
                self._listed.pop(int(name), None)
        self.after("versions expired")
        plain = "/" + self.root.split("://")[-1].removeprefix("file:").lstrip("/")
        for run in list_folders(self.spark, f"{self.root}/data"):
            folder = f"{plain}/data/{run}"
            held = [f for f in used if f == folder or f.startswith(f"{folder}/")]
            if not held:
                delete_path(self.spark, self._data(run))
            elif folder not in used:
                for inner in list_folders(self.spark, self._data(run)):
                    if f"{folder}/{inner}" not in used:
                        delete_path(self.spark, f"{self._data(run)}/{inner}")
        self.after("folders expired")


# ---- jobs over versioned tables ----


@dataclass
class Refreshed:
    """What a refresh did: a load of ``rows``, or a skip."""

    loaded: bool
    rows: int = 0


def refresh_versions(
    table: VersionedTable, contract: Contract, rows: DataFrame | None, run: str, profile: str = "default", force: bool = False, clean: bool = False
) -> Refreshed:
    """Load ``rows``, cast to the contract, into a table unless they are what it already holds.

    The rows are written once, to the folder that becomes the version, and their fingerprint is taken from there.
    It is compared with the one noted by the newest commit, of this profile: going to another profile and back
    loads again. ``force`` loads regardless; ``clean`` loads no rows as well, which are otherwise ignored. A run
    that was committed is not loaded again.
    """
    if table.committed(run) or (rows is None and not clean):
        return Refreshed(False)
    data = table.spark.createDataFrame([], contract.schema) if rows is None else conform(rows, contract)
    staged = table.stage(data, run)
    checksum = table_fingerprint(staged.df, contract.locator, profile).first()["fingerprint"]
    noted = table.properties()
    same = (noted.get("profile"), noted.get("checksum")) == (profile, checksum)
    if not clean and (not staged.rows or (same and not force)):
        table.discard(staged)
        return Refreshed(False)
    table.commit(staged, properties={"profile": profile, "checksum": checksum})
    return Refreshed(True, staged.rows)


POLICIES = ("delete", "archive", "notify")


def _checked(policy: str, archive: VersionedTable | None) -> None:
    if policy not in POLICIES:
        raise ValueError(f"unknown deletion policy {policy!r}")
    if policy == "archive" and archive is None:
        raise ValueError("archiving needs a table to archive to")


def retain(
    table: VersionedTable, at: str, days: int, as_of: Column, run: str, policy: str = "delete", archive: VersionedTable | None = None
) -> DataFrame:
    """Rows past their retention go, to the archive with ``archive``; ``notify`` changes nothing. Returns them.

    The archive is committed first, under the same run id, so that a repeated run neither loses rows nor archives
    them twice: until the table is committed it gives the same rows again, and after that neither is written.
    """
    _checked(policy, archive)
    if table.committed(run):
        return split_expired(table.read(table.version_of(run) - 1), at, days, as_of)[1]
    kept, gone = split_expired(table.read(), at, days, as_of)
    if policy == "notify":
        return gone
    now = table.version()
    if policy == "archive":
        archive.append(gone, run)
    table.replace(kept, run)
    return split_expired(table.read(now), at, days, as_of)[1]


def retain_days(
    table: VersionedTable, days: int, as_of: date, run: str, policy: str = "delete", archive: VersionedTable | None = None
) -> list[str]:
    """Retention of a table with a partition for each day (``YYYY-MM-DD``): the days that are past it, in order.

    Whole partitions are left out of the next version, so no kept row is read or written. Rows without a day stay.
    """
    _checked(policy, archive)
    first_kept = (as_of - timedelta(days=days)).isoformat()
    gone = sorted({str(p.value) for p in table.parts() if p.value is not None and str(p.value) < first_kept})
    if policy == "notify" or not gone or table.committed(run):
        return gone
    if policy == "archive":
        archive.append(table.read().filter(F.col(table.partition_by).cast("string") < first_kept), run)
    table.drop_partitions([p.value for p in table.parts() if p.value is not None and str(p.value) in gone], run)
    return gone
