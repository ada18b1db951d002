"""Sharding by size-tiered compaction with a versioned manifest.

Arrivals are appended as runs of small immutable Parquet shards. Runs of similar size (of one tier: a power of the
fan-in) are merged into target-sized files once a tier holds enough of them. Every change commits a new version of the
manifest, a small file that is written aside and renamed into place, which fails if the version exists: readers see a
whole version or none, and a writer that lost the race tries again on the newer one. Every version names its runs, and
runs that a merge replaced stay until `vacuum`, so earlier versions can be read. Data never passes the driver.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabula.session import scratch

#: Runs that a merge takes together, size of a merged file, size up to which a run is of the lowest tier.
FAN_IN, TARGET_BYTES, LOWEST_BYTES = 4, 128 << 20, 1 << 20
#: Arrivals that `shard` makes of a table.
ARRIVALS = 8
#: Seconds for which replaced runs stay readable by default.
RETENTION = 7 * 24 * 3600


@dataclass(frozen=True)
class Run:
    """One append or merge: a folder of shards below the root."""

    number: int
    path: str
    files: int
    rows: int
    bytes: int

    def tier(self, fan_in: int = FAN_IN) -> int:
        return max(0, math.ceil(math.log(max(1, self.bytes) / LOWEST_BYTES, fan_in)))


@dataclass(frozen=True)
class Manifest:
    """A version: the runs that hold its rows, and when it was committed."""

    version: int
    next_run: int
    schema: str | None
    runs: tuple[Run, ...]
    committed: float = 0.0


class CommitConflict(RuntimeError):
    """Another writer committed this version first, or merged the runs."""


class ShardStore:
    """A folder of runs and manifests, local or remote."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest manifest or an earlier one; an empty one where nothing was committed."""
        version = version if version is not None else (self.versions() or [0])[-1]
        if version == 0:
            return Manifest(0, 1, None, ())
        stream = self._fs().open(self._path("manifest", f"v{version:08d}.json"))
        try:
            raw = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Manifest(raw["version"], raw["next_run"], raw["schema"], tuple(Run(**r) for r in raw["runs"]), raw["committed"])

    def commit(self, manifest: Manifest) -> None:
        """Publish a version, at once or not at all."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf)
        aside = self._path("manifest", f".aside-{uuid.uuid4().hex}")
        stream = self._fs().create(aside, False)
        stream.write(json.dumps(asdict(manifest)).encode())
        stream.close()
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(aside, self._path("manifest", f"v{manifest.version:08d}.json"), none)
        except Exception as error:
            self._fs().delete(aside, False)
            if "FileAlreadyExists" in str(error):
                raise CommitConflict(f"version {manifest.version} exists") from error
            raise

    def _new_name(self) -> str:
        return f"run-{uuid.uuid4().hex}"

    def _measured(self, names: list[str]) -> list[Run]:
        """Runs, still without a number, of folders that are written; their rows are counted in one job."""
        paths = [f"data/{name}" for name in names]
        found = []
        for path in paths:
            files = [s for s in self._fs().listStatus(self._path(path)) if s.getPath().getName().startswith("part-")]
            found.append((path, len(files), sum(s.getLen() for s in files)))
        whole = [self.spark.read.parquet(f"{self.root}/{p}").select(F.lit(n).alias("n")) for n, (p, files, _) in enumerate(found) if files]
        rows: dict[int, int] = {}
        if whole:
            together = whole[0]
            for part in whole[1:]:
                together = together.unionAll(part)
            rows = {r["n"]: r["count"] for r in together.groupBy("n").count().collect()}
        return [Run(0, path, files, rows.get(n, 0), size) for n, (path, files, size) in enumerate(found)]

    def _commit_runs(self, names: list[str], schema: str, replaced: tuple[Run, ...]) -> tuple[Run, ...]:
        """Name the written folders in the next version, in place of `replaced`."""
        measured = self._measured(names)
        while True:
            now = self.manifest()
            if not set(replaced) <= set(now.runs):
                raise CommitConflict("the runs to be merged are gone")
            runs = tuple(Run(now.next_run + n, r.path, r.files, r.rows, r.bytes) for n, r in enumerate(measured))
            left = tuple(r for r in now.runs if r not in replaced)
            try:
                self.commit(Manifest(now.version + 1, now.next_run + len(runs), now.schema or schema, (*left, *runs), time.time()))
                return runs
            except CommitConflict:
                continue

    def append(self, df: DataFrame) -> Run:
        """One arrival: its partitions become small shards as they are."""
        name = self._new_name()
        df.write.parquet(f"{self.root}/data/{name}")
        return self._commit_runs([name], df.schema.json(), ())[0]

    def adopt(self, folder: str, schema: str) -> Run:
        """One arrival that is written already: its folder, given below the root, becomes a run."""
        name = self._new_name()
        self._fs().mkdirs(self._path("data"))
        if not self._fs().rename(self._path(folder), self._path("data", name)):
            raise OSError(f"{folder} can't be moved")
        return self._commit_runs([name], schema, ())[0]

    def exists(self, folder: str) -> bool:
        return self._fs().exists(self._path(folder))

    def drop(self, folder: str) -> None:
        self._fs().delete(self._path(folder), True)

    def read_runs(self, runs: tuple[Run, ...], schema: str) -> DataFrame:
        reader = self.spark.read.schema(T.StructType.fromJson(json.loads(schema)))
        return reader.parquet(*[f"{self.root}/{r.path}" for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        found = self.manifest(version)
        if found.schema is None:
            raise ValueError("nothing was committed")
        return self.read_runs(found.runs, found.schema)

    def compact(self, fan_in: int = FAN_IN, target_bytes: int = TARGET_BYTES) -> int:
        """Merge full tiers until none is full; returns how many merges were made.

        All full tiers are merged at once and committed in one version. Each target-sized file is written by one task,
        which reads whole partitions without a shuffle where there are enough of them.
        """
        merges = 0
        while True:
            now = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for run in sorted(now.runs, key=lambda r: r.number):
                tiers.setdefault(run.tier(fan_in), []).append(run)
            full = [tuple(runs[:fan_in]) for tier, runs in sorted(tiers.items()) if len(runs) >= fan_in]
            if not full:
                return merges
            with ThreadPoolExecutor(len(full)) as pool:
                names = list(pool.map(lambda chosen: self._merged(chosen, now.schema, target_bytes), full))
            self._commit_runs(names, now.schema, tuple(run for chosen in full for run in chosen))
            merges += len(full)

    def _merged(self, chosen: tuple[Run, ...], schema: str, target_bytes: int) -> str:
        """The rows of some runs in a new folder of target-sized files."""
        name = self._new_name()
        rows = self.read_runs(chosen, schema)
        files = max(1, math.ceil(sum(r.bytes for r in chosen) / target_bytes))
        enough = files <= rows.rdd.getNumPartitions()
        (rows.coalesce(files) if enough else rows.repartition(files)).write.parquet(f"{self.root}/data/{name}")
        return name

    def vacuum(self, retention: float = RETENTION) -> int:
        """Delete replaced runs and the versions that need them, and return how many runs went.

        Only runs go that an earlier version names, the latest does not, and no version needs that is younger than
        `retention` seconds or was the latest within that time. Folders that no version names belong to writers that
        have yet to commit and are never touched.
        """
        versions = [self.manifest(v) for v in self.versions()]
        if not versions:
            return 0
        ends = [later.committed for later in versions[1:]]
        old = [m for m, end in zip(versions, ends) if time.time() - end >= retention]
        needed = {r.path for m in versions if m not in old for r in m.runs}
        gone = {r.path for m in old for r in m.runs} - needed
        for manifest in old:
            if any(r.path in gone for r in manifest.runs):
                self._fs().delete(self._path("manifest", f"v{manifest.version:08d}.json"), False)
        for path in gone:
            self._fs().delete(self._path(path), True)
        return len(gone)


def _free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _arrival(docs: DataFrame, many: int) -> Column:
    """The arrival of a row, by a hash of its values: later ones are larger, in the proportion 1 : 3 : 5 and so on."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType) and f.dataType.typeName() != "variant"]
    hashed = F.xxhash64(*plain) if plain else F.xxhash64(F.monotonically_increasing_id())
    place = F.pmod(hashed, F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(F.sqrt(place) * many).cast("int")


def shard(
    docs: DataFrame, root: str | None = None, arrivals: int = ARRIVALS, fan_in: int = FAN_IN, target_bytes: int = TARGET_BYTES
) -> DataFrame:
    """Store `docs` below `root` (a new folder in the shared one) in `arrivals` arrivals, compacting after each, and
    return the stored rows with `shard`, the run and part they lie in, and `version`, that of the manifest.

    The arrivals are written in one pass, whatever files the table has, and then taken in one by one; a partition
    column of the table is a column like the others. Every row is stored exactly as it is, nulls, long texts and
    repeated rows included; an arrival without rows commits an empty run. Where `docs` has columns named shard or
    version, the new ones get an underscore more. Replaced runs stay, so that every version can be read.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or scratch(spark, "shards"))
    name, aside = _free_name(docs, "arrival"), f"arriving-{uuid.uuid4().hex}"
    docs.withColumn(name, _arrival(docs, arrivals)).write.partitionBy(name).parquet(f"{store.root}/{aside}")
    for n in range(arrivals):
        folder = f"{aside}/{name}={n}"
        if store.exists(folder):
            store.adopt(folder, docs.schema.json())
        else:
            store.append(spark.createDataFrame([], docs.schema))
        store.compact(fan_in, target_bytes)
    store.drop(aside)
    now = store.manifest()
    stored = store.read(now.version)
    where = stored.metadataColumn("_metadata")["file_path"]
    numbers = F.create_map(*[F.lit(x) for r in now.runs for x in (r.path.rsplit("/", 1)[-1], f"run-{r.number:06d}")])
    shard_name = F.concat(numbers[F.regexp_extract(where, r"/data/([^/]+)/", 1)], F.lit("/part-"), F.regexp_extract(where, r"/part-(\d+)-", 1))
    named = stored.withColumn(_free_name(stored, "shard"), shard_name)
    return named.withColumn(_free_name(named, "version"), F.lit(now.version).cast("long"))
