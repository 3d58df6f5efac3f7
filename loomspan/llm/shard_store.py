"""A store of immutable shards with size-tiered compaction and a versioned manifest.

Arrivals are appended as many small Parquet files (shards), each written
once and never changed.  Compaction takes the shards of one size tier (tier
t: from unit * fanout**t bytes) once `fanout` of them have come together and
merges them into files of about the target size; shards that have reached
half the target stay as they are, so a byte is rewritten a few times at most.
All merges of a round are one Spark job, dealt out by merge, each merge
bounded by the target.

A change is visible once its manifest is: version n + 1 is written aside and
renamed to its place, which fails if another writer was first; that writer's
version is then read and the change made again.  Readers take the highest
version and see all of a change or nothing.  A manifest names pieces, files
of up to PIECE_SHARDS shards each; a change writes only the pieces it alters.

A merge is committed only if it has as many rows as what it replaces.
Shards are named by their place under the root, so a store can be moved and
its root may have any name.  Shards that no kept version names are deleted
by vacuum(), once they are older than any write or read may take.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TARGET_BYTES = 128 << 20
SHARD_ROWS = 2000
FANOUT = 4
UNIT_BYTES = 64 << 10
RETRIES = 20
PIECE_SHARDS = 1000
#: Shards merged in one job, which sends their names to its tasks.
JOB_SHARDS = 20_000
#: Seconds after which no write or read is still under way.
GRACE_S = 7 * 86400
FILE, MERGE, SHARD = "_loomspan_file", "_loomspan_merge", "_loomspan_shard"


class Conflict(Exception):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    """path: below the root."""

    path: str
    bytes: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self.jvm = spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    # files

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.root).getFileSystem(self.conf)

    def _list(self, folder: str) -> list[tuple[str, int, float]]:
        """(path below the root, bytes, seconds since it was written) of the files in a folder of the store."""
        files, out, now = self._files(), [], time.time()
        if files.exists(self._path(f"{self.root}/{folder}")):
            it = files.listFiles(self._path(f"{self.root}/{folder}"), True)
            while it.hasNext():
                f = it.next()
                name = f.getPath().toString()
                out.append((name[name.rindex(f"/{folder}/") + 1 :], f.getLen(), now - f.getModificationTime() / 1000))
        return sorted(out)

    def _text(self, name: str) -> str:
        stream = self._files().open(self._path(f"{self.root}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, content) -> None:
        out = self._files().create(self._path(f"{self.root}/{name}"), False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()

    # manifests

    def versions(self) -> list[int]:
        names = [p.rpartition("/")[2] for p, *_ in self._list("manifest")]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, schema, shards and pieces (by name the shards in it); version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": [], "pieces": {}}
        found = json.loads(self._text(f"manifest/v{version:010d}.json"))
        pieces = {name: [Shard(**s) for s in json.loads(self._text(f"pieces/{name}.json"))] for name in found["pieces"]}
        return found | {"pieces": pieces, "shards": [s for piece in pieces.values() for s in piece]}

    def commit(self, base: dict, added: list[Shard], gone: set[str], schema: str | None) -> dict:
        """Version base + 1, all or nothing: the shards of base without those at the paths in gone, and those added."""
        version, names, loose = base["version"] + 1, [], list(added)
        for name, piece in base["pieces"].items():
            left = [s for s in piece if s.path not in gone]
            if len(left) == len(piece) and 2 * len(piece) > PIECE_SHARDS:
                names.append(name)
            else:
                loose += left
        for at in range(0, len(loose), PIECE_SHARDS):
            names.append(uuid.uuid4().hex)
            self._put(f"pieces/{names[-1]}.json", [asdict(s) for s in loose[at : at + PIECE_SHARDS]])
        aside, place = f"manifest/.{uuid.uuid4().hex}", f"manifest/v{version:010d}.json"
        self._put(aside, {"version": version, "schema": schema, "pieces": names})
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(f"{self.root}/{aside}"), self._path(f"{self.root}/{place}"), none)
        except Exception as e:
            self._files().delete(self._path(f"{self.root}/{aside}"), False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(version) from e
            raise
        return self.manifest(version)

    def _change(self, make) -> dict:
        """Commit make(newest manifest) = (added, gone, schema), again if another writer was first."""
        for _ in range(RETRIES):
            base = self.manifest()
            try:
                return self.commit(base, *make(base))
            except Conflict:
                continue
        raise Conflict("too many writers")

    # changes

    def append(self, arrivals: DataFrame, shard_rows: int = SHARD_ROWS) -> dict:
        """Write arrivals as shards of shard_rows rows at most and commit them.  An empty arrival adds the schema only."""
        folder = f"data/{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", shard_rows).option("compression", "zstd").parquet(f"{self.root}/{folder}")
        added = self._written(folder)
        schema = arrivals.schema.json()

        def make(base):
            if base["schema"] and base["schema"] != schema:
                raise ValueError("the arrival's columns aren't those of the store")
            return added, set(), schema

        return self._change(make)

    def _written(self, folder: str) -> list[Shard]:
        return [Shard(p, n) for p, n, _ in self._list(folder) if p.endswith(".parquet")]

    def tier(self, size: int) -> int:
        t = 0
        while size >= UNIT_BYTES * self.fanout ** (t + 1):
            t += 1
        return t

    def merges(self, shards: list[Shard]) -> list[list[Shard]]:
        """Which shards to merge: per tier, if it has as many as the fanout, its shards in groups of the target size at most."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.bytes < self.target:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        out = []
        for _, mine in sorted(tiers.items()):
            if len(mine) < self.fanout:
                continue
            group, size = [], 0
            for s in sorted(mine, key=lambda s: (s.bytes, s.path)):
                if group and size + s.bytes > self.target:
                    out.append(group)
                    group, size = [], 0
                group.append(s)
                size += s.bytes
            out.append(group)
        return [g for g in out if len(g) > 1]

    def compact(self) -> dict:
        """Merge round by round until no tier has enough shards; each round is one job and one commit."""
        while True:
            base = self.manifest()
            groups, n = [], 0
            for g in self.merges(base["shards"]):
                if groups and n + len(g) > JOB_SHARDS:
                    break
                groups.append(g)
                n += len(g)
            if not groups:
                return base
            folder = f"data/{uuid.uuid4().hex}"
            of = [(s.path, i) for i, g in enumerate(groups) for s in g]
            rows = self._read([p for p, _ in of], base["schema"])
            names = F.broadcast(self.spark.createDataFrame(of, f"{FILE} string, {MERGE} int"))  # JOB_SHARDS rows at most, or one group of a target's size
            told = rows.withColumn(FILE, self._file()).join(names, FILE).drop(FILE)
            told.repartitionByRange(len(groups), MERGE).write.partitionBy(MERGE).option("compression", "zstd").parquet(f"{self.root}/{folder}")
            gone, added = {p for p, _ in of}, self._written(folder)
            had, has = rows.count(), self._read([s.path for s in added], base["schema"]).count() if added else 0
            if had != has:
                raise RuntimeError(f"a merge of {had} rows has {has}; nothing was committed")

            def make(now, gone=gone, added=added):
                if not gone <= {s.path for s in now["shards"]}:
                    raise ValueError("another compaction has merged these shards")
                return added, gone, now["schema"]

            self._change(make)

    def vacuum(self, keep_versions: int = 1, grace_s: float = GRACE_S) -> int:
        """Delete shards and pieces that none of the newest versions names and that are older than grace_s seconds; how many.

        grace_s must be above the time of the longest write and read: shards
        of a writer that hasn't committed are named by no version yet.
        """
        kept = [self.manifest(v) for v in self.versions()[-keep_versions:]]
        named = {s.path for m in kept for s in m["shards"]} | {f"pieces/{name}.json" for m in kept for name in m["pieces"]}
        gone = [p for folder in ("data", "pieces") for p, _, age in self._list(folder) if p.endswith((".parquet", ".json")) and p not in named and age > grace_s]
        for p in gone:
            self._files().delete(self._path(f"{self.root}/{p}"), False)
        return len(gone)

    # reading

    @staticmethod
    def _file() -> Column:
        """The place of a row's file below the root; the store's own names need no encoding, whatever the root's do."""
        return F.regexp_extract("_metadata.file_path", "(data/[0-9a-f]{32}/.*)$", 1)

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*(f"{self.root}/{p}" for p in paths))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the column SHARD: the place below the root of the shard that holds each."""
        found = self.manifest(version)
        if not found["schema"]:
            raise ValueError("nothing was ever appended")
        if not found["shards"]:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(found["schema"]))).withColumn(SHARD, F.lit(None).cast("string"))
        return self._read([s.path for s in found["shards"]], found["schema"]).withColumn(SHARD, self._file())


def sharded(docs: DataFrame, root: str, target_bytes: int = TARGET_BYTES, shard_rows: int = SHARD_ROWS, fanout: int = FANOUT) -> ShardStore:
    """docs appended to the store at root and compacted; earlier content stays.

    All rows and columns are kept as they are: nulls, empty and very long
    texts, ties, repeated rows.  An empty table adds no rows.  Columns may
    have any name but FILE, MERGE and SHARD, for which a ValueError is raised.
    Shards that were merged stay until vacuum().
    """
    if taken := {FILE, MERGE, SHARD}.intersection(docs.columns):
        raise ValueError(f"the store needs the column names {sorted(taken)}")
    store = ShardStore(docs.sparkSession, root, target_bytes, fanout)
    store.append(docs, shard_rows)
    store.compact()
    return store
