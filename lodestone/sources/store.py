"""The index on disk: nested entries as Parquet in shards by the hash of the path, and the manifest derived from them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 7
ENTRY = (
    "path string, language string, content_hash string, is_test boolean, parse_status string, "
    "symbols array<struct<id:string,name:string,kind:string,start_line:int,end_line:int,signature:string,doc:string,export_kind:string,parent_id:string>>, "
    "imports array<struct<source_text:string,imported_names:array<string>,aliased:array<struct<local:string,imported:string>>,start_line:int,is_external:boolean>>, "
    "exports array<struct<name:string,start_line:int>>, calls array<struct<caller_id:string,callee_name:string,start_line:int>>, "
    "heritages array<struct<symbol_name:string,kind:string,parents:array<string>,start_line:int>>, file_summary string, identifiers array<string>, "
    "body_tokens array<struct<term:string,tf:int>>, body_length int"
)


def shard(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 2)


def valid_entry() -> Column:
    """Whether a record has what an entry must have; optional parts may be null."""
    needed = [F.col(c).isNotNull() for c in ("path", "language", "content_hash", "parse_status", "symbols", "imports", "exports", "calls", "heritages")]
    ok = needed[0] & (F.col("path") != "") & F.col("content_hash").rlike("^[0-9a-f]{64}$")
    for c in needed[1:]:
        ok = ok & c
    ok = ok & F.col("language").isin("typescript", "javascript", "json", "markdown", "generic")
    good_symbols = F.forall("symbols", lambda s: s["id"].isNotNull() & s["name"].isNotNull() & (s["start_line"] >= 1) & (s["end_line"] >= s["start_line"]))
    return F.coalesce(ok & good_symbols, F.lit(False))


class EntryStore:
    """Entries below one folder, in 256 shards by path. A change writes the shards that it touches anew, in a generation of
    its own, and a list that says for every shard which generation holds it; CURRENT names the list. Replacing CURRENT is one
    atomic rename, so a reader sees all of a change or none; the shards of the list before stay for those who still read it.
    A store of another schema version counts as empty."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _lines(self, name: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{name}")
        return [r[0] for r in self.spark.read.text(f"{self.root}/{name}").collect()] if fs.exists(p) else []

    def _current(self) -> tuple[str | None, dict[str, str]]:
        """The name of the current list, and generation by shard: 256 short lines at most."""
        head = (self._lines("CURRENT") or [""])[0].split(" ")
        if len(head) != 2 or head[0] != str(SCHEMA_VERSION):
            return None, {}
        return head[1], dict(line.split(" ") for line in self._lines(head[1]))

    def _read(self, shards: dict[str, str]) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.root}/{g}/shard={s}" for s, g in sorted(shards.items())]).filter(valid_entry())

    def load(self) -> DataFrame:
        """The valid entries; damaged records are left out."""
        return self._read(self._current()[1])

    def _put(self, name: str, lines: list[str]) -> None:
        """Writes a small file under another name and moves it over ``name`` in one step."""
        fs, tmp = self._fs(f"{self.root}/.{name}-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write("".join(f"{x}\n" for x in lines).encode())
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        target = fs.makeQualified(self._fs(f"{self.root}/{name}")[1])
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), target, options)

    def upsert(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Replaces the entries of ``changed`` (by path), drops those of ``removed`` (path), all or nothing. Only the shards
        of these paths are read and written."""
        gone = changed.select("path")
        if removed is not None:
            gone = gone.unionByName(removed.select("path"))
        gone = gone.distinct()
        touched = {r[0] for r in gone.select(shard(F.col("path"))).distinct().collect()}  # 256 at most
        before, shards = self._current()
        old = self._read({s: g for s, g in shards.items() if s in touched}).join(gone, "path", "left_anti")
        name = f"gen-{uuid.uuid4().hex}"
        entries = old.unionByName(changed.select(*old.columns)).withColumn("shard", shard(F.col("path")))
        entries.repartition("shard").write.partitionBy("shard").parquet(f"{self.root}/{name}")
        fs, at = self._fs(f"{self.root}/{name}")
        held = {f.getPath().getName().removeprefix("shard=") for f in fs.listStatus(at) if f.isDirectory()}
        after = {s: g for s, g in shards.items() if s not in touched} | {s: name for s in held}
        self._put(f"{name}.list", [f"{s} {g}" for s, g in sorted(after.items())])
        self._put("CURRENT", [f"{SCHEMA_VERSION} {name}.list"])
        self._sweep({f"{name}.list": after} | ({before: shards} if before else {}))

    def _sweep(self, kept: dict[str, dict[str, str]]) -> None:
        """Deletes lists, generations and shards that neither the current list nor the one before names."""
        fs, root = self._fs(self.root)
        named = {(g, s) for shards in kept.values() for s, g in shards.items()}
        for f in fs.listStatus(root):
            name = f.getPath().getName()
            if name.endswith(".list") and name not in kept:
                fs.delete(f.getPath(), False)
            elif f.isDirectory() and name.startswith("gen-"):
                own = {s for g, s in named if g == name}
                if not own:
                    fs.delete(f.getPath(), True)
                    continue
                for part in fs.listStatus(f.getPath()):
                    if part.isDirectory() and part.getPath().getName().removeprefix("shard=") not in own:
                        fs.delete(part.getPath(), True)

    def remove(self, paths: DataFrame) -> None:
        self.upsert(self.spark.createDataFrame([], ENTRY), paths)

    def clear(self) -> None:
        fs, p = self._fs(self.root)
        fs.delete(p, True)


def manifest(entries: DataFrame) -> DataFrame:
    return entries.select("path", "content_hash")


def manifest_differs(ours: DataFrame, derived: DataFrame) -> DataFrame:
    """path, ours, derived of all paths on which two manifests don't agree; none if they are equal."""
    a, b = ours.select("path", F.col("content_hash").alias("ours")), derived.select("path", F.col("content_hash").alias("derived"))
    return a.join(b, "path", "full").filter(~F.col("ours").eqNullSafe(F.col("derived")))


def index_version(entries: DataFrame) -> DataFrame:
    """One row: twelve hexadecimal digits that any change of a path or a hash changes.

    Lines are hashed shard by shard, then the at most 256 shards' hashes, so no list of all lines is made."""
    line = F.concat("path", F.lit(":"), "content_hash")
    parts = entries.groupBy(F.substring(F.sha2("path", 256), 1, 2).alias("s"), F.substring(F.sha2("path", 256), 3, 2).alias("s2")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("h"))
    shards = parts.groupBy("s").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s2", "h"))), lambda x: x["h"]), "\n"), 256).alias("h"))
    every = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "h"))), lambda x: x["h"]), "\n")
    return shards.agg(F.substring(F.sha2(every, 256), 1, 12).alias("index_version"))


def exact_index_version(entries: DataFrame) -> DataFrame:
    """The same over one sorted list of lines, for stores that fit into one task."""
    line = F.concat("path", F.lit(":"), "content_hash")
    return entries.agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256), 1, 12).alias("index_version"))
