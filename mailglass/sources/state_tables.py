"""State that changes: small tables as Parquet snapshots, of which a manifest names those that hold.

A commit writes the new snapshots of any number of tables, then one manifest that names them together with the unchanged ones.
Until the manifest is there, readers see the version before, and what a crash has left is named by none. Manifests are
numbered; of two writers that start from one version, the second one's number is taken and it fails instead of overwriting.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The tables of a mail folder's state.
SCHEMAS = {
    "sender_history": "addr string, domain string, count long, first_seen timestamp, last_seen timestamp, replied boolean, link_domains array<string>",
    "trust_files": "path string, counted_at timestamp",
    "trust_state": "root string, fingerprint string, files long, inbound long, replied_marks long, updated_at timestamp",
    "human_verdict": "scope string, key string, verdict string, created_at timestamp, expires_at timestamp, source string, note string",
    "notify_state": "key string, last_at timestamp",
    "reports": "report_id string, path string, score int, verdict string, category string, signals array<string>, ioc_count int, created_at timestamp",
    "intel_cache": "key string, value string, created_at timestamp, expires_at timestamp",
    "report_index": "report_id string, filename string, verdict string, score int, created_at timestamp, ioc_count int, report_path string, page_path string",
    "events": "folder string, at timestamp, kind string, text string, round long",
    "mailbox_sync": "folder string, uidvalidity long, last_uid long, last_sync timestamp",
}


class ConflictError(RuntimeError):
    """Another commit was made since the version that this one started from."""


class StateTables:
    """Versioned tables below `root`, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str] | None = None) -> None:
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas or SCHEMAS
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *filter(None, parts)]))

    def versions(self) -> list[int]:
        at = self._path("manifests")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict:
        """The version (the newest if None) and the folder of each table that has one."""
        version = max(self.versions(), default=0) if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}}
        text = self.spark.read.text(str(self._path("manifests", f"{version:010d}.json")), wholetext=True).first()[0]
        return json.loads(text)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is in a version; empty if it was never written. Later commits do not change what is read."""
        at = self.manifest(version)["tables"].get(name)
        return self.spark.createDataFrame([], self.schemas[name]) if at is None else self.spark.read.schema(self.schemas[name]).parquet(str(self._path(at)))

    def commit(self, changes: dict[str, DataFrame], base: int | None = None) -> int:
        """Replace tables, all of them or none; returns the new version.

        base: the version that the changes were computed from (the newest if None). Columns are taken by name.
        """
        unknown = set(changes) - set(self.schemas)
        if unknown:
            raise ValueError(f"no tables {sorted(unknown)}")
        old = self.manifest(base)
        tables = dict(old["tables"])
        for name, df in changes.items():
            tables[name] = f"{name}/{uuid.uuid4().hex}"
            typed = self.spark.createDataFrame([], self.schemas[name]).schema
            df.select(*[df[f.name].cast(f.dataType) for f in typed]).write.parquet(str(self._path(tables[name])))
        return self._switch({"version": old["version"] + 1, "tables": tables})

    def _switch(self, manifest: dict) -> int:
        jvm = self.spark.sparkContext._jvm
        new, target = self._path("manifests", f".{uuid.uuid4().hex}"), self._path("manifests", f"{manifest['version']:010d}.json")
        out = self._fs.create(new, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            no_overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self._hadoop.FileContext.getFileContext(target.toUri(), self._conf).rename(new, target, no_overwrite)
        except Exception as e:
            if self._fs.exists(target):
                self._fs.delete(new, False)
                raise ConflictError(f"version {manifest['version']} is taken") from e
            raise
        return manifest["version"]

    def remove(self, path: str) -> None:
        """Delete a folder of intermediate rows."""
        self._fs.delete(self._hadoop.Path(path), True)

    def exists(self, path: str) -> bool:
        at = self._hadoop.Path(path)
        return at.getFileSystem(self._conf).exists(at)

    def clear(self, *names: str) -> dict[str, int]:
        """Empty tables in one commit; returns how many rows each had."""
        had = {n: self.read(n).count() for n in names}
        self.commit({n: self.spark.createDataFrame([], self.schemas[n]) for n in names})
        return had

    def vacuum(self, keep: int = 2) -> int:
        """Delete manifests older than the newest `keep`, and snapshots that no kept one names; returns how many snapshots.
        Not while others write or still read old versions."""
        versions = self.versions()
        named = {at for v in versions[-keep:] for at in self.manifest(v)["tables"].values()}
        for v in versions[:-keep]:
            self._fs.delete(self._path("manifests", f"{v:010d}.json"), False)
        gone = 0
        for name in self.schemas:
            at = self._path(name)
            for s in self._fs.listStatus(at) if self._fs.exists(at) else ():
                if f"{name}/{s.getPath().getName()}" not in named:
                    gone += bool(self._fs.delete(s.getPath(), True))
        return gone


def purge_analysis(tables: StateTables, with_intel: bool = False) -> dict[str, int]:
    """Forget what was analysed (reports and their index, alert marks and, if asked, stored look-ups), together; repeating it changes nothing.
    History, human verdicts and the mailbox cursor stay."""
    return tables.clear("reports", "report_index", "notify_state", *(("intel_cache",) if with_intel else ()))
