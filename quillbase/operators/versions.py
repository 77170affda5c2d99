"""Tables published in versions: data is written first, a manifest last, and readers keep to the version they began with.

A root holds data folders, which nobody changes, and manifests by number. A version exists once its manifest does; that is put
in place by a rename, behind a lock file that only one writer can create. Stale versions, and data that no manifest names, go by collect().
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..shared import remove


#: The lock of a writer that has died, without a manifest, is passed over after so many seconds.
STALE_LOCK_S = 600.0


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def all(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> int | None:
        return max(self.all(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        """What a version says; the latest if none is named, empty if there is none."""
        version = self.latest() if version is None else version
        if version is None:
            return {}
        rows = self.spark.read.text(f"{self.root}/manifest/{version:012}.json", wholetext=True)
        return json.loads(rows.first()[0])

    def new_folder(self, label: str) -> str:
        """A folder for data, below the root, that no one else has."""
        return f"data/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, folder: str) -> None:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")

    def read(self, *folders: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def commit(self, content: Mapping, after: int | None) -> int:
        """Puts the manifest that follows `after` in place."""
        version = 0 if after is None else after + 1
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        made = self._path(f"{self.root}/manifest/{uuid.uuid4().hex}.tmp")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(dict(content), sort_keys=True).encode()))
        out.close()
        final = self._path(f"{self.root}/manifest/{version:012}.json")
        # some file systems rename over a file that is there: a lock file that only one can create comes first
        lock = self._path(f"{self.root}/manifest/{version:012}.lock")
        if self._fs.exists(lock) and not self._fs.exists(final) and self._fs.getFileStatus(lock).getModificationTime() < (time.time() - STALE_LOCK_S) * 1000:
            self._fs.delete(lock, False)
        try:
            self._fs.create(lock, False).close()
        except Exception as e:
            self._fs.delete(made, False)
            raise Conflict(f"version {version} of {self.root} is taken") from e
        if not self._fs.rename(made, final):
            raise Conflict(f"version {version} of {self.root} is taken")
        return version

    def publish(self, tables: Mapping[str, DataFrame], after: int | None = None, **facts) -> int:
        """Writes tables and makes them one version, which follows `after` (the latest if not named)."""
        after = self.latest() if after is None else after
        folders = {}
        for name, df in tables.items():
            folders[name] = self.new_folder(name)
            self.write(df, folders[name])
        return self.commit({"tables": folders, **facts}, after)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version; later versions don't change what is read."""
        return self.read(self.manifest(version)["tables"][name])

    def collect(self, keep: int = 2, grace_s: float = 3600.0) -> list[str]:
        """Removes manifests before the last `keep`, and data that no manifest left names and that is older than grace_s; what was removed.

        The grace keeps the data of writers that haven't published yet, and of readers of stale versions.
        """
        versions = self.all()
        kept = versions[-keep:]
        said = "\n".join(json.dumps(self.manifest(v)) for v in kept)
        gone = []
        for v in versions[:-keep] if keep else versions:
            for end in ("json", "lock"):
                remove(self.spark, f"{self.root}/manifest/{v:012}.{end}")
            gone.append(f"manifest/{v:012}.json")
        before = (time.time() - grace_s) * 1000
        for name in self._names("data"):
            at = self._path(f"{self.root}/data/{name}")
            if f"data/{name}" not in said and self._fs.getFileStatus(at).getModificationTime() <= before:
                remove(self.spark, f"{self.root}/data/{name}")
                gone.append(f"data/{name}")
        return gone
