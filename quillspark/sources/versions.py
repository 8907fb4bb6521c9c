"""Tables that are replaced as a whole: every version in a folder of its own, one small file says which one holds.

A write goes to a new folder first.  Then a commit file is written under
another name and renamed to the next number; a rename to a name that is taken
fails, so of two writers one wins and the other's version stays unseen.  A
reader lists the commit files and takes the highest.  Whatever step a writer
dies at, readers find the old version or the new one whole.

Commits are never changed: older versions stay readable by number or by the
run that wrote them, until ``expire`` removes them.  On a store whose rename
replaces its target two writers at once can both believe that they won.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

COMMITS, DIGITS = "_commits", 10


class Versions:
    """The versions of one table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.folder(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.folder(f"{self.path}/{name}")

    def commits(self) -> list[dict]:
        """All versions that hold or held, oldest first: number, data folder, run."""
        if not self.fs.exists(self._at(COMMITS)):
            return []
        names = sorted(f.getPath().getName() for f in self.fs.listStatus(self._at(COMMITS)))
        return [json.loads(self._read(f"{COMMITS}/{n}")) for n in names if n.isdigit()]

    def _read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def stage(self, rows: DataFrame) -> str:
        """Writes rows as a version that nobody sees yet; returns its folder."""
        data = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{data}")
        return data

    def prepare(self, data: str, run_id: str | None = None) -> tuple[str, str]:
        """Writes the commit file under a name that readers ignore; returns it and the name that it shall have."""
        number = max((c["version"] for c in self.commits()), default=0) + 1
        hidden = f"{COMMITS}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self._at(hidden), False)
        try:
            stream.write(bytearray(json.dumps({"version": number, "data": data, "run_id": run_id}).encode()))
        finally:
            stream.close()
        return hidden, f"{COMMITS}/{number:0{DIGITS}}"

    def publish(self, hidden: str, name: str) -> None:
        """Makes a prepared commit the one that holds, or fails if another writer was first."""
        if self.fs.exists(self._at(name)) or not self.fs.rename(self._at(hidden), self._at(name)):
            self.fs.delete(self._at(hidden), False)
            raise RuntimeError(f"another writer has made {name}")

    def replace(self, rows: DataFrame, run_id: str | None = None) -> int:
        """Replaces the table; the number of the new version."""
        self.publish(*self.prepare(self.stage(rows), run_id))
        return self.commits()[-1]["version"]

    def read(self, version: int | None = None, run_id: str | None = None) -> DataFrame:
        """The rows that hold, or those of a version, or the last of a run."""
        found = [c for c in self.commits() if version in (None, c["version"]) and run_id in (None, c["run_id"])]
        if not found:
            raise FileNotFoundError(f"{self.path} has no such version")
        return self.spark.read.parquet(f"{self.path}/{found[-1]['data']}")

    def expire(self, keep: int = 2) -> None:
        """Removes all but the last ``keep`` versions, and folders that no commit names.

        Commit files go first, so no reader is sent to a folder that is gone; to
        be run while no writer is at work.
        """
        old = self.commits()[: -keep or None]
        for c in old:
            self.fs.delete(self._at(f"{COMMITS}/{c['version']:0{DIGITS}}"), False)
        named = {c["data"] for c in self.commits()}
        for f in self.fs.listStatus(self.folder(self.path)):
            name = f.getPath().getName()
            if name.startswith("v-") and name not in named:
                self.fs.delete(f.getPath(), True)


def replace_table(rows: DataFrame, path: str, run_id: str | None = None) -> int:
    """Replaces the versioned table at ``path``; a failed write leaves what was there."""
    return Versions(rows.sparkSession, path).replace(rows, run_id)


def read_table(spark: SparkSession, path: str, version: int | None = None, run_id: str | None = None) -> DataFrame:
    return Versions(spark, path).read(version, run_id)
