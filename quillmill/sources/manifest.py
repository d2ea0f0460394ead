"""The state of a table of many folders in one small file that is replaced at once.

A writer first writes new folders, which nobody reads yet, then a manifest that names all folders of the new state. Manifests are numbered; one is written
beside its place and renamed, and the one with the largest number is the state. What breaks off before the renaming leaves the former state as it was, and folders that no
manifest names, which the next writer removes. Folders of the state before last are kept until then, for those who still read them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifest:
    """Numbered states below a folder. One writer at a time: of two that put the same number, the second fails."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def fs(self):
        return self.path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs().listStatus(self.path(name))] if self.fs().exists(self.path(name)) else []

    def delete(self, name: str) -> None:
        self.fs().delete(self.path(name), True)

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names("manifests") if n.endswith(".json") and not n.startswith((".", "_")))

    def _read(self, number: int) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/manifests/{number}.json").collect()))

    def state(self) -> dict | None:
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else None

    def put(self, state: dict) -> None:
        number = (self._numbers() or [-1])[-1] + 1
        beside = self.path(f"manifests/.{uuid.uuid4().hex}")
        out = self.fs().create(beside, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self.fs().rename(beside, self.path(f"manifests/{number}.json")):
            raise RuntimeError(f"manifest {number} is there already: another writer was faster")

    def sweep(self, top: str, folders_of) -> None:
        """Remove the folders below ``top`` that neither the last state nor the one before it names; folders_of gives a state's."""
        numbers = self._numbers()
        kept = {f for n in numbers[-2:] for f in folders_of(self._read(n))}
        for name in self.names(top):
            if name not in kept:
                self.delete(f"{top}/{name}")
        for n in numbers[:-2]:
            self.delete(f"manifests/{n}.json")
