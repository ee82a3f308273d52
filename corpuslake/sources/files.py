"""Small files of a shared folder, on any file system that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Folder:
    """JSON notes by name; a note is either there as a whole or not there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._disk = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        here = self._path(self.path)
        return sorted(s.getPath().getName() for s in self._disk.listStatus(here)) if self._disk.exists(here) else []

    def exists(self, name: str) -> bool:
        return self._disk.exists(self._path(f"{self.path}/{name}"))

    def read(self, name: str) -> dict:
        stream = self._disk.open(self._path(f"{self.path}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, value: dict, replace: bool = False) -> bool:
        """Write a note beside its place and rename it; false if there is one already and it is not to be replaced."""
        place = self._path(f"{self.path}/{name}")
        if self._disk.exists(place):
            if not replace:
                return False
            self._disk.delete(place, False)
        temp = self._path(f"{self.path}/.{name}.{self.spark._jvm.java.util.UUID.randomUUID()}")
        stream = self._disk.create(temp, True)
        stream.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        stream.close()
        done = self._disk.rename(temp, place)
        if not done:
            self._disk.delete(temp, False)
        return done

    def delete(self, name: str) -> bool:
        return self._disk.delete(self._path(f"{self.path}/{name}"), True)
