"""A manifest: which files of a folder count, as numbered versions that are written once.

A version is a small file that is written aside and then renamed to its number, which fails if
the number is taken. So of two writers one wins, and the other, which is told, looks again; and a
reader never sees a version that is not complete.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/manifest"

    def _file(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def newest(self) -> tuple[int, Any]:
        """(number, content) of the newest version; (-1, None) without any."""
        path, files = self._file()
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        numbers = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]
        if not numbers:
            return -1, None
        stream = files.open(self._file(f"v{max(numbers):012d}.json")[0])
        try:
            return max(numbers), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, after: int, content: Any) -> bool:
        """Writes the version that follows `after`; False if another writer was first."""
        (aside, files), (final, _) = self._file(f".{uuid.uuid4().hex}"), self._file(f"v{after + 1:012d}.json")
        stream = files.create(aside, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        fs = self.spark._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            context.rename(files.makeQualified(aside), files.makeQualified(final), options)
        except Exception:
            files.delete(aside, False)
            if files.exists(final):
                return False
            raise
        return True
