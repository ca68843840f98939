"""Small files on any store that Hadoop reaches."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read_json(self, path: str):
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create_json(self, path: str, value) -> bool:
        """Writes a new file as a whole; false if there is one already.

        The content is written under a name of its own and then gets the final one in one step that fails where the name
        is taken: a hard link on local files, a rename without overwriting elsewhere (atomic in HDFS; a store without
        atomic renames takes one writer at a time). A writer that dies leaves a part that nobody reads, and blocks no one.
        """
        fs, p = self._at(path)
        part = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        try:
            if p.toUri().getScheme() in (None, "file"):
                at = [self.jvm.java.nio.file.Paths.get(x.toUri().getPath(), self.spark.sparkContext._gateway.new_array(self.jvm.java.lang.String, 0)) for x in (p, part)]
                self.jvm.java.nio.file.Files.createLink(*at)
            else:
                none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = getattr(self.jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(part, p, none)
        except Exception:
            if not fs.exists(p):
                raise
            return False
        finally:
            if fs.exists(part):
                fs.delete(part, False)
        return True

    def age(self, path: str) -> float:
        """Seconds since a file or folder was last changed."""
        fs, p = self._at(path)
        return time.time() - fs.getFileStatus(p).getModificationTime() / 1000
