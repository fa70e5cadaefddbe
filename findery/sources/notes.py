"""Small files that say what counts in a folder that many write to.

A note is written aside and renamed to a name that must be free, so readers see it whole or not at all, and of two
writers of one name only one succeeds."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Notes:
    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._gateway, self._jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(conf)
        self._files = self._hadoop.FileContext.getFileContext(self.fs.makeQualified(self.at("")).toUri(), conf)

    def at(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def has(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def put(self, name: str, said: dict) -> bool:
        """False if the name is taken."""
        aside = self.at(f"pending/{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(json.dumps(said).encode())
        stream.close()
        self.fs.mkdirs(self.at(name).getParent())
        keep = self._gateway.new_array(self._hadoop.Options.Rename, 1)
        keep[0] = self._hadoop.Options.Rename.NONE
        try:
            self._files.rename(aside, self.at(name), keep)
        except Py4JJavaError as error:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        return True

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        if not self.has(folder):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self.at(folder)))

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)
