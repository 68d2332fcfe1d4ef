"""A folder of numbered records, of which the last counts; a new one appears whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has taken the number."""


class Folder:
    """Files of any store that Spark can write, by its file system interface."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """The entries of a folder in order; none if it does not exist."""
        where = self._at(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> None:
        """Writes under another name and renames, which fails where the name is taken."""
        draft = f".{uuid.uuid4().hex}"
        stream = self._fs.create(self._at(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at(draft), self._at(name)):
            self.delete(draft)
            raise Conflict(name)


class Log:
    """Records 0, 1, 2 and so on as JSON files in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.folder.names() if n.endswith(".json") and not n.startswith(".")]

    def get(self, number: int) -> dict:
        return json.loads(self.folder.read(f"{number:010d}.json"))

    def last(self) -> dict | None:
        numbers = self.numbers()
        return self.get(numbers[-1]) if numbers else None

    def append(self, record: dict) -> int:
        """Writes the record after the last; of two writers at once one gets a Conflict."""
        number = (self.numbers() or [-1])[-1] + 1
        self.folder.write_once(f"{number:010d}.json", json.dumps(record))
        return number

    def table(self, schema: str) -> DataFrame:
        """All records as rows, read by tasks."""
        return self.folder.spark.read.schema(schema).json(self.folder.path)
