"""Stored tables that change all at once.

A table's folder holds data folders ``_written=<id>``, each written once under a
fresh name, and numbered publications ``_published/<n>.json``, each saying
which month of which part lies in which data folder. A write adds data folders
first and one publication last, by a rename that fails if another writer took
the number. So a reader sees the state before a write or the state after it,
and a write that ends early leaves only folders that nothing refers to.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Spark's readers of a folder pass over names with an underscore.
PUBLICATIONS = "_published"


class ConcurrentWrite(RuntimeError):
    """Another writer published a change of the same table in the meantime."""


@dataclass
class Publication:
    """``parts``: for each part of a table, its months and the data folder of each. ``columns``: what each part holds."""

    number: int = 0
    parts: dict[str, dict[str, str]] = field(default_factory=dict)
    columns: dict[str, list[str]] = field(default_factory=dict)


class Store:
    """The folder of one table, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _names(self, *folder: str) -> list[str]:
        where = self._at(*folder)
        files = where.getFileSystem(self._conf)
        return [entry.getPath().getName() for entry in files.listStatus(where)] if files.exists(where) else []

    def current(self) -> Publication | None:
        """The newest publication, none if nothing was ever published."""
        numbers = [int(name[:-5]) for name in self._names(PUBLICATIONS) if name.endswith(".json") and name[:-5].isdigit()]
        if not numbers:
            return None
        where = self._at(PUBLICATIONS, f"{max(numbers):08d}.json")
        stream = where.getFileSystem(self._conf).open(where)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Publication(**json.loads(text))

    def write(self, frame: DataFrame, part: str) -> dict[str, str]:
        """Store a frame by ``ref_month`` in a fresh data folder, unseen until published; its months and their folder."""
        folder = f"{part}/_written={uuid.uuid4().hex}"
        frame.write.partitionBy("ref_month").parquet(f"{self.path}/{folder}")
        months = [name.split("=", 1)[1] for name in self._names(folder) if name.startswith("ref_month=")]
        return dict.fromkeys(months, folder)

    def publish(self, after: Publication, state: Publication) -> Publication:
        """Make ``state`` the current one, if ``after`` still is."""
        state.number = after.number + 1
        files = self._at().getFileSystem(self._conf)
        draft, final = (self._at(PUBLICATIONS, name) for name in (f".{uuid.uuid4().hex}", f"{state.number:08d}.json"))
        stream = files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(asdict(state), ensure_ascii=False).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(final), how)
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise ConcurrentWrite(f"{self.path} was changed by another writer") from error
            raise
        return state

    def read(self, state: Publication, part: str, schema: StructType) -> DataFrame:
        """The months of a part as published; ``schema`` ends with ``ref_month``. No footer is opened to plan it."""
        months = state.parts.get(part, {})
        if not months:
            return self._marked(self.spark.createDataFrame([], schema))
        paths = [f"{self.path}/{folder}/ref_month={month}" for month, folder in months.items()]
        frame = self.spark.read.schema(schema).option("basePath", f"{self.path}/{part}").parquet(*paths)
        return self._marked(frame.select(*[f"`{name.replace('`', '``')}`" for name in schema.names]))

    def _marked(self, frame: DataFrame) -> DataFrame:
        frame._flightpulse_folder = self.path
        return frame

    @staticmethod
    def folder_of(frame: DataFrame | None) -> str | None:
        """The folder of the table that a frame is, as read."""
        return getattr(frame, "_flightpulse_folder", None)

    def remove_unpublished(self, keep: int = 1) -> list[str]:
        """Delete data folders that none of the newest ``keep`` publications refers to, and older publications.

        For a time when no write is running; queries on an older state end with it.
        """
        files = self._at().getFileSystem(self._conf)
        numbers = sorted(int(name[:-5]) for name in self._names(PUBLICATIONS) if name.endswith(".json") and name[:-5].isdigit())
        used, parts = set(), set()
        for number in numbers[-keep:]:
            where = self._at(PUBLICATIONS, f"{number:08d}.json")
            stream = files.open(where)
            state = Publication(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
            parts |= set(state.parts)
            used |= {folder for months in state.parts.values() for folder in months.values()}
        gone = [f"{part}/{name}" for part in sorted(parts) for name in self._names(part) if f"{part}/{name}" not in used]
        for folder in gone:
            files.delete(self._at(*folder.split("/")), True)
        for number in numbers[:-keep]:
            files.delete(self._at(PUBLICATIONS, f"{number:08d}.json"), False)
        return gone
