"""A sink that writes a file a row and shows all of them or none."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.checks import DataError, gate
from ..session import ship_package

#: Files that the driver moves at a time in the commit.
MOVES = 32


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task left: its folder, where the list of its files is, and how many they are."""

    folder: str
    files: int


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of an address: a path, or file, hdfs, s3 and gs URIs."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}" if uri.startswith("/") else uri)


class CommittedFiles(DataSource):
    """Sink of rows (name, text): ``<path>/<name><suffix>``, published together when every task has ended well."""

    @classmethod
    def name(cls) -> str:
        return "committed_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite):
        return CommittedWriter(self.options["path"], self.options.get("suffix", ""), self.options["staging"])


class CommittedWriter(DataSourceWriter):
    """Each attempt of a task writes to a folder of its own below the staging folder; only committed attempts are published."""

    LIST = "_files.json"

    def __init__(self, path: str, suffix: str, staging: str):
        self.path, self.suffix, self.staging = path, suffix, staging

    def write(self, iterator) -> Written:
        store, staging = store_of(self.staging)
        folder, names = f"{staging}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=False)  # not after an abort took the staging folder away
        for row in iterator:
            if not row.name or "/" in row.name or row.name.startswith((".", "_")):
                raise DataError(f"{row.name} is no file name")
            with store.open_output_stream(f"{folder}/{row.name}{self.suffix}") as f:
                f.write((row.text or "").encode("utf-8", "surrogatepass"))
            names.append(row.name + self.suffix)
        with store.open_output_stream(f"{folder}/{self.LIST}") as f:
            f.write(json.dumps(names).encode())
        return Written(folder.rsplit("/", 1)[-1], len(names))

    def commit(self, messages) -> None:
        """Move committed files together below the staging folder, then give that folder the target's name: one step that shows all."""
        store, staging = store_of(self.staging)
        ready = f"{staging}/ready"
        store.create_dir(ready, recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            for m in messages:
                if m is None:
                    continue
                with store.open_input_stream(f"{staging}/{m.folder}/{self.LIST}") as f:
                    names = json.loads(f.readall())
                list(pool.map(lambda n, own=m.folder: store.move(f"{staging}/{own}/{n}", f"{ready}/{n}"), names))
        _, target = store_of(self.path)
        if store.get_file_info(target).type != fs.FileType.NotFound:
            raise DataError(f"{self.path} is there already")
        store.move(ready, target)
        store.delete_dir(staging)

    def abort(self, messages) -> None:
        """Tasks may still run: the staging folder loses its name first, so that they cannot write into what is deleted."""
        store, staging = store_of(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.move(staging, f"{staging}.aborted")
            store.delete_dir(f"{staging}.aborted")


def write_files_committed(df: DataFrame, name: str, text: str, target: str, suffix: str = "") -> int:
    """A file for each row of ``df`` in the new folder ``target``; how many they are.

    The folder appears with all files or not at all: a failing task, a name
    twice or a bad name leave nothing, and an attempt that Spark runs again adds
    nothing. Executors and the driver reach the folder by its address (a shared
    path, hdfs, s3, gs); null texts are empty files. No rows give an empty folder.
    """
    spark = df.sparkSession
    ship_package(spark)
    store, place = store_of(target)
    if store.get_file_info(place).type != fs.FileType.NotFound:
        raise DataError(f"{target} is there already")
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    gate(rows.groupBy("name").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or name is null"), "a file's name is missing or used twice", ["name"])
    head, _, last = target.rstrip("/").rpartition("/")
    staging = f"{head}/.{last}.staging-{uuid.uuid4().hex}"
    spark.dataSource.register(CommittedFiles)
    store.create_dir(store_of(staging)[1], recursive=True)
    try:
        rows.write.format("committed_files").mode("append").option("suffix", suffix).option("staging", staging).save(target)
    except Exception:
        CommittedWriter(target, suffix, staging).abort([])  # also where Spark failed before it could call it
        raise
    return sum(1 for f in store.get_file_info(fs.FileSelector(place)) if f.is_file)
