"""A table by key that is changed in numbered steps: batches of a stream, or versions of a store.

Each step writes its rows to a folder of its own and then commits a manifest: the list of the folders that
hold the table. When ``FAN`` folders of a level are there they are merged to one of the next level, newest row
of each key, so a reader opens at most ``(FAN - 1) * levels`` folders, the logarithm of the number of steps, and
each row is rewritten once a level. Nothing is changed in place: a manifest that was read stays true.

A manifest is written aside and renamed to its number. The rename fails if the number is taken, so of two
writers of one step one wins and the other gets ``Conflict`` (on file systems with an atomic rename, as HDFS; a
local folder or an object store checks and renames). A repeated stream batch commits its number again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from logmill.operators.ordering import extreme_rows

FAN = 8
STEP = "step_"


class Conflict(RuntimeError):
    """Another writer has committed this step."""


@dataclass(frozen=True)
class Manifest:
    step: int
    schema: StructType
    #: (level, folder), oldest first
    folders: list[tuple[int, str]]


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], fan: int = FAN) -> None:
        self.spark, self.root, self.keys, self.fan = spark, root.rstrip("/"), keys, fan
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def steps(self) -> list[int]:
        """All committed steps."""
        where = self._path("_steps")
        if not self._fs.exists(where):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, step: int | None = None) -> Manifest | None:
        """Of a step, or of the newest one; None if there is none."""
        if step is None:
            step = max(self.steps(), default=None)
        if step is None:
            return None
        stream = self._fs.open(self._path(f"_steps/{step:012d}.json"))
        try:
            held = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(step, StructType.fromJson(held["schema"]), [tuple(x) for x in held["folders"]])

    def _commit(self, manifest: Manifest, again: bool) -> None:
        text = json.dumps({"schema": manifest.schema.jsonValue(), "folders": manifest.folders})
        aside, to = self._path(f"_steps/.{uuid.uuid4().hex}"), self._path(f"_steps/{manifest.step:012d}.json")
        out = self._fs.create(aside, True)
        out.write(text.encode())
        out.close()
        rename = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if again else rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        try:
            context.rename(aside, to, options)
        except Exception as error:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"step {manifest.step} is committed already") from error
            raise

    def _read(self, schema: StructType, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders))

    def _write(self, rows: DataFrame, level: int, step: int) -> str:
        name = f"level={level}/{step:012d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}")
        return name

    def put(self, rows: DataFrame, step: int | None = None, again: bool = False) -> int:
        """Commit ``rows`` (at most one of each key) as a step: the one after the newest, if not given."""
        older = [s for s in self.steps() if step is None or s < step]
        last = self.manifest(older[-1]) if older else None
        step = (last.step + 1 if last else 0) if step is None else step
        rows = rows.withColumn(STEP, F.lit(step).cast("bigint"))
        folders = [*(last.folders if last else ()), (0, self._write(rows, 0, step))]
        level = 0
        while len(folders) >= self.fan and all(at == level for at, _ in folders[-self.fan :]):
            full = [f for _, f in folders[-self.fan :]]
            merged = extreme_rows(self._read(rows.schema, full), self.keys, STEP, newest=True)
            folders = [*folders[: -self.fan], (level + 1, self._write(merged, level + 1, step))]
            level += 1
        self._commit(Manifest(step, rows.schema, folders), again)
        return step

    def rows(self, step: int | None = None) -> DataFrame:
        """The newest row of each key as of a step."""
        manifest = self.manifest(step)
        if manifest is None:
            raise ValueError(f"nothing is committed in {self.root}")
        read = self._read(manifest.schema, [f for _, f in manifest.folders])
        return extreme_rows(read, self.keys, STEP, newest=True).drop(STEP)
