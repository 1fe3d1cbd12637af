"""Partitioned Parquet tables that change as a whole: upserts, range replacement, staged updates, appends and columns.

New content is written to a folder of its own. What the table consists of stands in one small file, which is swapped by a
rename: readers see the table before or after a change, never in between, and a writer that fails leaves it as it was.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Buckets of a table that is split by a key; writing deals large ones to several tasks and files.
BUCKETS = 32


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; on a local master a temporary one where that is unset."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-store-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own and read back, for plans that need it several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """A table in the folder ``path``, split by the values of the column ``by``; one writer at a time.

    A column with many values, such as an entity's key, needs ``buckets``: the table is then split by that many buckets of
    a hash of the values, so that its folders don't grow in number with them, and changes of some values write their
    buckets again. Null is a value of ``by`` like any other. A second writer is noticed when it commits and raises RuntimeError. Folders
    of earlier states stay, for readers that still use them, until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, by: str, buckets: int | None = None):
        self.spark, self.path, self.by, self.buckets = spark, path, by, buckets
        value = F.col(by).cast("string")
        self.code = F.pmod(F.xxhash64(value), F.lit(buckets)).cast("string") if buckets else F.coalesce(F.hex(value), F.lit("null"))

    def _fs(self):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _text(self) -> str | None:
        """The table's state: its schema and, for every value, the folders that hold its rows."""
        if not self._fs().exists(self._at("current.json")):
            return None
        return self.spark.read.text(f"{self.path}/current.json", wholetext=True).first()[0]

    def _commit(self, before: str | None, schema: StructType, parts: dict[str, list[str]]) -> None:
        if self._text() != before:
            raise RuntimeError(f"{self.path} was changed by another writer")
        jvm, new = self.spark._jvm, self._at(f"new-{uuid.uuid4().hex}.json")
        out = self._fs().create(new, True)
        out.write(bytearray(json.dumps({"schema": schema.json(), "parts": parts}).encode()))
        out.close()
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, self._at("current.json"), how)

    def _written(self, df: DataFrame) -> dict[str, list[str]]:
        """The folder of every value of ``df``; nothing is left of it if the writing fails. Values with many rows are dealt to several tasks."""
        folder = f"v-{uuid.uuid4().hex}"
        try:
            df.withColumn("part__", self.code).hint("rebalance", "part__").write.partitionBy("part__").parquet(f"{self.path}/{folder}")
        except Exception:
            self._fs().delete(self._at(folder), True)
            raise
        names = [f.getPath().getName() for f in self._fs().listStatus(self._at(folder))]
        return {n.removeprefix("part__="): [folder] for n in names if n.startswith("part__=")}

    def _codes(self, df: DataFrame) -> set[str]:
        return {r[0] for r in df.select(self.code).distinct().collect()}  # one row a value of the table's split

    def _load(self, text: str, codes: set[str] | None = None) -> DataFrame:
        state = json.loads(text)
        paths = [f"{self.path}/{v}/part__={code}" for code, folders in state["parts"].items() if codes is None or code in codes for v in folders]
        schema = StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def exists(self) -> bool:
        return self._text() is not None

    def read(self) -> DataFrame:
        return self._load(self._text())

    def create(self, df: DataFrame) -> Store:
        self._commit(None, df.schema, self._written(df))
        return self

    def _swap(self, text: str, df: DataFrame, codes: set[str]) -> None:
        """The values ``codes`` have the rows of ``df`` from now on, or none; the others stay."""
        state = json.loads(text)
        schema = StructType.fromJson(json.loads(state["schema"]))
        parts = {c: f for c, f in state["parts"].items() if c not in codes}
        self._commit(text, schema, parts | self._written(df.select([f.name for f in schema.fields])))

    def append(self, new: DataFrame) -> None:
        """Rows come to those that are there; no row is read or written again."""
        text = self._text()
        state = json.loads(text)
        schema = StructType.fromJson(json.loads(state["schema"]))
        for code, folders in self._written(new.select([f.name for f in schema.fields])).items():
            state["parts"].setdefault(code, []).extend(folders)
        self._commit(text, schema, state["parts"])

    def replace_partitions(self, new: DataFrame) -> None:
        """Values of ``by`` that ``new`` has are replaced; doing it again changes nothing."""
        text, codes = self._text(), self._codes(new)
        rest = self._without(text, codes, new) if self.buckets else None
        self._swap(text, new if rest is None else rest.unionByName(new.select(*rest.columns)), codes)

    def _without(self, text: str, codes: set[str], keys: DataFrame) -> DataFrame:
        """The rows of these buckets whose value ``keys`` lacks."""
        gone = keys.select(F.col(self.by).alias("_gone")).distinct()
        return self._load(text, codes).join(gone, F.col(self.by).eqNullSafe(F.col("_gone")), "left_anti")

    def replace_range(self, new: DataFrame, column: str, low, high) -> None:
        """Rows with ``column`` from ``low`` to ``high`` go and ``new`` comes, in one step; rows with a null stay.

        Only values of ``by`` that have such rows are written again.
        """
        text = self._text()
        within = F.coalesce(F.col(column).between(low, high), F.lit(False))
        codes = self._codes(self._load(text).where(within)) | self._codes(new)
        old = self._load(text, codes)
        self._swap(text, old.where(~within).unionByName(new.select(*old.columns)), codes)

    def upsert_range(self, new: DataFrame, day: str) -> None:
        """For every key of ``new`` its rows replace those between its own first and last day; old rows without a day stay.

        The table is split by the key, which may be null.
        """
        text, codes = self._text(), self._codes(new)
        old = self._load(text, codes)
        span = new.groupBy(F.col(self.by).alias("_k")).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
        within = F.coalesce(F.col(day).between(F.col("_a"), F.col("_b")), F.lit(False))
        kept = old.join(span, F.col(self.by).eqNullSafe(F.col("_k")), "left").where(~within).select(*old.columns)
        self._swap(text, kept.unionByName(new.select(*old.columns)), codes)

    def staged_update(self, stage: DataFrame, keys: list[str], columns: list[str]) -> None:
        """Columns of rows whose keys are in ``stage`` take its values; other rows stay. Keys occur once in ``stage``."""
        text, codes = self._text(), self._codes(stage)
        old = self._load(text, codes)
        new = stage.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
        joined = old.join(new, keys, "left")
        self._swap(text, joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns]), codes)

    def overwrite(self, new: DataFrame) -> None:
        """The table consists of ``new`` from now on."""
        text = self._text()
        self._swap(text, new, set(json.loads(text)["parts"]))

    def remove(self, keys: DataFrame) -> None:
        """All rows of the values of ``by`` that ``keys`` has go; without buckets nothing is written but the state."""
        text, codes = self._text(), self._codes(keys)
        if self.buckets:
            return self._swap(text, self._without(text, codes, keys), codes)
        state = json.loads(text)
        self._commit(text, StructType.fromJson(json.loads(state["schema"])), {c: f for c, f in state["parts"].items() if c not in codes})

    def with_columns(self, add: dict[str, Column] | None = None, remove: tuple[str, ...] = ()) -> Store:
        """The table again in a new folder with columns added and removed."""
        df = self.read().withColumns(add or {}).drop(*remove)
        return Store(self.spark, f"{self.path}-{uuid.uuid4().hex}", self.by, self.buckets).create(df)

    def vacuum(self) -> int:
        """Delete folders that the table no longer consists of; how many there were. No reader may still use them."""
        used = {v for folders in json.loads(self._text())["parts"].values() for v in folders}
        old = [f.getPath() for f in self._fs().listStatus(self._at("")) if f.getPath().getName().startswith("v-") and f.getPath().getName() not in used]
        for path in old:
            self._fs().delete(path, True)
        return len(old)
