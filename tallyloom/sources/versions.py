"""A table of records with versions, none of which is ever changed or lost.

A version is a manifest: a JSON file that names, for each bucket of keys, the
folder with that bucket's rows. A commit writes the buckets that change to new
folders and then publishes the next manifest by a rename that fails if the
version is there already: of two writers that read the same version one is
refused, and readers see the old state or the new one.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import merges

BUCKETS = 16
FRESH = ("add", "supersede error", "supersede environment")


class Refused(Exception):
    """Another writer has published the version that this one was to be."""


@dataclass
class Banked:
    """What came of banking: the version (unchanged if nothing was banked), and
    the action for every incoming record."""

    version: int
    actions: DataFrame

    @property
    def conflicts(self) -> DataFrame:
        return self.actions.where("action = 'conflict'").drop("action")


class Versions:
    """The table below ``root``, its rows told apart by ``key``."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.key, self.buckets = spark, root.rstrip("/"), key, buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, at: str):
        return self._hadoop.Path(f"{self.root}/{at}")

    def _files(self):
        return self._path("").getFileSystem(self._conf)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def current(self) -> int:
        """The latest version; 0 before the first commit."""
        folder = self._path("versions")
        if not self._files().exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._files().listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def manifest(self, version: int) -> dict:
        if not version:
            return {"version": 0, "buckets": {}, "schema": None}
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version:08d}.json", wholetext=True).first()[0])

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of a version, the latest by default, or of some of its buckets."""
        m = self.manifest(self.current() if version is None else version)
        if m["schema"] is None:
            raise ValueError(f"{self.root} has no version yet")
        schema = StructType.fromJson(m["schema"])
        paths = [f"{self.root}/{p}" for b, p in m["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, rows: DataFrame, based_on: int, changed: set[int] | None = None, actions: str | None = None) -> int:
        """Publishes ``based_on`` + 1: ``rows`` in place of the buckets ``changed``
        (None: all), the others as they are. Raises ``Refused``, and leaves
        nothing, if that version is there by then."""
        old, at = self.manifest(based_on), f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket_", self._bucket()).repartition("bucket_").write.partitionBy("bucket_").parquet(f"{self.root}/{at}")
        new = {s.getPath().getName().partition("=")[2]: f"{at}/{s.getPath().getName()}" for s in self._files().listStatus(self._path(at)) if "=" in s.getPath().getName()}
        kept = {} if changed is None else {b: p for b, p in old["buckets"].items() if int(b) not in changed}
        manifest = {"version": based_on + 1, "parent": based_on, "buckets": kept | new, "schema": rows.schema.jsonValue(), "actions": actions}
        try:
            self._publish(based_on + 1, json.dumps(manifest))
        except Refused:
            self._files().delete(self._path(at), True)
            raise
        return based_on + 1

    def _publish(self, version: int, text: str) -> None:
        draft, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{version:08d}.json")
        out = self._files().create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)  # without any: never over a file that is there
        try:
            self._hadoop.FileContext.getFileContext(jvm.java.net.URI(self._files().makeQualified(final).toString()), self._conf).rename(draft, final, options)
        except Py4JJavaError as e:
            self._files().delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Refused(f"version {version} of {self.root} is another writer's") from None
            raise

    def bank(self, incoming: DataFrame, partner_by: list[str] | None = None, based_on: int | None = None) -> Banked:
        """Banks ``incoming`` (key, error, device, dtype, mean; more columns stay):
        new records and those that supersede are in the next version, superseded
        ones in the versions before; conflicts change nothing, and the others are
        applied all the same. Only buckets that change are read and written again.
        The actions stay beside the version that they led to."""
        version = self.current() if based_on is None else based_on
        existing = self.read(version) if version else incoming.limit(0)
        at = f"actions/{uuid.uuid4().hex}"
        merges.bank(existing, incoming, self.key, partner_by).withColumn("bucket_", self._bucket()).write.parquet(f"{self.root}/{at}")
        actions = self.spark.read.parquet(f"{self.root}/{at}")
        fresh = actions.where(F.col("action").isin(*FRESH))
        changed = {r["bucket_"] for r in fresh.select("bucket_").distinct().collect()}  # as many as there are buckets
        if changed:
            rest = self.read(version, changed) if version else existing
            rows = rest.join(fresh.select(*self.key), self.key, "left_anti").unionByName(fresh.select(*rest.columns))
            version = self.commit(rows, version, changed, at)
        return Banked(version, actions.drop("bucket_"))

    def superseded(self, version: int) -> DataFrame:
        """The rows that ``version`` replaced, as the version before has them."""
        m = self.manifest(version)
        gone = self.spark.read.parquet(f"{self.root}/{m['actions']}").where("action like 'supersede%'").select(*self.key)
        return self.read(m["parent"]).join(gone, self.key, "left_semi") if m["parent"] else self.read(version).limit(0)
