"""A price table whose writes are all or nothing.

Data folders are written beside each other and never changed; a manifest file names those that make up a version.  A
version exists from the moment its manifest is renamed into place, which fails if another writer took the number, so a
failed job, a lost driver or a racing writer leaves the version before it as it was.  Readers take the newest manifest.

    data/<id>/          Parquet of one write: a base by year, or one batch
    manifests/<n>.json  {"version", "base": {year: folder}, "batches": [{"no", "folder", "years"}], "applied": {stream: batch}}

Batches are kept as they came and resolved when read, the later one winning; ``compact`` folds them into the base, only
in the years that they touch, so a read touches the base and the batches since.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .prices import upsert_prices

SCHEMA = "symbol string, bar_date date, open double, high double, low double, close double, adj_close double, volume bigint"


class Conflict(RuntimeError):
    """Another writer committed the version that this one was about to."""


class PriceTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        root = self._path(self.path)
        self._files = root.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # ---- versions
    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        folder = self._path(f"{self.path}/manifests")
        if not self._files.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the newest; an empty table before the first commit."""
        if version is None:
            known = self.versions()
            if not known:
                return {"version": 0, "base": {}, "batches": [], "applied": {}}
            version = known[-1]
        stream = self._files.open(self._path(f"{self.path}/manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, old: dict, **changes: object) -> int:
        new = old | changes | {"version": old["version"] + 1}
        aside = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}.tmp")
        out = self._files.create(aside, False)
        try:
            out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        finally:
            out.close()
        try:
            self._context.rename(aside, self._path(f"{self.path}/manifests/{new['version']:012d}.json"), self._no_options)
        except Exception as error:
            self._files.delete(aside, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {new['version']} of {self.path} is taken") from None
            raise
        return new["version"]

    # ---- reading
    def _folders(self, folders: list[str]) -> DataFrame:
        names = [f"{self.path}/data/{name}" for name in folders]
        return self.spark.read.schema(SCHEMA).parquet(*names) if names else self.spark.createDataFrame([], SCHEMA)

    def _resolved(self, base: list[str], batches: list[dict], years: list[int] | None = None) -> DataFrame:
        rows = self._folders(base)
        if not batches:
            return rows
        later = None
        for batch in batches:
            part = self._folders([batch["folder"]]).withColumn("batch_no", F.lit(batch["no"]))
            later = part if later is None else later.unionByName(part)
        return upsert_prices(rows, later if years is None else later.where(F.year("bar_date").isin(years)))

    def read(self, version: int | None = None, years: list[int] | None = None) -> DataFrame:
        """Bars of a version; ``years`` reads the base folders and batches of these years only."""
        held = self.manifest(version)
        if years is None:
            return self._resolved(list(held["base"].values()), held["batches"])
        wanted = {str(year) for year in years}
        rows = self._resolved([name for year, name in held["base"].items() if year in wanted],
                              [b for b in held["batches"] if wanted & set(map(str, b["years"]))], years)
        return rows.where(F.year("bar_date").isin(years))

    def changed_years(self, since: int, version: int | None = None) -> list[int]:
        """Years whose data may differ between two versions, from the manifests alone."""
        old, new = self.manifest(since), self.manifest(version)
        base = {int(y) for y in {*old["base"], *new["base"]} if old["base"].get(y) != new["base"].get(y)}
        one, other = ({b["folder"]: b["years"] for b in m["batches"]} for m in (old, new))
        batches = {year for name in one.keys() ^ other.keys() for year in (one | other)[name]}
        return sorted(base | batches)

    # ---- writing
    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """A data folder by year, rows of a symbol together, and its years; nothing refers to it yet."""
        name = uuid.uuid4().hex
        (rows.select(*K.PRICE_COLUMNS).withColumn("year", F.year("bar_date")).repartitionByRange("year", "symbol", "bar_date")
         .sortWithinPartitions("year", "symbol", "bar_date").write.partitionBy("year").parquet(f"{self.path}/data/{name}"))
        found = [s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.path}/data/{name}"))]
        return name, sorted(int(x[5:]) for x in found if x.startswith("year="))

    def overwrite(self, rows: DataFrame) -> int:
        """Replace the whole table by ``rows`` (one row per symbol and date)."""
        old = self.manifest()
        name, years = self._write(rows)
        return self._commit(old, base={str(y): f"{name}/year={y}" for y in years}, batches=[])

    def upsert(self, rows: DataFrame, stream: str | None = None, number: int | None = None) -> int:
        """Add a batch that wins over what is there; all of its rows or none.

        A row that fails a guard fails the write before anything is committed.  ``stream`` and ``number`` make the call
        idempotent: a number that the stream has already applied changes nothing.  Repeats in the batch must agree.
        """
        old = self.manifest()
        if stream is not None and old["applied"].get(stream, -1) >= number:
            return old["version"]
        name, years = self._write(rows)
        last = max([b["no"] for b in old["batches"]], default=0)
        batches = [*old["batches"], {"no": last + 1, "folder": name, "years": years}] if years else old["batches"]
        return self._commit(old, batches=batches, applied=old["applied"] | ({stream: number} if stream is not None else {}))

    def compact(self) -> int:
        """Fold the batches into the base, rewriting only years that they touch; the rows stay the same.

        A failure leaves the version before.  A batch that another writer commits meanwhile makes this a conflict.
        """
        old = self.manifest()
        years = sorted({year for batch in old["batches"] for year in batch["years"]})
        if not years:
            return old["version"]
        touched = self._resolved([old["base"][str(y)] for y in years if str(y) in old["base"]], old["batches"])
        name, written = self._write(touched)
        base = {y: folder for y, folder in old["base"].items() if int(y) not in years}
        return self._commit(old, base=base | {str(y): f"{name}/year={y}" for y in written}, batches=[])

    def vacuum(self, keep: int = 2) -> int:
        """Delete data that none of the newest ``keep`` versions names, and the older manifests; returns folders deleted.

        Run it while no writer is at work: a write that hasn't committed yet is such data too.
        """
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        used = {name.split("/")[0] for m in kept for name in [*m["base"].values(), *(b["folder"] for b in m["batches"])]}
        for version in known[:-keep]:
            self._files.delete(self._path(f"{self.path}/manifests/{version:012d}.json"), False)
        data, gone = self._path(f"{self.path}/data"), 0
        for status in self._files.listStatus(data) if self._files.exists(data) else []:
            if status.getPath().getName() not in used:
                self._files.delete(status.getPath(), True)
                gone += 1
        return gone
