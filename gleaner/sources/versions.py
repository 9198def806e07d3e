"""Tables that change by whole files, published version by version in one atomic step."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.tables import file_names, publish_text

#: Parts that a new table's rows are dealt to by the hash of their key. The first version fixes the number for the life of the tables.
BUCKETS = 64


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def _bucket_in(path: str) -> int:
    return int(path.split("/bucket=")[1].split("/")[0])


@dataclass(frozen=True)
class Version:
    """A published state: its number, the number of buckets, and the files of each table relative to the root."""

    number: int = 0
    buckets: int = BUCKETS
    files: dict[str, list[str]] = field(default_factory=dict)


class VersionedTables:
    """Some tables below one folder that change together.

    Rows lie in ``<root>/<table>/batch=<id>/bucket=<n>/``, the bucket being the hash of the table's key. A version is a list of files. Writers add
    files in a fresh batch folder first; nobody reads those until the next version's list appears, which takes one rename that fails if
    another writer was faster. A crash before it leaves the last version as it was, and files that nobody reads. Readers of keys open
    only the files of the keys' buckets. The lists hold names alone, as Spark's own file index does.
    """

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets

    def latest(self) -> Version:
        """The last published version; version 0, without files, if there is none."""
        names = [n for n in file_names(self.spark, f"{self.root}/versions") if n.endswith(".json") and n[:-5].isdigit()]
        if not names:
            return Version(buckets=self.buckets)
        text = self.spark.read.text(f"{self.root}/versions/{max(names)}", wholetext=True).first()[0]
        return Version(int(max(names)[:-5]), **json.loads(text))

    def files(self, version: Version, table: str, keys: DataFrame | None = None) -> list[str]:
        """The files of a table, of those that may hold one of the ``keys`` (first column) if given. At most one number a bucket is collected."""
        found = version.files.get(table, [])
        if keys is not None:
            wanted = {r[0] for r in keys.select(bucket_of(F.col(keys.columns[0]), version.buckets)).distinct().collect()}
            found = [name for name in found if _bucket_in(name) in wanted]
        return found

    def read(self, table: str, files: list[str]) -> DataFrame | None:
        """The rows of some files of a table; None without files."""
        if not files:
            return None
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{name}" for name in files]).drop("batch", "bucket")

    def holding(self, table: str, files: list[str], keys: DataFrame) -> list[str]:
        """Those of the files that hold a row with one of the ``keys`` (first column)."""
        if not files:
            return []
        name = self.keys[table]
        rows = self.spark.read.parquet(*[f"{self.root}/{f}" for f in files]).select(name, F.col("_metadata.file_path").alias("file"))
        found = rows.join(keys.select(F.col(keys.columns[0]).alias(name)), name, "left_semi").select("file").distinct().collect()
        held = {"/".join(r[0].split("/")[-3:]) for r in found}
        return [f for f in files if "/".join(f.split("/")[-3:]) in held]

    def stage(self, table: str, rows: DataFrame, version: Version) -> list[str]:
        """Write rows as files that no version lists yet; they are meant for the one after ``version``."""
        batch = f"{table}/batch={uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", bucket_of(F.col(self.keys[table]), version.buckets)).repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/{batch}")
        return [f"{batch}/{folder}/{name}" for folder in file_names(self.spark, f"{self.root}/{batch}") if folder.startswith("bucket=") for name in file_names(self.spark, f"{self.root}/{batch}/{folder}")]

    def publish(self, base: Version, added: dict[str, list[str]], dropped: dict[str, list[str]] | None = None) -> Version:
        """Make the next version of ``base`` visible. Fails if ``base`` is not the last one any more."""
        gone = {table: set(names) for table, names in (dropped or {}).items()}
        files = {
            table: [name for name in base.files.get(table, []) if name not in gone.get(table, ())] + added.get(table, []) for table in self.keys
        }
        publish_text(self.spark, f"{self.root}/versions/{base.number + 1:012d}.json", json.dumps({"buckets": base.buckets, "files": files}))
        return Version(base.number + 1, base.buckets, files)

    def rewrite(self, table: str, base: Version, files: list[str], change: Callable[[DataFrame], DataFrame]) -> Version:
        """Replace the rows of some files by what ``change`` makes of them; all other files stay as they are."""
        if not files:
            return base
        return self.publish(base, {table: self.stage(table, change(self.read(table, files)), base)}, {table: files})

    def merge_files(self, table: str, most: int = 8) -> Version:
        """Rewrite the buckets that lie in more than ``most`` files as one each."""
        base = self.latest()
        held: dict[int, list[str]] = {}
        for name in base.files.get(table, []):
            held.setdefault(_bucket_in(name), []).append(name)
        return self.rewrite(table, base, [name for names in held.values() if len(names) > most for name in names], lambda rows: rows)
