"""The contact store: contacts in hash buckets of their key, of which a batch rewrites only those it touches.

A version of the store is a manifest, one line of JSON that names the folder
of every bucket of every table.  Folders are written once and never changed: a
batch reads the buckets that its keys fall into, writes their merged rows to
new folders, and publishes a manifest that names the old folders for all other
buckets.  So a small batch costs what it touches, whatever the store holds, an
unfinished run is not seen, and readers of an older version keep their files.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadloom.operators import resolve as R
from leadloom.session import staged

#: Contacts, the files each was seen in, and all phones and e-mails of contacts.
TABLES = ("contacts", "files", "keys")


class ContactStore:
    """Versions of contacts under ``path``; ``buckets`` is fixed when the store is first written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path = spark, path
        self._folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = self.versions()
        self.buckets = self._manifest(known[-1])["buckets"] if known else buckets

    # --- versions ----------------------------------------------------------
    def versions(self) -> list[str]:
        """Names of the complete versions, in order."""
        root = self._folder(f"{self.path}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(n.removeprefix("version=") for n in names if self._fs.exists(self._folder(f"{self.path}/manifest/{n}/_SUCCESS")))

    def before(self, version: str) -> str | None:
        """The last complete version that is earlier than ``version``."""
        return max((v for v in self.versions() if v < version), default=None)

    def _manifest(self, version: str | None) -> dict:
        if version is None:
            return {"buckets": self.buckets, "schemas": {}, "folders": {t: {} for t in TABLES}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/version={version}").first()[0])

    def _publish(self, version: str, manifest: dict) -> None:
        line = self.spark.createDataFrame([(json.dumps(manifest),)], "value string")
        line.coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/version={version}")

    # --- reading -----------------------------------------------------------
    def bucket(self, key: str = "lead_key") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str = "lead_key") -> list[int]:
        """The buckets that hold the keys of these rows: ``buckets`` numbers at most."""
        return sorted(r[0] for r in rows.filter(F.col(key).isNotNull()).select(self.bucket(key)).distinct().collect())

    def rows(self, table: str, version: str | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """Rows of a table in a version (default: the newest), all or those of some buckets; None before anything is stored."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        manifest = self._manifest(version)
        if table not in manifest["schemas"]:
            return None
        schema, folders = StructType.fromJson(manifest["schemas"][table]), manifest["folders"][table]
        paths = [f"{self.path}/{folder}" for bucket, folder in folders.items() if buckets is None or int(bucket) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def contacts(self, version: str | None = None) -> DataFrame | None:
        return self.rows("contacts", version)

    def known_keys(self, keyed: DataFrame, version: str | None) -> DataFrame | None:
        """The stored phones and e-mails in the buckets that the keys of ``keyed`` fall into: all that an anti-join needs."""
        return None if version is None else self.rows("keys", version, self.touched(keyed))

    # --- writing -----------------------------------------------------------
    def _write(self, manifest: dict, table: str, rows: DataFrame, run: str, touched: list[int]) -> DataFrame:
        """Write the rows of the touched buckets and name their folders in the manifest; returns the written rows."""
        folder = f"{table}/{run}"
        placed = rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket")  # splits large buckets, joins small ones
        placed.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        manifest["schemas"][table] = rows.schema.jsonValue()
        for bucket in touched:
            manifest["folders"][table].pop(str(bucket), None)
            if self._fs.exists(self._folder(f"{self.path}/{folder}/_bucket={bucket}")):
                manifest["folders"][table][str(bucket)] = f"{folder}/_bucket={bucket}"
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}")

    def merge(self, contacts: DataFrame, files: DataFrame, version: str, base: str | None = None) -> None:
        """Publish ``version``: the contacts of ``base`` (None: an empty store) and a batch of golden contacts and their files.

        The batch is read several times and should be a written table.  A
        version that is merged again replaces its manifest.
        """
        manifest, run = self._manifest(base), f"{version}-{uuid.uuid4().hex[:12]}"
        touched = self.touched(contacts)
        old, old_files = (None if base is None else self.rows(t, base, touched) for t in ("contacts", "files"))
        merged_files = files if old is None else old_files.unionByName(files).distinct()
        written = self._write(manifest, "files", merged_files.filter("lead_key IS NOT NULL"), run, touched)
        merged = contacts if old is None else R.upsert(old, None, contacts, written)
        self._write(manifest, "contacts", merged.filter("lead_key IS NOT NULL"), run, touched)
        keys = R.history_keys(contacts)
        touched = self.touched(keys)
        old = None if base is None else self.rows("keys", base, touched)
        self._write(manifest, "keys", keys if old is None else old.unionByName(keys).distinct(), run, touched)
        self._publish(version, manifest)

    def add_keys(self, keys: DataFrame, version: str, base: str | None = None) -> None:
        """Publish ``version``: ``base`` with these lead keys among the known ones."""
        manifest, run = self._manifest(base), f"{version}-{uuid.uuid4().hex[:12]}"
        touched = self.touched(keys)
        old = None if base is None else self.rows("keys", base, touched)
        keys = keys.select("lead_key")
        self._write(manifest, "keys", (keys if old is None else old.unionByName(keys)).distinct(), run, touched)
        self._publish(version, manifest)

    def vacuum(self) -> int:
        """Delete the folders that no version names; returns their number.  To be run while nothing else writes."""
        used = {f.split("/_bucket=")[0] for v in self.versions() for t in self._manifest(v)["folders"].values() for f in t.values()}
        gone = 0
        for table in TABLES:
            root = self._folder(f"{self.path}/{table}")
            for status in self._fs.listStatus(root) if self._fs.exists(root) else []:
                if f"{table}/{status.getPath().getName()}" not in used:
                    gone += bool(self._fs.delete(status.getPath(), True))
        return gone


def merge_batch(store: ContactStore, raw: DataFrame, version: str) -> None:
    """Clean a batch of raw contact rows and merge it as ``version`` on the one before; repeating it replaces its own."""
    keyed = staged(R.lead_keys(R.clean(raw)).filter("lead_key IS NOT NULL").select(*R.MERGED), "keyed")
    store.merge(staged(R.golden(keyed), "golden"), staged(R.golden_files(keyed), "files"), version, store.before(version))
