"""Tables that change by whole commits: a manifest names the Parquet folders of one state of all tables of a store.

A commit writes new folders first and one manifest row last. That row is a file of its own, which Spark's committer
moves into place in one step, so a lost job leaves nothing half visible: readers resolve the newest manifest and see only
what it names. A commit has a batch name; one that is there already does nothing, so replays change nothing. A store has
one writer at a time. Folders of earlier states stay for readers who still use them, and are the caller's to delete."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
MANIFEST = "version long, batch string, parts array<struct<name: string, bucket: int, path: string, rows: long, version: long>>, schemas map<string, string>, note map<string, string>"
#: Buckets of a table of versions, by a hash of its key.
BUCKETS = 16
#: A bucket is folded when later versions have more than this share of the rows of its first one.
FOLD = 0.5


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one is set only on one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="keelson-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/keelson/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read again: what is used several times is computed once."""
    rows.write.parquet(path := scratch(rows.sparkSession, name))
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Store:
    """A store at ``uri``; ``create`` makes one with tables of given schemas (DDL) and no rows."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, uri: str, schemas: dict[str, str]) -> Store:
        store = cls(spark, uri)
        store._put(0, "created", [], schemas, {})
        return store

    def _put(self, version: int, batch: str, parts: list, schemas: dict, note: dict) -> None:
        self.spark.createDataFrame([(version, batch, parts, schemas, note)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.uri}/manifest")

    def commits(self) -> DataFrame:
        """All commits so far, one row each."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.uri}/manifest")

    def current(self, version: int | None = None):
        """The newest commit, or that of a version."""
        rows = self.commits() if version is None else self.commits().filter(C("version") == version)
        return rows.orderBy(F.desc("version")).first()

    def has(self, batch: str) -> bool:
        return not self.commits().filter(C("batch") == batch).isEmpty()

    def folder(self, batch: str, name: str) -> str:
        """Where a commit puts a table's files. What a lost attempt left there is written over: no manifest names it."""
        return f"{self.uri}/data/{name}/{batch}"

    def commit(self, batch: str, added: list[tuple], note: dict[str, str] | None = None, dropped: tuple[str, ...] = ()) -> None:
        """Publish (name, bucket, path, rows) parts beside the current ones, without those whose path is ``dropped``."""
        now = self.current()
        version = now.version + 1
        kept = [tuple(p) for p in now.parts if p.path not in set(dropped)]
        self._put(version, batch, kept + [(*p, version) for p in added], now.schemas, {**now.note, **(note or {})})

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of a table as of the newest commit, or of a version."""
        now = self.current(version)
        return self._rows(now.schemas[name], [p.path for p in now.parts if p.name == name])

    def _rows(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


# four related tables, insert only
RELATIONS = {
    "customers": ("customer_id", "gender", "senior_citizen", "partner", "dependents", "tenure_months", "churn"),
    "contracts": ("contract_type", "paperless_billing", "payment_method"),
    "services": ("phone_service", "multiple_lines", "internet_service", "online_security", "online_backup", "device_protection", "tech_support", "streaming_tv", "streaming_movies"),
    "billings": ("monthly_charges", "total_charges"),
}
WHOLE = ("senior_citizen", "tenure_months", "churn")
KEYS = ("contract_id", "service_id", "billing_id")
COLUMNS = tuple(c for of in RELATIONS.values() for c in of)


def kind(column: str) -> str:
    return "int" if column in WHOLE else "double" if column in RELATIONS["billings"] else "string"


SCHEMAS = {name: ", ".join(["id string", *(f"{c} string" for c in KEYS if name == "customers"), *(f"{c} {kind(c)}" for c in of)]) for name, of in RELATIONS.items()}


def split(rows: DataFrame) -> dict[str, DataFrame]:
    """One wide row a subscriber -> four related rows, whose shared key is a hash of the id."""
    key = F.md5("customer_id")
    return {name: rows.select(key.alias("id"), *(key.alias(c) for c in KEYS if name == "customers"), *(C(c).cast(kind(c)).alias(c) for c in of)) for name, of in RELATIONS.items()}


def joined(store: Store, version: int | None = None) -> DataFrame:
    """The wide rows again, by the keys of the four tables."""
    rows = store.read("customers", version)
    for name, key in (("contracts", "contract_id"), ("services", "service_id"), ("billings", "billing_id")):
        rows = rows.join(store.read(name, version).withColumnRenamed("id", key), key)
    return rows


def load(store: Store, rows: DataFrame, filename: str, batch: str) -> dict[str, str]:
    """Insert the subscribers that the store doesn't have, in all four tables and its history at once.

    Rows whose id is there already are skipped; rows without an id, and further rows of an id within the batch (all but
    the smallest), have failed. One pass stages one row an id with its number of rows; counts and the
    four tables are read from that, so nothing is counted twice by a task that ran twice."""
    if store.has(batch):
        return next(r for r in history(store).filter(C("batch") == batch).collect()).asDict()
    known = store.read("customers").select("customer_id", F.lit(True).alias("known"))
    first = rows.groupBy("customer_id").agg(F.min(F.struct(*(C(c).cast(kind(c)).alias(c) for c in COLUMNS if c != "customer_id"))).alias("r"), F.count("*").alias("copies"))
    usable = F.coalesce(F.trim("customer_id") != "", F.lit(False))
    staged = first.join(known, "customer_id", "left").select("customer_id", "r.*", "copies", F.when(~usable, "failed").when(C("known"), "skipped").otherwise("inserted").alias("outcome"))
    staged.write.mode("overwrite").partitionBy("outcome").parquet(at := store.folder(batch, "staged"))
    staged = store.spark.read.schema(staged.schema).parquet(at)
    found = {r["outcome"]: (r["ids"], r["n"]) for r in staged.groupBy("outcome").agg(F.count("*").alias("ids"), F.sum("copies").alias("n")).collect()}
    ids = {o: found.get(o, (0, 0))[0] for o in ("inserted", "skipped")}
    failed = sum(n for _, n in found.values()) - sum(ids.values())
    note = {"filename": filename, "rows_processed": sum(n for _, n in found.values()), "rows_inserted": ids["inserted"], "rows_skipped": ids["skipped"], "rows_failed": failed, "status": "degraded" if failed else "success"}
    added = []
    for name, part in split(staged.filter("outcome = 'inserted'")).items():
        part.write.mode("overwrite").parquet(path := store.folder(batch, name))
        added.append((name, None, path, ids["inserted"]))
    store.commit(batch, added, {k: str(v) for k, v in note.items()})
    return note


def history(store: Store) -> DataFrame:
    """(version, batch, filename, rows_processed, rows_inserted, rows_skipped, rows_failed, status) of the loads."""
    return store.commits().filter("note['filename'] IS NOT NULL").select("version", "batch", C("note")["filename"].alias("filename"), *(C("note")[c].cast("long").alias(c) for c in ("rows_processed", "rows_inserted", "rows_skipped", "rows_failed")), C("note")["status"].alias("status"))


# tables of versions: merge on read, folded by bucket
def upsert(store: Store, name: str, rows: DataFrame, key: str, batch: str, order: str | None = None, buckets: int = BUCKETS, note: dict[str, str] | None = None) -> None:
    """Add the rows of a batch, one a key: the last by ``order``, then the greatest. The batch again changes nothing.

    What is written grows with the batch and not with the table."""
    if store.has(batch):
        return
    version = store.current().version + 1
    own = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max(F.struct(*([C(order).alias("__order")] if order else []), *own)).alias("r")).select(key, *(C("r")[c].alias(c) for c in own))
    last = last.select(F.lit(version).alias("version"), "*", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"))
    _bucketed(store, last, name, batch, note)


def _bucketed(store: Store, rows: DataFrame, name: str, batch: str, note: dict[str, str] | None = None, dropped: tuple[str, ...] = ()) -> None:
    path = store.folder(batch, name)
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    written = store.spark.read.schema(rows.schema).parquet(path).groupBy("bucket").agg(F.count("*").alias("n")).orderBy("bucket").collect()
    store.commit(batch, [(name, r["bucket"], f"{path}/bucket={r['bucket']}", r["n"]) for r in written], note, dropped)


def newest(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with a ``version`` the newest of each key."""
    own = [c for c in rows.columns if c not in (key, "version")]
    return rows.groupBy(key).agg(F.max(F.struct("version", *own)).alias("r")).select(key, "r.*")


def state(store: Store, name: str, key: str, version: int | None = None) -> DataFrame:
    """The newest row of each key, as of the newest commit or of a version."""
    return newest(store.read(name, version), key).drop("version")


def update(store: Store, name: str, rows: DataFrame, key: str, columns: list[str], batch: str, buckets: int = BUCKETS) -> None:
    """Set some columns of the keys that the table has; a null value leaves what is there, other keys aren't inserted."""
    if store.has(batch):
        return
    new = rows.groupBy(key).agg(F.max(F.struct(*columns)).alias("__new"))
    now = state(store, name, key).join(new, key)
    upsert(store, name, now.select(key, *(F.coalesce(C("__new")[c], C(c)).alias(c) if c in columns else C(c) for c in now.columns if c not in (key, "__new"))), key, batch, buckets=buckets)


def fold(store: Store, name: str, key: str, share: float = FOLD) -> list[int]:
    """Rewrite the buckets in which later versions hold more than ``share`` of the rows of the first one; returns them.

    After it a read sees at most 1 + ``share`` times the rows that were in a bucket when it was last
    folded, however many batches came since. All other buckets keep their files."""
    now = store.current()
    parts: dict[int, list] = {}
    for p in sorted((p for p in now.parts if p.name == name), key=lambda p: p.version):
        parts.setdefault(p.bucket, []).append(p)
    old = {b: of for b, of in parts.items() if sum(p.rows for p in of[1:]) > share * of[0].rows}
    if old:
        paths = [p.path for of in old.values() for p in of]
        bucket = F.regexp_extract("_metadata.file_path", r"/bucket=(\d+)/[^/]*$", 1).cast("int")
        rows = store._rows(now.schemas[name], paths).withColumn("bucket", bucket)
        _bucketed(store, newest(rows, key).select("version", key, *(c for c in rows.columns if c not in ("version", key))), name, f"fold-{now.version}", dropped=tuple(paths))
    return sorted(old)


def read_rows(store: Store, name: str) -> int:
    """The rows that a read of the table scans."""
    return sum(p.rows for p in store.current().parts if p.name == name)


# change capture
def sync(store: Store, name: str, source: DataFrame, key: str, score, batch: str, stamp: str = "updated_at", late: timedelta = timedelta(hours=1)) -> dict[str, str]:
    """Score the rows of ``source`` that are new or updated since the last sync, and upsert them.

    The highest ``stamp`` seen is stored in the same commit as the scored rows, so a job that ends in between has done
    neither. The next sync scans from that mark less ``late``, which Parquet's statistics prune; of what it finds it
    scores a row if the table has none of its key, or an older one. So rows of one stamp that arrive apart, and
    updates that arrive up to ``late`` after newer ones, are scored once, and what was scored is not scored again. Of
    several rows of a key the newest counts. Rows without a stamp are never seen."""
    if not store.has(batch):
        mark = store.current().note.get(f"mark:{name}")
        rows, seen = source.filter(C(stamp).isNotNull()), store.read(name)
        if mark:
            since = F.lit(datetime.fromisoformat(mark) - late)
            rows, seen = rows.filter(C(stamp) >= since), seen.filter(C(stamp) >= since)
        rows = rows.groupBy(key).agg(F.max(F.struct(stamp, *(c for c in rows.columns if c not in (key, stamp)))).alias("r")).select(key, "r.*")
        seen = seen.groupBy(key).agg(F.max(stamp).alias("__seen"))
        rows = rows.join(seen, key, "left").filter(C("__seen").isNull() | (C("__seen") < C(stamp))).drop("__seen")
        scored = score(rows).withColumn(stamp, C(stamp))
        scored.write.mode("overwrite").parquet(at := store.folder(batch, "scored"))
        scored = store.spark.read.schema(scored.schema).parquet(at)
        new = scored.agg(F.max(stamp).alias("mark"), F.count("*").alias("n")).first()
        marks = [m for m in (mark, new["mark"] and new["mark"].isoformat()) if m]
        upsert(store, name, scored, key, batch, note={"synced": str(new["n"]), **({f"mark:{name}": max(marks, key=datetime.fromisoformat)} if marks else {})})
    return dict(next(r for r in store.commits().filter(C("batch") == batch).collect()).note)
