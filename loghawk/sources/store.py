"""Scan store: Parquet tables under one root (S7-S10, H4 write side).

``scan_events``, its rollups and ``incident_reports`` have one folder per scan, ``scans`` one folder per
new scan beside ``scans_base``, to which :meth:`ScanStore.compact_scans` moves their rows, so
that many scans are few files. ``audit_log`` is appended to. Reads name their schema: a
table that doesn't exist yet is an empty one.

A scan is written as a whole or not at all: :meth:`ScanStore.transaction` writes all of its
tables into a staging folder, then records that it is complete, and puts its folders in place by
renames, the scan's row last. A writer that fails before leaves nothing to be read; one
that fails between renames is finished by the next (:meth:`ScanStore.recover`). Writing a scan
again replaces its folders, also by no rows; deleting a scan drops them.

Ids are claimed by creating a file that must not exist yet, so two writers never get one.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loghawk.constants import EVENT_COLUMNS
from loghawk.operators.rollups import address_rollup, hour_rollup

SCAN_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("dataset_name", T.StringType()), T.StructField("scan_date", T.StringType()),
    T.StructField("total_logs", T.LongType()), T.StructField("threat_count", T.LongType()),
    T.StructField("critical_count", T.LongType()), T.StructField("report_json", T.StringType()),
])
_EVENT_TYPES = {
    "is_anomaly": T.BooleanType(),
    **{c: T.DoubleType() for c in (
        "bytes_sent", "bytes_received", "connection_duration", "attack_type_confidence", "attack_probability",
        "anomaly_score", "frequency_score", "severity_weight", "threat_score")},
}
SCAN_EVENT_SCHEMA = T.StructType([
    T.StructField("scan_id", T.LongType()),
    *[T.StructField(c, _EVENT_TYPES.get(c, T.StringType())) for c in EVENT_COLUMNS]])
INCIDENT_SCHEMA = T.StructType([
    T.StructField("scan_id", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in (
        "incident_id", "threat_type", "severity", "affected_assets", "recommended_actions", "created_at")]])
AUDIT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("action", T.StringType()), T.StructField("details", T.StringType()),
    T.StructField("created_at", T.StringType()),
])
HOUR_SCHEMA = T.StructType([
    T.StructField("scan_id", T.LongType()), T.StructField("hour", T.TimestampNTZType()),
    *[T.StructField(c, T.StringType()) for c in ("predicted_label", "attack_type_predicted", "severity")],
    T.StructField("events", T.LongType()), T.StructField("scored_events", T.LongType())])
ADDRESS_SCHEMA = T.StructType([
    T.StructField("scan_id", T.LongType()), T.StructField("side", T.StringType()),
    T.StructField("address", T.StringType()), T.StructField("attacks", T.LongType())])
#: table -> (schema, column that names a scan's folder); ``scan_models`` holds saved models, not rows
TABLES = {"scans": (SCAN_SCHEMA, "id"), "scan_events": (SCAN_EVENT_SCHEMA, "scan_id"),
          "incident_reports": (INCIDENT_SCHEMA, "scan_id"), "audit_log": (AUDIT_SCHEMA, None),
          "scan_hours": (HOUR_SCHEMA, "scan_id"), "scan_addresses": (ADDRESS_SCHEMA, "scan_id"),
          "scan_models": (None, "scan_id")}
#: Summed up from a scan's stored rows, and replaced with them.
ROLLUPS = {"scan_hours": hour_rollup, "scan_addresses": address_rollup}

def _place(table: str, scan_id: int | None = None) -> str:
    return table if scan_id is None else f"{table}/{TABLES[table][1]}={int(scan_id)}"


#: Scans are published in this order: the scan's row commits it.
PUBLISH_ORDER = ["scan_events", *ROLLUPS, "scan_models", "incident_reports", "scans_base", "scans"]
#: Rows of one file when several scans are stored at once.
FILE_ROWS = 1_000_000
COMPLETE = "complete.json"


class ScanStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str, scan_id: int | None = None) -> str:
        return self.root + "/" + _place(table, scan_id)

    # ---------------------------------------------------------------- files
    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _move(self, old: str, new: str) -> None:
        fs, p = self._fs(new)
        fs.mkdirs(p.getParent())
        if not fs.rename(self._fs(old)[1], p):
            raise OSError(f"can't move {old} to {new}")

    def _write_text(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read_text(self, path: str) -> str:
        jvm = self.spark.sparkContext._jvm
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create_new(self, path: str) -> bool:
        """Create an empty file; False if it is there, also when another writer is just creating it."""
        jvm = self.spark.sparkContext._jvm
        fs, p = self._fs(path)
        fs.mkdirs(p.getParent())
        try:
            if fs.getScheme() == "file":  # the local file system's create checks first and creates then
                jvm.java.nio.file.Files.createFile(jvm.java.io.File(p.toUri().getPath()).toPath(),
                                                   self.spark.sparkContext._gateway.new_array(
                                                       jvm.java.nio.file.attribute.FileAttribute, 0))
            else:
                fs.create(p, False).close()
            return True
        except Py4JJavaError as e:
            if "AlreadyExist" in e.java_exception.getClass().getName():
                return False
            raise

    # ---------------------------------------------------------------- transactions
    @contextmanager
    def transaction(self):
        """Writes of one or more tables that become readable together, or not at all."""
        tx = _Staged(self, f"{self.root}/_staging/{uuid.uuid4().hex}")
        try:
            yield tx
        except BaseException:
            self._delete(tx.folder)
            raise
        self._write_text(f"{tx.folder}/{COMPLETE}", json.dumps(tx.places))
        self._publish(tx.folder)

    def _publish(self, folder: str) -> None:
        """Put a complete staging folder's parts in place; may be repeated after any failure."""
        places = json.loads(self._read_text(f"{folder}/{COMPLETE}"))
        for place in sorted(places, key=lambda x: PUBLISH_ORDER.index(x.split("/")[0])):
            fs, staged = self._fs(f"{folder}/{place}")
            if not fs.exists(staged):  # it is in place already
                continue
            if fs.exists(self._fs(f"{self.root}/{place}")[1]):
                self._delete(f"{folder}/_old/{place}")
                self._move(f"{self.root}/{place}", f"{folder}/_old/{place}")
            self._move(f"{folder}/{place}", f"{self.root}/{place}")
        self._delete(folder)

    def recover(self) -> int:
        """Finish the publications that a lost writer has begun; their number. For when no writer is at work."""
        found = [f"{self.root}/_staging/{n}" for n in self._names(f"{self.root}/_staging")]
        complete = [f for f in found if self._fs(f)[0].exists(self._fs(f"{f}/{COMPLETE}")[1])]
        for folder in complete:
            self._publish(folder)
        return len(complete)

    def next_id(self, table: str) -> int:
        """An id of ``scans`` or ``audit_log`` that no other writer gets, above all that are stored."""
        claimed = f"{self.root}/_ids/{table}"
        top = max([self.read(table).agg(F.max("id")).first()[0] or 0, *(int(n) for n in self._names(claimed) if n.isdigit())])
        while True:
            top += 1
            if self._create_new(f"{claimed}/{top}"):
                return top

    # ---------------------------------------------------------------- writes
    def write_scan(self, scan_id: int, *args, **kwargs) -> None:
        """The scan's row; see :meth:`_Staged.write_scan`."""
        with self.transaction() as tx:
            tx.write_scan(scan_id, *args, **kwargs)

    def write_events(self, scan_id: int, scored: DataFrame) -> None:
        """All of a scan's scored rows."""
        with self.transaction() as tx:
            tx.write_events(scan_id, scored)

    def write_incidents(self, scan_id: int, incident_rows: DataFrame) -> None:
        """A scan's incident rows."""
        with self.transaction() as tx:
            tx.write_incidents(scan_id, incident_rows)

    def write_event_table(self, events: DataFrame, file_rows: int = FILE_ROWS) -> None:
        """S8 for several scans at once: rows with ``scan_id``, each scan's folder replaced.

        A scan's rows are dealt to as many tasks, a file each, as their number asks for.
        """
        rows = events.select(*[F.col(f.name).cast(f.dataType) for f in SCAN_EVENT_SCHEMA])
        files = rows.groupBy("scan_id").agg(F.ceil(F.count(F.lit(1)) / file_rows).cast("int").alias("_files"))
        salt = F.pmod(F.xxhash64(*EVENT_COLUMNS), F.col("_files"))
        salted = rows.join(files, "scan_id").withColumn("_salt", salt)
        (salted.repartition("scan_id", "_salt").drop("_files", "_salt").select(*rows.columns)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("scan_id").parquet(self.path("scan_events")))
        self._write_rollup_tables(rows)

    def _write_rollup_tables(self, rows: DataFrame) -> None:
        """The rollups of several scans' rows; a scan that has no attack any more loses its addresses."""
        for table, rollup in ROLLUPS.items():
            summed = rollup(rows, "scan_id").select(*TABLES[table][0].names)
            (summed.repartition("scan_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("scan_id").parquet(self.path(table)))
        stored = set(self.scan_ids("scan_addresses"))
        quiet = rows.select("scan_id").distinct().join(
            rows.where("predicted_label = 'Attack'").select("scan_id").distinct(), "scan_id", "left_anti")
        self._each(lambda i: self._delete(self.path("scan_addresses", i)),
                   [r["scan_id"] for r in quiet.collect() if r["scan_id"] in stored])

    def write_audit(self, entries: DataFrame) -> None:
        """Append audit rows (id, user_id, action, details, created_at)."""
        entries.select(*[F.col(f.name).cast(f.dataType) for f in AUDIT_SCHEMA.fields]) \
               .write.mode("append").parquet(self.path("audit_log"))

    def compact_scans(self) -> None:
        """Move the rows of the new scans' folders into the base table, dropping deleted scans from it.

        For one compaction at a time; scans written meanwhile keep their folders.
        """
        ids = self.scan_ids("scans")
        if not ids:
            return
        with self.transaction() as tx:
            rows = self.scans().coalesce(1) if len(ids) < FILE_ROWS else self.scans()
            rows.write.parquet(tx.place("scans_base"))
        self._each(lambda i: self._delete(self.path("scans", i)), ids)

    # ---------------------------------------------------------------- deletes
    @staticmethod
    def _each(fn, items) -> None:
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(fn, items))

    def delete_scan(self, scan_id: int) -> None:
        """H4: drop the scan's folder in every table, its row first."""
        self._delete_ids([scan_id])

    def _delete_ids(self, ids: list[int]) -> None:
        base = self._base()
        in_base = set()
        if base is not None:
            asked = self.spark.createDataFrame([(i,) for i in ids], "id long")
            in_base = {r["id"] for r in base.join(asked, "id", "left_semi").select("id").collect()}

        def drop(i: int) -> None:
            if i in in_base:  # a folder without rows stands for the deletion until the next compaction
                self._delete(self.path("scans", i))
                self._write_text(f"{self.path('scans', i)}/_deleted", "")
            for table in ("scans", "incident_reports", "scan_models", *ROLLUPS, "scan_events"):
                if table != "scans" or i not in in_base:
                    self._delete(self.path(table, i))

        self._each(drop, ids)

    def scan_ids(self, table: str = "scan_events") -> list[int]:
        """Scans that have a folder in the table, from one listing."""
        start = f"{TABLES[table][1]}="
        return sorted(int(n.split("=")[1]) for n in self._names(self.path(table)) if n.startswith(start))

    def delete_scans(self, scan_ids: DataFrame, table: str = "scan_events") -> None:
        """H4 for the stored scans among ``scan_ids``, from one listing; only those reach the driver."""
        stored = self.spark.createDataFrame([(i,) for i in self.scan_ids(table)], "scan_id long")
        found = stored.join(scan_ids.select("scan_id").distinct(), "scan_id", "left_semi").collect()
        self._delete_ids([r["scan_id"] for r in found])

    # ---------------------------------------------------------------- reads
    def read(self, table: str) -> DataFrame:
        schema, _ = TABLES[table]
        if table == "scans":
            return self._read_scans(schema)
        if not self._names(self.path(table)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table)).select(*schema.names)

    def _base(self) -> DataFrame | None:
        if not self._names(self.path("scans_base")):
            return None
        return self.spark.read.schema(SCAN_SCHEMA).parquet(self.path("scans_base"))

    def _read_scans(self, schema) -> DataFrame:
        """The base table's rows, and the new folders' in place of those with their ids."""
        base, ids = self._base(), self.scan_ids("scans")
        out = self.spark.createDataFrame([], schema) if base is None else base
        if ids:
            new = self.spark.createDataFrame([(i,) for i in ids], "id long")
            folders = self.spark.read.schema(schema).parquet(self.path("scans")).select(*schema.names)
            out = folders if base is None else out.join(new, "id", "left_anti").select(*schema.names).unionByName(folders)
        return out

    def scans(self) -> DataFrame:
        return self.read("scans")

    def events(self) -> DataFrame:
        return self.read("scan_events")

    def hours(self) -> DataFrame:
        """Rollups of the stored rows; see ``operators.rollups``."""
        return self.read("scan_hours")

    def addresses(self) -> DataFrame:
        return self.read("scan_addresses")

    def models_path(self, scan_id: int) -> str:
        """Folder of a scan's saved models; see ``plans.scan_models``."""
        return self.path("scan_models", scan_id)

    def incidents(self) -> DataFrame:
        return self.read("incident_reports")

    def audit(self) -> DataFrame:
        return self.read("audit_log")


class _Staged:
    """The writes of a transaction, in its staging folder."""

    def __init__(self, store: ScanStore, folder: str):
        self.store, self.folder, self.places = store, folder, []

    def place(self, table: str, scan_id: int | None = None) -> str:
        self.places.append(_place(table, scan_id))
        return f"{self.folder}/{self.places[-1]}"

    def _write(self, table: str, scan_id: int, rows: DataFrame) -> None:
        schema, key = TABLES[table]
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema if f.name != key]) \
            .write.parquet(self.place(table, scan_id))

    def write_scan(self, scan_id: int, user_id: int, dataset_name: str, metrics: DataFrame,
                   scan_date: str | None = None, detection_metrics: DataFrame | None = None,
                   classification_accuracy: DataFrame | None = None) -> None:
        """The metrics row and the models' metrics become the scan's JSON report."""
        date = F.lit(scan_date) if scan_date else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
        report = metrics
        if detection_metrics is not None:  # a row a model
            names = ["model", "accuracy", "precision", "recall", "f1"]
            per_model = detection_metrics.agg(F.array_sort(F.collect_list(F.struct(*names))))
            report = report.withColumn("detection_metrics", per_model.scalar())
        if classification_accuracy is not None:
            report = report.withColumn("classification_accuracy", classification_accuracy.select("accuracy").scalar())
        row = report.select(
            F.lit(user_id).alias("user_id"), F.lit(dataset_name).alias("dataset_name"), date.alias("scan_date"),
            "total_logs", F.col("attack_count").alias("threat_count"), "critical_count",
            F.to_json(F.struct(*report.columns)).alias("report_json"))
        self._write("scans", scan_id, row)

    def write_events(self, scan_id: int, scored: DataFrame) -> None:
        """S8, with the rollups of the rows as they were written."""
        self._write("scan_events", scan_id, scored)
        schema = T.StructType([f for f in SCAN_EVENT_SCHEMA if f.name != "scan_id"])
        rows = self.store.spark.read.schema(schema).parquet(f"{self.folder}/{_place('scan_events', scan_id)}")
        for table, rollup in ROLLUPS.items():
            self._write(table, scan_id, rollup(rows))

    def write_models(self, scan_id: int, models) -> None:
        """A scan's fitted models, a ``PipelineModel``."""
        models.write().save(self.place("scan_models", scan_id))

    def write_incidents(self, scan_id: int, incident_rows: DataFrame) -> None:
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
        self._write("incident_reports", scan_id, incident_rows.withColumn("created_at", now))


__all__ = ["EVENT_COLUMNS", "ScanStore"]
