"""Versioned documents: Parquet folders plus one append-only log.

A log row is the commit point of everything that happens to a document: ingest, saved SQL result, transformation, cell
edits, rename. Every change of cells writes a full copy to a fresh folder first, so a lost job leaves nothing visible and the
way a change is stored never depends on how many rows it touches. The copy of a transformation keeps the former text of the cells
it changed; the change log, the transformation history and SQL lineage are views. Renames are log rows alone.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F

from sheetloom.functions.text import cell, text_of
from sheetloom.operators.console import document_context, read_only, run_query, workspace_context
from sheetloom.operators.edits import checked_edits, patched, rename_column, unmatched_edits
from sheetloom.operators.grid import ROW_ID, data_columns
from sheetloom.operators.rules import Rule
from sheetloom.operators.transform import Transformation, TransformError, outcome
from sheetloom.plans import files
from sheetloom.session import several_writers

MAX_COLUMNS = 16_384
ORIGIN = ("_path", "_sheet_index", "_sheet")
CHANGED, BEFORE = f"{ROW_ID}_changed", f"{ROW_ID}_before"

LOG_COLUMNS = {
    "document_id": "string",
    "version": "bigint",
    "kind": "string",
    "path": "string",
    "row_count": "bigint",
    "column_count": "bigint",
    "cause": "string",
    "created_at": "timestamp",
    "duration_ms": "bigint",
    "name": "string",
    "source_type": "string",
    "source_file": "string",
    "source_sheet": "string",
    "transformation_id": "string",
    "sequence": "bigint",
    "transformation_type": "string",
    "column_name": "string",
    "configuration_json": "string",
    "affected_rows": "bigint",
    "failed_rows": "bigint",
    "source_document_id": "string",
    "sql": "string",
    "old_name": "string",
    "new_name": "string",
}
LOG_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in LOG_COLUMNS.items())


class VersionConflict(RuntimeError):
    """Somebody else committed a version of the same document first."""


class DocumentError(ValueError):
    """A document that is missing, too wide or otherwise unusable."""


@dataclass(frozen=True)
class Prepared:
    """Rows of a document that is written but not yet visible."""

    document_id: str
    path: str
    rows: int
    width: int
    milliseconds: int


@dataclass(frozen=True)
class Applied:
    transformation_id: str
    version: int
    affected_rows: int
    failed_rows: int


def check_width(width: int) -> None:
    if width > MAX_COLUMNS:
        raise DocumentError(f"{width} columns; the limit is {MAX_COLUMNS}")


def with_row_ids(df: DataFrame) -> DataFrame:
    """Stable ids without a shuffle, computed once and then stored with the rows.

    They ascend within a task. Delimited files bring ids of their own, which follow the files.
    """
    return df.select(F.monotonically_increasing_id().alias(ROW_ID), *[cell(name) for name in df.columns if name != ROW_ID])


class DocumentStore:
    """Documents below one root folder; use one root per workspace."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- log ---

    def log(self, document_id: str | None = None) -> DataFrame:
        folders = [f"{self.root}/versions"]
        if document_id is not None:
            folders = [f"{self.root}/versions/{document_id}", f"{self.root}/versions/batches"]
        folders = [folder for folder in folders if files.exists(self.spark, folder)]
        if not folders:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        log = self.spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").parquet(*folders)
        return log if document_id is None else log.where(F.col("document_id") == document_id)

    def entries(self, document_id: str) -> list[Row]:
        """The log of one document in version order (one small row per version)."""
        entries = self.log(document_id).orderBy("version").collect()
        if not entries:
            raise DocumentError(f"no document '{document_id}'")
        return entries

    def _commit(self, document_id: str, version: int, **values) -> None:
        folder = f"{self.root}/versions/{document_id}/{version:09d}"
        if files.exists(self.spark, folder):
            raise VersionConflict(f"version {version} of '{document_id}' exists already")
        row = dict.fromkeys(LOG_COLUMNS) | values
        row |= {"document_id": document_id, "version": version, "created_at": datetime.now(timezone.utc)}
        frame = self.spark.createDataFrame([tuple(row[name] for name in LOG_COLUMNS)], LOG_SCHEMA)
        frame.coalesce(1).write.mode("error").parquet(folder)

    def _fresh_path(self, document_id: str, kind: str) -> str:
        return f"{self.root}/{kind}/{document_id}/{uuid.uuid4().hex}"

    # --- documents ---

    def create(self, name: str, df: DataFrame, cause: str = "ingest", **source: str | None) -> str:
        """Write a new document with row ids and counts taken during the write; returns its id."""
        if not name.strip():
            raise DocumentError("the document has no name")
        return self.publish(self.prepare(df), name, cause, **source)

    def create_many(self, df: DataFrame, keys: Sequence[str], name: Column, **source: Column) -> list[str]:
        """New documents from the rows of one frame, one per distinct ``keys``; returns their ids. Row ids are made unless the rows bring them.

        One job writes all rows into a folder per document, one reads the counts, one appends the log rows.
        """
        batch, started = uuid.uuid4().hex, time.monotonic()
        path = self._fresh_path("batches", "data")
        document_id = F.md5(F.concat_ws("|", F.lit(batch), *[cell(k).cast("string") for k in keys]))
        columns = [c for c in df.columns if c not in keys and c != ROW_ID]
        row_id = cell(ROW_ID) if ROW_ID in df.columns else F.monotonically_increasing_id().alias(ROW_ID)
        check_width(len(columns))
        try:
            tagged = df.select(document_id.alias("_document_id"), *[cell(k) for k in keys], row_id, *[cell(c) for c in columns])
            with several_writers(self.spark, len(tagged.columns)):
                tagged.write.option("compression", "zstd").partitionBy("_document_id").parquet(path)
            written = self.spark.read.parquet(path)
            counted = written.groupBy("_document_id", *[cell(k) for k in keys]).agg(F.count("*").alias("rows"))
            spent = F.lit(int(1000 * (time.monotonic() - started)))
            values = {
                "duration_ms": spent, "document_id": F.col("_document_id"), "version": F.lit(1), "kind": F.lit("copy"),
                "path": F.concat(F.lit(path + "/_document_id="), F.col("_document_id")), "row_count": F.col("rows"),
                "column_count": F.lit(len(columns)), "cause": F.lit("ingest"), "created_at": F.current_timestamp(),
                "name": F.trim(name), **source,
            }
            entries = counted.select(*[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in LOG_COLUMNS.items()])
            entries.coalesce(1).write.mode("error").parquet(f"{self.root}/versions/batches/{batch}")
        except Exception:
            files.delete(self.spark, path)
            raise
        log = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/versions/batches/{batch}")
        return [row.document_id for row in log.orderBy("source_file", "source_sheet").collect()]

    def prepare(self, df: DataFrame, numbered: bool = False) -> Prepared:
        """Write the rows of a new document without making it visible; ``numbered`` rows bring their ids."""
        width = len([c for c in df.columns if c != ROW_ID])
        check_width(width)
        document_id, started = uuid.uuid4().hex, time.monotonic()
        path, counts = self._write_copy(document_id, df if numbered else with_row_ids(df))
        return Prepared(document_id, path, counts["rows"], width, int(1000 * (time.monotonic() - started)))

    def publish(self, prepared: Prepared, name: str, cause: str, **source: str | None) -> str:
        try:
            self._commit(
                prepared.document_id, 1, kind="copy", path=prepared.path, row_count=prepared.rows, column_count=prepared.width,
                cause=cause, name=name.strip(), duration_ms=prepared.milliseconds, **source,
            )
        except Exception:
            self.discard(prepared)
            raise
        return prepared.document_id

    def discard(self, prepared: Prepared) -> None:
        files.delete(self.spark, prepared.path)

    def save_query(self, name: str, query: str, source_document_id: str | None = None) -> str:
        """Store the result of a reading query over the current SQL context as a new document, with its lineage."""
        if source_document_id:
            self.entries(source_document_id)
        result = run_query(self.spark, query)
        return self.create(name, result, "sql", source_type="sql", source_file=name.strip(), source_document_id=source_document_id, sql=read_only(query))

    def open_document_context(self, document_id: str) -> None:
        """SQL sees this document, as ``documento`` and under its own name."""
        entries = self.entries(document_id)
        document_context(self._rows(entries), entries[-1].name)

    def open_workspace_context(self) -> None:
        """SQL sees every document of the store under its name."""
        workspace_context([(name, self.read(i)) for i, name in self.names().items()])

    def _write_copy(self, document_id: str, df: DataFrame, **counts: Column) -> tuple[str, dict]:
        """Write a full copy; row counts and further aggregates are observed on the way."""
        path, counted = self._fresh_path(document_id, "data"), Observation()
        every = [F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in counts.items()]]
        try:
            df.observe(counted, *every).write.mode("error").parquet(path)
        except Exception:
            files.delete(self.spark, path)
            raise
        return path, counted.get

    def read(self, document_id: str, version: int | None = None) -> DataFrame:
        entries = [e for e in self.entries(document_id) if version is None or e.version <= version]
        if not entries:
            raise DocumentError(f"no version {version} of '{document_id}'")
        return self._rows(entries)

    def _rows(self, entries: list[Row]) -> DataFrame:
        """The document after the given log rows: the last copy under its present names."""
        start = max(i for i, e in enumerate(entries) if e.kind == "copy")
        df = self.spark.read.parquet(entries[start].path).drop(*ORIGIN, CHANGED, BEFORE)
        for e in entries[start + 1 :]:
            df = rename_column(df, data_columns(df, ROW_ID).index(e.old_name), e.new_name)[0]
        return df

    # --- transformations ---

    def apply(self, document_id: str, t: Transformation) -> Applied:
        """Write the transformed document as a new copy and log it.

        A column keeps its type. When a new text cannot become a value of it the whole transformation is refused, so document, history and
        change log always agree. One pass writes the copy, marks the changed rows, keeps their former text and counts.
        """
        entries = self.entries(document_id)
        last, df = entries[-1], self._rows(entries)
        new = outcome(df, t)
        changed = ~new.before.eqNullSafe(new.after)
        marks = df.select(*[cell(c) for c in df.columns], changed.alias(CHANGED), F.when(changed, new.before).alias(BEFORE), new.value.alias("_new"), new.failed.alias("_failed"), new.misfit.alias("_misfit"))
        counted = Observation()
        marks = marks.observe(counted, F.count_if(CHANGED).alias("affected"), F.count_if("_failed").alias("failed"), F.count_if("_misfit").alias("misfits"))
        copy = marks.select(*[F.col("_new").alias(c) if c == t.column else cell(c) for c in df.columns], CHANGED, BEFORE)
        path, counts = self._write_copy(document_id, copy)
        try:
            counts |= counted.get
            if counts["misfits"]:
                raise TransformError(f"{counts['misfits']} new texts do not fit the type of column '{t.column}'")
            transformation_id = uuid.uuid4().hex
            self._commit(
                document_id,
                last.version + 1,
                kind="copy",
                path=path,
                row_count=counts["rows"],
                column_count=last.column_count,
                cause="transformation",
                name=last.name,
                transformation_id=transformation_id,
                sequence=max((e.sequence or 0 for e in entries), default=0) + 1,
                transformation_type=t.kind,
                column_name=t.column,
                configuration_json=json.dumps(t.config, ensure_ascii=False),
                affected_rows=counts["affected"],
                failed_rows=counts["failed"],
            )
        except Exception:
            files.delete(self.spark, path)
            raise
        return Applied(transformation_id, last.version + 1, counts["affected"], counts["failed"])

    def history(self, document_id: str) -> DataFrame:
        """Applied transformations in order."""
        done = self.log(document_id).where("transformation_id IS NOT NULL")
        return done.select(
            "transformation_id",
            "document_id",
            "sequence",
            "transformation_type",
            "column_name",
            "configuration_json",
            "affected_rows",
            "failed_rows",
            F.lit("applied").alias("status"),
            "created_at",
        ).orderBy("sequence")

    def deltas(self, document_id: str) -> DataFrame:
        """All cell changes of the document's transformations, read from the marks in their copies."""
        schema = "transformation_id string, row_id bigint, column_name string, old_value string, new_value string"
        out = self.spark.createDataFrame([], schema)
        for e in self.entries(document_id):
            if e.transformation_id:
                copy = self.spark.read.parquet(e.path).where(cell(CHANGED))
                out = out.unionByName(
                    copy.select(
                        F.lit(e.transformation_id).alias("transformation_id"),
                        cell(ROW_ID).alias("row_id"),
                        F.lit(e.column_name).alias("column_name"),
                        cell(BEFORE).alias("old_value"),
                        text_of(copy, e.column_name).alias("new_value"),
                    )
                )
        return out

    # --- edits ---

    def patch(self, document_id: str, edits: DataFrame) -> tuple[int, DataFrame]:
        """Commit a batch of cell edits; returns the version and the edits that were refused, with the reason.

        ``edits`` has the columns row_id, column_name, value, sequence.
        """
        entries = self.entries(document_id)
        last, df = entries[-1], self._rows(entries)
        checked = checked_edits(df, edits)
        missing = unmatched_edits(df, checked.where("problem IS NULL")).withColumn("problem", F.lit("unknown row"))
        refused = checked.where("problem IS NOT NULL").unionByName(missing)
        path, counts = self._write_copy(document_id, patched(df, edits))
        touched = checked.where("problem IS NULL").join(df.select(cell(ROW_ID).alias("row_id")), "row_id", "left_semi")
        try:
            self._commit(
                document_id, last.version + 1, kind="copy", path=path, row_count=counts["rows"], column_count=last.column_count,
                cause="edit", name=last.name, affected_rows=touched.select("row_id", "column_name").distinct().count(),
            )
        except Exception:
            files.delete(self.spark, path)
            raise
        return last.version + 1, refused

    def rename(self, document_id: str, index: int, new_name: str, rules: Sequence[Rule] = ()) -> tuple[int, list[Rule]]:
        """Rename a column in the log only; no data is rewritten."""
        entries = self.entries(document_id)
        last, df = entries[-1], self._rows(entries)
        renamed, followed = rename_column(df, index, new_name, rules)
        if renamed.columns == df.columns:
            return last.version, followed
        self._commit(
            document_id, last.version + 1, kind="rename", row_count=last.row_count, column_count=last.column_count, cause="rename",
            name=last.name, old_name=data_columns(df, ROW_ID)[index], new_name=new_name.strip(),
        )
        return last.version + 1, followed

    # --- lineage ---

    def lineage(self) -> DataFrame:
        """Saved SQL results: source document, result document, SQL text, time."""
        saved = self.log().where("sql IS NOT NULL")
        return saved.select("source_document_id", F.col("document_id").alias("result_document_id"), "sql", "created_at")

    def names(self) -> dict[str, str]:
        """Logical name of every document, by id."""
        latest = self.log().groupBy("document_id").agg(F.max_by("name", "version").alias("name"))
        return {row.document_id: row.name for row in latest.collect()}
