"""Reports as files: a JSON document and a page of HTML for each, and the index that finds them, as one unit.

Tasks write the files of their own rows, each under a temporary name that is then moved, so a task that runs twice leaves the
same files. Only when all are there does the state table `report_index` name them; what a failed run has left is written over by
the next one, as names follow from the reports.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailglass.functions.batches import bounded
from mailglass.functions.names import safe_file_name
from mailglass.operators.reports import page
from mailglass.operators.state import upsert
from mailglass.sources.state_tables import StateTables


def named(reports: DataFrame) -> DataFrame:
    """reports with `stem`: a folder of the first two digits of the id, then a safe name of the mail's file and the id, which
    keeps names apart. An id that is no plain word is replaced by its hash."""
    plain = F.when(F.col("report_id").rlike("^[A-Za-z0-9_-]{2,64}$"), F.col("report_id")).otherwise(F.sha2(F.coalesce("report_id", F.lit("")), 256).substr(1, 32))
    name = safe_file_name(F.regexp_replace(F.coalesce("filename", F.lit("")), r"(?i)\.eml$", ""), F.lit("mail"))
    return reports.withColumn("stem", F.concat(plain.substr(1, 2), F.lit("/"), name, F.lit("_"), plain))


def write_report_files(tables: StateTables, reports: DataFrame, root: str) -> DataFrame:
    """Write operators.reports.documents below root (a path or address that pyarrow's file systems open) and index them; returns
    the new index. A report that is there already is written over. Rows with one id must be one report."""
    base = tables.manifest()["version"]
    x = named(reports)
    document = F.to_json(F.struct(*[F.col(f"`{c}`") for c in reports.columns]))
    root = root.rstrip("/")
    at = lambda ending: F.concat(F.lit(root + "/"), "stem", F.lit(ending))
    rows = x.select("report_id", "filename", "verdict", "score", "created_at", "ioc_count", at(".json").alias("report_path"), at(".html").alias("page_path"), document.alias("_json"), page().alias("_html"))
    kept = rows.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        files, top = FileSystem.from_uri(root) if "://" in root else (FileSystem.from_uri("file://" + root)[0], root)
        made = set()
        for b in batches:
            for ending, paths in (("_json", b.column("report_path")), ("_html", b.column("page_path"))):
                for path, text in zip(paths.to_pylist(), b.column(ending).to_pylist(), strict=True):
                    target = top + path[len(root) :]
                    folder = target.rsplit("/", 1)[0]
                    if folder not in made:
                        files.create_dir(folder, recursive=True)
                        made.add(folder)
                    part = f"{folder}/.{uuid.uuid4().hex}"
                    with files.open_output_stream(part) as out:
                        out.write((text or "").encode())
                    files.move(part, target)
            yield b.select(kept)

    schema = rows.select(*kept).schema
    done = f"{tables.root}/work-{uuid.uuid4().hex}"
    bounded(rows).mapInArrow(run, schema).write.parquet(done)
    index = upsert(tables.read("report_index", base), tables.spark.read.schema(schema).parquet(done), ["report_id"])
    tables.commit({"report_index": index}, base)
    tables.remove(done)
    return tables.read("report_index")


def read_report(tables: StateTables, report_id: str) -> dict | None:
    """The document of a report by its id, from the index; None if no report has it or its file has gone."""
    import json

    row = tables.read("report_index").filter(F.col("report_id") == report_id).first()
    if row is None:
        return None
    if not tables.exists(row.report_path):
        return None
    return json.loads(tables.spark.read.text(row.report_path, wholetext=True).first()[0])
