"""Reports as files and back."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mailglass.operators import reports
from mailglass.plans import mails
from mailglass.sources import report_files
from mailglass.sources.state_tables import StateTables


def test_every_row_of_the_index_has_its_files(spark, folder, tmp_path, monkeypatch):
    t, root = StateTables(spark, str(tmp_path / "state")), str(tmp_path / "reports")
    names = F.array(*[F.lit(f"/in/{n}.eml") for n in ("ordinary", "a:b|c", "n" * 200, "���", "ordinary")])
    x = mails.analysed(spark, folder).filter("page_id < 12").withColumn("path", F.get(names, (F.col("page_id") % 5).cast("int")))
    docs = reports.documents(x, F.expr("timestamp'2024-01-01 00:00:00'"))
    with monkeypatch.context() as m:
        m.setattr(StateTables, "_switch", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            report_files.write_report_files(t, docs, root)
    assert t.read("report_index").count() == 0
    index = report_files.write_report_files(t, docs, root).collect()
    files = {str(p): p.read_bytes() for p in Path(root).rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert len(index) == 12 and set(files) == {p for r in index for p in (r.report_path, r.page_path)}
    for r in index:
        doc = json.loads(files[r.report_path])
        assert (doc["report_id"], doc["verdict"], doc["score"]) == (r.report_id, r.verdict, r.score) and files[r.page_path].startswith(b"<!doctype html>")
        assert len(Path(r.report_path).name) <= 80 + 1 + 16 + 5
    again = report_files.write_report_files(t, docs, root).collect()
    assert sorted(again) == sorted(index) and {str(p): p.read_bytes() for p in Path(root).rglob("*") if p.is_file()} == files
    one = report_files.read_report(t, index[0].report_id)
    assert one["filename"] == index[0].filename and report_files.read_report(t, "none") is None
    Path(index[1].report_path).unlink()
    assert report_files.read_report(t, index[1].report_id) is None
