"""Storage of intermediate tables, and the entry's dealing with the optional subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from spanwise import session

ROOT = Path(__file__).resolve().parent.parent


def test_a_cluster_must_name_its_folder():
    for master, ok in (("local", True), ("local[8]", True), ("local-cluster[3,2,1024]", False), ("yarn", False), ("spark://h:7077", False)):
        kept = {}
        spark = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d, set=kept.__setitem__), sparkContext=SimpleNamespace(master=master))
        if ok:
            assert session.shared_dir(spark).startswith("file:///") and "spark.checkpoint.dir" in kept
        else:
            with pytest.raises(ValueError, match="executors share"):
                session.shared_dir(spark)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: "hdfs:///x"))
    assert session.shared_dir(named) == "hdfs:///x"


def test_release(spark):
    df = session.materialize(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file://")
    assert Path(path).exists() and session.release(spark) >= 1
    assert not Path(path).exists() and session.release(spark) == 0


def test_entry_reports_a_broken_subpackage(tmp_path):
    """Without it the rest works; one that is there but fails to import is an error."""
    import shutil

    for name in ("spanwise", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=False)
    shutil.rmtree(tmp_path / "spanwise" / "llm", ignore_errors=True)
    plain = run()
    assert plain.returncode == 0, plain.stderr
    (tmp_path / "spanwise" / "llm").mkdir()
    (tmp_path / "spanwise" / "llm" / "__init__.py").write_text("")
    (tmp_path / "spanwise" / "llm" / "queries.py").write_text("import no_such_module\n")
    assert run().returncode != 0


def test_logs_as_a_stream(spark, tmp_path):
    from spanwise.streaming.logs import follow_logs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\r\ntwo\n\nthree")
    (tmp_path / "in" / "b.log").write_text("")
    (tmp_path / "in" / "c.txt").write_text("no log\n")
    for expected in (["[a] one", "[a] three", "[a] two"], ["[a] one", "[a] three", "[a] two", "[d] new"]):
        stream = follow_logs(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert stream.awaitTermination(120) in (True, None)
        assert sorted(r["line"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == expected
        (tmp_path / "in" / "d.log").write_text("new\n")
