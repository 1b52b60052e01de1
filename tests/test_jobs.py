"""The jobs over growing and changing input, run again, and from the command line."""
import json
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from jobs import _common, reference_index, review_findings
from ripplescope.sources import references

DATA = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string, lang string"


def _plain(rows):
    found = Counter()
    for i, text in rows:
        found.update((i, w) for w in re.findall(r"\w+", text or ""))
    return found


def _held(spark, out):
    rows = reference_index.current(spark, out).collect()
    assert len({(r.doc_id, r.token) for r in rows}) == len(rows)
    return {(r.doc_id, r.token): r.n for r in rows if r.token is not None}


@pytest.fixture()
def config(spark):
    return _common.config(spark, _common.default("reference_index")) | {"buckets": 4}


def test_index_takes_only_what_is_new(spark, config, tmp_path, caplog):
    docs, out, checkpoint = (str(tmp_path / x) for x in ("docs", "out", "checkpoint"))
    first = [(1, "one Two_3 two one", "x"), (2, None, "x"), (3, "", "x"), (None, "naïve 字", None), (4, "a b c", "x"), (4, "c d", "x")]
    spark.createDataFrame(first, TEXTS).coalesce(1).write.parquet(docs)
    caplog.set_level("INFO", "jobs")
    run = lambda: reference_index.run(spark, docs, out, checkpoint, config)
    run()
    assert _held(spark, out) == _plain([r[:2] for r in first])
    files = {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")}
    run()
    assert "nothing new" in caplog.text and {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet")} == files
    later = [(5, "five one", "x"), (1, "one anew", "x"), (4, "", "x"), (None, "other", None)]
    spark.createDataFrame(later, TEXTS).coalesce(1).write.mode("append").parquet(docs)
    caplog.clear()
    run()
    assert "batch 1: 4 texts read" in caplog.text
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    replaced = {r[0] for r in later}
    assert _held(spark, out) == _plain([r[:2] for r in first if r[0] not in replaced] + [r[:2] for r in later])
    # a batch whose end was not noted is run again and gives the same
    before = sorted(map(str, spark.read.parquet(out).collect()))
    for p in Path(checkpoint, "commits").glob("*1*"):
        p.unlink()
    run()
    assert sorted(map(str, spark.read.parquet(out).collect())) == before


def test_index_of_an_empty_table(spark, config, tmp_path):
    spark.createDataFrame([], TEXTS).write.parquet(str(tmp_path / "docs"))
    reference_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), config)
    spark.createDataFrame([(1, "later", "x")], TEXTS).write.mode("append").parquet(str(tmp_path / "docs"))
    reference_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), config)
    assert _held(spark, str(tmp_path / "out")) == {(1, "later"): 1}


def test_names_are_looked_up_as_words(spark):
    texts = {"a.py": "import os.path\nready? go(x)", "b.py": "os\npath go2 \\E", "c.py": "ospath os.pathx go", "d.py": "", "e.py": None, "f.py": "naïve go"}
    files = spark.createDataFrame(list(texts.items()), "path string, source string")
    names = ["os", "go", "os.path", "na", "naïve", "ready?", "nowhere", "??", "", None, "go", "a\\Eb"]
    found = references.lookup(references.index(files), spark.createDataFrame([(n,) for n in names], "name string"), files).collect()
    want = {(n, p) for n in names if n and re.search(r"\w", n) for p, t in texts.items() if re.search(r"\b" + re.escape(n) + r"\b", t or "")}
    assert {(r.name, r.path) for r in found} == want and len(found) == len(want)
    only_words = references.lookup(references.index(files), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {(r.name, r.path) for r in only_words} == {x for x in want if re.fullmatch(r"\w+", x[0])}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A copy of the tables with some of the orders."""
    folder = tmp_path_factory.mktemp("tables")
    for name in ("part", "orders", "lineitem"):
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        df.filter("o_orderkey % 3 = 0" if name == "orders" else "true").write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_findings_are_the_same_again_and_months_are_replaced(spark, tables, tmp_path, caplog):
    out, config = str(tmp_path / "out"), _common.config(spark, _common.default("review_findings"))
    caplog.set_level("INFO", "jobs")
    review_findings.run(spark, str(tables), out, config)
    whole = sorted(map(tuple, review_findings.read(spark, out).collect()), key=str)
    assert {r[2] for r in whole} == {"risk", "phantom", "impact", "test"} and len({r[0] for r in whole}) > 24
    con = duckdb.connect()
    for name in ("part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    assert [tuple(map(str, r[:5])) for r in whole] == [tuple(map(str, r[:5])) for r in sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(review_findings.COLUMNS)} FROM ({review_findings.SQL})").fetchall()), key=str)]
    month = sorted({r[0] for r in whole})[3]
    kept = {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet") if month not in str(p)}
    review_findings.run(spark, str(tables), out, config | {"first_month": month, "last_month": month})
    assert sorted(map(tuple, review_findings.read(spark, out).collect()), key=str) == whole
    assert kept == {p: p.stat().st_mtime_ns for p in Path(out).rglob("*.parquet") if month not in str(p)}
    assert "changes of" in caplog.text and "findings of kind impact written" in caplog.text


def test_settings_stay_and_folders_are_new(spark):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    made = [_common.new_folder(spark, "job") for _ in range(2)]
    assert made[0] != made[1]
    found = entry.queries()["job2_reference_index"](spark, DATA)
    assert found.select("doc_id").distinct().count() == spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").distinct().count()
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def test_command_line(spark, tmp_path):
    spark.createDataFrame([(1, "one two", "x")], TEXTS).write.parquet(str(tmp_path / "docs"))
    (tmp_path / "config.json").write_text(json.dumps({"key": "doc_id", "text": "text", "buckets": 2, "max_files_per_batch": 5}))
    args = [sys.executable, "-m", "jobs.reference_index", "--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "cp"), "--config", str(tmp_path / "config.json")]
    for said in ("1 texts read", "nothing new"):
        done = subprocess.run(args, cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and said in done.stderr, done.stderr[-2000:]
    assert {(r.token, r.n) for r in spark.read.parquet(str(tmp_path / "out")).select("token", "n").collect()} == {("one", 1), ("two", 1)}


def test_jobs_need_no_text_operators():
    code = "import sys; import jobs.reference_index, jobs.review_findings; assert not [m for m in sys.modules if m.startswith(('ripplescope.llm', 'corpus_pipeline'))]"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True, timeout=120)
    assert {"job1_review_findings", "job2_reference_index"} <= set(entry.queries()) & set(entry.oracle_sql())


def test_index_of_one_batch_is_read_without_a_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    reference_index.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "mark"), {"key": "doc_id", "text": "text", "buckets": 4, "max_files_per_batch": 10})
    found = reference_index.current(spark, str(tmp_path / "out"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.token or "", r.n) for r in found.collect()) == [(1, "a", 2), (1, "b", 1), (2, "", 0)]
