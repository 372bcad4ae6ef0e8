"""The sink for documents with names of their own: whole files, published once, whatever happens to tasks."""

import pathlib
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from pagemill.catalog import oracles, queries
from pagemill.sources import named_files as nf
from pagemill.sources.named_files import in_pieces, read_files, write_files
from tests.conftest import SF_DIR
from tools.check import compare, connect

SCHEMA = "path string, part int, ord long, content string"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def files(root):
    return {str(p.relative_to(root)): p.read_text() for p in pathlib.Path(root).rglob("*") if p.is_file()}


def test_rows_of_a_path_are_one_file_in_order(spark, folder):
    given = [("a/x y#%41é.md", 1, 5, "two"), ("a/x y#%41é.md", 0, 9, "one"), ("a/x y#%41é.md", 1, 10, "three\n"), ("a/_hidden.md", 0, 0, None), ("b/日本.md", 0, 0, "text")]
    write_files(spark.createDataFrame(given, SCHEMA), f"{folder}/out")
    want = {"a/x y#%41é.md": "one\ntwo\nthree\n", "a/_hidden.md": "", "b/日本.md": "text"}
    assert files(f"{folder}/out") == want and [p.name for p in pathlib.Path(folder).iterdir()] == ["out"]
    assert {r.path: bytes(r.content).decode() for r in read_files(spark, f"file:{folder}/out").collect()} == want
    with pytest.raises(Exception, match="exists"):
        write_files(spark.createDataFrame(given, SCHEMA), f"{folder}/out")
    write_files(spark.createDataFrame(given[-1:], SCHEMA), f"{folder}/out", overwrite=True)
    assert files(f"{folder}/out") == {"b/日本.md": "text"} and [p.name for p in pathlib.Path(folder).iterdir()] == ["out"]


@pytest.mark.parametrize("bad", [("../x.md", 0, 0, "a"), ("/x.md", 0, 0, "a"), ("a//x.md", 0, 0, "a"), (None, 0, 0, "a"), ("ok.md", 0, 1, "again")])
def test_a_failed_job_leaves_nothing(spark, folder, bad):
    rows = spark.createDataFrame([("ok.md", 0, 1, "a"), bad], SCHEMA)
    with pytest.raises(Exception):
        write_files(rows, f"{folder}/out")
    assert list(pathlib.Path(folder).iterdir()) == []


def test_no_rows_give_an_empty_folder(spark, folder):
    write_files(spark.createDataFrame([], SCHEMA), f"{folder}/out")
    assert files(f"{folder}/out") == {} and read_files(spark, f"{folder}/out").count() == 0


def test_large_documents_go_on_in_further_files(spark, folder):
    rows = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("s"), F.col("id") % 300, F.lit(".md"))).otherwise("hot.md").alias("path"),
                                    (F.col("id") > 50).cast("int").alias("part"), "id", F.repeat(F.lit("x"), 20).alias("content")).toDF("path", "part", "ord", "content")
    cut = in_pieces(rows, 10_000)
    assert cut.count() == 4000 and cut.where("path LIKE 'hot%'").select("path").distinct().count() == 7
    write_files(rows, f"{folder}/out", file_bytes=10_000)
    found = files(f"{folder}/out")
    hot = [found["hot.md"], *(found[f"hot.{k}.md"] for k in range(2, 8))]
    whole = [r.content for r in rows.where("path = 'hot.md'").orderBy("part", "ord").collect()]
    assert "\n".join(hot) == "\n".join(whole) and max(map(len, hot)) < 11_000
    assert sum(1 for p in found if p.startswith("hot")) == 7 and len(found) == 7 + rows.where("path <> 'hot.md'").select("path").distinct().count()


KILLED = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pagemill.sources import named_files as nf
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
write = nf.NamedFilesWriter.write
def dies_once(self, batches):
    def rows():
        for batch in batches:
            for k in range(0, batch.num_rows, 7):
                if k > 20 and TaskContext.get().attemptNumber() == 0:
                    open({out!r} + f"-killed-{{TaskContext.get().partitionId()}}", "w").close()
                    os.kill(os.getpid(), 9)
                yield batch.slice(k, 7)
    return write(self, rows())
nf.NamedFilesWriter.write = dies_once
import pagemill, pyspark.cloudpickle as cp
cp.register_pickle_by_value(nf)
rows = spark.range(400).selectExpr("concat('d', id % 5, '/f', id div 2, '.md') AS path", "0 AS part", "id AS ord", "concat('text ', id) AS content")
nf.write_files(rows, {out!r})
"""


def test_killed_tasks_are_repeated_without_a_trace(folder):
    repo, out = str(pathlib.Path(__file__).resolve().parents[1]), f"{folder}/out"
    run = subprocess.run([sys.executable, "-c", KILLED.format(repo=repo, out=out)], capture_output=True, text=True, timeout=300, cwd=folder)
    assert run.returncode == 0, run.stderr[-3000:]
    want: dict[str, str] = {}
    for k in range(400):
        path = f"d{k % 5}/f{k // 2}.md"
        want[path] = f"{want[path]}\ntext {k}" if path in want else f"text {k}"
    assert list(pathlib.Path(folder).glob("out-killed-*")) and files(out) == want and not [p for p in pathlib.Path(folder).iterdir() if p.name.startswith("_out")]


def test_all_documents_of_all_sites(spark):
    ok, message = compare(spark, connect(SF_DIR), "out3_named_files", SF_DIR, queries()["out3_named_files"], oracles()["out3_named_files"])
    assert ok, message
