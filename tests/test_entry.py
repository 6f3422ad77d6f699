"""The driver's entry without the optional parts, and where intermediate tables go."""

import os
import shutil
import subprocess
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpusloom import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("also", [True, False])
def test_entry_works_without_the_optional_parts(tmp_path, also):
    copy = tmp_path / "repo"
    skip = shutil.ignore_patterns(".git", "tests", "__pycache__", "llm", *(["corpus_pipeline.py"] if also else []))
    shutil.copytree(ROOT, copy, ignore=skip)
    (copy / "corpusloom" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op1') for k in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 70


def fake(master, conf=None, checkpoint=None):
    state = {"dir": checkpoint}
    context = SimpleNamespace(master=master, applicationId="app-1", getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda d: state.update(dir=f"{d}/uuid"))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: conf or default))


def test_the_setting_of_the_session_comes_first():
    assert session.work_dir(fake("spark://host:7077", "hdfs:///shared/", "hdfs:///other")) == "hdfs:///shared"
    assert session.new_folder(fake("local[2]", "hdfs:///shared"), "x").startswith("hdfs:///shared/corpusloom/app-1/x-")


def test_a_folder_set_on_the_context_is_used():
    assert session.work_dir(fake("yarn", None, "hdfs:///mine/1")) == "hdfs:///mine/1"


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1000]", "k8s://https://host"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_dir(fake(master))


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_one_machine_gets_a_folder_of_its_own(master):
    assert session.work_dir(fake(master)).startswith("file:///")


def test_stored_tables_are_written_and_dropped(spark):
    kept = session.stored(spark.range(10), "numbers")
    again = session.stored(kept.where(F.col("id") > 5), "numbers")
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    session.drop_stored(spark, kept)
    assert not os.path.exists(path) and again.count() == 4
