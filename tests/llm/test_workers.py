"""Ids as they are given, and workers that cannot import the package."""

import os
import subprocess
import sys

from pyspark import cloudpickle

import punctua
from punctua.llm import packing
from punctua.llm import runs as R
from punctua.llm import words as W

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(punctua.__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})  # the driver's path alone
from punctua.session import build_session
from punctua.llm import decontaminate, packing, quality
spark = build_session("workers", "2", 2)
spark.sparkContext.setLogLevel("ERROR")

def importable(_):
    import importlib.util
    return [importlib.util.find_spec("punctua") is not None]

assert not any(spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect())
text = "one two three four five six seven"
docs = spark.createDataFrame([(k, f"{{text}} x{{k}}" if k % 2 else "BUY !!! $$$ " * 9) for k in range(40)],
                             "doc_id long, text string")
labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
model = quality.fit(docs, labels)
assert quality.predict(docs, model).count() == 40 and quality.accepted(docs, labels).count() > 0
items = spark.createDataFrame([(7, text), (None, "a b c"), (8, None)], "item_id int, text string")
found = decontaminate.contained(docs, items)
assert dict(found.dtypes)["item_id"] == "int"
assert [tuple(r)[:2] for r in found.orderBy("doc_id").collect()] == [(k, 7) for k in range(1, 40, 2)]
assert decontaminate.clean(docs, items).count() == 20
print("fine")
"""


def test_workers_need_no_copy_of_the_package(spark, tmp_path):
    script = tmp_path / "driver.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-3000:]


def test_packing_keeps_large_ids_beside_a_null(spark):
    ids = [9007199254740993, None, 9007199254740995, -9007199254740993]
    docs = spark.createDataFrame([(i, "a b", None) for i in ids], "doc_id long, text string, source string")
    got = packing.pack(docs, one_source=False)
    assert dict(got.dtypes)["doc_id"] == "bigint"
    assert {r.doc_id for r in got.collect()} == set(ids)


def test_staged_folders_can_be_removed(spark):
    with R.scope() as folders:
        table = R.staged(spark.range(5), "some")
        assert table.count() == 5
    R.staged(spark.range(5), "outside")
    assert len(folders) == 1 and os.path.exists(folders[0].removeprefix("file:"))
    R.removed(spark, folders)
    assert not os.path.exists(os.path.dirname(folders[0].removeprefix("file:")))


def test_task_functions_travel_without_what_the_driver_computed():
    def task(text):
        return [hashes.tolist() for _, hashes in W.word_hashes([text], lower=True)]

    here = task(b"a B c")  # leaves tables of some MB in this process
    sent = cloudpickle.dumps(task)
    assert len(sent) < 1 << 18 and cloudpickle.loads(sent)(b"a B c") == here
