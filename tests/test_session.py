"""The shared folder for intermediate results."""

import datetime as dt
import os

import pytest

from skein.session import checkpoint_folder, checkpointed, forget, shared_path


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,1000]", "locality"])
def test_no_machine_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError):
        checkpoint_folder(master, None)
    assert checkpoint_folder(master, "hdfs:///shared") == "hdfs:///shared"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_local_folder_on_one_machine(master):
    assert os.path.isdir(checkpoint_folder(master, None))


def test_round_trip(spark):
    rows = [(1, "a", [1, None], {"k": 1.5}, (None, "x"), dt.datetime(2024, 1, 2, 3, 4, 5, 678)), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "n int, `odd. name` string, l array<int>, m map<string,double>, s struct<a:int,b:string>, t timestamp")
    kept = checkpointed(df)
    assert kept.schema == df.schema and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    forget(kept)
    assert checkpointed(df.limit(0)).count() == 0
    assert shared_path(spark) != shared_path(spark)
