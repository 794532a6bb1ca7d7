import glob
import os
import shutil
import uuid
from types import SimpleNamespace

import pytest

from textquarry.llm import common


def test_own_tables_are_cleared_alone(spark):
    kept = common.staged(spark.range(3).toDF("n"), "mine")
    top = common.shared_dir(spark).removeprefix("file:")
    other = f"{top}/textquarry/another-{uuid.uuid4().hex}/t"
    os.makedirs(other)
    assert kept.count() == 3 and glob.glob(f"{top}/textquarry/{spark.sparkContext.applicationId}/mine-*")
    common.clear_scratch(spark)
    assert not glob.glob(f"{top}/textquarry/{spark.sparkContext.applicationId}") and os.path.isdir(other)
    shutil.rmtree(os.path.dirname(other))


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[2,1,1024]"])
def test_no_temporary_folder_on_a_cluster(master):
    conf = SimpleNamespace(get=lambda key, default: None)
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf=conf, sparkContext=context))
