"""Session helpers: the checkpoint folder comes from the session."""
import types

import pytest

from montevar.session import checkpoint_dir


def test_a_local_session_gets_one_scratch_folder(spark):
    got = checkpoint_dir(spark)
    assert got and checkpoint_dir(spark) == got
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or got.replace("file:", "").startswith(configured.replace("file:", ""))


def _session(master, configured):
    made = []
    context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None,
                                    setCheckpointDir=made.append)
    conf = types.SimpleNamespace(get=lambda key, default=None: configured or default)
    return types.SimpleNamespace(sparkContext=context, conf=conf)


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(_session("spark://host:7077", None))
    with pytest.raises(ValueError):
        checkpoint_dir(_session("local-cluster[3,2,1024]", None))
    assert checkpoint_dir(_session("yarn", "hdfs://shared/ckpt")) == "hdfs://shared/ckpt"
