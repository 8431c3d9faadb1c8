from __future__ import annotations

from types import SimpleNamespace

import pytest

from busvitals.sources import scratch


def session(configured=None, master="local[2]"):
    held = {}
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: held.get("dir"), setCheckpointDir=lambda d: held.update(dir=d), applicationId="app"
    )
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: configured), sparkContext=context)


def test_the_configured_folder_is_used():
    assert scratch.shared_dir(session("hdfs://shared/x/", "yarn")) == "hdfs://shared/x"


def test_only_local_sessions_get_a_folder_of_their_own():
    local = session()
    assert scratch.shared_dir(local) == scratch.shared_dir(local)
    assert local.sparkContext.getCheckpointDir() is None  # the session is left as it is
    with pytest.raises(RuntimeError):
        scratch.shared_dir(session(master="yarn"))


def test_context_has_the_calls(spark):
    assert callable(spark.sparkContext.getCheckpointDir)
    assert scratch.fresh_path(spark, "a") != scratch.fresh_path(spark, "a")
