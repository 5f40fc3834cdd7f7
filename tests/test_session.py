"""The shared folder and the intermediate tables."""

import os
from types import SimpleNamespace

import pytest

from corpusloom import session as S


def test_intermediates_go_with_their_block(spark):
    with S.intermediates():
        df = S.written(spark.range(5), "five")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *_: None)
    fake = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"), conf=conf)  # neither names one
    with pytest.raises(RuntimeError):
        S.shared_dir(fake)
