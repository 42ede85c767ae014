import pytest

from cartlens.session import ensure_checkpoint_dir


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, conf):
        self.master = master
        self._conf = conf
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def getConf(self):
        return self._conf

    def setCheckpointDir(self, d):
        self.dir = d


class _Session:
    def __init__(self, master, conf=None):
        self.conf = _Conf(conf or {})
        self.sparkContext = _Context(master, _Conf(conf or {}))


def test_cluster_without_shared_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(_Session("yarn"))


def test_configured_checkpoint_dir_is_used():
    s = _Session("yarn", {"spark.checkpoint.dir": "hdfs://nn/shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs://nn/shared/ckpt"


def test_local_mode_gets_a_scratch_dir():
    s = _Session("local[2]")
    assert ensure_checkpoint_dir(s).startswith("/")


def test_rank_is_deterministic_across_runs(spark):
    from cartlens.operators.folds import assign_folds
    from cartlens.operators.ratings import filter_active_users
    from cartlens.operators.relations import load_ratings

    from .conftest import SF001

    r = filter_active_users(load_ratings(spark, SF001))
    a = assign_folds(r.repartition(3))
    b = assign_folds(r.repartition(7))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
