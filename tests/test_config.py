import pytest

from lodestream.config import Config


def test_local_and_remote():
    assert Config.read('{"dataset_path": "/data/x", "epoch_duration_ms": 50}').path() == "/data/x"
    c = Config.read('{"dataset_path": "x/y", "is_remote": true, "provider_uri": "s3://host:9000/bucket", "access_key": "a", "secret_key": "b", "use_ssl": false}')
    assert c.path() == "s3a://bucket/x/y" and c.spark()["spark.hadoop.fs.s3a.endpoint"] == "host:9000"
    assert c.spark()["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false" and "b'" not in repr(c)


def test_keys():
    text = """{"is_remote": true, "provider_uri": "minio://127.0.0.1:9000/tpch/", "access_key": "k", "secret_key": "s", "use_ssl": false, "dataset_path": "d", "blockpool_size_gb": 64,
      "max_network_bandwidth_gb": 8, "max_prepared_mb": 1024, "max_retriever_proportion": 0.333, "epoch_duration_ms": 50, "warm_up_time_ms": 300, "damping_factor": 0.5, "ema_alpha": 0.1, "reassignment_threshold": 0.05}"""
    c = Config.read(text)
    assert c.path() == "s3a://tpch/d" and c.max_retriever_proportion == 0.333 and c.spark()["spark.executor.memory"] == "65536m"


WRONG = ["{", "{}", '{"dataset_path": "x", "is_remote": true}']
WRONG += [f'{{"dataset_path": "x", "{k}": {v}}}' for k in ("blockpool_size_gb", "max_network_bandwidth_gb", "max_prepared_mb", "epoch_duration_ms", "warm_up_time_ms") for v in (0, -1)]
WRONG += [f'{{"dataset_path": "x", "{k}": {v}}}' for k in ("max_retriever_proportion", "damping_factor", "ema_alpha", "reassignment_threshold") for v in (-0.1, 1.1)]


@pytest.mark.parametrize("text", WRONG)
def test_refused(text):
    with pytest.raises(ValueError):
        Config.read(text)
