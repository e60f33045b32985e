"""Engine configuration from a JSON file, as Spark settings and a data path."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from .sources.ingest import object_store


@dataclass(frozen=True)
class Config:
    """Keys of the file. The limits of an IO scheduler (from max_network_bandwidth_gb on) are checked and have no
    effect: Spark and its file systems schedule IO."""

    dataset_path: str
    is_remote: bool = False
    provider_uri: str = ""
    access_key: str = ""
    secret_key: str = ""
    use_ssl: bool = True
    blockpool_size_gb: float | None = None
    max_network_bandwidth_gb: float | None = None
    max_prepared_mb: float | None = None
    max_retriever_proportion: float | None = None
    epoch_duration_ms: float | None = None
    warm_up_time_ms: float | None = None
    damping_factor: float | None = None
    ema_alpha: float | None = None
    reassignment_threshold: float | None = None

    @staticmethod
    def read(text: str) -> Config:
        try:
            given = json.loads(text)
        except json.JSONDecodeError as e:
            raise ValueError(f"the configuration is not JSON: {e}") from e
        known = {f.name for f in fields(Config)}
        if "dataset_path" not in given:
            raise ValueError("dataset_path is missing")
        c = Config(**{k: v for k, v in given.items() if k in known})
        if c.is_remote and not (c.provider_uri and c.access_key and c.secret_key):
            raise ValueError("a remote dataset needs provider_uri, access_key and secret_key")
        for name in ("blockpool_size_gb", "max_network_bandwidth_gb", "max_prepared_mb", "epoch_duration_ms", "warm_up_time_ms"):
            if (v := getattr(c, name)) is not None and v <= 0:
                raise ValueError(f"{name} must be above 0")
        for name in ("max_retriever_proportion", "damping_factor", "ema_alpha", "reassignment_threshold"):
            if (v := getattr(c, name)) is not None and not 0 <= v <= 1:
                raise ValueError(f"{name} must be from 0 to 1")
        return c

    def bucket(self) -> tuple[str, str]:
        """(endpoint, bucket) of a provider URI scheme://host[:port]/bucket."""
        host, _, rest = self.provider_uri.partition("://")[2].partition("/")
        return host, rest.partition("/")[0]

    def path(self) -> str:
        return f"s3a://{self.bucket()[1]}/{self.dataset_path.strip('/')}" if self.is_remote else self.dataset_path

    def spark(self) -> dict[str, str]:
        out = object_store(self.bucket()[0], self.access_key, self.secret_key, self.use_ssl) if self.is_remote else {}
        if self.blockpool_size_gb:
            out["spark.executor.memory"] = f"{int(self.blockpool_size_gb * 1024)}m"
        return out

    def __repr__(self) -> str:
        return f"Config(path={self.path()!r})"
