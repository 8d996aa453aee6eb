"""Results of repeated requests: written once as Parquet in the shared folder, read back while they are fresh.

The key is the hash of the request. The folder of a result names when it was
written; it is fresh for a fixed time and a further one that depends on the key,
so that results of one moment do not all end together. Nothing is invalidated
by writes. A result that two sessions write at once has two folders, of which
the younger is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from spectrafold.functions.scalars import request_key

# Fixed values.
SECONDS, JITTER = 300, 300


def lifetime(key: str) -> int:
    return SECONDS + int(key[:8], 16) % JITTER


def cached(spark: SparkSession, folder: str, request: dict[str, Any], query: Callable[[], DataFrame], now: int) -> DataFrame:
    """The rows of the query for this request, at most its lifetime old; now: seconds."""
    key = request_key(request)
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs
    home = paths.Path(f"{folder}/{key}")
    files = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kept = [f.getPath() for f in files.listStatus(home)] if files.exists(home) else []
    fresh = [(int(p.getName().split("-")[0]), p) for p in kept if files.exists(paths.Path(p, "_SUCCESS"))]
    fresh = [(at, p.toString()) for at, p in fresh if at <= now < at + lifetime(key)]
    if fresh:
        return spark.read.parquet(max(fresh)[1])
    path = f"{folder}/{key}/{now}-{uuid.uuid4().hex}"
    query().write.parquet(path)
    return spark.read.parquet(path)
