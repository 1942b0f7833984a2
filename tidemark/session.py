"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = Lock()
_dropping: dict[int, tuple[int, str | None]] = {}  # per session: how many are inside, and the setting before them


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on. On a cluster leave ``master`` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Change records carry UTC instants and UTC calendar days, so the session must too."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the storage all executors share.

    Only a local session may do without that setting: there the driver's disk is shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/tidemark/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries planned inside delete the files of their shuffles when they end; otherwise those stay until the driver happens to
    collect its garbage."""
    session = spark._jvm.System.identityHashCode(spark._jsparkSession)
    with _lock:
        inside, before = _dropping.get(session) or (0, spark.conf.get(DROP_SHUFFLES, None))
        _dropping[session] = inside + 1, before
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _lock:
            inside, before = _dropping.pop(session)
            if inside > 1:
                _dropping[session] = inside - 1, before
            elif before is None:
                spark.conf.unset(DROP_SHUFFLES)
            else:
                spark.conf.set(DROP_SHUFFLES, before)


def together(spark: SparkSession, *jobs: Callable[[], Result]) -> list[Result]:
    """Run independent Spark jobs side by side; small ones leave most of a cluster idle."""
    if not jobs:
        return []
    in_thread = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [done.result() for done in [pool.submit(in_thread(job)) for job in jobs]]
