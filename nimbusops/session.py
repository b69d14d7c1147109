"""Session settings and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_scope: ContextVar[list[Staging] | None] = ContextVar("scope", default=None)


# The JVM does not compile methods above 8000 bytes. Wide projections of raw text get there, and then
# run interpreted, five times slower; below the limit Spark splits them into small methods instead.
COMPILED_METHOD_BYTES = "8000"


def prepare(spark: SparkSession) -> SparkSession:
    """Sets two options of the session for good: its zone is UTC, as local times are zone-less and date
    functions must not shift them, and generated methods stay below the limit above."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED_METHOD_BYTES)
    return spark


def staging_root(spark: SparkSession) -> str:
    """Shared folder named by the session; a temporary one only for a local master."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="nimbusops-")
    return _local_roots[app]


class Staging:
    """Writes intermediate tables once as Parquet in the shared folder and reads them back.

    The written table cuts the lineage (a lost executor re-reads it, it does not recompute the raw
    scan) and gives the optimizer a real file size for its broadcast decision.

    Tables live as long as the block that the staging is the context of, or the `scoped` call that it was
    made in, and no longer than the application; `drop` ends the life of one of them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        app = spark.sparkContext.applicationId
        self.path = f"{staging_root(spark)}/nimbusops-{app}-{uuid.uuid4().hex}"
        self.names: list[str] = []
        system, folder = self._folder()
        system.mkdirs(folder)
        system.deleteOnExit(folder)
        if (scope := _scope.get()) is not None:
            scope.append(self)

    def _folder(self, name: str = ""):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def write(self, name: str, df: DataFrame) -> DataFrame:
        target = f"{self.path}/{name}"
        df.write.parquet(target)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(target)

    def drop(self, name: str) -> None:
        """Delete one table, after its last consumer."""
        system, folder = self._folder(name)
        system.delete(folder, True)
        self.names.remove(name)

    def remove(self) -> None:
        """Delete what was staged; frames that read it are of no use afterwards."""
        system, folder = self._folder()
        system.delete(folder, True)
        self.names.clear()

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        self.remove()


def scoped(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of build(), without the tables that were staged on the way: the result is written and they
    are removed. A result that needs no staged table stays a plan."""
    kept, opened = Staging(spark), []
    token = _scope.set(opened)
    try:
        df = build()
        return kept.write("result", df) if any(staging.names for staging in opened) else df
    finally:
        _scope.reset(token)
        if any(staging.names for staging in opened):
            for staging in opened:
                staging.remove()
