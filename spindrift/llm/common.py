"""Helpers shared by the training-data operators: tables, durable cuts, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of one Arrow batch are handed to Python functions in slices of about so many characters.
SLICE_CHARS = 4_000_000
#: Bytes, as shuffled, up to which a partition of a join's side is hashed in memory.
HASHED_SIDE = "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all machines share, as spark.checkpoint.dir names it; a temporary one only on a single machine that has none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = tempfile.mkdtemp(prefix="spindrift-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def durable(df: DataFrame, **options: str) -> DataFrame:
    """df, written once to the shared folder and read from there.

    Lost executors don't matter, nothing is computed again, and neither the plan nor its size
    estimate is carried on, as checkpoints do, whose estimates multiply in loops of joins.
    """
    spark = df.sparkSession
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Within it these settings of the session hold; what was there comes back after it."""
    before = {n: spark.conf.get(n, None) for n in settings}
    for n, value in settings.items():
        spark.conf.set(n, value)
    try:
        yield
    finally:
        for n, value in before.items():
            if value is None:
                spark.conf.unset(n)
            else:
                spark.conf.set(n, value)


def same_plan_at_every_size(spark: SparkSession):
    """Within it no join is turned into a broadcast by the size of its input, only by a hint."""
    return session_settings(spark, {n: "-1" for n in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")})


def few_pages(spark: SparkSession):
    """Within it tasks hold few pages of Spark's memory.

    A sort, a map of a partial aggregate and the map before it each take a whole page (32 MB on an executor of
    1.8 GB) however few rows they get, and many small tasks of several such operators make the heap grow to its end.
    So joins whose side is small in every partition hash it, without two sorts; larger ones sort as before. Partial
    aggregates have one map.
    """
    return session_settings(spark, {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": HASHED_SIDE, "spark.sql.codegen.aggregate.map.twolevel.enabled": "false"})


def drop_old_shuffles(spark: SparkSession) -> None:
    """Has the driver's collector run, so that Spark removes the shuffle files that no plan needs any more."""
    spark.sparkContext._jvm.System.gc()


_kept: list[tuple[object, object]] = []


def one_a_worker(key: object, make: Callable[[], object]) -> object:
    """What make gives, kept by a worker while the same key asks for it; whatever was kept before goes first.

    Workers outlive stages, so an operator's tables must not stay when the next operator runs.
    """
    if not _kept or not (_kept[0][0] is key or isinstance(key, str) and _kept[0][0] == key):
        _kept.clear()
        _kept.append((key, make()))
    return _kept[0][1]


def let_go() -> None:
    """Drops what a worker keeps."""
    _kept.clear()


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts are large, so that Python strings of few texts live at once."""
    for batch in batches:
        size = batch.column(text).nbytes if batch.num_rows else 0
        step = max(1, batch.num_rows * chars // max(size, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """df through work, batch by batch; work gets a few texts at a time and returns rows of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text):
            out = work(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)
