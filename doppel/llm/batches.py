"""Helpers for work on Arrow batches of texts and for files between jobs."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from doppel.checkpoint import checkpoint_dir

SLICE_CHARS = 1_500_000


def texts(column: pd.Series) -> list[str]:
    """The texts of a batch; null is empty."""
    return ["" if t is None or t != t else t for t in column.tolist()]


def slices(frames: Iterable[pd.DataFrame], column: str = "text", most: int = SLICE_CHARS) -> Iterator[pd.DataFrame]:
    """The batches cut into runs of rows of about `most` characters, so that memory does not follow the batch size."""
    for frame in frames:
        if not len(frame):
            continue
        found = texts(frame[column])
        frame = frame.assign(**{column: found}).reset_index(drop=True)
        run = np.cumsum([len(t) for t in found]) // most
        for _, part in frame.groupby(run, sort=True):
            yield part.reset_index(drop=True)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written to a new folder below the shared checkpoint folder and read again; smaller than a checkpoint."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def erased(*frames: DataFrame) -> None:
    """Removes the folders of written() frames that no later step reads."""
    for frame in frames:
        spark = frame.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """A column name like `name` that the frame has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
