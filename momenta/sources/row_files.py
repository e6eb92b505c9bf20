"""Rows of doubles in files that tasks write and read by themselves, for fits that pass over the same rows many times.

A pass reads the bytes as they lie, so it costs some tens of nanoseconds a row instead of the hundreds of a row that is decoded and
handed to Python. A file counts only once its row is in the table of files, so tasks that are run again leave nothing wrong behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momenta.plans.protocols import partial_sums
from momenta.sources.scratch import folder, saved

#: Bytes of a piece, the least that a task gets, and of a chunk, which is worked on at once.
PIECE, CHUNK = 8 << 20, 1 << 17


class RowFiles:
    def __init__(self, path: str, width: int, files: list[tuple[str, int]]):
        self.path, self.width, self.files = path, width, files
        self.piece, self.chunk = (max(n // (8 * width), 1) for n in (PIECE, CHUNK))
        #: The piece that each file begins with, and the number of all.
        self.first = np.cumsum([0, *(-(-n // self.piece) for _, n in files)])

    def sums(self, spark: SparkSession, update: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of update(chunk) over all chunks: chunk (width, n) has the columns one after the other, and update gives a vector of that size."""
        pieces = int(self.first[-1])

        def run(batch: pa.RecordBatch) -> np.ndarray:
            fs, root = pafs.FileSystem.from_uri(self.path)
            out = np.zeros(size)
            for p in batch["id"].to_pylist():
                f = int(np.searchsorted(self.first, p, "right")) - 1
                name, n = self.files[f]
                at = (p - int(self.first[f])) * self.piece
                with fs.open_input_file(f"{root}/{name}") as file:
                    file.seek(at * self.width * 8)
                    left = min(self.piece, n - at)
                    while left:
                        rows = min(self.chunk, left)
                        z = np.frombuffer(file.read(rows * self.width * 8)).reshape(rows, self.width)
                        out += update(np.ascontiguousarray(z.T))
                        left -= rows
            return out

        found = np.zeros(size)
        if pieces:
            for r in partial_sums(spark.range(0, pieces, 1, min(pieces, max(64, 4 * spark.sparkContext.defaultParallelism))), run).collect():
                found[r.i] = r.v
        return found


def write_rows(df: DataFrame, *columns: Column) -> RowFiles:
    """The columns of df as doubles, in files; rows with a null are left out."""
    path, width = folder(df.sparkSession, "rows"), len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        name, n = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                z = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                out.write(np.ascontiguousarray(z.T).tobytes())
                n += len(z.T)
        yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], ["file", "n"])

    rows = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    rows = rows.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in rows.columns)))
    files = saved(rows.mapInArrow(run, "file string, n long"), "files").where("n > 0").collect()
    return RowFiles(path, width, sorted((r.file, r.n) for r in files))
