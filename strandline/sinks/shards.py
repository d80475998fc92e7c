"""Parquet files with names and contents of our choosing, written inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Feature
from ..sources import stores

_NARROW = {"bool": pa.bool_(), "float16": pa.float32(), "float32": pa.float32(), "float64": pa.float64(), "string": pa.string()} | {f"{s}int{b}": getattr(pa, f"{s}int{b}")() for s in ("", "u") for b in (8, 16, 32, 64)}


def _declared(kind: pa.DataType, leaf: pa.DataType) -> pa.DataType:
    return pa.list_(_declared(kind.value_type, leaf)) if pa.types.is_list(kind) or pa.types.is_large_list(kind) else leaf


def arrow_schema(schema: pa.Schema, features: dict[str, Feature]) -> pa.Schema:
    """The Arrow schema with the declared leaf types, unsigned ones included."""
    return pa.schema([pa.field(f.name, _declared(f.type, _NARROW[features[f.name].dtype])) if f.name in features and features[f.name].dtype in _NARROW else f for f in schema])


def many_tasks(spark: SparkSession) -> int:
    """Tasks for work that files take, not bytes: small files in their thousands would else be one task's."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_files(frames: DataFrame, *, path: str, order: list[str], features: dict[str, Feature], drop: tuple[str, ...] = ("__path",), tasks: int | None = None) -> DataFrame:
    """Writes the rows of each value of ``__path`` to that file below ``path``, in order.

    ``__path`` decides the partition, so a file is one task's; it is written
    under a hidden name of the attempt and renamed when whole.  A failed attempt
    takes its unfinished file with it, and what a lost executor leaves is hidden
    from every reader.  Bytes decide how many tasks there are, unless ``tasks``
    does.  Returns (path, rows, bytes), a row for each file.
    """

    # names with dots cannot be named to a task's function, so columns travel by number
    columns = list(frames.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        fs, root = stores.filesystem(path)
        name, made, writer, out, rows, done = None, None, None, None, 0, []

        def close() -> None:
            nonlocal writer
            if writer is not None:
                writer.close()
                out.close()
                writer = None
                target = f"{root}/{name}"
                stores.commit(fs, made, target)
                done.append((name, rows, fs.get_file_info(target).size))

        try:
            for batch in (b.rename_columns(columns) for b in batches):
                if not batch.num_rows:
                    continue
                keep = [i for i, f in enumerate(batch.schema) if f.name not in drop]
                # where the path changes, by runs of the whole column
                runs = pc.run_end_encode(batch.column(batch.schema.get_field_index("__path")))
                begin = 0
                for own, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                    part = pa.Table.from_batches([batch.slice(begin, end - begin)]).select(keep)
                    part = part.cast(arrow_schema(part.schema, features))
                    if own != name:
                        close()
                        name, rows = own, 0
                        target = f"{root}/{own}"
                        fs.create_dir(target.rpartition("/")[0], recursive=True)
                        made = stores.attempt_of(target, attempt)
                        out = fs.open_output_stream(made)
                        writer = pq.ParquetWriter(out, part.schema)
                    writer.write_table(part)
                    rows += part.num_rows
                    begin = end
            close()
        except BaseException:
            if writer is not None:
                out.close()
                fs.delete_file(made)
            raise
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "rows", "bytes"])

    placed = (frames.repartition(tasks, "__path") if tasks else frames.repartition(F.col("__path"))).sortWithinPartitions("__path", *order)
    return placed.toDF(*(f"c{i}" for i in range(len(columns)))).mapInArrow(run, "path string, rows bigint, bytes bigint")
