"""Writing results: overwrite, several outputs of one job, backup copy, append of finished work."""

from __future__ import annotations

import contextlib
import io
import logging
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.sources.tables import scratch_path, stored

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Output:
    """One table to write: what, what it is called, and where it goes."""

    df: DataFrame
    description: str
    path: str

    @classmethod
    def from_dict(cls, spec: dict) -> "Output":
        if set(spec) != {"df", "description", "path"}:
            raise ValueError(f"an output needs exactly df, description and path, not {sorted(spec)}")
        return cls(**spec)


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_outputs(outputs: Iterable[Output | dict], plan_dir: str | None = None,
                  show_samples: bool = False, backup_root: str | None = None, side_by_side: int = 4) -> list[str]:
    """Write each output; on request dump its plan, log a sample and copy the written table.

    Outputs don't depend on each other, so a few are submitted side by side and fill each other's gaps. All are checked before the first
    is written; an output that fails stops the call once those that run have ended.
    """
    ready = [spec if isinstance(spec, Output) else Output.from_dict(spec) for spec in outputs]

    for out in ready if plan_dir else ():
        explain_to_file(out.df, plan_dir, out.description)

    def write(out: Output) -> str:
        write_table(out.df, out.path)
        table = out.df.sparkSession.read.parquet(out.path)
        if show_samples:
            log_sample(table, out.description)
        if backup_root:
            backup_table(out.df.sparkSession, out.path, backup_path(out.path, backup_root))
        return out.path

    with ThreadPoolExecutor(side_by_side) as pool:
        return list(pool.map(write, ready))


def backup_path(path: str, backup_root: str) -> str:
    return f"{backup_root.rstrip('/')}/{path.rstrip('/').rsplit('/', 1)[-1]}"


def backup_table(spark: SparkSession, path: str, target: str) -> None:
    """Replace the copy at ``target`` (any URI Spark can write) by the table at ``path``."""
    write_table(spark.read.parquet(path), target)


def log_sample(df: DataFrame, description: str = "", rows: int = 10, shown: int = 5) -> list:
    """Log column types and the first rows; one job, ``rows`` rows on the driver."""
    sample = df.limit(rows).collect()
    log.info("%s\ntypes: %s\nrows: %s", description, df.dtypes, sample[:shown])
    return sample


def explain_text(df: DataFrame, mode: str = "extended") -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode=mode)
    return text.getvalue()


def explain_to_file(df: DataFrame, folder: str, description: str, stamp: str = "general") -> str:
    """Parsed, analysed, optimised and physical plan of ``df`` as a text file of the driver."""
    path = f"{folder.rstrip('/')}/plan_{description}.{stamp}.txt"
    with open(path, "w", encoding="utf-8") as f:
        f.write(explain_text(df))
    return path


def append_pending(work: DataFrame, keys: list[str], path: str,
                   evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Evaluate only the work whose ``keys`` have no result below ``path`` yet, and keep the result.

    Results are rows of one table with a column ``batch``, and ``run_time`` is added to each. A batch counts once its id is in
    the table of commits, which is written after it; a job lost half-way leaves nothing that counts, and the next call
    takes up its work. Nothing is written when nothing is pending.
    """
    spark, root = work.sparkSession, path.rstrip("/")
    results, commits = f"{root}/results", f"{root}/commits"
    committed = stored(spark, commits, "batch string")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.select(*keys).schema.fields)
    done = stored(spark, results, f"{schema}, batch string").join(committed, "batch", "left_semi").select(*keys).distinct()
    # The pending work is written once: what decides whether there is any, and what is evaluated, is read from there.
    pending = work.join(done, keys, "left_anti")
    todo = scratch_path(spark, "pending")
    pending.write.parquet(todo)
    pending = spark.read.schema(work.schema).parquet(todo)
    if pending.isEmpty():
        if committed.isEmpty():
            return evaluate(pending).withColumn("run_time", F.current_timestamp())
    else:
        batch = uuid.uuid4().hex
        (evaluate(pending).withColumns({"run_time": F.current_timestamp(), "batch": F.lit(batch)})
         .write.mode("append").partitionBy("batch").parquet(results))
        spark.createDataFrame([(batch,)], "batch string").write.mode("append").parquet(commits)
    return spark.read.parquet(results).join(stored(spark, commits, "batch string"), "batch", "left_semi").drop("batch")
