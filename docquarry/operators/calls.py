"""Calls of a model that can be resumed: bounded and concurrent in each task, with timeout and attempts, and a log of answers by the digest of the prompt.

Equal prompts are asked once. Answers go to the log in waves, each a job of its own, so what a run that breaks has finished stays, and the next run asks only what has no answer yet. A prompt whose attempts were all in vain is a row with its error; the next run asks it again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources import commits
from . import capability

LOG = "digest string, answer string, ok boolean, attempts int, error string"


@dataclass(frozen=True)
class Client:
    """A model behind ``ask`` (a prompt to an answer; an exception or a null is a failed attempt). A prompt that does not fit the context beside the output is refused without a call. Waiting between attempts doubles from ``pause``."""

    ask: Callable[[str], str | None]
    timeout: float = 120.0
    attempts: int = 6
    parallel: int = 4
    pause: float = 0.5
    context_tokens: int = 8192
    output_tokens: int = 1024

    def one(self, prompt: str, pool: ThreadPoolExecutor) -> tuple[str | None, int, str | None]:
        """(answer, attempts made, error). A call that is late is given up; its thread ends by itself."""
        if len(prompt) > capability.input_budget(self.context_tokens, self.output_tokens):
            return None, 0, "too_long"
        error = None
        for n in range(1, self.attempts + 1):
            try:
                got = pool.submit(self.ask, prompt).result(self.timeout)
                if got is not None:
                    return got, n, None
                error = "empty"
            except Late:
                error = "timeout"
            except Exception as e:  # whatever a model fails with is that prompt's error
                error = type(e).__name__
            if n < self.attempts:
                time.sleep(self.pause * 2 ** (n - 1))
        return None, self.attempts, error


def log(spark: SparkSession, path: str) -> DataFrame:
    """The log in a folder; empty before the first run."""
    fs, p = commits.store(spark, path)
    return spark.read.schema(LOG).parquet(path) if fs.exists(p) else spark.createDataFrame([], LOG)


def answers(spark: SparkSession, path: str) -> DataFrame:
    """One row a digest: an answer where there is one, else the last failure told."""
    order = F.struct("ok", "attempts", "answer", "error")
    return log(spark, path).groupBy("digest").agg(F.max(order).alias("r")).select("digest", "r.answer", "r.ok", "r.attempts", "r.error")


def ask(prompts: DataFrame, client: Client, path: str, waves: int = 8) -> DataFrame:
    """Ask what has no answer in the log in ``path``, wave by wave, and give every row of prompts (column prompt) its answer, ok, attempts and error. A null prompt is not asked."""
    spark = prompts.sparkSession
    ship(spark)
    keyed = prompts.withColumn("digest", F.sha2(F.col("prompt"), 256))

    def run(batches):
        # Late calls keep their threads, so the pool for calls has room for all attempts of a batch.
        for b in batches:
            calls = ThreadPoolExecutor(client.parallel * client.attempts)
            with ThreadPoolExecutor(client.parallel) as rows:
                got = list(rows.map(lambda p: client.one(p, calls), b.column("prompt").to_pylist()))
            calls.shutdown(wait=False, cancel_futures=True)
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([g[0] for g in got], pa.string()), pa.array([g[0] is not None for g in got]), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())], ["digest", "answer", "ok", "attempts", "error"])

    for wave in range(waves):
        done = log(spark, path).where("ok").select("digest").distinct()
        mine = keyed.where(F.col("prompt").isNotNull() & (F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave)).dropDuplicates(["digest"]).select("digest", "prompt").join(done, "digest", "left_anti")
        mine.repartition("digest").mapInArrow(run, LOG).write.mode("append").parquet(path)
    found = answers(spark, path)
    return keyed.join(found, "digest", "left").withColumn("ok", F.coalesce("ok", F.lit(False))).drop("digest")
