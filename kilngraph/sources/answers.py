"""Content-addressed model answers: every distinct prompt is asked once, also across failed and repeated runs.

The key of an answer is the SHA-256 of the call's options and the prompt.  Prompts whose key has an answer are anti-joined
away; the others are dealt to tasks by key and asked in calls that fit a token budget.  A task writes the answers of each
call as one file before it makes the next call, under a name that follows from the keys in it: an attempt that repeats the
task, or a run that follows a failed one, finds the file and does not ask again.  Whatever reads answers reads the files.

A call that fails is tried again, then halved, so that one bad prompt does not take others with it; a prompt that fails
alone goes to the table of failed prompts and is asked again by the next run.

Defined cases: a blank or null prompt gets an empty answer without a call; a prompt that failed has a null answer; rows
that share a prompt share its answer; a model that returns another number of answers than it got prompts has failed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilngraph.functions.text import strip
from kilngraph.operators.linking import bounded

Generator = Callable[[list[str], int], list[str]]

#: Tokens and prompts of one call at most (a longer prompt is a call of its own), and how often a call is tried.
CALL_TOKENS, CALL_PROMPTS, ATTEMPTS = 65_536, 64, 2
#: Bytes of UTF-8 that count as a token when calls are filled.
TOKEN_BYTES = 3
ANSWERS, FAILED = "key string, response string", "key string, prompt string, error string"


def key_of(prompt: Column, options: dict[str, Any]) -> Column:
    """The key of a prompt under ``options``."""
    return F.sha2(F.concat(F.lit(json.dumps(options, sort_keys=True) + "\u0000"), prompt), 256)


def calls(rows: Iterator[tuple[str, str]], most_tokens: int, most_prompts: int) -> Iterator[list[tuple[str, str]]]:
    """Runs of (key, prompt) that fit one call."""
    call, tokens = [], 0
    for key, prompt in rows:
        size = len(prompt.encode()) // TOKEN_BYTES + 1
        if call and (tokens + size > most_tokens or len(call) >= most_prompts):
            yield call
            call, tokens = [], 0
        call.append((key, prompt))
        tokens += size
    if call:
        yield call


def _tried(generator: Generator, call: list[tuple[str, str]], max_tokens: int, attempts: int) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """(answers, failures) of one call; a call that fails for good is halved."""
    error = ""
    for _ in range(attempts):
        try:
            found = generator([p for _, p in call], max_tokens)
            if len(found) == len(call):
                return [(key, "" if text is None else str(text)) for (key, _), text in zip(call, found, strict=True)], []
            error = f"{len(found)} answers to {len(call)} prompts"
        except Exception as broken:  # noqa: BLE001  whatever a model does, the job goes on
            error = f"{type(broken).__name__}: {broken}"[:500]
    if len(call) == 1:
        return [], [(*call[0], error)]
    half = len(call) // 2
    first, second = _tried(generator, call[:half], max_tokens, attempts), _tried(generator, call[half:], max_tokens, attempts)
    return first[0] + second[0], first[1] + second[1]


def _put(folder: str, name: str, columns: dict[str, list[str]]) -> None:
    """Write a small Parquet file; it has its name only once it is whole."""
    system, inner = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)
    unready = f"{inner}/.{name}-{uuid.uuid4().hex}"
    pq.write_table(pa.table(columns), unready, filesystem=system)
    system.move(unready, f"{inner}/{name}")


def _there(path: str) -> bool:
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return system.get_file_info(inner).type == pyarrow.fs.FileType.File


@dataclass
class AnswerStore:
    """Answers below ``root``, a folder that driver and executors share; ``options`` are part of every key (model, temperature)."""

    spark: SparkSession
    root: str
    options: dict[str, Any] = field(default_factory=dict)
    call_tokens: int = CALL_TOKENS
    call_prompts: int = CALL_PROMPTS
    attempts: int = ATTEMPTS

    def _folder(self, kind: str, max_tokens: int) -> str:
        digest = hashlib.sha256(json.dumps(self._all(max_tokens), sort_keys=True).encode()).hexdigest()[:16]
        return f"{self.root.rstrip('/')}/{kind}/{digest}"

    def _all(self, max_tokens: int) -> dict[str, Any]:
        return {**self.options, "max_tokens": max_tokens}

    def _read(self, kind: str, schema: str, max_tokens: int) -> DataFrame:
        path = self._folder(kind, max_tokens)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)

    def answers(self, max_tokens: int) -> DataFrame:
        """key, response of everything answered under these options."""
        return self._read("answers", ANSWERS, max_tokens)

    def failed(self, max_tokens: int) -> DataFrame:
        """key, prompt, error of prompts that the last run to ask them got no answer for."""
        return self._read("failed", FAILED, max_tokens).join(self.answers(max_tokens), "key", "left_anti").dropDuplicates(["key"])

    def ask(self, rows: DataFrame, generator: Generator, max_tokens: int, prompt_col: str = "prompt", out_col: str = "response") -> DataFrame:
        """``rows`` with ``out_col``; only prompts without an answer are sent to the model, each once."""
        prompt = F.when(strip(F.coalesce(F.col(prompt_col), F.lit(""))) != "", F.col(prompt_col))
        key = key_of(prompt, self._all(max_tokens))
        open_ = rows.select(key.alias("key"), prompt.alias("prompt")).where("key is not null").dropDuplicates(["key"])
        open_ = open_.join(self.answers(max_tokens).select("key"), "key", "left_anti")
        # Dealt and sorted by key, so a repeated task makes the same calls again and finds their files.
        dealt = open_.repartition("key").sortWithinPartitions("key")
        done = dealt.mapInArrow(self._caller(generator, max_tokens), "asked long, failed long").agg(F.sum("asked"), F.sum("failed")).first()
        self.asked, self.lost = done[0] or 0, done[1] or 0
        found = bounded(self.answers(max_tokens).dropDuplicates(["key"]).select(F.col("key").alias("__key"), F.col("response").alias("__response")))
        out = rows.withColumn("__mine", key).join(found, F.col("__mine") == F.col("__key"), "left")
        return out.withColumn(out_col, F.when(F.col("__mine").isNull(), F.lit("")).otherwise(F.col("__response"))).drop("__mine", "__key", "__response")

    def _caller(self, generator: Generator, max_tokens: int):
        answers, failed = self._folder("answers", max_tokens), self._folder("failed", max_tokens)
        most_tokens, most_prompts, attempts = self.call_tokens, self.call_prompts, self.attempts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (pair for batch in batches for pair in zip(batch.column("key").to_pylist(), batch.column("prompt").to_pylist(), strict=True))
            asked = lost = 0
            for call in calls(rows, most_tokens, most_prompts):
                name = hashlib.sha256("".join(k for k, _ in call).encode()).hexdigest() + ".parquet"
                if _there(f"{answers}/{name}"):
                    continue
                good, bad = _tried(generator, call, max_tokens, attempts)
                if bad:
                    _put(failed, name, dict(zip(("key", "prompt", "error"), map(list, zip(*bad, strict=True)), strict=True)))
                if good:
                    _put(answers, name, dict(zip(("key", "response"), map(list, zip(*good, strict=True)), strict=True)))
                asked, lost = asked + len(call), lost + len(bad)
            yield pa.RecordBatch.from_pydict({"asked": pa.array([asked], pa.int64()), "failed": pa.array([lost], pa.int64())})

        return run

    def compact(self, max_tokens: int, files: int = 1) -> None:
        """Rewrite the answers as ``files`` files; to be run while nothing asks."""
        path = self._folder("answers", max_tokens)
        old, fresh = self.answers(max_tokens).dropDuplicates(["key"]), f"{path}-{uuid.uuid4().hex}"
        old.repartition(files).write.parquet(fresh)
        jvm = self.spark._jvm.org.apache.hadoop.fs
        system = jvm.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.delete(jvm.Path(path), True)
        system.rename(jvm.Path(fresh), jvm.Path(path))
