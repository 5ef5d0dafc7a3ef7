"""Prompt rendering for unmatched queries and a pluggable completion hook."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two prompt templates of the service ({text} = issue body).
SUMMARY_TEMPLATE = ("Please analyze the following GitHub issue body and provide a detailed summary of "
                    "the problem. Please note that we are only looking for a summary and not a solution "
                    "or any additional information. Thank you. ONLY SUMMARY.\n\nIssue Body: {text}\n\n")
SOLUTION_TEMPLATE = ("What is a possible solution to the following GitHub issue? Please provide a very "
                     "detailed and instructive solution, or if there are no questions to answer in the "
                     "issue, suggest some potential solutions or explain why a solution may not be "
                     "feasible. If you are unsure, please provide any insights or suggestions that may be "
                     "helpful in resolving the issue. Thank you for your contribution!.\n\n Github "
                     "Issue:{text}\n\n")


def _render(template: str, text: Column) -> Column:
    before, after = template.split("{text}")
    return F.concat(F.lit(before), F.coalesce(text, F.lit("")), F.lit(after))


def summary_prompt(text: Column) -> Column:
    return _render(SUMMARY_TEMPLATE, text)


def solution_prompt(text: Column) -> Column:
    return _render(SOLUTION_TEMPLATE, text)


Client = Callable[[list[str]], list[str | None]]


def _call(client: Client, texts: list[str]) -> list[str | None]:
    replies = list(client(texts))
    if len(replies) != len(texts):
        raise ValueError(f"{len(replies)} replies to {len(texts)} prompts")
    return replies


def _ask(client: Client, texts: list[str], attempts: int, pause: float) -> list[tuple[str | None, str | None, int]]:
    """(reply, error, calls) per prompt: one call for all of them; if it fails, each prompt
    has the calls that are left to itself, so a prompt fails for no other one."""
    try:
        return [(r, None, 1) for r in _call(client, texts)]
    except Exception as e:  # noqa: BLE001  whatever the client raises becomes data
        first = e
    out = []
    for text in texts:
        reply, error, calls = None, first, 1
        while calls < attempts:
            time.sleep(pause * 2 ** (calls - 1))
            calls += 1
            try:
                reply, error = _call(client, [text])[0], None
                break
            except Exception as e:  # noqa: BLE001
                error = e
        out.append((reply, None if error is None else f"{type(error).__name__}: {error}", calls))
    return out


def complete(prompts: DataFrame, client_factory: Callable[[], Client], prompt_col: str = "prompt", *,
             batch_size: int = 32, attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """Batch completion with a pluggable client: all columns plus ``reply`` (stripped),
    ``error`` (of the last call; null if there is a reply) and ``calls``.

    ``client_factory`` runs once per task and returns a function from a list of prompts to
    as many replies; a reply of None stays null, without an error.  A call that raises is
    made again, prompt by prompt, up to ``attempts`` calls for a prompt with doubling pauses
    of ``pause`` seconds; what still fails is a row with an error, never a failed job.
    Prompts stay in their partitions, so the partitions bound the calls at one time.  A null
    prompt is asked as an empty one; columns of the input with these names are replaced.
    """
    from ..session import ship_package
    ship_package(prompts.sparkSession)  # workers import this module
    added = [T.StructField("reply", T.StringType()), T.StructField("error", T.StringType()),
             T.StructField("calls", T.IntegerType())]
    names = [f.name for f in added]
    d = prompts.select(F.struct(*[F.col(f"`{c}`") for c in prompts.columns]).alias("row"),
                       F.coalesce(F.col(f"`{prompt_col}`"), F.lit("")).alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = client_factory()
        for batch in batches:
            texts, found = batch.column("prompt"), []
            for i in range(0, len(texts), batch_size):  # one call's texts at a time
                found += _ask(client, texts.slice(i, batch_size).to_pylist(), attempts, pause)
            replies = [None if r is None else str(r).strip() for r, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(replies, pa.string()), pa.array([e for _, e, _ in found], pa.string()),
                 pa.array([n for _, _, n in found], pa.int32())], ["row", *names])

    out = d.mapInArrow(run, T.StructType([d.schema["row"], *added]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in prompts.columns if c not in names], *names)


def completion_activity(completed: DataFrame, endpoint: str, done: str) -> DataFrame:
    """Activity rows of completions: 200 with the description ``done``, or 502 with the
    client's error."""
    ok = F.col("error").isNull()
    return completed.select("*", F.lit("POST").alias("request_type"), F.lit(endpoint).alias("api_endpoint"),
                            F.when(ok, 200).otherwise(502).alias("response_code"),
                            F.when(ok, F.lit(done)).otherwise(F.col("error")).alias("description"))
