"""Batch generation through a user callable, with at most one recovery per prompt."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import constants as k
from lodestone.functions import replies
from lodestone.operators import answers
from lodestone.policies import ContextPolicy
from lodestone.session import stage

# provider(prompt, max_output_tokens) -> dict with text or error kind and optional facts.
Provider = Callable[[str, int], dict]

REPLY_SCHEMA = (
    "query_id {key}, reply string, finish_reason string, input_tokens bigint, output_tokens bigint, "
    "error_kind string, status_code int, retryable boolean, http_attempts int, elapsed_seconds double, "
    "max_output_tokens bigint"
)
FACTS = ("text", "finish_reason", "input_tokens", "output_tokens", "error_kind", "status_code", "retryable", "http_attempts")


def _ask(prompts: DataFrame, provider: Provider) -> DataFrame:
    """prompts(query_id, prompt, max_output_tokens) -> one reply or error row each."""
    schema = REPLY_SCHEMA.format(key=prompts.schema["query_id"].dataType.simpleString())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query_id, prompt, limit in zip(
                batch["query_id"], batch["prompt"], batch["max_output_tokens"], strict=True
            ):
                started = time.perf_counter()
                try:
                    reply = provider(prompt, int(limit))
                except Exception as error:  # the call failed; the row says how
                    reply = {"error_kind": type(error).__name__}
                facts = {name: reply.get(name) for name in FACTS}
                facts["reply"] = facts.pop("text")
                elapsed = round(time.perf_counter() - started, 4)
                rows.append(
                    {"query_id": query_id, **facts, "elapsed_seconds": elapsed, "max_output_tokens": int(limit)}
                )
            if rows:
                frame = pd.DataFrame(rows)
                for name in ("input_tokens", "output_tokens", "status_code", "http_attempts"):
                    frame[name] = frame[name].astype("Int64")
                yield frame[[f.split()[0] for f in schema.split(", ")]]

    return prompts.select("query_id", "prompt", "max_output_tokens").mapInPandas(run, schema)


def _judged(asked: DataFrame, call_type: str) -> DataFrame:
    """Adds rule, failure_category, recovery and larger_output to raw replies."""
    parse = replies.parse_reply if call_type == "generation" else replies.parse_verdict
    rule = parse(F.col("reply"))["rule"]
    failed = F.col("error_kind").isNotNull()
    category = F.when(
        failed,
        answers.provider_failure_category(
            F.col("error_kind"), F.coalesce("retryable", F.lit(False))
        ),
    ).when(
        F.col("rule").isNotNull(),
        replies.unusable_category(F.col("finish_reason"), replies.is_cut_off(F.col("reply"))),
    )
    ruled = asked.withColumn("rule", F.when(~failed, rule))
    return answers.failure_policy(ruled.withColumn("category", category))


def generate(
    prompts: DataFrame,
    provider: Provider,
    model: str,
    call_type: str = "generation",
    policy: ContextPolicy = ContextPolicy(),
) -> tuple[DataFrame, DataFrame]:
    """prompts(query_id, prompt) -> (replies, calls).

    Recoverable failures are asked a second time, truncated ones with the larger
    limit. Each pass is written to the shared folder: a provider must not be called
    again because a task is recomputed later.
    """
    first_prompts = prompts.withColumn("max_output_tokens", F.lit(policy.output_reserve_tokens))
    first = stage(_judged(_ask(first_prompts, provider), call_type), f"{call_type}-1")
    again = first.filter(F.col("recovery")).select(
        "query_id",
        F.when(F.col("larger_output"), policy.recovery_output_tokens)
        .otherwise(policy.output_reserve_tokens)
        .alias("max_output_tokens"),
    )
    second_prompts = prompts.select("query_id", "prompt").join(again, "query_id")
    second = stage(_judged(_ask(second_prompts, provider), call_type), f"{call_type}-2")
    final = first.join(second.select("query_id"), "query_id", "left_anti").unionByName(second)
    calls = call_records(first, 1, model, call_type).unionByName(
        call_records(second, 2, model, call_type)
    )
    return final, calls


def call_records(judged: DataFrame, attempt: int, model: str, call_type: str) -> DataFrame:
    """One provider-call row per judged reply."""
    failed = F.col("error_kind").isNotNull()
    result: Column = (
        F.when(failed, "provider_error").when(F.col("rule").isNotNull(), "unusable_reply").otherwise("parsed")
    )
    return judged.select(
        "query_id",
        F.lit(call_type).alias("call_type"),
        F.lit(attempt).alias("attempt"),
        F.lit(model).alias("model"),
        F.lit("json_object").alias("response_format"),
        "elapsed_seconds",
        result.alias("result"),
        "max_output_tokens",
        "finish_reason",
        "input_tokens",
        "output_tokens",
        F.when(~failed, F.length("reply")).alias("reply_characters"),
        F.when(~failed, replies.visible_characters(F.col("reply"))).alias("reply_visible_characters"),
        F.col("category").alias("failure_category"),
        F.coalesce("rule", "error_kind").alias("failure_detail"),
        "status_code",
        "http_attempts",
    )


def truncated(calls: DataFrame) -> DataFrame:
    return calls.filter(F.col("finish_reason") == k.TRUNCATED_FINISH)
