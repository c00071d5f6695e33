"""Fitted programs on streams: a stateless projection with static joins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quern.operators import features


def apply_stream(stream: DataFrame, programs: dict[str, dict], types: dict[str, str], fitted: features.Fitted, keep: list[str]) -> DataFrame:
    """``features.apply`` on a streaming frame; statistics stay those of the batch fit."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return features.apply(stream, programs, types, fitted, keep)
