"""Answers of a model service, asked with retries; the service is a function, so recorded outputs stand in for it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ask(prompts: DataFrame, service: Callable[[int, str, int], str], tries: int = 5, pause: float = 0.0) -> DataFrame:
    """(id, output, attempts): service(id, prompt, attempt) may raise; the wait doubles after each failure, and what fails at last is an error text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, prompt in zip(pdf["id"], pdf["prompt"], strict=True):
                for attempt in range(1, tries + 1):
                    try:
                        rows.append((key, service(key, prompt, attempt), attempt))
                        break
                    except ConnectionError as e:
                        if attempt == tries:
                            rows.append((key, f"ERROR: {e}", attempt))
                        elif pause:
                            time.sleep(pause * 2**attempt)
            yield pd.DataFrame(rows, columns=["id", "output", "attempts"])

    return prompts.select("id", "prompt").mapInPandas(run, "id long, output string, attempts int")
