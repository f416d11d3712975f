"""Pluggable text generation. The library has no model; a deterministic stand-in serves tests.

A generator is a function over batches of ``(id, prompt)`` pandas frames that yields the
same frames with a ``response`` column, run by ``mapInPandas``. It is called once per
partition, so it can load a model once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.rubric import NAMES

Generator = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def mock(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sectioned answers with half-step scores fixed by prompt and sample number."""
    for pdf in batches:
        out = []
        for prompt, k in zip(pdf["prompt"], pdf["k"]):
            base = zlib.crc32(f"{k}/{prompt}".encode())
            scores = "\n".join(f"{n}: {1 + ((base >> (3 * i)) % 9) / 2}" for i, n in enumerate(NAMES))
            out.append(f"[EVIDENCE]\nstand-in\n\n[REASONING]\nSample {k} of {len(prompt)} characters.\n\n[SCORES]\n{scores}")
        yield pdf.assign(response=out)


def with_retry(one: Callable[[str], str], tries: int = 3, delay: float = 1.0, sleep: Callable[[float], None] | None = None, interval: float = 0.0, clock: Callable[[], float] | None = None) -> Generator:
    """A generator out of a single call: failures are retried after ``delay * 2 ** i``, then give an empty text.

    Calls of one task start at least ``interval`` seconds apart, so a job makes at most its number of tasks
    at a time divided by ``interval`` calls a second.
    """
    import time

    pause, now = sleep or time.sleep, clock or time.monotonic

    def run(batches):
        free = None  # when the next call may start
        for pdf in batches:
            out = []
            for prompt in pdf["prompt"]:
                text = ""
                for i in range(tries):
                    if free is not None and free > now():
                        pause(free - now())
                    free = now() + interval
                    try:
                        text = one(prompt)
                        break
                    except Exception:  # any failure of the service counts
                        if i < tries - 1:
                            pause(delay * 2**i)
                out.append(text)
            yield pdf.assign(response=out)

    return run


def generate(df: DataFrame, id_col: str, prompt_col: str, generator: Generator = mock, k: int = 1) -> DataFrame:
    """``(id, k, response)``: ``k`` responses for each prompt."""
    asked = df.select(F.col(id_col).cast("string").alias("id"), F.col(prompt_col).alias("prompt"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    return asked.mapInPandas(generator, "id string, prompt string, k int, response string").drop("prompt")
