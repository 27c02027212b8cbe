"""Embedding the queue of texts with an injected model, and guarding queries against a model that fails.

The model is any callable from a list of texts to a list of vectors. It says what went wrong by the exception it
raises: ``Unavailable`` (try again later), ``TooLong`` (of one text), anything else is a refusal of the batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 16
LEAST_CHARS = 64
RETRIES = 4
COOLDOWN, TIMEOUTS = 30.0, 2

Model = Callable[[list[str]], list[list[float]]]


class Unavailable(Exception):
    """The model can't be reached, or is overloaded."""


class TooLong(Exception):
    """A text is longer than the model takes."""


def patiently(model: Model, texts: list[str], wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Asks up to four times, waiting twice as long each time, as long as the model is unavailable."""
    for n in range(RETRIES):
        try:
            return model(texts)
        except Unavailable:
            if n == RETRIES - 1:
                raise
            sleep(wait * 2**n)
    return []


def shortened(model: Model, text: str, **kw) -> list[float]:
    """One text, halved until the model takes it, to no less than 64 characters."""
    while True:
        try:
            return patiently(model, [text], **kw)[0]
        except TooLong:
            if len(text) // 2 < LEAST_CHARS:
                raise
            text = text[: len(text) // 2]


def embed_batch(model: Model, texts: list[str], **kw) -> list[tuple[list[float] | None, str | None, bool]]:
    """(vector, error, counts as an attempt) of each text. A refused batch is tried text by text; if the model goes away, the rest doesn't count."""
    try:
        got = patiently(model, texts, **kw)
        if len(got) == len(texts):
            return [(list(map(float, v)), None, True) for v in got]
    except Unavailable as e:
        return [(None, f"unavailable: {e}", False)] * len(texts)
    except Exception:  # noqa: BLE001, S110
        pass
    out: list[tuple[list[float] | None, str | None, bool]] = []
    for t in texts:
        try:
            out.append((list(map(float, shortened(model, t, **kw))), None, True))
        except Unavailable as e:
            return out + [(None, f"unavailable: {e}", False)] * (len(texts) - len(out))
        except Exception as e:  # noqa: BLE001
            out.append((None, f"{type(e).__name__}: {e}"[:300], True))
    return out


def embed(queue: DataFrame, model: Model, batch: int = BATCH) -> DataFrame:
    """(hash, window) -> (hash, embedding, last_error, counted), each distinct text once, in batches per partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                got = embed_batch(model, list(part["window"]))
                yield pd.DataFrame({"hash": part["hash"], "embedding": [x[0] for x in got], "last_error": [x[1] for x in got], "counted": [x[2] for x in got]})

    return queue.select("hash", "window").dropDuplicates(["hash"]).mapInPandas(run, "hash string, embedding array<float>, last_error string, counted boolean")


def absorb(vectors: DataFrame, done: DataFrame, now: F.Column) -> DataFrame:
    """The next snapshot of (hash, embedding, attempts, embedded_at, last_error): attempts go up for what was tried, a vector clears the error."""
    new = done.select("hash", F.col("embedding").alias("_e"), F.col("last_error").alias("_x"), F.col("counted").alias("_c"))
    j = vectors.join(new, "hash", "full")
    got = F.col("_e").isNotNull()
    return j.select(
        "hash", F.coalesce("_e", "embedding").alias("embedding"), F.coalesce(F.coalesce("attempts", F.lit(0)) + F.when(F.col("_c"), 1).otherwise(0), F.lit(0)).alias("attempts"),
        F.when(got, now).otherwise(F.col("embedded_at")).alias("embedded_at"), F.when(got, None).otherwise(F.coalesce("_x", "last_error")).alias("last_error"),
    )


class Breaker:
    """Stands before the model of queries: a refusal or two timeouts in a row open it for half a minute, and searches go by text alone."""

    def __init__(self, model: Model, clock: Callable[[], float] = time.monotonic):
        self.model, self.clock = model, clock
        self.timeouts, self.open_until = 0, float("-inf")

    def __call__(self, text: str) -> list[float] | None:
        """The query's vector, or None while the model is out."""
        if self.clock() < self.open_until:
            return None
        try:
            v = self.model([text])[0]
        except TimeoutError:
            self.timeouts += 1
            if self.timeouts >= TIMEOUTS:
                self._trip()
            return None
        except Exception:  # noqa: BLE001
            self._trip()
            return None
        self.timeouts = 0
        return v

    def _trip(self) -> None:
        self.open_until, self.timeouts = self.clock() + COOLDOWN, 0
