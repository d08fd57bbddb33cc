"""What is computed outside the engine: embeddings, completions, tool calls.

A provider is a plain function on batches; these wrap one into an Arrow-
batched operator.  The offline ones are deterministic stand-ins, not models.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.operators.agent import FAILED

TIMEOUT = 10.0


def hashed_embedding(texts: list[str], size: int = 64) -> np.ndarray:
    """Unit vectors of signed word counts at places that a digest of the word gives."""
    out = np.zeros((len(texts), size), np.float32)
    for i, text in enumerate(texts):
        for word in (text or "").lower().split():
            d = hashlib.md5(word.encode()).digest()
            out[i, int.from_bytes(d[:4], "little") % size] += 1 if d[4] & 1 else -1
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1, length)


def embed(text: Column, provider: Callable[[list[str]], np.ndarray] = hashed_embedding) -> Column:
    """An array<float> column from a provider that takes a batch of texts."""
    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(provider(batch.fillna("").tolist()), np.float32)))
    return run(text)


def post_json(endpoint: str, arguments: dict, timeout: float = TIMEOUT):
    """POST arguments; the response as JSON if it is, else as text."""
    import urllib.request

    request = urllib.request.Request(endpoint, json.dumps(arguments).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        body = response.read().decode()
    try:
        return json.loads(body)
    except ValueError:
        return body


class Retrying:
    """A provider that tries again, spares one that is down, and keeps to a rate; one of its own in each worker.

    Errors in `again` (timeouts, and HTTP 5xx and 429) are tried `attempts`
    times, after `pause` seconds doubled each time and a random share of it.
    After `trip` failures in a row an endpoint is left alone for `rest`
    seconds: its calls fail at once.  `rate` is the most calls a second to an
    endpoint from this worker; a cluster's rate is that times its workers.
    """

    def __init__(self, provider: Callable[[str, dict], object], attempts: int = 3, pause: float = 0.2, trip: int = 5, rest: float = 30.0, rate: float | None = None, clock=time.monotonic, sleep=time.sleep):
        self.provider, self.attempts, self.pause, self.trip, self.rest, self.rate, self.clock, self.sleep = provider, attempts, pause, trip, rest, rate, clock, sleep
        self.failures: dict[str, int] = {}
        self.until: dict[str, float] = {}
        self.free: dict[str, float] = {}

    @staticmethod
    def again(error: Exception) -> bool:
        code = getattr(error, "code", None)
        return code == 429 or code >= 500 if isinstance(code, int) else isinstance(error, OSError)

    def __call__(self, endpoint: str, arguments: dict) -> object:
        if self.clock() < self.until.get(endpoint, 0):
            raise RuntimeError("left alone after failures")
        for n in range(self.attempts):
            if self.rate:
                now = self.clock()
                at = max(now, self.free.get(endpoint, 0))
                self.free[endpoint] = at + 1 / self.rate
                if at > now:
                    self.sleep(at - now)
            try:
                got = self.provider(endpoint, arguments)
            except Exception as e:
                self.failures[endpoint] = self.failures.get(endpoint, 0) + 1
                if self.failures[endpoint] >= self.trip:
                    self.until[endpoint] = self.clock() + self.rest
                    self.failures[endpoint] = 0
                    raise
                if n + 1 == self.attempts or not self.again(e):
                    raise
                self.sleep(self.pause * 2**n * (1 + random.random()))
            else:
                self.failures[endpoint] = 0
                return got
        raise ValueError("attempts is at least 1")


def execute_calls(calls: DataFrame, provider: Callable[[str, dict], object] = post_json) -> DataFrame:
    """calls (tool_name, endpoint_url, arguments as JSON, ...) with `result` and `failed`; errors become values.

    Malformed arguments are an error of their row.  A retried task calls again,
    so providers should be idempotent (see operators.agent.ledger).
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            results = []
            for name, endpoint, arguments in zip(b["tool_name"], b["endpoint_url"], b["arguments"], strict=True):
                try:
                    got = provider(endpoint, json.loads(arguments))
                    results.append(got if isinstance(got, str) else json.dumps(got))
                except Exception as e:  # noqa: BLE001  whatever a provider raises is the call's result
                    results.append(f"{FAILED} '{name}': {e}")
            yield b.assign(result=results, failed=[r.startswith(FAILED) for r in results])
    kind = ", ".join(f"`{n}` {t}" for n, t in calls.dtypes)
    return calls.mapInPandas(run, f"{kind}, result string, failed boolean")


def complete(prompts: DataFrame, transcript: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Completions from a recorded transcript (key, completion, stop_reason), null where it has none."""
    return prompts.join(transcript, key, "left")
