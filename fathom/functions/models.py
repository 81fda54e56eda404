"""Pluggable model interfaces with deterministic offline implementations, and wrappers for flaky calls.

The offline implementations are rules, not models: they make pipelines run and tests repeatable, and say
nothing of a model's quality.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.text import tokens


class Generator(Protocol):
    def generate(self, prompt: str) -> str: ...


class Embedder(Protocol):
    def vector(self, text: Column) -> Column: ...


class PairScorer(Protocol):
    def score(self, query: Column, text: Column) -> Column: ...


class HashedEmbedder:
    """Signed feature hashing of lower-case words into `dims` numbers, as one expression (md5, so that SQL can repeat it)."""

    def __init__(self, dims: int = 16):
        self.dims = dims

    def vector(self, text: Column) -> Column:
        hashes = F.transform(tokens(text), lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long"))
        sign = lambda h: F.when(F.floor(h / self.dims) % 2 == 0, 1.0).otherwise(-1.0)
        one = lambda d: F.aggregate(F.filter(hashes, lambda h: h % self.dims == d), F.lit(0.0), lambda s, h: s + sign(h))
        return F.array(*[one(d) for d in range(self.dims)])


class OverlapScorer:
    """Share of the query's distinct words that a text has."""

    def score(self, query: Column, text: Column) -> Column:
        q = F.array_distinct(tokens(query))
        return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


class EchoGenerator:
    """Answers with the prompt's last line."""

    def generate(self, prompt: str) -> str:
        return prompt.strip().rsplit("\n", 1)[-1]


GENERATORS: dict[str, Callable[[], Generator]] = {"echo": EchoGenerator}


def generated(prompt: Column, provider: str = "echo") -> Column:
    """The provider's answer to each prompt; the generator is made once per worker batch stream."""
    if provider not in GENERATORS:
        raise ValueError(f"unknown provider {provider}")
    make = GENERATORS[provider]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for prompts in batches:
            yield prompts.map(lambda p: None if p is None else model.generate(p))

    return run(prompt)


@dataclass
class Retry:
    """Calls again after ConnectionError, waiting 0.2, 0.4, ... seconds (2 at most), five attempts in all."""

    attempts: int = 5
    first_wait: float = 0.2
    most_wait: float = 2.0
    sleep: Callable[[float], None] = time.sleep
    made: int = 0

    def __call__(self, call: Callable[[], object]) -> object:
        for n in range(self.attempts):
            self.made = n + 1
            try:
                return call()
            except ConnectionError:
                if n + 1 == self.attempts:
                    raise
                self.sleep(min(self.most_wait, self.first_wait * 2**n))
        raise AssertionError("no attempts")


class BreakerOpenError(RuntimeError):
    """The circuit is open: the call was not made, or was the one that opened it."""


@dataclass
class Breaker:
    """Opens after `fail_max` failures in a row; lets one call through after `reset_s` seconds."""

    fail_max: int = 3
    reset_s: float = 2.0
    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    opened: float | None = None

    def __call__(self, call: Callable[[], object]) -> object:
        if self.opened is not None and self.clock() - self.opened < self.reset_s:
            raise BreakerOpenError("open")
        try:
            out = call()
        except Exception as e:
            self.failures += 1
            if self.failures >= self.fail_max or self.opened is not None:
                self.opened = self.clock()
                raise BreakerOpenError("opened") from e
            raise
        self.failures, self.opened = 0, None
        return out


@dataclass
class ToolLoop:
    """An agent's bounded loop: policy(question, trace) names a tool or answers (None, answer)."""

    tools: dict[str, Callable[[str], str]]
    policy: Callable[[str, list[dict]], tuple[str | None, str]]
    most: int = 6
    trace: list[dict] = field(default_factory=list)

    def run(self, question: str) -> dict:
        self.trace = []
        for _ in range(self.most):
            tool, value = self.policy(question, self.trace)
            if tool is None:
                return {"trace": self.trace, "answer": value, "status": "answered"}
            result = self.tools[tool](value) if tool in self.tools else f"unknown tool {tool}"
            self.trace.append({"tool": tool, "input": value, "result_preview": re.sub(r"\s+", " ", result)[:200]})
        return {"trace": self.trace, "answer": "", "status": "iteration cap"}
