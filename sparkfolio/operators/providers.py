"""Provider calls: a chain with failover, guarded by cooldowns and a retry budget; and its relational part."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, MapType, StringType, StructField, StructType


@dataclass(frozen=True)
class RetryPolicy:
    attempts: int = 3
    base_s: float = 1.0
    most_s: float = 20.0
    budget_s: float = 30.0


def waits(attempts: Column, policy: RetryPolicy = RetryPolicy()) -> Column:
    """The delays before each of ``attempts`` further attempts."""
    steps = F.when(attempts > 0, F.sequence(F.lit(0), attempts - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.least(F.lit(policy.base_s) * F.pow(F.lit(2.0), i), F.lit(policy.most_s)))


class GaveUp(RuntimeError):
    """All attempts failed; ``reason``: permanent, daily_quota, attempts or budget."""

    def __init__(self, reason: str, last: Exception):
        super().__init__(f"{reason}: {last}")
        self.reason = reason


def call_with_retry(call: Callable[[], str], classify: Callable[[Exception], tuple[str, float | None]], policy: RetryPolicy, sleep: Callable[[float], None], count: Callable[[], None] = lambda: None) -> str:
    """Call until it works: waits the longer of the backoff and what the provider asks for, within the budget."""
    waited = 0.0
    for attempt in range(policy.attempts + 1):
        count()
        try:
            return call()
        except Exception as error:  # noqa: BLE001 - any provider error is classified
            kind, asked = classify(error)
            if kind != "transient":
                raise GaveUp(kind, error) from error
            if attempt == policy.attempts:
                raise GaveUp("attempts", error) from error
            delay = max(min(policy.base_s * 2**attempt, policy.most_s), asked or 0.0)
            if waited + delay > policy.budget_s:
                raise GaveUp("budget", error) from error
            sleep(delay)
            waited += delay
    raise AssertionError("unreachable")


@dataclass(frozen=True)
class Reply:
    text: str | None
    provider: str | None
    calls: dict[str, int]
    errors: list[str]


@dataclass
class Chain:
    """Providers in order; one that ran out of its daily quota is skipped for a while."""

    providers: dict[str, Callable[[str], str]]
    classify: Callable[[Exception], tuple[str, float | None]]
    policy: RetryPolicy = RetryPolicy()
    cooldown_s: float = 3600.0
    marks: dict[str, float] = field(default_factory=dict)

    def ask(self, prompt: str, now: float, sleep: Callable[[float], None]) -> Reply:
        """The first answer, who gave it, how often each provider was called, and why others gave none."""
        calls: dict[str, int] = {}
        errors: list[str] = []
        for name, call in self.providers.items():
            if self.marks.get(name, float("-inf")) > now:
                errors.append(f"{name}: cooling")
                continue
            calls[name] = 0

            def count(name=name):
                calls[name] += 1

            try:
                return Reply(call_with_retry(lambda call=call: call(prompt), self.classify, self.policy, sleep, count), name, calls, errors)
            except GaveUp as error:
                errors.append(f"{name}: {error.reason}")
                if error.reason == "daily_quota":
                    self.marks[name] = now + self.cooldown_s
        return Reply(None, None, calls, errors)

    def answer(self, prompt: str, now: float, sleep: Callable[[float], None]) -> tuple[str | None, str | None]:
        """The first answer and who gave it; (None, None) if all fail: the caller then serves the evidence itself."""
        reply = self.ask(prompt, now, sleep)
        return reply.text, reply.provider


def generate(rows: DataFrame, make_chain: Callable[[], Chain], clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Adds mode, text, provider, failover, calls (by provider) and errors to ``rows`` (refused, prompt, evidence, ...).

    The chain is made once in every task, so its clients and cooldown marks live as long as the task; a
    provider without quota is asked again by other tasks, once each.  Refused rows call nobody; where all
    providers fail, the evidence is served as it is.  Calls are a column, not an accumulator: a task that runs again
    would be counted twice there.
    """

    def run(batches):
        chain = make_chain()
        for batch in batches:
            made = [None if refused else chain.ask(prompt, clock(), sleep) for refused, prompt in zip(batch["refused"], batch["prompt"], strict=True)]
            first = next(iter(chain.providers), None)
            yield batch.assign(
                mode=["refused" if m is None else "degraded" if m.text is None else "generated" for m in made],
                text=[None if m is None else e if m.text is None else m.text for m, e in zip(made, batch["evidence"], strict=True)],
                provider=[m.provider if m else None for m in made],
                failover=[bool(m and m.provider is not None and m.provider != first) for m in made],
                calls=[m.calls if m else {} for m in made],
                errors=[m.errors if m else [] for m in made],
            ).astype({"mode": object, "text": object, "provider": object})

    kept = rows.drop("mode", "text", "provider", "failover", "calls", "errors")
    extra = [("mode", StringType()), ("text", StringType()), ("provider", StringType()), ("failover", BooleanType()), ("calls", MapType(StringType(), IntegerType())), ("errors", ArrayType(StringType()))]
    return kept.mapInPandas(run, StructType([*kept.schema.fields, *[StructField(n, t) for n, t in extra]]))
