"""Pluggable embedding and summary providers, called in batches inside tasks."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import strip, truncated

Embed = Callable[[list[str]], Sequence[Sequence[float]]]


def with_retries(call: Callable, *, retries: int = 5, base_s: float = 2.0, wait_s: Callable[[Exception], float | None] = lambda e: None) -> Callable:
    """``call`` tried again after exponential delays with jitter, or after the wait that an error itself asks for."""

    def run(*args):
        for n in range(retries + 1):
            try:
                return call(*args)
            except Exception as e:
                if n == retries:
                    raise
                asked = wait_s(e)
                time.sleep(asked + 0.5 if asked is not None else base_s * 2**n + random.random() * base_s)

    return run


def _in_batches(rows: DataFrame, text: str, out: str, kind: str, provider: Callable, fill: Callable, batch: int, pause_s: float, retries: int, base_s: float, wait_s: Callable[[Exception], float | None], failed: str | None = None) -> DataFrame:
    """``rows`` with what a provider, made once a task, gives for each text; calls of up to ``batch`` texts, with retries.

    A call that fails for good fails the job, or gives ``failed`` for each of its texts.
    """

    def answers(call: Callable, texts: list) -> Sequence:
        try:
            return call(texts)
        except Exception:
            if failed is None:
                raise
            return [failed] * len(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for b in batches:
            call = call or with_retries(provider(), retries=retries, base_s=base_s, wait_s=wait_s)
            texts, values = [fill(t) for t in b[text]], []
            for s in range(0, len(texts), batch):
                got = answers(call, texts[s : s + batch])
                if len(got) != len(texts[s : s + batch]):
                    raise ValueError("a provider gave another number of results than texts")
                values += got
                if pause_s:
                    time.sleep(pause_s)
            yield b.assign(**{out: [list(map(float, v)) for v in values] if kind == "array<float>" else [str(v) for v in values]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != out)
    return rows.drop(out).mapInPandas(run, f"{schema}, `{out}` {kind}")


def embed(rows: DataFrame, text: str, out: str, provider: Callable[[], Embed], *, batch: int = 50, pause_s: float = 0.0, retries: int = 5, base_s: float = 2.0, wait_s: Callable[[Exception], float | None] = lambda e: None) -> DataFrame:
    """``rows`` with a vector for each text. ``provider`` is made once a task and called with up to ``batch`` texts.

    Null and blank texts are embedded as one blank. The provider must give one vector a text, in order. A call that fails is
    tried again, after the wait that the error asks for or an exponential delay.
    """
    fill = lambda t: t if isinstance(t, str) and t.strip() else " "
    return _in_batches(rows, text, out, "array<float>", provider, fill, batch, pause_s, retries, base_s, wait_s)


def embed_query(text: str, provider: Callable[[], Embed]) -> list[float]:
    """The vector of a question."""
    return list(map(float, with_retries(provider())([text if text.strip() else " "])[0]))


def summarize(rows: DataFrame, text: str, out: str, provider: Callable[[], Callable[[list[str]], Sequence[str]]], *, longest: int = 2000, batch: int = 50, pause_s: float = 0.0, retries: int = 2, base_s: float = 1.0, wait_s: Callable[[Exception], float | None] = lambda e: None, failed: str | None = "") -> DataFrame:
    """``rows`` with a provider's summary of each text, cut to ``longest`` characters and marked before it is sent.

    A batch whose last try fails has ``failed`` for its summaries; None lets the job fail instead.
    """
    shown = rows.withColumn("_shown", prompt_text(F.coalesce(F.col(text), F.lit("")), longest))
    return _in_batches(shown, "_shown", out, "string", provider, lambda t: t, batch, pause_s, retries, base_s, wait_s, failed).drop("_shown")


def prompt_text(content: str | Column, longest: int = 2000) -> Column:
    """What a summary provider is sent: content over the limit is cut and marked."""
    return truncated(content, longest)


def local_summary(content: str | Column, longest: int = 160) -> Column:
    """A summary without a provider: the first line that isn't blank, without comment marks; empty if there is none."""
    c = F.col(content) if isinstance(content, str) else content
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda t: strip(F.regexp_replace(t, r"^[\s/*#]+|[\s*/]+$", "")))
    return truncated(F.coalesce(F.get(F.filter(lines, lambda t: t != ""), F.lit(0)), F.lit("")), longest)
