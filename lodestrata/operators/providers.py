"""Scores by a chain of providers, with failover by batch and a table of what has been scored."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import settle, stored
from ..sources.commits import Table

Scorer = Callable[[pd.Series, pd.Series], pd.Series]


@dataclass(frozen=True)
class Provider:
    """A model of (question, text), and the seconds that one batch may take."""

    name: str
    score: Scorer
    seconds: float = 30.0
    tries: int = 1


def within(seconds: float, call: Callable[[], pd.Series]) -> pd.Series:
    """What the call gives, or TimeoutError; a call that hangs is left behind in a thread that ends with its worker."""
    got: list = []

    def run() -> None:
        try:
            got.append((call(), None))
        except Exception as e:
            got.append((None, e))

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    if not got:
        raise TimeoutError(f"no answer in {seconds} s")
    value, error = got[0]
    if error is not None:
        raise error
    return value


def content_key(chain: str) -> F.Column:
    """What a score depends on: the chain's name and both texts."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c)), F.lit("-"))
    return F.sha2(F.concat_ws("\x1f", F.lit(chain), F.octet_length(part("question")), part("question"), part("text")), 256)


def chain_name(providers: list[Provider]) -> str:
    return hashlib.sha256("/".join(p.name for p in providers).encode()).hexdigest()[:12]


def chained_scores(pairs: DataFrame, providers: list[Provider], cache: Table | None = None, rows: int = 256) -> DataFrame:
    """pairs (question, text, ...) with ``score`` and ``provider``, the first of the chain that answered for the row's batch.

    A batch of ``rows`` goes to the first provider, and to the next if that fails, gives another number of scores, or takes longer than its
    seconds; no row is lost: where all fail, score and provider are null. Equal pairs are scored once. With a cache (a table by
    ``key``) pairs that have a score there call nothing, and new scores are one commit, so a rerun calls no provider twice.
    """
    settle(pairs.sparkSession)
    name = chain_name(providers)
    keyed = stored(pairs.withColumn("_key", content_key(name)), "pairs")
    asked = keyed.select(F.col("_key").alias("key"), "question", "text").dropDuplicates(["key"])
    known = cache.read() if cache is not None and cache.snapshot().version >= 0 else None
    if known is not None:
        asked = asked.join(known.select("key"), "key", "left_anti")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), rows):
                part, answer = frame.iloc[lo : lo + rows].reset_index(drop=True), (None, None)
                for p in [p for p in providers for _ in range(p.tries)]:
                    try:
                        scores = within(p.seconds, lambda p=p, part=part: pd.Series(p.score(part["question"], part["text"])))
                    except Exception:  # whatever a provider raises is its failure, and the next one's turn
                        continue
                    if len(scores) == len(part):
                        answer = (scores.astype(float).to_numpy(), p.name)
                        break
                yield pd.DataFrame({"key": part["key"], "score": answer[0] if answer[1] else [None] * len(part), "provider": [answer[1]] * len(part)})

    fresh = stored(asked.mapInPandas(score, "key string, score double, provider string"), "scores")
    if cache is not None:
        done = fresh.where("provider is not null")
        if known is None:
            cache.create(done)
        elif not done.isEmpty():
            cache.append(done)
    scores = fresh if known is None else fresh.unionByName(known.select(fresh.columns).join(keyed.select(F.col("_key").alias("key")).distinct(), "key", "left_semi"))
    return keyed.join(scores, F.col("_key") == F.col("key"), "left").drop("_key", "key")
