"""Model access as a relation: prompts joined to completions.

``prompts`` is (prompt_id, role, prompt); a provider returns (prompt_id, text,
prompt_tokens, completion_tokens).  A prompt without a completion has a null
text, which every operator counts as a failed call.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store

COMPLETION = "prompt_id string, text string, prompt_tokens int, completion_tokens int"


class Provider(Protocol):
    def __call__(self, prompts: DataFrame) -> DataFrame: ...


#: From (question_id, question, clarifying) to (question_id, reply).
User = Callable[[DataFrame], DataFrame]


class Canned:
    """Completions that are there already."""

    def __init__(self, completions: DataFrame) -> None:
        self.completions = completions

    def __call__(self, prompts: DataFrame) -> DataFrame:
        return prompts.select("prompt_id").join(self.completions, "prompt_id", "left")


class Called:
    """Completions by a function of (role, prompt), called in as many tasks as ``concurrency``; a call that fails thrice is null.

    With ``seed`` the function is given it as a third argument.
    """

    def __init__(self, call: Callable[..., tuple[str, int, int]], concurrency: int = 4, tries: int = 3, wait: float = 2.0, seed: int | None = None) -> None:
        self.call = call if seed is None else lambda role, prompt: call(role, prompt, seed)
        self.concurrency, self.tries, self.wait = concurrency, tries, wait

    def __call__(self, prompts: DataFrame) -> DataFrame:
        call, tries, wait = self.call, self.tries, self.wait

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for prompt_id, role, text in zip(frame.prompt_id, frame.role, frame.prompt, strict=True):
                    got = (None, 0, 0)
                    for k in range(tries):
                        try:
                            got = call(role, text)
                            break
                        except Exception:  # noqa: BLE001 - one failed call must not end a campaign
                            time.sleep(min(30.0, wait * 2**k))
                    rows.append((prompt_id, *got))
                yield pd.DataFrame(rows, columns=["prompt_id", "text", "prompt_tokens", "completion_tokens"])

        return prompts.select("prompt_id", "role", "prompt").repartition(self.concurrency, "prompt_id").mapInPandas(run, COMPLETION)


class Recorded:
    """Completions that are asked for once and written; every branch of a plan, every retry and a resumed run read the same ones.

    They are kept in the store's table ``completions`` by prompt id and a hash
    of the prompt.  A call that failed is asked for again when the prompt is.
    """

    def __init__(self, provider: Provider, store: Store) -> None:
        self.provider, self.store = provider, store

    def __call__(self, prompts: DataFrame) -> DataFrame:
        keys = ["prompt_id", "prompt_hash"]
        asked = prompts.withColumn("prompt_hash", F.md5(F.col("prompt").cast("binary")))
        have = self.store.read_all("completions", RECORD)
        new = asked.join(have.where("text is not null"), keys, "left_anti")
        done = new.select(*keys, "role").join(self.provider(new.select("prompt_id", "role", "prompt")), "prompt_id", "left")
        done = done.withColumn("at", F.current_timestamp()).select(*[c.split()[0] for c in RECORD.split(", ")])
        self.store.append("completions", done)
        last = F.max_by(F.struct("text", "prompt_tokens", "completion_tokens"), "at").alias("x")
        known = self.store.read_all("completions", RECORD).groupBy(*keys).agg(last)
        return asked.select(*keys).join(known, keys, "left").select("prompt_id", "x.*")


RECORD = "prompt_id string, prompt_hash string, role string, text string, prompt_tokens int, completion_tokens int, at timestamp"


def probe(call: Callable[[], object]) -> tuple[bool, str]:
    """(whether a service answers, what it says or the error)."""
    try:
        return True, str(call())
    except Exception as e:  # noqa: BLE001 - a report of what fails
        return False, f"{type(e).__name__}: {e}"


def by_index(rows: list[tuple[int, list[float]]], n: int) -> list[list[float]]:
    """Vectors of (place, vector) rows in the order of the texts, however they came; a missing one is an error."""
    out = [v for _, v in sorted(rows, key=lambda r: r[0])]
    if [i for i, _ in sorted(rows, key=lambda r: r[0])] != list(range(n)):
        raise ValueError(f"{len(rows)} vectors for {n} texts, or places that repeat")
    return out


class Embedder:
    """Vectors by a function of a list of texts, in batches, within tasks.

    The function gives a vector a text in their order, or (place, vector) rows
    in any.
    """

    def __init__(self, call: Callable[[list[str]], list[list[float]]], batch: int = 32) -> None:
        self.call, self.batch = call, batch

    def __call__(self, rows: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
        call, batch = self.call, self.batch
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", vector array<double>"

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                texts = [prefix + (t or "") for t in frame[text]]
                made: list[list[float]] = []
                for k in range(0, len(texts), batch):
                    some = texts[k : k + batch]
                    got = list(call(some))
                    if len(got) != len(some):
                        raise ValueError(f"{len(got)} vectors for {len(some)} texts")
                    made += by_index(got, len(some)) if isinstance(got[0], tuple) else got
                yield frame.assign(vector=made)

        return rows.mapInPandas(run, schema)


class Scorer:
    """Scores of passages by a cross-encoder: a function of (model, question, passages), called once a question."""

    def __init__(self, call: Callable[[str, str, list[str]], list[float]]) -> None:
        self.call = call

    def __call__(self, pairs: DataFrame, model: str) -> DataFrame:
        """(question_id, chunk_id, score) of (question_id, chunk_id, rank, question, text); missing scores and NaN are errors."""
        call = self.call

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("rank")
            scores = [float(x) for x in call(model, frame.question.iloc[0], frame.text.tolist())]
            if len(scores) != len(frame) or any(map(math.isnan, scores)):
                raise ValueError(f"{model} gave {len(scores)} scores for {len(frame)} passages, or NaN")
            return frame[["question_id", "chunk_id"]].assign(score=scores)

        kinds = dict(pairs.dtypes)
        return pairs.groupBy("question_id").applyInPandas(run, f"question_id {kinds['question_id']}, chunk_id {kinds['chunk_id']}, score double")


def usage(completions: DataFrame) -> DataFrame:
    """Calls and tokens of each role, from rows and not from accumulators, which retried tasks count twice."""
    return completions.groupBy("role").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count_if(F.col("text").isNull()).alias("failed")
    )
