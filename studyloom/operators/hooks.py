"""Models are outside the engine: text models and vector models plug in as functions over batches.

A hook gets a list and returns a list of the same length. It runs in Arrow batches on the executors;
what it raises for a row becomes that row's error, never a failed job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TextModel = Callable[[list[tuple[str, str]]], list[str]]
VectorModel = Callable[[list[str]], list[list[float]]]


def ask(prompts: DataFrame, model: TextModel, system: str = "system", user: str = "user") -> DataFrame:
    """``prompts`` with ``answer`` and ``error``; order and number of rows stay. A batch that fails is asked row by row."""
    columns = [c for c in prompts.columns]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)

    def one(pair: tuple[str, str]) -> tuple[str | None, str | None]:
        try:
            return model([pair])[0], None
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pairs = list(zip(pdf[system], pdf[user]))
            try:
                done = [(a, None) for a in model(pairs)] if pairs else []
                if len(done) != len(pairs):
                    raise ValueError("a model has to answer each prompt")
            except Exception:
                done = [one(p) for p in pairs]
            yield pdf.assign(answer=pd.Series([a for a, _ in done], dtype=object, index=pdf.index), error=pd.Series([e for _, e in done], dtype=object, index=pdf.index))[[*columns, "answer", "error"]]

    return prompts.mapInPandas(run, f"{shape}, answer string, error string")


def embed(texts: DataFrame, model: VectorModel, id_: str, text: str) -> DataFrame:
    """``<id>, vector, error``: vectors of unit length, null for null text. A batch that fails, or gets too few vectors, is embedded row by row."""
    kind = texts.schema[id_].dataType.simpleString()

    def one(t: str) -> tuple[list[float] | None, str | None]:
        try:
            (vector,) = model([t])
            return vector, None
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            known = pdf[text].notna()
            asked = pdf.loc[known, text].tolist()
            try:
                done = [(v, None) for v in model(asked)] if asked else []
                if len(done) != len(asked):
                    raise ValueError("a model has to give a vector for each text")
            except Exception:
                done = [one(t) for t in asked]
            answers = iter(done)
            rows = [next(answers) if k else (None, None) for k in known]
            yield pd.DataFrame({id_: pdf[id_], "vector": pd.Series([v for v, _ in rows], dtype=object, index=pdf.index), "error": pd.Series([e for _, e in rows], dtype=object, index=pdf.index)})

    from studyloom.operators.retrieval import unit_length

    raw = texts.select(id_, text).mapInPandas(run, f"`{id_}` {kind}, vector array<double>, error string")
    return raw.select(id_, F.when(F.col("vector").isNotNull(), unit_length(F.col("vector"))).alias("vector"), "error")


#: Sends one request with an address, headers and a body; returns the answer's status, or raises.
Send = Callable[[str, dict[str, str], str], int]
TRIES, FIRST_PAUSE, LONGEST_PAUSE = 3, 2.0, 30.0


def deliver(rows: DataFrame, send: Send, id_: str, url: str, token: str, body: str, tries: int = TRIES, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows`` with ``outcome``, ``status`` and ``n_tries`` of sending each row's ``body`` to its ``url``.

    Every request carries the row's id as its idempotency key, so a receiver can drop what a task that is run again
    sends twice. What fails for now is sent again after 2, 4, ... seconds, at most 30; a receiver's refusal isn't.
    ``outcome`` is ``delivered``, ``permanent`` or ``transient``, as :mod:`studyloom.operators.jobs` names them.
    """
    from studyloom.operators.jobs import RETRY_CALLBACK

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def attempt(row: dict) -> tuple[str, int | None, int]:
        headers = {"Content-Type": "application/json", "Idempotency-Key": str(row[id_])}
        if row[token]:
            headers["Authorization"] = f"Bearer {row[token]}"
        status = None
        for n in range(1, tries + 1):
            try:
                status = int(send(row[url], headers, row[body]))
            except Exception:
                status = None
            if status is not None and 200 <= status < 300:
                return "delivered", status, n
            if status is not None and 400 <= status < 500 and status not in RETRY_CALLBACK:
                return "permanent", status, n
            if n < tries:
                pause(min(FIRST_PAUSE * 2 ** (n - 1), LONGEST_PAUSE))
        return "transient", status, tries

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            done = [attempt(r) for r in pdf[[id_, url, token, body]].astype(object).where(pdf[[id_, url, token, body]].notna(), None).to_dict("records")]
            yield pdf.assign(outcome=[o for o, _, _ in done], status=pd.array([s for _, s, _ in done], dtype="Int32"), n_tries=[n for _, _, n in done])

    return rows.mapInPandas(run, f"{shape}, outcome string, status int, n_tries int")
