"""Model calls as functions of columns. An endpoint is given by the caller; those here are stand-ins that need no model
and always answer alike, and tests and queries use no other."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Texts sent in one request, and repairs of an answer that does not parse.
BATCH, REPAIRS, TRIES = 1024, 5, 3
#: Stands at the end of a prompt that is asked again, once for each answer that was of no use.
RETRY = "\nThe answer was not valid, try again."


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Chat(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class StubEmbedder:
    """Unit vectors seeded by the text's hash."""

    def __init__(self, dimensions: int = 1024):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
            v = np.random.default_rng(seed).standard_normal(self.dimensions)
            out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
        return out


class StubChat:
    """Answers with the length and the first words of the prompt; a prompt for repair with the JSON in it."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            found = re.search(r"\{.*\}", p, re.S) if p.startswith("Repair:") else None
            out.append(found[0] if found else f"{len(p)}: {' '.join(p.split()[:8])}")
        return out


class ScriptedChat:
    """Answers by a rule (prompt, attempt) of the caller's, attempts being counted by prompts that begin alike."""

    def __init__(self, rule):
        self.rule = rule

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.rule(p.split(RETRY)[0], p.count(RETRY)) for p in prompts]


def embedder(kind: str, **settings) -> Embedder:
    """The embedding endpoint of a kind: one that the caller gives, or the stand-in; any other kind is an error."""
    if kind == "given":
        return settings["endpoint"]
    if kind == "stub":
        return StubEmbedder(**settings)
    raise ValueError(f"unknown kind of embedding endpoint: {kind}")


def chat(kind: str, **settings) -> Chat:
    """The chat endpoint of a kind, as embedder()."""
    if kind == "given":
        return settings["endpoint"]
    if kind == "stub":
        return StubChat()
    raise ValueError(f"unknown kind of chat endpoint: {kind}")


def chat_options(preset: str, seed: int | None = None) -> dict[str, float | int]:
    """Sampling settings by name: greedy, controlled, or of low entropy."""
    known = {"greedy": {"temperature": 0.0, "top_p": 1.0, "top_k": 1}, "controlled": {"temperature": 0.2, "top_p": 0.9, "top_k": 40}, "low_entropy": {"temperature": 0.1, "top_p": 0.5, "top_k": 10}}
    return known[preset] | ({} if seed is None else {"seed": seed})


def embed(text: Column, endpoint: Embedder, batch: int = BATCH) -> Column:
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            clean = texts.fillna("").tolist()
            found = [v for i in range(0, len(clean), batch) for v in endpoint.embed(clean[i : i + batch])]
            yield pd.Series(found, dtype=object)

    return run(text)


def embedded(rows: DataFrame, text: str, endpoint: Embedder, vector: str = "vec", batch: int = BATCH) -> tuple[DataFrame, Observation]:
    """The rows with the vectors of their texts, and what to look out for in them, counted as they pass: rows, bad_dimension
    (vectors of another dimension than the endpoint's), zero_vector (all but zero). The counts are there when the rows have
    been written, without another pass; ``warnings`` puts them into words."""
    found = rows.withColumn(vector, embed(F.col(text), endpoint, batch))
    v, seen = F.col(vector), Observation()
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.size(v) != endpoint.dimensions).alias("bad_dimension"), F.count_if(F.forall(v, lambda x: F.abs(x) < 1e-6)).alias("zero_vector")]
    return found.observe(seen, *counts), seen


def warnings(counts: dict[str, int], dimensions: int) -> list[str]:
    """What the counts of embedded() warn of."""
    said = {"bad_dimension": f"have another dimension than {dimensions}", "zero_vector": "are all but zero"}
    return [f"{counts[k]} of {counts['rows']} vectors {text}" for k, text in said.items() if counts[k]]


def complete(prompt: Column, endpoint: Chat) -> Column:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in parts:
            yield pd.Series(endpoint.complete(prompts.fillna("").tolist()), dtype=object)

    return run(prompt)


def _json_in(answer: str) -> str | None:
    begin, end = answer.find("{"), answer.rfind("}")
    try:
        json.loads(found := answer[begin : end + 1])
    except ValueError:
        return None
    return found


def structured(answer: Column, schema: str, endpoint: Chat, repairs: int = REPAIRS) -> Column:
    """The JSON in an answer, as a struct of the schema. An answer without any is given back for repair, so many times at
    most, those of a batch in one request; what still has none is null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for answers in parts:
            texts = answers.fillna("").tolist()
            out: list[str | None] = [_json_in(a) for a in texts]
            for _ in range(repairs):
                open_ = [i for i, x in enumerate(out) if x is None]
                if not open_:
                    break
                for i, a in zip(open_, endpoint.complete([f"Repair: {texts[i]}" for i in open_]), strict=True):
                    texts[i], out[i] = a, _json_in(a)
            yield pd.Series(out, dtype=object)

    return F.from_json(run(answer), schema)


def accepted(prompt: Column, endpoint: Chat, valid, tries: int = TRIES) -> Column:
    """The first answer that is valid (a function of prompt and answer), asked for so many times at most; null without."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in parts:
            asked = prompts.fillna("").tolist()
            out: list[str | None] = [None] * len(asked)
            for attempt in range(tries):
                open_ = [i for i, x in enumerate(out) if x is None]
                for i, a in zip(open_, endpoint.complete([asked[i] + RETRY * attempt for i in open_]) if open_ else [], strict=True):
                    out[i] = a if valid(asked[i], a) else None
            yield pd.Series(out, dtype=object)

    return run(prompt)


def refined(contexts: Column, endpoint: Chat, first: str, following: str, finals: tuple[str, ...] = ()) -> Column:
    """One answer from an array of contexts: a draft of the first, refined with each that follows, and given to each final
    prompt in turn. No contexts give null. The rows of a batch go side by side, a request for each step of them all."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in parts:
            given = [list(texts) if texts is not None else [] for texts in rows]
            out: list[str | None] = [None] * len(given)

            def ask(prompts: dict[int, str]) -> None:
                if prompts:
                    for i, a in zip(prompts, endpoint.complete(list(prompts.values())), strict=True):
                        out[i] = a

            for k in range(max(map(len, given), default=0)):
                ask({i: f"{following}\n{out[i]}\n{texts[k]}" if k else f"{first}\n{texts[k]}" for i, texts in enumerate(given) if k < len(texts)})
            for final in finals:
                ask({i: f"{final}\n{a}" for i, a in enumerate(out) if a is not None})
            yield pd.Series(out, dtype=object)

    return run(contexts)


def merge(answers: DataFrame, by: str, order: str, answer: str, endpoint: Chat) -> DataFrame:
    """One answer from those that are not empty, in order, for each key."""
    given = F.array_sort(F.collect_list(F.when(F.trim(answer) != "", F.struct(order, answer))))
    joined = answers.groupBy(by).agg(F.array_join(F.transform(given, lambda x: x[answer]), "\n\n").alias("_a"))
    return joined.select(by, complete(F.concat(F.lit("Merge:\n"), "_a"), endpoint).alias(answer))


def first_that_handles(*results: Column) -> Column:
    """Of a chain of classifiers, the result of the first that has one."""
    return F.coalesce(*results)
