"""Model calls behind a plain protocol, with a deterministic offline provider."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from lodewell.functions.names import fresh
from lodewell.functions.text import shorten


class Provider(Protocol):
    """Answers prompts; may raise on any of them. Tasks are retried, so answers should be idempotent."""

    def complete(self, prompt: str) -> str: ...


class Offline:
    """Scores by counting: an answer any run repeats."""

    def complete(self, prompt: str) -> str:
        words = prompt.split()
        score = lambda k: round(10 * (len(set(words[k::3])) / max(1, len(words[k::3]))), 3)
        return json.dumps({"industry_impact_score": score(0), "milestone_score": score(1), "attention_score": score(2)})


def complete(df: DataFrame, prompt: str, provider: Callable[[], Provider], *, attempts: int = 3) -> DataFrame:
    """`df` with answer and error (underscores in front if taken), one of them null: a failed row stops no other.

    Each task makes its own provider; `df`'s partitions bound how many call at once.
    """
    at = df.columns.index(prompt)
    names = fresh(df, "answer"), fresh(df, "error")

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = provider()
        for batch in batches:
            answers, errors = [], []
            for text in batch.column(at).to_pylist():
                answer = error = None
                for _ in range(attempts):
                    try:
                        answer, error = model.complete(text or ""), None
                        break
                    except Exception as e:  # noqa: BLE001  a provider may raise anything
                        error = f"{type(e).__name__}: {e}"
                answers.append(answer)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[f.name for f in schema])

    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)] + [StructField("a", StringType()), StructField("e", StringType())])
    return df.mapInArrow(call, schema).toDF(*df.columns, *names)


class BatchProvider(Protocol):
    """Answers requests of several texts at once, each reply with the index of its text, in any order."""

    def embed(self, texts: list[str]) -> list[tuple[int, list[float]]]: ...

    def rerank(self, query: str, texts: list[str]) -> list[tuple[int, float]]: ...


def _replies(call: Callable[[list[str]], list[tuple]], texts: list[str], batch: int, attempts: int) -> tuple[list, list[str | None]]:
    """(replies, errors) in the order of the texts, from requests of at most `batch` texts.

    A request that fails, or whose replies don't answer each of its texts once, is made again, `attempts` times in all;
    its texts then have the error, and those of other requests don't.
    """
    replies, errors = [], []
    for begin in range(0, len(texts), batch):
        asked = texts[begin : begin + batch]
        found, error = {}, None
        for _ in range(attempts):
            try:
                given = call(asked)
                found, error = dict(given), None
                if len(given) == len(asked) and set(found) == set(range(len(asked))):
                    break
                error = f"{len(given)} replies to {len(asked)} texts"
            except Exception as e:  # noqa: BLE001  a provider may raise anything
                error = f"{type(e).__name__}: {e}"
        replies += [None if error else found[i] for i in range(len(asked))]
        errors += [error] * len(asked)
    return replies, errors


def embedded(df: DataFrame, text: str, provider: Callable[[], BatchProvider], *, batch: int = 10, attempts: int = 3, most: int = 32_000) -> DataFrame:
    """`df` with embedding and error (underscores in front if taken), one of them null.

    Texts are cut to `most` characters and a mark, and sent by each task in requests of at most `batch`; null counts as
    empty. A request that fails in the end leaves the others alone.
    """
    names = fresh(df, "embedding"), fresh(df, "error")
    sent = df.withColumn(fresh(df, "_sent"), F.coalesce(shorten(F.col(text), most), F.lit("")))

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = provider()
        for rows in batches:
            vectors, errors = _replies(model.embed, rows.column(rows.num_columns - 1).to_pylist(), batch, attempts)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=[f.name for f in schema])

    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)] + [StructField("v", ArrayType(DoubleType())), StructField("e", StringType())])
    return sent.mapInArrow(call, schema).toDF(*df.columns, *names)


def reranked(found: DataFrame, k: int, provider: Callable[[], BatchProvider], *, by: str = "query", text: str = "text", score: str = "similarity", batch: int = 10, attempts: int = 3) -> DataFrame:
    """The k best candidates of each query, with rerank_score, place (from 1) and reranked, which says who placed them.

    `found` holds, for each query, a bounded number of candidates: `by`, query_text, text, score and rank, their order.
    A model scores texts by query in requests of at most `batch`; the best come first, ties in the given order. If a
    request of a query fails in the end, its candidates keep their order and `score`. Other columns ride along.
    """
    at = {name: found.columns.index(name) for name in (by, "query_text", text, score, "rank")}
    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(found.schema)] + [StructField("s", DoubleType()), StructField("p", IntegerType()), StructField("r", BooleanType())])

    def place(group: pa.Table) -> pa.Table:
        model = provider()
        group = group.sort_by([(group.column_names[at["rank"]], "ascending")])
        texts = [t or "" for t in group.column(at[text]).to_pylist()]
        scores, errors = _replies(lambda some: model.rerank(group.column(at["query_text"])[0].as_py() or "", some), texts, batch, attempts)
        good = not any(errors)
        order = sorted(range(len(texts)), key=lambda i: -scores[i]) if good else list(range(len(texts)))
        order = order[:k]
        given = [float(scores[i]) for i in order] if good else [float(v or 0.0) for v in group.column(at[score]).take(pa.array(order, pa.int64())).to_pylist()]
        columns = [*group.take(pa.array(order, pa.int64())).columns, pa.array(given), pa.array(range(1, len(order) + 1), pa.int32()), pa.array([good] * len(order))]
        return pa.table([c if isinstance(c, pa.Array) else c.combine_chunks() for c in columns], names=[f.name for f in schema])

    return found.groupBy(by).applyInArrow(place, schema).toDF(*found.columns, "rerank_score", "place", "reranked")


class Tools:
    """Named operators: register more, and run one by name."""

    def __init__(self):
        self._tools: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, tool: Callable[..., DataFrame]) -> None:
        self._tools[name] = tool

    def names(self) -> list[str]:
        return sorted(self._tools)

    def run(self, name: str, *args, **kwargs) -> DataFrame:
        if name not in self._tools:
            raise KeyError(f"no tool {name!r}; there are {', '.join(self.names())}")
        return self._tools[name](*args, **kwargs)
