"""Pluggable models: embedders, rerankers and answer writers are plain callables, and HTTP ones are optional.

Nothing here is needed to run a query. An embedder maps texts to vectors, a scorer maps a query and
documents to numbers, a generator maps chat messages to text.
"""

from __future__ import annotations

import importlib
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Scorer = Callable[[str, Sequence[str]], Sequence[float]]
Generator = Callable[[Sequence[dict]], str]


class ServiceError(RuntimeError):
    """A model's service failed or answered in a wrong shape."""


def load(name: str) -> Callable:
    """The callable ``module:attribute``."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError("a hook is named module:attribute")
    return getattr(importlib.import_module(module), attribute)


def post_json(url: str, payload: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def parse_embeddings(answer: dict) -> list[list[float]] | None:
    """Vectors of either common answer shape, those of the second in the order of their index."""
    if isinstance(answer.get("embeddings"), list):
        return answer["embeddings"]
    if isinstance(answer.get("data"), list):
        return [row["embedding"] for row in sorted(answer["data"], key=lambda row: row.get("index", 0))]
    return None


def http_embedder(base: str, model: str, timeout: float = 300) -> Embedder:
    """Posts to ``/api/embed``; where that is unknown or unreadable, to ``/v1/embeddings``."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        got = None
        try:
            got = parse_embeddings(post_json(f"{base.rstrip('/')}/api/embed", {"model": model, "input": list(texts)}, timeout))
        except urllib.error.HTTPError as e:
            if e.code != 404:
                raise ServiceError(f"the embedder answered {e.code}") from e
        if got is None:
            got = parse_embeddings(post_json(f"{base.rstrip('/')}/v1/embeddings", {"model": model, "input": list(texts)}, timeout))
        if got is None or len(got) != len(texts):
            raise ServiceError("the embedder did not answer with one vector for each text")
        return got

    return embed


def http_models(base: str, timeout: float = 5) -> list[str]:
    """The models that a chat service has loaded; none where it cannot be asked."""
    try:
        with urllib.request.urlopen(f"{base.rstrip('/')}/v1/models", timeout=timeout) as answer:
            found = json.load(answer).get("data", [])
    except (OSError, ValueError, AttributeError):
        return []
    return [str(m["id"]) for m in found if isinstance(m, dict) and m.get("id")]


def http_generator(base: str, model: str, timeout: float = 30, max_tokens: int = 768, *, loaded_only: bool = False) -> Generator:
    """Posts to ``/v1/chat/completions``; with ``loaded_only`` a service that does not list the model is down."""

    def generate(messages: Sequence[dict]) -> str:
        payload = {"model": model, "messages": list(messages), "max_tokens": clamp_tokens(max_tokens), "temperature": 0}
        if loaded_only and model not in http_models(base):
            raise ServiceError(f"the service has not loaded {model}")
        answer = post_json(f"{base.rstrip('/')}/v1/chat/completions", payload, timeout)
        return answer["choices"][0]["message"]["content"]

    return generate


def clamp_tokens(n: int | None, low: int = 512, high: int = 1024, default: int = 768) -> int:
    return default if n is None else max(low, min(high, int(n)))


def embed_health(base: str, timeout: float = 5) -> None:
    """Raises unless the embedding service answers; to be called before a run that embeds."""
    try:
        with urllib.request.urlopen(f"{base.rstrip('/')}/api/tags", timeout=timeout) as answer:
            status = answer.status
    except (OSError, ValueError) as e:
        raise ServiceError(f"the embedding service at {base} does not answer ({type(e).__name__})") from e
    if not 200 <= status < 300:
        raise ServiceError(f"the embedding service at {base} answered {status}")


def reachable(url: str, timeout: float = 3) -> bool:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            return answer.status < 500
    except (OSError, ValueError):
        return False


def embed_column(df: DataFrame, make: Callable[[], Embedder], *, text_col: str = "text", batch: int = 8) -> DataFrame:
    """``df`` with ``embedding``; ``make`` builds the embedder once in each task, which sends ``batch`` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for rows in batches:
            texts = [t or "" for t in rows.column(rows.schema.get_field_index(text_col)).to_pylist()]
            got: list = []
            for a in range(0, len(texts), batch):
                part = embedder(texts[a : a + batch])
                if len(part) != len(texts[a : a + batch]):
                    raise ServiceError("the embedder did not answer with one vector for each text")
                got += [list(map(float, v)) for v in part]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(got, pa.list_(pa.float32()))], names=[*rows.schema.names, "embedding"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, embedding array<float>")
