"""Questions over an archive: retrieve, cite, optionally answer, and record what was asked."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.candidates import auth_shaped
from ..functions.text import query_text
from ..operators.answers import Answer, answer, audit_rows, best_body, draft_row, prompt_block
from ..operators.thread_pack import citations, get_thread
from ..operators.vector import cosine_search
from ..sources.services import Embedder, Scorer, ServiceError
from ..sources.tables import local_table, settled
from .retrieve import Query, Store, retrieve

ASK_K = 8


def query_vector(spark: SparkSession, query: str, embed: Embedder | None) -> list[float] | None:
    """The query's vector, or none where there is no embedder or it fails: text search goes on without it."""
    if embed is None:
        return None
    payload = spark.range(1).select(query_text(F.lit(query))).first()[0]
    try:
        got = embed([payload])
    except (ServiceError, OSError):
        return None
    return [float(x) for x in got[0]]


def hybrid_search(spark: SparkSession, store: Store, query: str, *, now: str, embed: Embedder | None = None, k: int = 20, lane: str | None = None, after: str | None = None, before: str | None = None, **options) -> DataFrame:
    """``retrieve`` for one query; ``embed`` left out searches texts only."""
    return retrieve(spark, store, [Query(0, query, query_vector(spark, query, embed), lane, after, before)], k=k, now=now, **options)


def semantic_search(spark: SparkSession, store: Store, text: DataFrame, query: str, embed: Embedder, k: int = 10) -> DataFrame:
    """Cosine only; here a failing embedder is an error."""
    payload = spark.range(1).select(query_text(F.lit(query))).first()[0]
    return cosine_search(store.vectors, text, [(0, [float(x) for x in embed([payload])[0]])], k)


def with_prompt_body(messages: DataFrame, text: DataFrame) -> DataFrame:
    """Messages with what a prompt may show of them."""
    body = text.select("id", F.col("body").alias("_body"))
    cleaned = F.col("cleaned_body") if "cleaned_body" in messages.columns else F.lit("")
    return messages.join(body, "id", "left").withColumn("prompt_body", best_body(cleaned, "_body", "snippet")).drop("_body")


def ask(
    spark: SparkSession,
    store: Store,
    text: DataFrame,
    query: str,
    *,
    now: str,
    embed: Embedder | None = None,
    generate: Callable[[Sequence[dict]], str] | None = None,
    actor: str = "user",
    k: int = ASK_K,
    model: str | None = None,
    host: str | None = None,
    **options,
) -> tuple[Answer, DataFrame]:
    """An answer whose citations are ids of its hits, and the audit row to append. Sign-in mail stays in the
    citations and out of the prompt."""
    k = k or ASK_K
    # both are settled: nothing is computed again or stays behind
    hits = hybrid_search(spark, store, query, now=now, embed=embed, k=k, **options)
    cited = settled(citations(hits.withColumnRenamed("message_id", "id")))
    ids = [r["id"] for r in cited.orderBy("citation").collect()]  # a pack and its spines
    block = ""
    if generate is not None:
        messages = store.messages.where(F.col("id").isin(ids)) if store.lookup is None else store.lookup(ids)
        found = prompt_block(cited, with_prompt_body(messages, text.where(F.col("id").isin(ids)))).first()
        block = found["block"] if found else ""
    rows = [r.asDict() for r in hits.orderBy("out_pos").collect()]
    got = answer(query, rows, ids, block, generate, "live" if any(r["rerank"] is not None for r in rows) else "none")
    asked = local_table(spark, [(0, query)], "query_id long, query string")
    labels = {"model": model, "host": host, "generate_mode": got.generate_mode, "rerank_mode": got.rerank_mode}
    return got, audit_rows(cited, asked, now, actor, k, labels)


def get_message(messages: DataFrame, text: DataFrame, message_id: object) -> dict | None:
    """One message with its body and whether it is sign-in mail."""
    one = with_prompt_body(messages.where(F.col("id") == F.lit(message_id)), text).withColumn("auth_shaped", auth_shaped("lane", "subject")).first()
    return one.asDict() if one else None


def tools(spark: SparkSession, store: Store, text: DataFrame, *, clock: Callable[[], str], embed: Embedder | None = None, generate=None, scorer: Scorer | None = None, drafts: str | None = None) -> dict[str, Callable[[dict], dict]]:
    """JSON arguments to JSON results, for ``plans.server``; ``drafts`` is the folder of the drafts' text files."""

    def window(a: dict) -> dict:
        return {x: a.get(x) for x in ("lane", "after", "before")}

    def rows(df: DataFrame) -> list[dict]:
        return [r.asDict() for r in df.collect()]

    def one_key(a: dict) -> object:
        key = a.get("thread_id") or a.get("message_id")
        if not key:
            raise ValueError("a thread_id or message_id is needed")
        return key

    return {
        "ask": lambda a: ask(spark, store, text, a["query"], now=clock(), embed=embed, generate=None if a.get("hits_only") else generate, k=int(a.get("k") or ASK_K), scorer=scorer, **window(a))[0].__dict__,
        "hybrid_search": lambda a: {"hits": rows(hybrid_search(spark, store, a["query"], now=clock(), embed=None if a.get("fts_only") else embed, k=int(a.get("k") or 20), scorer=scorer, **window(a)).orderBy("out_pos"))},
        "get_thread": lambda a: {"messages": rows(get_thread(store.messages, one_key(a)))},
        "get_message": lambda a: {"message": get_message(store.messages, text, a["message_id"])},
        "draft_reply": lambda a: {"draft": rows(draft_row(store.messages, a["message_id"], a.get("text"), clock(), bool(a.get("send")), drafts))[0] | {"sent": False}},
    }


#: What the arguments of tools must be; those that are not named are ignored.
KINDS = {"query": str, "message_id": (str, int), "thread_id": (str, int), "lane": str, "after": str, "before": str, "text": str, "k": int, "hits_only": bool, "fts_only": bool, "send": bool}


def wrong_arguments(arguments: dict) -> str | None:
    """What is wrong with the types of a tool's arguments."""
    for name, value in arguments.items():
        kind = KINDS.get(name)
        if kind is None or value is None:
            continue
        if name == "k" and isinstance(value, str) and value.strip().isdigit():
            continue
        if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
            return f"{name} has the wrong type"
    return None


def call(found: dict[str, Callable[[dict], dict]], name: str, arguments: dict) -> dict:
    """A tool's result, or ``{"error": ...}`` for a wrong name or wrong arguments, with ``"failed": True`` where the tool itself
    failed: no exception of a tool leaves a server without an answer."""
    if name not in found:
        return {"error": f"no tool {name}"}
    wrong = wrong_arguments(arguments)
    if wrong:
        return {"error": wrong}
    try:
        return found[name](arguments)
    except (KeyError, ValueError) as e:
        return {"error": " ".join(str(e).split())[:160]}
    except Exception as e:
        return {"error": f"{type(e).__name__}: {' '.join(str(e).split())}"[:160], "failed": True}
