"""Command line: python -m siftspark COMMAND ROOT ...

index     build the indexes of the text and of identifiers      search    hybrid search
cosine    search by vectors alone                               ask       answer with citations
thread    the messages of a thread                              message   one message with its text
draft     keep a draft of a reply                               health    tables, samples of searches, services, writers
backfill  embed what is missing or has changed                  merge     copy what only other archives have
migrate   add the columns that tables lack                      serve     the tools over HTTP
tools     the tools on standard input and output                generate  answer from a JSON file of hits
"""

from __future__ import annotations

import argparse
import json
import sys
from contextlib import nullcontext
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from .operators.answers import hits_messages, response_lines
from .operators.thread_pack import get_thread
from .plans import runs, server
from .plans.ask import ask, get_message, hybrid_search, semantic_search, tools
from .plans.checkup import checkup
from .plans.disk import migrate_table, open_store, refresh_indexes
from .sources import schemas
from .sources.scorers import BACKENDS, scorer
from .sources.services import embed_health, http_embedder, http_generator, load
from .sources.tables import exists, read, read_hits
from .streaming.increment import writer_lock

COMMANDS = ["index", "search", "cosine", "ask", "thread", "message", "draft", "health", "backfill", "merge", "migrate", "serve", "tools", "generate"]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siftspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("command", choices=COMMANDS)
    out.add_argument("root", help="folder of the archive, or the file of hits")
    out.add_argument("query", nargs="*", help="words of the query, the thread's or message's id, or the archives to merge")
    out.add_argument("-k", type=int)
    for name in ("lane", "after", "before"):
        out.add_argument(f"--{name}")
    out.add_argument("--embedder", help="URL of an embedding service, or module:attribute")
    out.add_argument("--generator", help="URL of a chat service, or module:attribute")
    out.add_argument("--scorer", help=f"module:attribute of a reranker, or one of {', '.join(BACKENDS)}")
    out.add_argument("--scorer-url", default="http://127.0.0.1:11434")
    out.add_argument("--model", default="qwen3-embedding:8b")
    out.add_argument("--text", default="", help="text of a draft")
    out.add_argument("--lines", action="store_true", help="an answer as text, not JSON")
    out.add_argument("--dry-run", action="store_true")
    out.add_argument("--legacy", action="store_true", help="backfill subject and body by the hash of the text")
    out.add_argument("--compat", action="store_true", help="merge the seven old columns only")
    out.add_argument("--dims", type=int, default=1024)
    out.add_argument("--limit", type=int)
    out.add_argument("--max-chars", type=int)
    out.add_argument("--min-chars", type=int)
    out.add_argument("--shard", help="I/N: the I-th of N shards by id")
    out.add_argument("--with-auth", action="store_true", help="embed sign-in mail too")
    out.add_argument("--lock", help="file of the writer's lock")
    out.add_argument("--backups", help="folder that a health run looks for")
    out.add_argument("--no-hybrid", action="store_true")
    out.add_argument("--host", default="127.0.0.1")
    out.add_argument("--port", type=int, default=8765)
    return out


def hooks(a: argparse.Namespace) -> tuple:
    """Embedder, generator and scorer of the arguments, each None if it is not given."""
    made = lambda name, make: None if not name else make(name) if "://" in name else load(name)
    rank = scorer(a.scorer, url=a.scorer_url) if a.scorer in BACKENDS else made(a.scorer, load)
    return made(a.embedder, lambda url: http_embedder(url, a.model)), made(a.generator, lambda url: http_generator(url, a.model)), rank


def choice(a: argparse.Namespace) -> runs.Choice:
    shard, _, shards = (a.shard or "0/0").partition("/")
    return runs.Choice(int(shards), int(shard), a.max_chars, a.min_chars, a.limit, not a.with_auth)


def write(spark: SparkSession, a: argparse.Namespace, now: str) -> dict:
    """The commands that change an archive, one writer at a time where a lock is named."""
    with writer_lock(a.lock) if a.lock else nullcontext():
        if a.command == "index":
            refresh_indexes(spark, a.root)
            return {}
        if a.command == "merge":
            return runs.merge_archives(spark, a.root, a.query, compat=a.compat, dry=a.dry_run)
        if a.command == "migrate":
            tables = {"messages": schemas.MESSAGES, "meta": schemas.META}
            return {name: migrate_table(spark, f"{a.root}/{name}", schema) for name, schema in tables.items()}
        make = None
        if a.embedder:
            name, model = a.embedder, a.model
            make = (lambda: http_embedder(name, model)) if "://" in name else (lambda: load(name))
            if "://" in name and not a.dry_run:
                embed_health(name)
        return runs.backfill(spark, a.root, make, now=now, dims=a.dims, legacy=a.legacy, dry=a.dry_run, choice=choice(a))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("siftspark").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    clock = lambda: datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    query, now = " ".join(a.query), clock()
    if a.command in ("index", "merge", "migrate", "backfill"):
        said = write(spark, a, now)
        if said:
            print(json.dumps(said))
        return 0
    embed, generate, rank = hooks(a)
    if a.command == "generate":
        if generate is None:
            raise SystemExit("generate needs --generator")
        print(generate(hits_messages(query, [r.asDict(True) for r in read_hits(spark, a.root).collect()])))
        return 0
    if a.command == "health":
        parts = [(n, s) for n, s in (("messages", schemas.MESSAGES), ("meta", schemas.META), ("vectors", schemas.VECTORS))]
        found = [read(spark, f"{a.root}/{n}", s) if exists(spark, f"{a.root}/{n}") else None for n, s in parts]
        store = open_store(spark, a.root) if exists(spark, f"{a.root}/messages") and exists(spark, f"{a.root}/text") else None
        probe = (lambda: embed_health(a.embedder)) if a.embedder and "://" in a.embedder else None
        report = checkup(spark, store, *found, now=now, embed=embed, probe=probe, backups=a.backups, locks=[a.lock] if a.lock else [], hybrid=not a.no_hybrid)
        print("\n".join(report.lines()))
        return report.exit_code
    store = open_store(spark, a.root)
    text = read(spark, f"{a.root}/text", schemas.MESSAGE_TEXT)
    window = {"lane": a.lane, "after": a.after, "before": a.before}
    served = tools(spark, store, text, clock=clock, embed=embed, generate=generate, scorer=rank, drafts=f"{a.root}/drafts")
    if a.command == "serve":
        with server.http_server(served, a.host, a.port) as http:
            http.serve_forever()
        return 0
    if a.command == "tools":
        return server.serve_tools(served, sys.stdin.buffer, sys.stdout.buffer)
    if a.command == "ask":
        got, _ = ask(spark, store, text, query, now=now, embed=embed, generate=generate, k=a.k or 8, scorer=rank, **window)
        print("\n".join(response_lines(got)) if a.lines else got.to_json())
        return 0
    if a.command in ("message", "draft"):
        found = get_message(store.messages, text, query) if a.command == "message" else server.dispatch(served, "draft_reply", {"message_id": query, "text": a.text})
        print(json.dumps(found, default=str))
        return 0 if found and "error" not in found else 1
    if a.command == "thread":
        rows = get_thread(store.messages, query)
    elif a.command == "cosine":
        rows = semantic_search(spark, store, text, query, embed, a.k or 10).orderBy("distance")
    else:
        rows = hybrid_search(spark, store, query, now=now, embed=embed, k=a.k or 20, scorer=rank, **window).orderBy("out_pos")
    for line in rows.toJSON().collect():  # a page of hits
        print(line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
