"""Command line: python -m textquarry VERB ..."""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import functions as F

from textquarry.functions.query_syntax import parse_context_spec, parse_document_spec
from textquarry.functions.text import line_range
from textquarry.operators.catalog import CatalogError
from textquarry.operators.vector import Embedder, HashEmbedder
from textquarry.plans.engine import Engine, SearchOptions
from textquarry.session import get_session
from textquarry.sources import sinks

VERSION = "0.1.0"


def load(spec: str | None):
    """An object named `module:factory`, made by calling the factory."""
    if not spec:
        return None
    module, _, factory = spec.partition(":")
    return getattr(importlib.import_module(module), factory)()


def embedder_of(args: argparse.Namespace) -> Embedder:
    return load(args.embedder) or HashEmbedder()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textquarry")
    top.add_argument("--root", default=os.environ.get("TEXTQUARRY_ROOT", os.path.expanduser("~/.textquarry")), help="folder of the indexes")
    top.add_argument("--index", default="default", help="name of the index")
    top.add_argument("--embedder", help="module:factory of an embedding backend")
    verbs = top.add_subparsers(dest="verb", required=True)

    collection = verbs.add_parser("collection").add_subparsers(dest="action", required=True)
    add = collection.add_parser("add")
    add.add_argument("folder")
    add.add_argument("--name", default="")
    add.add_argument("--mask", dest="glob")
    add.add_argument("--context")
    collection.add_parser("remove").add_argument("name")
    rename = collection.add_parser("rename")
    rename.add_argument("name")
    rename.add_argument("new")
    collection.add_parser("list")

    context = verbs.add_parser("context").add_subparsers(dest="action", required=True)
    put = context.add_parser("add")
    put.add_argument("place")
    put.add_argument("context")
    context.add_parser("rm").add_argument("place")
    context.add_parser("list")
    context.add_parser("check")

    for name in ("search", "vsearch", "query"):
        find = verbs.add_parser(name)
        find.add_argument("words", nargs="+")
        find.add_argument("-n", "--limit", type=int)
        find.add_argument("-c", "--collections")
        find.add_argument("--min-score", type=float, default=0.0)
        for fmt in sinks.FORMATS:
            find.add_argument(f"--{fmt}", dest="formats", action="append_const", const=fmt)
        if name == "query":
            find.add_argument("--generator", help="module:factory of a text generator, for query variants")
            find.add_argument("--reranker", help="module:factory of a reranker")
            find.add_argument("--intent", default="")
            find.add_argument("--hyde", action="store_true")
            find.add_argument("--explain", action="store_true")

    verbs.add_parser("index").add_argument("--chunk-strategy", default="auto")
    embed = verbs.add_parser("embed")
    embed.add_argument("-f", "--force", action="store_true")
    embed.add_argument("--chunk-strategy", default="auto")
    get = verbs.add_parser("get")
    get.add_argument("spec")
    get.add_argument("--from", dest="first", type=int, default=0)
    get.add_argument("-l", "--lines", type=int, default=0)
    several = verbs.add_parser("multi-get")
    several.add_argument("spec")
    several.add_argument("--max-bytes", type=int, default=0)
    several.add_argument("--json", action="store_true")
    verbs.add_parser("chunks").add_argument("path")
    listing = verbs.add_parser("ls")
    listing.add_argument("place", nargs="?")
    bench = verbs.add_parser("bench")
    bench.add_argument("file")
    bench.add_argument("--mode", default="bm25")
    for name in ("status", "doctor", "cleanup", "version"):
        verbs.add_parser(name)
    return top


def find(engine: Engine, args: argparse.Namespace) -> str:
    fmt = sinks.chosen_format(set(args.formats or ()))
    options = SearchOptions(args.limit or sinks.default_limit(fmt), args.collections, args.min_score)
    words = " ".join(args.words)
    if args.verb == "search":
        return sinks.render(engine.search(words, options), fmt)
    if args.verb == "vsearch":
        return sinks.render(engine.search_similar(words, embedder_of(args), options), fmt)
    hits = engine.search_hybrid(words, embedder_of(args), options, load(args.generator), args.intent, args.hyde, load(args.reranker))
    if args.explain and "rrf_only" in hits.columns:
        return "\n".join(r["value"] for r in sinks.json_rows(hits, explain=True).orderBy("rank").collect())
    return sinks.render(hits, fmt)


def run(engine: Engine, args: argparse.Namespace) -> str:
    """What a verb prints."""
    table = lambda rows: "\n".join("\t".join("" if v is None else str(v) for v in r) for r in rows.collect())
    if args.verb in ("search", "vsearch", "query"):
        return find(engine, args)
    if args.verb == "collection":
        if args.action == "add":
            engine.add_collection(args.folder, args.name, **({"glob": args.glob} if args.glob else {}), context=args.context)
        elif args.action == "remove":
            engine.remove_collection(args.name)
        elif args.action == "rename":
            engine.rename_collection(args.name, args.new)
        return table(engine.collections().select("name", "root", "doc_count", "context"))
    if args.verb == "context":
        if args.action == "check":
            return table(engine.undescribed())
        if args.action == "add":
            engine.add_context(args.context, *parse_context_spec(args.place))
        elif args.action == "rm":
            engine.remove_context(*parse_context_spec(args.place))
        return table(engine.contexts())
    if args.verb == "index":
        return ", ".join(f"{k} {n}" for k, n in engine.index(args.chunk_strategy).items())
    if args.verb == "embed":
        if args.force:
            engine.rechunk(args.chunk_strategy)
        return f"embedded {engine.embed(embedder_of(args), args.force)}"
    if args.verb == "get":
        path, line = parse_document_spec(args.spec)
        rows = engine.get(path).select(line_range(F.col("content"), max(args.first, line, 1), args.lines)).collect()
        if rows:
            return rows[0][0]
        near = engine.suggestions(path).select("collection", "path", "doc_id").collect()
        raise CatalogError(f"document not found: {path}" + ("\ndid you mean:\n" + "\n".join(f"  {r[0]}/{r[1]}  #{r[2]}" for r in near) if near else ""))
    if args.verb == "multi-get":
        docs = engine.get_many(args.spec, args.max_bytes)
        return "[" + ",\n".join(r[0] for r in sinks.documents_json(docs).collect()) + "]" if args.json else sinks.documents_text(docs)
    if args.verb == "ls":
        if not args.place:
            return table(engine.collections().select("name", "doc_count"))
        name, _, prefix = args.place.partition("/")
        return table(engine.list_paths(name, prefix).select("path", "doc_id"))
    if args.verb == "chunks":
        return table(engine.chunks_of(args.path).select("seq", "start_pos", "end_pos", F.regexp_replace(F.substring("text", 1, 60), r"\s+", " ")))
    if args.verb == "bench":
        return table(engine.benchmark(args.file, args.mode, embedder_of(args))[1])
    if args.verb == "status":
        return table(engine.status())
    if args.verb == "doctor":
        return "\n".join(f"{'ok ' if good else 'BAD'} {name}" for name, good in engine.doctor().items())
    return ", ".join(f"{k} {n}" for k, n in engine.cleanup().items())


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.verb == "version":
        print(VERSION)
        return 0
    try:
        print(run(Engine(get_session(), args.root, args.index), args))
    except CatalogError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
