"""Commands: build, update, search, ask, react, serve, mcp, list, remove, prune, config."""

from __future__ import annotations

import argparse
import json
import os
import sys

from plumbline import config as cfg
from plumbline import sinks
from plumbline.catalog import BuildOptions, Catalog, IndexMeta
from plumbline.operators import rag
from plumbline.operators.search import SearchOptions

META_COLUMNS = ("source", "chunk_type", "chunk_index", "block_type", "name", "language", "start_line", "end_line", "part")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def files(c: argparse.ArgumentParser, strategy: str) -> None:
        c.add_argument("index_name")
        c.add_argument("--docs", nargs="+", default=["."])
        c.add_argument("--doc-chunk-size", type=int, default=256)
        c.add_argument("--doc-chunk-overlap", type=int, default=128)
        c.add_argument("--file-types", nargs="*")
        c.add_argument("--exclude-types", nargs="*", default=[])
        c.add_argument("--include-hidden", action="store_true")
        c.add_argument("--chunking-strategy", choices=["simple", "ast", "auto"], default=strategy)
        c.add_argument("--max-files", type=int)
        c.add_argument("--max-file-size-kb", type=int, default=1024)

    b = sub.add_parser("build")
    files(b, "simple")
    b.add_argument("--backend-name", choices=["exact", "ivf", "hnsw", "diskann"], default="exact")
    b.add_argument("--embedding-model", default="hashing")
    b.add_argument("--embedding-mode", choices=sorted(["hashing", "openai", "ollama", "gemini", "local"]), default="hashing")
    b.add_argument("--embedding-host")
    b.add_argument("--embedding-api-base")
    b.add_argument("--embedding-api-key")
    b.add_argument("--embedding-prompt-template")
    b.add_argument("--embedding-batch-size", type=int)
    b.add_argument("--dimensions", type=int, default=64)
    b.add_argument("--graph-degree", type=int, default=32)
    b.add_argument("--complexity", type=int, default=64)
    b.add_argument("--force", action="store_true")
    b.add_argument("--recompute", action="store_true")
    files(sub.add_parser("update"), "auto")

    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("-i", "--index", required=True)
    s.add_argument("-k", "--top-k", type=int, default=5)
    s.add_argument("--complexity", type=int, default=64)
    s.add_argument("--show-metadata", action="store_true")
    s.add_argument("--filter")
    s.add_argument("--hybrid", action="store_true")
    s.add_argument("--auto-hybrid", action=argparse.BooleanOptionalAction, default=True)
    s.add_argument("--expand", action=argparse.BooleanOptionalAction, default=True)
    s.add_argument("--hybrid-alpha", type=float, default=0.7)
    s.add_argument("--format", choices=["text", "json", "markdown"], default="text")
    s.add_argument("--query-prompt-template")

    for name, k in (("ask", 5), ("react", 3)):
        a = sub.add_parser(name)
        a.add_argument("query", nargs="?")
        a.add_argument("-i", "--index", required=True)
        a.add_argument("--llm", choices=sorted(rag.MODELS), default="ollama")
        a.add_argument("--model")
        a.add_argument("-k", "--top-k", type=int, default=k)
        a.add_argument("--complexity", type=int, default=64)
        a.add_argument("--max-steps", type=int, default=5)
        a.add_argument("--interactive", action="store_true")

    v = sub.add_parser("serve")
    v.add_argument("--index", required=True)
    v.add_argument("--port", type=int, default=8080)
    v.add_argument("--host", default="127.0.0.1")
    v.add_argument("--cors", action="store_true")
    sub.add_parser("mcp")
    sub.add_parser("list").add_argument("--detailed", action="store_true")
    r = sub.add_parser("remove")
    r.add_argument("index_name")
    r.add_argument("--force", action="store_true")
    q = sub.add_parser("prune")
    q.add_argument("index_name")
    q.add_argument("--yes", action="store_true")
    c = sub.add_parser("config")
    c.add_argument("action", choices=["show", "init", "path"])
    c.add_argument("--force", action="store_true")
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("plumbline").getOrCreate()


def build_options(a: argparse.Namespace) -> BuildOptions:
    e = {"host": getattr(a, "embedding_host", None), "base_url": getattr(a, "embedding_api_base", None), "api_key": getattr(a, "embedding_api_key", None), "batch_size": getattr(a, "embedding_batch_size", None)}
    return BuildOptions(a.doc_chunk_size, a.doc_chunk_overlap, a.chunking_strategy, a.file_types, a.exclude_types, a.include_hidden, a.max_files, a.max_file_size_kb, getattr(a, "embedding_prompt_template", None), getattr(a, "recompute", False), getattr(a, "force", False), {k: v for k, v in e.items() if v is not None})


def chat(find, model, read=input, write=print, record: str | None = None) -> None:
    """/help, /clear, /history and /quit; other lines are questions. Earlier answers aren't sent to the model.

    Questions are appended to the file ``record`` if there is one.
    """
    history: list[tuple[str, str]] = []
    while True:
        try:
            line = read("> ").strip()
        except (EOFError, KeyboardInterrupt):
            return
        if line in ("/quit", "/exit", "/q"):
            return
        if line in ("/help", "/h", "/?"):
            write("/help /clear /history /quit")
        elif line in ("/clear", "/c"):
            history.clear()
        elif line in ("/history",):
            for q, a in history:
                write(f"Q: {q}\nA: {a}")
        elif line:
            if record:
                os.makedirs(os.path.dirname(record) or ".", exist_ok=True)
                with open(record, "a", encoding="utf-8") as f:
                    f.write(line + "\n")
            history.append((line, rag.ask(line, find, model)))
            write(history[-1][1])


def main(argv: list[str] | None = None, catalog: Catalog | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "config":
        path = cfg.default_path()
        print(path if a.action == "path" else cfg.Config.load(path).shown() if a.action == "show" else f"written: {cfg.init(path, a.force)}")
        return 0
    cat = catalog or Catalog(session())
    if a.command == "build":
        meta = IndexMeta(backend_name=a.backend_name, embedding_model=a.embedding_model, embedding_mode=a.embedding_mode, dimensions=a.dimensions, backend_kwargs={"graph_degree": a.graph_degree, "complexity": a.complexity})
        print(f"{cat.build(a.index_name, a.docs, meta, build_options(a)).passage_count} passages")
    elif a.command == "update":
        print(f"{cat.update(a.index_name, a.docs, build_options(a)).passage_count} passages")
    elif a.command == "search":
        o = SearchOptions(a.top_k, a.complexity, a.filter, a.hybrid, a.hybrid_alpha, a.query, a.auto_hybrid)
        found = cat.search(a.index, a.query, o, a.expand, a.query_prompt_template)
        shown = META_COLUMNS if a.show_metadata or a.format != "text" else ()
        print({"text": sinks.to_text, "json": sinks.to_json, "markdown": sinks.to_markdown}[a.format](found, shown))
    elif a.command in ("ask", "react"):
        model = rag.MODELS[a.llm](**({"model": a.model} if a.model else {}))
        find = lambda q: cat.search(a.index, q, SearchOptions(a.top_k, a.complexity))
        if a.command == "react":
            print(rag.react(a.query, find, model, a.max_steps, print if a.verbose else None))
        elif a.interactive or not a.query:
            chat(find, model, record=os.path.join(os.path.dirname(cfg.default_path()), "history.txt"))
        else:
            print(rag.ask(a.query, find, model))
    elif a.command == "serve":
        from plumbline.server import serve

        serve(cat, a.index, a.host, a.port, a.cors)
    elif a.command == "mcp":
        from plumbline.server import mcp

        mcp(cat, sys.stdin, sys.stdout)
    elif a.command == "list":
        for row in cat.list():
            print(json.dumps(row) if a.detailed else f"{row['name']} {row['status']}")
    elif a.command == "remove":
        found = cat.places(a.index_name)
        folder = None
        if len(found) > 1 and not a.force:
            print("\n".join(f"{i}. {f}" for i, f in enumerate(found, 1)))
            folder = found[int(input("which one: ")) - 1]
        cat.remove(a.index_name, a.force, None if a.force else input("name of the index: "), folder)
    elif a.command == "prune":
        if not a.yes and input("drop the stored vectors? [y/N] ").strip().lower() not in ("y", "yes"):
            print("nothing done")
        else:
            print("pruned" if cat.prune(a.index_name) else "nothing to prune")
    return 0


if __name__ == "__main__":
    sys.exit(main())
