"""Chunkers: byte-exact prose chunks and code-aware chunks, as pure functions and as table functions of Spark.

Sizes are in tokens of four bytes. The prose chunker cuts at the last white space under the limit, trims, and starts
the next chunk the overlap before the cut. The code chunker finds blocks by line patterns of the language, keeps the
first of overlapping ones, splits oversized blocks by lines and adds the gaps before blocks as context; it falls
back to prose without language or blocks. ``keep_tail`` also keeps what follows the last block and oversized gaps.

Defined cases: null text gives no chunk, empty text one empty chunk; text under the limit is one untrimmed chunk; an
overlap as large as a chunk is left out for that chunk; an oversized block ends with its last line.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.functions.text import LANGUAGES

TOKEN_BYTES = 4
#: White space as Unicode defines it (a fixed value).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = re.compile(f"[{SPACES}]")

#: Per language, kind of block and the line that opens it (group 1 is its name).
BLOCKS: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("function", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"),
        ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"),
        ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"),
        ("impl", r"^\s*impl(?:<[^>]+>)?\s+(?:(\w+)|for\s+(\w+))"),
        ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)"),
        ("mod", r"^\s*(?:pub\s+)?mod\s+(\w+)\s*\{"),
    ],
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "javascript": [
        ("function", r"^\s*(?:async\s+)?function\s+(\w+)"),
        ("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"),
        ("class", r"^\s*(?:export\s+)?class\s+(\w+)"),
        ("method", r"^\s*(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{"),
        ("arrow", r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>"),
    ],
    "go": [("function", r"^\s*func\s+(?:\([^)]+\)\s+)?(\w+)"), ("struct", r"^\s*type\s+(\w+)\s+struct"), ("interface", r"^\s*type\s+(\w+)\s+interface")],
    "java": [
        ("class", r"^\s*(?:public\s+)?(?:abstract\s+)?class\s+(\w+)"),
        ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"),
        ("method", r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:\w+(?:<[^>]+>)?)\s+(\w+)\s*\("),
    ],
    "c": [("function", r"^\s*(?:\w+(?:\s*\*)?)\s+(\w+)\s*\([^)]*\)\s*\{?"), ("class", r"^\s*class\s+(\w+)"), ("struct", r"^\s*struct\s+(\w+)")],
    "ruby": [("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)"), ("method", r"^\s*def\s+(\w+)")],
    "other": [("function", r"^\s*(?:def|func|function)\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
}
BLOCKS |= {"typescript": BLOCKS["javascript"], "cpp": BLOCKS["c"]}
_RULES = {k: [(kind, re.compile(rx)) for kind, rx in v] for k, v in BLOCKS.items()}


@dataclass
class Chunk:
    text: str
    chunk_type: str
    chunk_index: int | None = None
    block_type: str | None = None
    name: str | None = None
    language: str | None = None
    start_line: int | None = None
    end_line: int | None = None
    part: int | None = None


@dataclass
class CodeBlock:
    """Lines [start_line, end_line), counted from 0."""

    block_type: str
    name: str
    start_line: int
    end_line: int


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def simple_chunks(text: str, size: int, overlap: int) -> list[Chunk]:
    limit, back = size * TOKEN_BYTES, overlap * TOKEN_BYTES
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= limit:
        return [Chunk(text, "simple", 0)]
    offsets = [0]  # byte offset of every character, and of the end
    for ch in text:
        offsets.append(offsets[-1] + _size(ch))
    spaces = [offsets[m.start()] for m in SPACE.finditer(text)]
    floor = lambda at: offsets[bisect_right(offsets, at) - 1]
    out: list[Chunk] = []
    start = 0
    while start < len(raw):
        end = floor(min(start + limit, len(raw)))
        cut = end
        if end < len(raw):
            i = bisect_right(spaces, end - 1) - 1
            if i >= 0 and spaces[i] >= start:
                cut = spaces[i]
        if cut <= start:
            start = offsets[bisect_right(offsets, start)]
            continue
        piece = raw[start:cut].decode("utf-8", "surrogatepass").strip(SPACES)
        if piece:
            out.append(Chunk(piece, "simple", len(out)))
        follow = floor(cut - back if cut > start + back else cut)
        follow = follow if follow > start else cut
        if follow >= len(raw) or cut >= len(raw):
            break
        start = follow
    return out


def _indent(line: str) -> int:
    return _size(line) - _size(line.lstrip(SPACES))


def _end_by_indent(lines: list[str], start: int) -> int:
    base = _indent(lines[start])
    for i in range(start + 1, len(lines)):
        if lines[i].strip(SPACES) and _indent(lines[i]) <= base:
            return i
    return len(lines)


def _end_by_braces(lines: list[str], start: int) -> int:
    depth, opened = 0, False
    for i in range(start, len(lines)):
        for ch in re.findall(r"[{}]", lines[i]):
            depth += 1 if ch == "{" else -1
            opened |= ch == "{"
            if opened and depth == 0 and ch == "}":
                return i + 1
    return min(start + 50, len(lines))


def code_blocks(lines: list[str], language: str) -> list[CodeBlock]:
    """Blocks by their first line, in order of the patterns; of overlapping ones the first stays."""
    ends = _end_by_indent if language in ("python", "ruby") else _end_by_braces
    found = []
    for kind, rx in _RULES.get(language, _RULES["other"]):
        for i, line in enumerate(lines):
            if m := rx.search(line):
                found.append(CodeBlock(kind, m.group(1) or "anonymous", i, ends(lines, i)))
    kept: list[CodeBlock] = []
    taken: list[tuple[int, int]] = []
    for b in sorted(found, key=lambda b: b.start_line):
        if not taken or b.start_line >= max(e for _, e in taken):
            kept.append(b)
            taken.append((b.start_line, b.end_line))
    return kept


def _lines(text: str) -> list[str]:
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return [x.removesuffix("\r") for x in lines]


def code_chunks(text: str, path: str, size: int, overlap: int, keep_tail: bool = False) -> list[Chunk]:
    language = LANGUAGES.get(path.rsplit("/", 1)[-1].rpartition(".")[2])
    lines = _lines(text)
    blocks = code_blocks(lines, language) if language else []
    if not blocks:
        return simple_chunks(text, size, overlap)
    limit, step_back = size * TOKEN_BYTES, overlap * TOKEN_BYTES // 80
    out: list[Chunk] = []
    for b in blocks:
        content = "\n".join(lines[b.start_line : b.end_line])
        if _size(content) <= limit:
            out.append(Chunk(content, "ast", None, b.block_type, b.name, language, b.start_line + 1, b.end_line))
            continue
        at, part = b.start_line, 0
        while at < b.end_line:
            first, length, taken = at, 0, []
            while at < b.end_line and length < limit:
                taken.append(lines[at])
                length += _size(lines[at]) + 1
                at += 1
            out.append(Chunk("\n".join(taken), "ast", None, b.block_type, f"{b.name}_part{part}", language, first + 1, at, part))
            part += 1
            if at >= b.end_line:
                break
            at = max(at - step_back, first + 1)
    before = 0
    for b in [*blocks, *([CodeBlock("", "", len(lines), len(lines))] if keep_tail else [])]:
        if b.start_line > before:
            gap = "\n".join(lines[before : b.start_line])
            if _size(gap.strip(SPACES)) > 20 and (_size(gap) <= limit or keep_tail):
                out += [Chunk(c.text, "context", start_line=before + 1, end_line=b.start_line) for c in simple_chunks(gap, size, overlap)]
        before = b.end_line
    return sorted(out, key=lambda c: c.start_line or 0)


def chunk_text(text: str | None, path: str, size: int = 256, overlap: int = 128, strategy: str = "auto", keep_tail: bool = False) -> list[Chunk]:
    """Chunks by strategy: simple, ast, or auto (by extension)."""
    if strategy not in ("simple", "ast", "auto"):
        raise ValueError(f"unknown chunking strategy: {strategy}")
    if text is None:
        return []
    known = (path or "").rsplit("/", 1)[-1].rpartition(".")[2] in LANGUAGES
    if strategy == "simple" or strategy == "auto" and not known:
        return simple_chunks(text, size, overlap)
    return code_chunks(text, path or "", size, overlap, keep_tail)


CHUNK_COLUMNS = "ordinal int, text string, chunk_type string, chunk_index int, block_type string, name string, language string, start_line int, end_line int, part int"
_FIELDS = ["text", "chunk_type", "chunk_index", "block_type", "name", "language", "start_line", "end_line", "part"]


def chunk_table(docs: DataFrame, keys: list[str], text: str = "text", path: str | None = None, size: int = 256, overlap: int = 128, strategy: str = "auto", keep_tail: bool = False) -> DataFrame:
    """keys plus one row per chunk, in one pass without exchange (Arrow batches)."""
    schema = StructType([*docs.select(*keys).schema.fields, *StructType.fromDDL(CHUNK_COLUMNS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            texts, paths = batch.column("_text").to_pylist(), batch.column("_path").to_pylist()
            for i, (t, p) in enumerate(zip(texts, paths)):
                for no, c in enumerate(chunk_text(t, p or "", size, overlap, strategy, keep_tail)):
                    at.append(i)
                    rows.append((no, c))
            own = batch.select(keys).take(pa.array(at, pa.int64()))
            columns = [pa.array([no for no, _ in rows], pa.int32())]
            for f in _FIELDS:
                kind = pa.string() if f in ("text", "chunk_type", "block_type", "name", "language") else pa.int32()
                columns.append(pa.array([getattr(c, f) for _, c in rows], kind))
            yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=[*keys, "ordinal", *_FIELDS])

    source = docs.select(*keys, F.col(text).alias("_text"), (F.col(path) if path else F.lit("")).alias("_path"))
    return source.mapInArrow(run, schema)


class ChunkFunction:
    """Table function for SQL: SELECT … FROM docs, LATERAL chunk_text(text, path, 256, 128, 'auto')."""

    def eval(self, text: str, path: str, size: int, overlap: int, strategy: str):
        for no, c in enumerate(chunk_text(text, path or "", size, overlap, strategy)):
            yield (no, *[getattr(c, f) for f in _FIELDS])


def register(spark) -> None:
    spark.udtf.register("chunk_text", F.udtf(ChunkFunction, returnType=CHUNK_COLUMNS))
