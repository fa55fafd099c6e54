"""Files as rows: listing with the rules of the build command, and text reading.

The listing pushes the size limit and the glob to Spark's binaryFile source; extension, folder and ignore rules are
column predicates on the path. Ignore files (.gitignore and a project's own) are read on the driver: one small file
per folder.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import extension

#: Extensions that are read by default, and folders of builds and dependencies that are not entered.
TYPES = ".txt .md .py .js .ts .tsx .jsx .rs .go .java .c .cpp .cc .h .hpp .json .yaml .yml .toml .rb .php .swift .kt .scala .cs".split()
PDF = ".pdf"  # read like the others by a build with an extractor
SKIPPED_FOLDERS = "target node_modules .git __pycache__ venv .venv dist build .next .nuxt vendor Pods .gradle .cache deps _build .elixir_ls .hex priv".split()
MAX_FILE_KB, MAX_JSON_KB = 1024, 10
IGNORE_FILES = (".gitignore", ".indexignore")


def local_path(path: str | Column) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(p, r"^file:/*", "/")


def allowed(path: str | Column, size: str | Column, types: Sequence[str] | None = None, excluded: Sequence[str] = (), max_kb: int = MAX_FILE_KB) -> Column:
    """Deny list before allow list, then the size limit (stricter for .json). Extensions are case-sensitive."""
    ext = extension(path)
    s = F.col(size) if isinstance(size, str) else size
    limit = F.when(ext == ".json", F.lit(MAX_JSON_KB * 1024)).otherwise(F.lit(max_kb * 1024))
    return (ext != "") & ~ext.isin(list(excluded) or [""]) & ext.isin(list(types or TYPES)) & (s <= limit)


def in_skipped_folder(path: str | Column) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return p.rlike("/(" + "|".join(re.escape(x) for x in SKIPPED_FOLDERS) + ")/")


def is_hidden(path: str | Column, root: str = "") -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.substring(p, len(root) + 1, 1 << 20).rlike(r"(^|/)\.[^/]")


def ignore_rules(root: str) -> list[tuple[str, str, bool]]:
    """(folder, pattern, negated) of the user's and the repository's own exclusions and the ignore files under a root."""
    rules = []
    config = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    for path in (os.path.join(config, "git", "ignore"), os.path.join(root, ".git", "info", "exclude")):
        if os.path.isfile(path):
            rules += [(root, *rule) for rule in _rules(path)]
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if n not in SKIPPED_FOLDERS]
        for name in IGNORE_FILES:
            if name in files:
                rules += [(folder, *rule) for rule in _rules(os.path.join(folder, name))]
    return rules


def _rules(path: str) -> list[tuple[str, bool]]:
    with open(path, encoding="utf-8", errors="replace") as f:
        lines = [line.rstrip() for line in f.read().splitlines()]
    return [(line.removeprefix("!"), line.startswith("!")) for line in lines if line and not line.startswith("#")]


def ignored(path: str | Column, rules: list[tuple[str, str, bool]]) -> Column:
    """Later rules win, as in git."""
    p = F.col(path) if isinstance(path, str) else path

    def one(folder: str, pattern: str) -> Column:
        directory = pattern.endswith("/")
        body = pattern.strip("/")
        anchored = "/" in body or pattern.startswith("/")
        rx = "".join("(?:.*/)?" if x == "**/" else ".*" if x == "**" else fnmatch.translate(x)[4:-3].replace(".*", "[^/]*") for x in re.split(r"(\*\*/|\*\*)", body) if x)
        head = "^" + re.escape(folder.rstrip("/")) + "/" + ("" if anchored else "(?:.*/)?")
        return p.rlike(head + rx + ("/.*" if directory else "(?:/.*)?") + "$")

    return reduce(lambda seen, r: F.when(one(r[0], r[1]), F.lit(not r[2])).otherwise(seen), rules, F.lit(False))


def list_files(spark: SparkSession, paths: Sequence[str], types: Sequence[str] | None = None, excluded: Sequence[str] = (), include_hidden: bool = False, max_files: int | None = None, max_kb: int = MAX_FILE_KB, pruned: bool = True) -> DataFrame:
    """path, length of the files to read, in no order. max_files keeps the first in order of path.

    Explicit files obey the extension and size rules but not the folder rules. ``pruned=False`` leaves size and
    folder rules out, as the update command of the original does.
    """
    frames = []
    for root in paths:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(local_path("path").alias("path"), "length")
        local = re.match(r"(?!file:)[A-Za-z][\w+.-]+:", root) is None
        own = os.path.abspath(re.sub(r"^file:/*", "/", root)) if local else root.rstrip("/")
        keep = allowed("path", "length", types, excluded, max_kb if pruned else 1 << 40)
        if not (local and os.path.isfile(own)):
            inside = F.substring("path", len(own) + 1, 1 << 20)
            if pruned:
                keep &= ~in_skipped_folder(inside)
            if not include_hidden:
                keep &= ~is_hidden(inside)
            if local:
                keep &= ~ignored("path", ignore_rules(own))
        frames.append(found.where(keep))
    out = reduce(lambda a, b: a.unionByName(b), frames).distinct()
    return out.orderBy("path").limit(max_files) if max_files else out


def read_texts(spark: SparkSession, files: DataFrame, paths: Sequence[str], pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """path, text of the listed files. Files that are not UTF-8 are left out; PDFs only with an extractor."""
    content = reduce(lambda a, b: a.unionByName(b), [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select(local_path("path").alias("path"), "content") for p in paths])
    rows = content.dropDuplicates(["path"]).join(files.select("path"), "path", "left_semi")
    plain = rows.where(~F.lower("path").endswith(".pdf")).select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("text")).where("text is not null")
    if pdf is None:
        return plain

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(pdf(x) or "").strip() for x in b.column(1).to_pylist()]
            at = [i for i, t in enumerate(texts) if t]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([texts[i] for i in at], pa.string())], names=["path", "text"])

    return plain.unionByName(rows.where(F.lower("path").endswith(".pdf")).select("path", "content").mapInArrow(extract, "path string, text string"))


def extension_stats(chunks: DataFrame, source: str, n: int = 10) -> DataFrame:
    """ext, chunks, files, per_file (whole) of the n commonest extensions, as a build reports them."""
    own = chunks.where(F.col(source).isNotNull())
    stats = own.groupBy(extension(source).alias("ext")).agg(F.count("*").alias("chunks"), F.countDistinct(source).alias("files"))
    return stats.withColumn("per_file", F.expr("chunks div files")).orderBy(F.desc("chunks"), "ext").limit(n)
