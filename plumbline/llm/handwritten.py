"""Problem 3: source files that nobody wrote by hand here: generated, minified, third-party copies, data as code.

A file is what the chunks of one metadata.source hold. Every chunk gives partial sums (compressed and plain bytes,
token entropy, identifier lengths, comment and line statistics), which are added up per file, so a file of any size
never comes into one task. A random forest is trained on these features. Its labels are weak: notices in comments
(generated by, do not edit, mirrored from, ...; also statements that a file is kept by hand) and file names
by convention (.min.js, _pb2, _data). What makes labels is hidden from the features. Files without a label count as
hand-written in the training, and both kinds weigh the same.

The verdict on a file is that of the forest, unless the file says that it is kept by hand, with one exception. A third-party copy is written by hand, only elsewhere:
its text has the same features as any other, so no forest over such features can know it (see the README for
figures). Therefore a file that says of itself as a whole where it comes from is taken at its word, and a file in a
folder that by convention holds third-party code is a copy. The column ``known_by`` tells which it was.

The forest is fitted on at most ``SAMPLE_FILES`` files; features and verdicts cover all.

Defined cases: chunks without readable source belong to no file; documentation, settings and files of unknown kind
are no cases; of a repeated chunk the latest arrival counts; empty files are no cases; without labels of both kinds
there is no forest and only statements and folders decide; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed

SAMPLE_FILES = 12_000
TREES, DEPTH = 40, 8
LEAST_SCORE = 0.5

#: Extensions of program code.
CODE = frozenset("rs py pyi js mjs cjs jsx ts tsx go java kt scala rb c h cc cpp hpp cs php swift m mm lua pl r dart vue css scss sql".split())
#: Notices of files that were not written here, and of files that were.
NOTICE = re.compile(
    r"(?i)code generated by|\bdo not (?:edit|modify)\b|@generated\b|<auto-?generated|\bauto-?generated\b|automatically generated|machine[ -](?:written|generated)|generated (?:from|by|with|on)\b"
    r"|changes will be (?:lost|overwritten)|regenerate with|\boutput of [\w.-]*\s*(?:compiler|generator|codegen|tool)"
    r"|nicht von hand|automatisch erzeugt|ne pas (?:modifier|[ée]diter)|g[ée]n[ée]r[ée] automatiquement|no editar|no modificar|creado por \S+ \d|generado por"
    r"|imported from upstream|mirrored from|send fixes upstream|\bvendored\b|bundled here|local changes will be overwritten|redistribution (?:is allowed|and use)|\bpublic domain\b|third[- ]party copy|copied from \S+ (?:release|version|v?\d)"
    r"|unmodified copy of|taken from https?:|übernommen aus|bitte nicht ändern|copi[ée]e? (?:de|depuis) \S+ (?:v?\d|version)|sans modification|copia (?:exacta|sin cambios|de \S+ v?\d)|tomado de|sin modificar"
)
HAND = re.compile(r"(?i)\bnot generated\b|\b(?:maintained|written|edited|chosen|kept) by hand\b")
SPOKEN = re.compile(r"\"[^\"]*\"")  # what a comment quotes is not said of the file
FOLDERS = frozenset("vendor _vendor node_modules third_party thirdparty 3rdparty external extern pods bower_components site-packages dist-packages upstream jspm_packages deps carthage __generated__ generated gen autogen codegen".split())
STEM = re.compile(r"(?:\.(?:min|bundle|chunk|pb|g|freezed)|[._-](?:pb2|pb2_grpc|gen|generated|designer|autogen|codegen)|-[0-9a-f]{8,}|[-_.]v?\d+\.\d+\.\d+)$")
DATA_STEM = re.compile(r"(?:^|[._-])(?:data|dataset|words|wordlist|fixtures?|tables?|blob|font|lookup|corpus|dict|samples|weights)$")
COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--|;|<!--|\"\"\"|''')")
TOKEN = re.compile(r"[A-Za-z_]\w*|\d\w*|[^\w\s]")
IDENTIFIER = re.compile(r"[A-Za-z_]\w*")
SUMS = ["bytes", "packed", "lines", "comments", "line_squares", "tokens", "entropy", "identifiers", "letters", "short_names", "numbered", "digits", "spaces", "shapes", "literals", "quoted", "chunks"]
FEATURES = ["compression", "entropy", "identifier_length", "short_names", "numbered", "comment_density", "line_length", "line_spread", "digit_share", "space_share", "shape_share", "literal_share", "quoted_share", "tokens_per_line"]


@lru_cache(1 << 16)
def kind_of(path: str) -> tuple[bool, bool]:
    """(lies in a folder for third-party code, is named like a file that is not written by hand)."""
    parts = path.lower().split("/")
    stem = parts[-1].rpartition(".")[0]
    return bool(FOLDERS & set(parts[:-1])), bool(STEM.search(stem) or DATA_STEM.search(stem))


def measure(text: str) -> tuple[list[float], bool, bool]:
    """(sums of a chunk, has a notice, says it is by hand). Comments with a notice are left out of the sums."""
    notice = hand = False
    kept = []
    for line in text.split("\n"):
        if line.lstrip()[:1] and (COMMENT.match(line) or line.startswith("/*!")):
            said = SPOKEN.sub("", line)
            if HAND.search(said):
                hand = True
                continue
            if NOTICE.search(said):
                notice = True
                continue
        kept.append(line)
    body = "\n".join(kept)
    raw = body.encode("utf-8", "replace")
    tokens = TOKEN.findall(body)
    n = len(tokens)
    entropy = -sum(c * math.log2(c / n) for c in Counter(tokens).values()) if n else 0.0
    names = [t for t in tokens if t[0].isalpha() or t[0] == "_"]
    full = [k for k in kept if k.strip()]
    shapes = len({re.sub(r"\d+", "0", IDENTIFIER.sub("a", k)) for k in full})
    digits = sum(map(body.count, "0123456789"))
    return (
        [
            float(len(raw)), float(len(zlib.compress(raw, 1))) if raw else 0.0, float(len(full)), float(sum(1 for k in full if COMMENT.match(k))), float(sum(len(k) ** 2 for k in full)),
            float(n), entropy, float(len(names)), float(sum(map(len, names))), float(sum(1 for t in names if len(t) <= 2)), float(sum(1 for t in names if t[-1].isdigit())),
            float(digits), float(sum(map(body.count, " \t\n"))), float(shapes), float(sum(1 for t in tokens if t[0].isdigit())), float(body.count('"') + body.count("'")), 1.0,
        ],
        notice,
        hand,
    )


def files_of(chunks: DataFrame) -> DataFrame:
    """source, is_named, notice, hand and the features of each file of program code."""
    parts = ", ".join(f"{c} double" for c in SUMS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in batch.column(3).to_pylist()]
            kinds = [kind_of(s) for s in batch.column(2).to_pylist()]
            flags = [pa.array([k[i] for k in kinds], pa.bool_()) for i in range(2)] + [pa.array([r[i] for r in rows], pa.bool_()) for i in (1, 2)]
            sums = [pa.array([r[0][k] for r in rows], pa.float64()) for k in range(len(SUMS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *flags, *sums], names=["chunk_id", "ingested_at", "source", "foreign_folder", "named", "notice", "hand", *SUMS])

    # only texts of program code go to the workers
    code = chunks.where("chunk_id is not null and text <> ''").select("chunk_id", "ingested_at", F.get_json_object("metadata", "$.source").alias("source"), "text")
    code = code.where(F.col("source").rlike(r"(?i)\.(?:" + "|".join(sorted(CODE)) + ")$"))
    measured = code.mapInArrow(scan, f"chunk_id bigint, ingested_at timestamp, source string, foreign_folder boolean, named boolean, notice boolean, hand boolean, {parts}")
    newest = F.struct(F.coalesce(F.col("ingested_at"), F.timestamp_micros(F.lit(0).cast("long"))), "source")
    payload = ["source", "foreign_folder", "named", "notice", "hand", *SUMS]
    one = measured.groupBy("chunk_id").agg(F.max_by(F.struct(*payload), newest).alias("m")).select("m.*")
    total = one.groupBy("source").agg(*[F.max(c).alias(c) for c in ("foreign_folder", "named", "notice", "hand")], *[F.sum(c).alias(c) for c in SUMS])

    def per(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1.0))

    mean = per("bytes", "lines")
    return total.where("bytes > 0").select(
        "source", "named", "notice", "hand", "foreign_folder",
        per("packed", "bytes").alias("compression"), per("entropy", "tokens").alias("entropy"), per("letters", "identifiers").alias("identifier_length"), per("short_names", "identifiers").alias("short_names"),
        per("numbered", "identifiers").alias("numbered"), per("comments", "lines").alias("comment_density"), mean.alias("line_length"), F.sqrt(F.greatest(F.lit(0.0), per("line_squares", "lines") - mean * mean)).alias("line_spread"),
        per("digits", "bytes").alias("digit_share"), per("spaces", "bytes").alias("space_share"), per("shapes", "lines").alias("shape_share"), per("literals", "tokens").alias("literal_share"), per("quoted", "bytes").alias("quoted_share"), per("tokens", "lines").alias("tokens_per_line"),
    )


def judge_files(chunks: DataFrame) -> DataFrame:
    """source, forest (its probability), notice, named, hand, known_by (forest, notice, folder), elsewhere (the verdict)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    files = checkpointed(files_of(chunks))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(files)
    # files in folders for third-party code and files that look like data but have no telling name get no label
    unsure = F.col("foreign_folder") | (F.col("literal_share") > 0.25) | (F.col("line_length") > 140)
    label = F.when(F.col("hand"), 0.0).when(F.col("notice") | F.col("named"), 1.0).when(unsure, F.lit(None)).otherwise(0.0)
    counts = files.agg(F.count(label).alias("n"), F.sum(label).alias("yes")).first()
    n, yes = counts["n"], counts["yes"] or 0.0
    if 0 < yes < n:
        share = min(1.0, SAMPLE_FILES / n)
        sample = vectors.withColumn("label", label).where(F.pmod(F.xxhash64("source", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).where("label is not null").select("features", "label")
        # both kinds weigh the same
        sample = sample.withColumn("weight", F.when(F.col("label") > 0, 0.5 * n / yes).otherwise(0.5 * n / (n - yes)))
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, subsamplingRate=0.7, featureSubsetStrategy="sqrt", weightCol="weight", seed=17).fit(sample)
        scored = forest.transform(vectors).withColumn("forest", vector_to_array("probability")[1])
    else:
        scored = vectors.withColumn("forest", F.lit(0.0))
    known_by = F.when(F.col("hand"), None).when(F.col("forest") >= LEAST_SCORE, "forest").when(F.col("notice"), "notice").when(F.col("foreign_folder"), "folder")
    out = scored.select("source", "forest", "notice", "named", "foreign_folder", "hand", known_by.alias("known_by"), *FEATURES)
    return out.withColumn("elsewhere", F.col("known_by").isNotNull())
