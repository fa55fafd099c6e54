"""Problem 8: pages that consist of repeated keywords, link lists or product tags instead of sentences.

A page is cut into stretches (a line, or a sentence of a line). Every two neighbouring words of a stretch have the
pointwise mutual information (PMI) of the counts of the whole corpus, the page's own left out and discounted for
small counts, so a pair that only this page has is worth nothing: n/(n+1) · m/(m+1) · ln(n·N / (f1·f2)), m the
smaller of f1 and f2. A stretch is spam if the mean over its words is below ``INCOHERENT``: word salad, tag and
product lists have neighbours that meet by chance, links hold no words of their own, and a collocation that the page
repeats ``REPEATED`` times or more adds nothing, which brings stuffed keywords down however well they go together.
Two kinds of stretch are excused: sentences (enough function words of several kinds, which repeated sentences also
have) and code, settings, logs and rows of tables, known by their form. A page is flagged if more than half of its words
(runs of letters and digits, those of addresses included) stand in spam stretches.

Scale. Every distinct text is counted once, so copies don't lend each other coherence. The texts are encoded once and
dealt out to blocks of about ``BLOCK_BYTES`` by a hash; a block counts its words and pairs and asks for their totals
by one row each, whatever the number of its pages that have them. The totals are a sum over each word or pair (a hot
one has at most as many rows as there are blocks) and go back to the blocks that asked, so all pairs of the corpus are
used, none is hashed into classes, and nothing is broadcast or brought to the driver.

Defined cases: null, empty and wordless texts are no spam; copies count each; a doc_id that comes twice counts
once; an unclosed tag of a link ends with its line; empty tables give no rows. Texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, join_crowded

BLOCK_BYTES = 8 << 20
#: The mean PMI under which a stretch is incoherent, and the most that one pair adds.
INCOHERENT, MOST = 1.3, 3.0
REPEATED = 3  # a pair that occurs so often in a page is repeated
SENTENCE = 0.16  # share of function words from which a stretch counts as a sentence
SIGNS = 0.3  # share of tokens with signs of code from which a stretch counts as code

#: Function words of the four languages of the corpus.
FUNCTION_WORDS = frozenset(
    """the a an of to and in is it that for on with as are was were be been by at from this these those which or not but so each its
    when if we you i they he she has had have can cannot could our only no all than then there before after while what why how does do did
    into both us will would between more most my your their just also because until still any some here who may must should
    der die das den dem des ein eine einen einem eines einer und ist nicht wir sie es er mit von zu zum zur im in auf für noch wenn auch obwohl
    ob dass so bevor wird war hat haben nun sind als an aus bei nach wie was warum bis um über oder aber nur sich ihr ihre ich du mir man jede
    jeden jeder jedes dieser diese dieses
    le la les un une des du de et est ne pas nous vous il elle on ce cette ces que qui quand si dans sur pour avant après avec se au aux y en
    par plus ou mais son sa ses leur leurs dont puis chaque comme lorsque pourquoi depuis sans me te été
    el los las una unos unas del al y es no con por para lo su sus cuando antes después hay como más pero entre ya le desde este esta esto
    eso aunque todavía mientras cada muy otra otro unos que qué nadie había ha han fue son es ser está dos mismo misma donde tan si
    personne avait ont était sont tout tous toute deux même aussi très il faut elles ils je tu mon ma mes
    niemand hatte hatten etwa wieder erneut jene jener kein keine mehr sehr schon""".split()
)
WORD = re.compile(r"[^\W\d_]+")
RUN = re.compile(r"\w+")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][. ]){2,}[^\W\d_](?![^\W_])")
LINK = re.compile(r"</?a\b[^>\n]*+>?|(?:https?|ftp)://\S+|www\.\S+|\[/?url\b[^\]\n]*+\]?|(?<![\w.-])[\w-]++(?:\.[\w-]++)++/\S*")
STRETCH = re.compile(r"\n+|(?<=[.!?…])[^\S\n]+")
SIGN = re.compile(r"[={}<>\\]|\w_\w|[a-z][A-Z]|\(\)|::|->|\)\.|^[\w.-]+(?:,[\w.-]*){2,}$|^`.*`$")
ANY_SIGN = re.compile(r"[={}<>\\_`(),]|[a-z][A-Z]|::|->")  # one of these is in every sign
LOG = re.compile(r"^\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d")
ROW = re.compile(r"^\s*\|.*\|\s*$")
REMARK = re.compile(r"\s#\s.*")
CODE_LINE = re.compile(r"^\s*(?:import|from|use|package|require|require_relative|include|def|class|fn|pub|func|return|const|let|var|end|else|if|for|while|raise|throw|type|struct|\$|//|#include|```)\b|^\s{4,}\S|[;{}]\s*$|^\t")


def _joined(text: str) -> str:
    """The text with letters that are set apart ("k e y", "k.e.y") joined."""
    return SPACED.sub(lambda m: m[0].replace(".", "").replace(" ", ""), text)


def words(text: str) -> list[str]:
    """Lower-cased words; letters that are set apart make one."""
    return WORD.findall(_joined(text).lower())


def _structured(bare: str) -> bool:
    """Whether a stretch looks like code, settings, a log line or a row of a table. Separators of lists don't count."""
    if LOG.match(bare) or ROW.match(bare) or CODE_LINE.search(bare):
        return True
    if not ANY_SIGN.search(bare):
        return False
    tokens = [t for t in REMARK.sub("", bare).split() if t[0] != "#"]
    signs = counted = 0
    for t in tokens:
        sign = SIGN.search(t.rstrip(";,.:!?")) is not None
        signs += sign
        counted += sign or RUN.search(t) is not None
    return signs > SIGNS * counted


def _sentence(own: list[str], counted: Callable[[], Counter], least: int = 1) -> bool:
    """Whether function words hold the words together.

    There must be enough of them, and of several kinds: a run of keywords that contain some ("base de datos")
    repeats the same few. With fewer than three kinds those inside repeated pairs (of ``counted``) don't count.
    ``least``: kinds that are needed (more for a stretch that is mostly links).
    """
    at = [i for i, w in enumerate(own) if w in FUNCTION_WORDS]
    if not at or len(at) < SENTENCE * len(own):
        return False
    kinds = len({own[i] for i in at})
    if kinds < least:
        return False
    if kinds >= 3:
        return len(at) <= 5 * kinds
    pairs = counted()
    free = [i for i in at if (not i or pairs[own[i - 1], own[i]] < REPEATED) and (i + 1 == len(own) or pairs[own[i], own[i + 1]] < REPEATED)]
    return len(free) >= 0.5 * len(at)


class Page(NamedTuple):
    """The stretches of a text: their words, how many words and runs each has, and whether it is excused."""

    words: list[str]
    sizes: list[int]
    runs: list[int]
    excused: list[bool]


def page(text: str) -> Page:
    parts = []
    spaced = SPACED.search(text) is not None
    for stretch in STRETCH.split(text):
        runs = shown = RUN.findall(stretch)
        if not runs:
            continue
        bare = stretch
        if "/" in stretch or "<" in stretch or "[" in stretch or "www." in stretch:
            bare = LINK.sub(" ", stretch)
            if bare != stretch:
                shown = RUN.findall(bare)
        if spaced:
            own = words(bare)
        else:
            joined = " ".join(shown).lower()
            own = joined.split() if joined.replace(" ", "").isalpha() else WORD.findall(joined)
        parts.append((bare, len(runs), len(runs) - len(shown), own))

    @cache
    def counted() -> Counter:
        pairs: Counter[tuple[str, str]] = Counter()
        for p in parts:
            pairs.update(zip(p[3], p[3][1:]))
        return pairs

    excused = [_sentence(own, counted, 3 if linked > len(own) else 1) or _structured(bare) for bare, _, linked, own in parts]
    return Page([w for p in parts for w in p[3]], [len(p[3]) for p in parts], [p[1] for p in parts], excused)


def _hash(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_ENCODED = "block int, h1 bigint, h2 int, words array<bigint>, sizes array<int>, runs array<int>, excused array<boolean>"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns block, h1, h2, text. A text that comes again in the task is left out."""
    seen: set[tuple[int, int]] = set()
    known: dict[str, int] = {}
    for batch in batches:
        keep, pages = [], []
        for i, key in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        for lo in range(0, len(keep), 1000):
            some = pa.array(keep[lo : lo + 1000], pa.int64())
            pages = [page(t) for t in batch.column(3).take(some).to_pylist()]
            hashes = []
            for p in pages:
                for w in p.words:
                    h = known.get(w)
                    if h is None:
                        h = known[w] = _hash(w)
                    hashes.append(h)
            if len(known) > 400_000:
                known.clear()
            ends = np.cumsum([0, *(len(p.words) for p in pages)], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes, pa.int64()))]
            lists += [pa.array([p[k] for p in pages], pa.list_(t)) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(some) for k in range(3)), *lists], names=["block", "h1", "h2", "words", "sizes", "runs", "excused"])


class Block(NamedTuple):
    """The distinct texts of a block, flattened: per word its text and stretch, per pair where its first word stands."""

    h1: np.ndarray
    h2: np.ndarray
    words: np.ndarray
    runs: np.ndarray
    excused: np.ndarray
    page_of: np.ndarray  # of each stretch
    stretch_of: np.ndarray  # of each word
    first: np.ndarray  # of each pair
    keys: np.ndarray  # of each pair


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def _block(table: pa.Table) -> Block:
    # tasks leave out repeated texts each for itself: here the rest of them
    key = np.stack([table.column("h1").to_numpy(), table.column("h2").to_numpy().astype(np.int64)], 1)
    _, once = np.unique(key, axis=0, return_index=True)
    table = table.take(pa.array(np.sort(once)))
    w, _ = _flat(table, "words")
    sizes, per_page = _flat(table, "sizes")
    runs, _ = _flat(table, "runs")
    excused, _ = _flat(table, "excused")
    w, sizes = w.astype(np.int64), sizes.astype(np.int64)
    stretch_of = np.repeat(np.arange(len(sizes)), sizes)
    first = np.flatnonzero(stretch_of[1:] == stretch_of[:-1])
    page_of = np.repeat(np.arange(table.num_rows), per_page.astype(np.int64))
    return Block(table.column("h1").to_numpy(), table.column("h2").to_numpy(), w, runs.astype(np.int64), excused.astype(bool), page_of, stretch_of, first, pair_keys(w[first], w[first + 1]))


#: The key by which every block asks for the number of words of the corpus.
ALL = 0


def _ask(table: pa.Table) -> pa.Table:
    """A row for each word and pair of the block with its count, and one with the count of all words."""
    b = _block(table)
    w, wn = np.unique(b.words, return_counts=True)
    p, pn = np.unique(b.keys, return_counts=True)
    keys, n = np.concatenate([[ALL], w, p]), np.concatenate([[len(b.words)], wn, pn])
    return pa.table({"block": pa.array(np.full(len(keys), table.column("block")[0].as_py()), pa.int32()), "key": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64())})


def associations(own: np.ndarray, pair: np.ndarray, left: np.ndarray, right: np.ndarray, all_: float) -> np.ndarray:
    """Discounted PMI from the counts of pairs and words, without the page's own pairs; 0 for pairs it alone has."""
    n = np.maximum(pair - own, 0).astype(np.float64)
    left, right = np.maximum(left, 1).astype(np.float64), np.maximum(right, 1).astype(np.float64)
    least = np.minimum(left, right)
    return np.where(n > 0, np.log(np.maximum(n, 1) * max(all_, 1.0) / (left * right)) * n / (n + 1) * least / (least + 1), 0.0)


def _total(keys: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, n[at], 1)


def _judge(pages: pa.Table, totals: pa.Table) -> pa.Table:
    """h1, h2, spam_share, mean_pmi, repeated_share of the texts of a block; totals that are missing are 1."""
    names = ["h1", "h2", "spam_share", "mean_pmi", "repeated_share"]
    if not pages.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), *[pa.float64()] * 3)], names=names)
    b = _block(pages)
    order = np.argsort(totals.column("key").to_numpy())
    keys, n = totals.column("key").to_numpy()[order], totals.column("total").to_numpy()[order]
    count = len(b.h1)
    stretches = len(b.runs)
    if len(b.keys):
        page = b.page_of[b.stretch_of[b.first]]
        by = np.lexsort((b.keys, page))
        new = np.concatenate([[True], (np.diff(page[by]) != 0) | (np.diff(b.keys[by]) != 0)])
        no = np.cumsum(new) - 1
        own = np.empty(len(by), dtype=np.int64)
        own[by] = np.bincount(no)[no]
        every, where = np.unique(b.words, return_inverse=True)
        f = _total(keys, n, every)[where]
        value = associations(own, _total(keys, n, b.keys), f[b.first], f[b.first + 1], float(_total(keys, n, np.array([ALL]))[0]))
        again = own >= REPEATED
        held = np.bincount(b.stretch_of[b.first], np.where(again, 0.0, np.minimum(value, MOST)), stretches)
        pairs = np.maximum(np.bincount(page, minlength=count), 1)
        mean, repeated = np.bincount(page, value, count) / pairs, np.bincount(page, again, count) / pairs
    else:
        held, mean, repeated = np.zeros(stretches), np.zeros(count), np.zeros(count)
    spam = ~b.excused & (held < INCOHERENT * np.maximum(b.runs - 1, 1))
    all_ = np.maximum(np.bincount(b.page_of, b.runs, count), 1)
    share = np.bincount(b.page_of, b.runs * spam, count) / all_
    return pa.table([pa.array(b.h1, pa.int64()), pa.array(b.h2, pa.int32()), share, mean, repeated], names=names)


def score_pages(docs: DataFrame) -> DataFrame:
    """doc_id, spam_share, mean_pmi, repeated_share, is_spam of every document."""
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"))
    size = docs.agg(F.ceil(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / BLOCK_BYTES).alias("n"))
    blocks = F.greatest(F.lit(1), size.scalar())
    texts = rows.where("text is not null and text <> ''").select(F.pmod("h1", blocks).cast("int").alias("block"), "h1", "h2", "text")
    encoded = texts.mapInArrow(_encode, _ENCODED)
    asked = encoded.groupBy("block").applyInArrow(_ask, "block int, key bigint, n bigint")
    totals = asked.withColumn("total", F.expr("sum(n) over (partition by key)")).where("total > 1").select("block", "key", "total")
    measured = "h1 bigint, h2 int, spam_share double, mean_pmi double, repeated_share double"
    scored = checkpointed(encoded.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_judge, measured))
    columns = ["spam_share", "mean_pmi", "repeated_share"]
    found = join_crowded(rows.select("doc_id", "h1", "h2"), scored, ["h1", "h2"])
    out = found.groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in columns])
    return out.withColumn("is_spam", F.col("spam_share") > 0.5)
