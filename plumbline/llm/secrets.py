"""Problem 5: credentials in texts of chunks and contents of code blocks, and the texts with them masked.

1. Candidates: every literal of ``LEAST_LENGTH`` characters or more, of any length, with the name it is given to,
   if it has one (assignments in any of the languages, attributes, tags, prose that sets a value), values in command
   lines, addresses and headers, and private key blocks. None is ruled out before it is scored.
2. Features: the likelihood of the characters under a Markov chain whose transitions are counted over all texts,
   shape and classes of the characters, words of the surrounding identifiers, the kind of place, and the path.
3. A logistic regression is fitted to weak labels: patterns of known key formats, addresses with a password,
   private keys and mixed values given to a name that ends in a word for secrets are positive; placeholders,
   references, checksums, ids, plain addresses, prose and words are negative.
   Other candidates have no label and take no part in the fit. The sample it is fitted on has at most
   ``SAMPLE_ITEMS`` items, and of their plain words one in ``PLAIN_ONE_IN``; the Markov chain, the candidates and the scores cover all texts.
4. The scores are calibrated on held-out weak labels (Platt scaling); candidates at or above ``LEAST_SCORE`` are
   credentials. Masking replaces the characters of the value by asterisks and leaves quotes, line breaks and
   lengths as they are.

Defined cases: null and empty texts have no credentials; null or broken metadata gives no path features; of a
repeated item only the latest arrival counts; lines end at \\n only; empty tables give no rows. Texts are read whole.
Without weak labels of both kinds nothing can be learnt: then only the places that hold nothing but credentials count
(private keys, addresses, headers, command lines), if their value is no placeholder, reference or mask.
"""

from __future__ import annotations

import base64
import binascii
import json
import math
import re
import zlib
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ITEMS = 30_000
LEAST_SCORE = 0.5
PLAIN_ONE_IN = 8  # of the literals that are labelled as plain words or plain names, this share is in the sample (by a hash)
LEAST_CELL = 20  # patterns with fewer rows weigh less
LEAST_LENGTH = 4
TEXTS = 500  # that are scored together

#: Words of names that hold secrets, of names that hold none, and of names about secrets.
SECRET_WORDS = frozenset(
    "password passwd passwort kennwort pass pwd pw secret token bearer credential credentials auth passphrase apikey contrasena clave geheimnis motdepasse passe jeton".split()
)
PLAIN_WORDS = frozenset(
    "checksum sha sha1 sha256 sha512 md5 etag commit revision digest integrity uuid guid id trace request run object hash fingerprint version icon image color colour url public verify label title name file path field count max min tokens limit size dsn source".split()
)
SECRET_NAME = re.compile(r"(?:api|access|secret|auth|signing|private|encryption|account)key$|motdepasse|passwo?r?d$|passphrase$|secret$|authtoken$|apitoken$|accesstoken$|bearer$|kennwort$|rootpw$|dbpass$")
PLAIN_KEYS = frozenset("cache primary foreign sort partition public object map dict row index group shard".split())
SKIPPED_NAMES = frozenset("str string char const value is to set here as static final let var pub private export uint8_t byte bytes text content data default the name key literal".split())

IDENTIFIER = re.compile(r"[A-Za-z_$][\w$-]*")
NAME_PART = re.compile(r"[\w$-]")
NAME = r"[A-Za-z_$][\w.$-]*"
QUOTE = re.compile(r"""["'`]""")
QUOTED = re.compile(r"""(["'`])((?:\\.|(?!\1)[^\n\\])*+)\1""")
APOSTROPHE = re.compile(r"(?<=\w)(?<!\b[bBrRfFuUnNeExX])(?<!\b(?:[rR][bB]|[bB][rR]|[fF][rR]|[rR][fF]))'(?=\w)")
MORE = re.compile(r"""[ \t]*(?:\+|\.|,|\\)?[ \t]*(?:\r?\n[ \t]*(?:[+.\\][ \t]*)?)?(["'`])((?:\\.|(?!\1)[^\n\\]){4,}?)\1""")
BARE = re.compile(rf"^[ \t]*(?:[#;*/-]+[ \t]*)?(?:export[ \t]+|set[ \t]+)?({NAME})[ \t]*[=:][ \t]*([^\s\"'`<>(){{}}\[\],;]{{4,}})[ \t]*(?:[#;].*)?\r?$", re.M)
TAGGED = re.compile(rf"<({NAME})>([^<>\s]{{4,}})</")
USERINFO = re.compile(r"\b([A-Za-z][A-Za-z0-9+.-]*)://([^\s:/@\"'`<>]*):([^\s/@\"'`<>]+)@[\w.-]")
SCHEME = re.compile(r"\b(Basic|Bearer|Token)[ \t]+([A-Za-z0-9._~+/=:*!#$%^&@?-]{8,})")
PRIVATE = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_END = re.compile(r"-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
COMMAND = re.compile(
    r"(?:--?(?:pass(?:word|wd|phrase)?|token|secret|api-?key)[= ]|(?:mysql|mysqldump|mariadb|sshpass)\b[^\n]*?\s-p)[\"']?([^\s\"'`]{4,})"
    r"|\s(?:-u|--user)[= ][\"']?[^\s:\"']+:([^\s\"'`]{4,})"
    r"|(?i:identified by|with password)\s+['\"]([^'\"\n]{4,})['\"]"
    r"|(?i:\blog-?in\b|\bcredentials?\b)[^:\n]{0,60}:[ \t]*[^\s/]+[ \t]*/[ \t]*([^\s\"'`]{4,})"
    r"|(?i:\(|, |\buser \S+[, ]+)(?i:pass|password|pwd|pw|passwort|kennwort)[ :=]+([^\s),;\"'`]{4,})"
)
#: Formats of keys that their issuers document.
KNOWN = re.compile(
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bgithub_pat_\w{22,}|\bxox[abeoprs]-[0-9A-Za-z-]{20,}|\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"
    r"|\bAIza[0-9A-Za-z_-]{35}|\bsk-(?:proj-|ant-)?[0-9A-Za-z_-]{20,}|\beyJ[0-9A-Za-z_-]{8,}={0,2}\.eyJ[0-9A-Za-z_-]{8,}={0,2}\.[0-9A-Za-z_-]{8,}|\bglpat-[0-9A-Za-z_-]{20,}|\bSG\.[\w-]{16,}\.[\w-]{16,}"
)
REFERENCE = re.compile(r"\$\{[^}]*\}|\$\([^)]*\)|%\(\w+\)|\{\{.*\}\}|^<[^<>]+>$|^\$[A-Za-z_]\w*$|^%\w+%$|^(?:vault|env|ssm|secret|secrets|file|arn|keychain|op|kms|aws|gcp|sops)[:/]|^(?:os\.|process\.|getenv|System\.|ENV\b)")
MASKED = re.compile(r"\*{3,}|[xX]{6,}|\.{3,}|•{3,}|#{4,}|_{5,}|-{6,}$|^(.)\1+$")
HOLDER = re.compile(
    r"(?i)(?:^|[\W_])(?:your|my)[\W_]|change[\W_]?(?:me|this|it)|replace[\W_]?(?:me|this|with)|(?:^|[\W_])(?:todo|fixme|tbd|placeholder|dummy|redacted)(?:$|[\W_])|(?:^|[\W_])(?:insert|enter|put)[\W_]|goes[\W_]?here|fill[\W_]?in|not[\W_]?set"
    r"|^(?:none|null|nil|test|n/a|unset|removed|hidden|example|sample)$|(?:example|sample|fake|dummy)[\W_]?(?:key|secret|token|password|value)|(?:key|secret|token|password)[\W_]?(?:example|here)"
)
BLOB = re.compile(r"^[A-Za-z0-9+/]{64,}={0,2}$")
UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
HEX = re.compile(r"^[0-9a-fA-F]+$")
SETTINGS = re.compile(r"\.(?:env|ini|ya?ml|toml|properties|conf|cfg|json|xml|local|sh|tf)$")
SUBWORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
PATH = re.compile(r"^(?:[a-z0-9_.@~-]*/)+[\w.@-]*$|^[a-z][a-z0-9-]*(?:\.[a-z][a-z0-9-]*)+$")
URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://")


#: Words that values consist of which are names about secrets.
META_WORDS = SECRET_WORDS | {"api", "key", "field", "smtp", "root", "db", "client"}
#: Patterns of weak_label that most literals of a corpus have.
PLAIN = (7, 10)
#: Classes of bytes: 1 digits, 2 capitals, 3 small letters, 0 others.
CLASS_OF = np.zeros(256, dtype=np.int8)
CLASS_OF[48:58], CLASS_OF[65:91], CLASS_OF[97:123] = 1, 2, 3
#: Kinds of places that hold nothing but credentials.
PLACES = ("private", "userinfo", "basic", "scheme", "command")


class Candidate(NamedTuple):
    start: int
    end: int  # of the value; of a private key start is that of its first marker, end that of its body
    kind: str
    name: str
    value: str


def _name_before(text: str, at: int) -> str:
    """The last name of the line before a place, however far it is; words of declarations don't count."""
    line = text.rfind("\n", 0, at) + 1
    width = 120
    while True:
        begin = max(line, at - width)
        names = IDENTIFIER.findall(text, begin, at)
        if begin > line and names and IDENTIFIER.match(text, begin) and NAME_PART.match(text, begin - 1):
            names = names[1:]  # cut by the window
        for n in reversed(names):
            if n.lower() not in SKIPPED_NAMES:
                return n
        if begin == line:
            return ""
        width *= 4


def subwords(name: str) -> list[str]:
    return [w.lower() for w in SUBWORD.findall(name)]


@lru_cache(1 << 16)
def name_kind(name: str) -> tuple[bool, bool, bool]:
    """(ends in a word for secrets, has one, has a word of names that hold none).

    What a name means is said by its last word: a password field or a token limit is no secret.
    """
    own = subwords(name)
    while len(own) > 1 and own[-1].isdigit():
        own.pop()
    joined = "".join(own)
    key = own[-1:] == ["key"] and not PLAIN_KEYS & set(own)
    head = own[-1:] != [] and own[-1] in SECRET_WORDS or SECRET_NAME.search(joined) is not None or key
    return head, head or not SECRET_WORDS.isdisjoint(own), not PLAIN_WORDS.isdisjoint(own)


def secret_name(name: str) -> bool:
    """Whether a word of the name is one for secrets."""
    return name_kind(name)[1]


def literals(text: str) -> Iterator[re.Match[str]]:
    """Literals of any length, so that no closing quote is taken for an opening one. They end in their line."""
    at, open_until = 0, {}
    while q := QUOTE.search(text, at):
        at = q.end()
        if q.start() < open_until.get(q[0], 0) or q[0] == "'" and APOSTROPHE.match(text, q.start()):
            continue
        if m := QUOTED.match(text, q.start()):
            yield m
            at = m.end()
        else:  # unclosed: nor is any later one of its kind in the line
            end = text.find("\n", at)
            open_until[q[0]] = len(text) if end < 0 else end


def candidates(text: str) -> list[Candidate]:
    """Places that may disclose a credential, in order and without overlap."""
    out: list[Candidate] = []
    taken: list[tuple[int, int]] = []  # sorted, without overlap

    def add(a: int, b: int, kind: str, name: str, value: str) -> None:
        at = bisect(taken, (a, b))
        if not (at and taken[at - 1][1] > a or at < len(taken) and taken[at][0] < b):
            taken.insert(at, (a, b))
            out.append(Candidate(a, b, kind, name, value))

    if "PRIVATE KEY" in text:
        for m in PRIVATE.finditer(text):
            end = PRIVATE_END.search(text, m.end())
            add(m.start(), end.start() if end else len(text), "private", "private_key", text[m.end() : end.start() if end else len(text)])
    if "://" in text:
        for m in USERINFO.finditer(text):
            add(m.start(3), m.end(3), "userinfo", _name_before(text, m.start()), m[3])
    for m in SCHEME.finditer(text):
        add(m.start(2), m.end(2), "basic" if m[1] == "Basic" else "scheme", "authorization", m[2])
    for m in COMMAND.finditer(text):
        g = m.lastindex
        add(m.start(g), m.end(g), "command", "password", m[g])
    for m in KNOWN.finditer(text):
        add(m.start(), m.end(), "known", _name_before(text, m.start()), m[0])
    for m in literals(text):
        value, end, last = m[2], m.end(2), m.end()
        if len(value) < LEAST_LENGTH:
            continue
        while more := MORE.match(text, last):
            if re.fullmatch(r"[ \t]*,[ \t]*", text[last : more.start(1)]) and not text[: m.start()].endswith("concat!("):
                break
            value, end, last = value + more[2], more.end(2), more.end()
        add(m.start(2), end, "quoted", _name_before(text, m.start()), value)
    for rx, kind in ((BARE, "bare"), (TAGGED, "tagged")):
        for m in rx.finditer(text):
            add(m.start(2), m.end(2), kind, m[1], m[2])
    return sorted(out)


def _about_secrets(value: str) -> bool:
    """Whether a value is itself only a name about secrets."""
    shown = subwords(value)
    return bool(shown) and set(shown) <= META_WORDS


def _address(value: str) -> bool:
    return value.startswith(("/", "./", "data:", "ssh-", "sha256-", "sha384-", "sha512-")) or URL.match(value) is not None or PATH.match(value) is not None


def weak_label(c: Candidate) -> tuple[int, int] | None:
    """(1: a credential or 0: none, number of the pattern that says so); None: unknown."""
    v = c.value
    for no, holder in enumerate((REFERENCE, MASKED, HOLDER)):
        if holder.search(v):
            return 0, no
    if c.kind in ("private", "userinfo"):
        return 1, 3
    if c.kind == "basic":
        try:
            return (1, 4) if b":" in base64.b64decode(v + "=" * (-len(v) % 4), validate=True) else None
        except (binascii.Error, ValueError):
            return None
    if KNOWN.fullmatch(v):
        return 1, 5
    if c.kind not in ("quoted", "bare", "tagged"):
        return None
    head, any_, plain = name_kind(c.name)
    if _address(v) or _about_secrets(v):
        return 0, 6
    if v.count(" ") >= 2 or not any_ and (" " in v or v.isalpha()):
        return 0, 7
    if not any_ and (plain or HEX.match(v) or UUID.match(v) or BLOB.match(v)):
        return 0, 8 if HEX.match(v) or UUID.match(v) else 9 if BLOB.match(v) else 10
    if head and len(v) >= 8 and " " not in v and any(ch.isdigit() for ch in v) and any(ch.isalpha() for ch in v):
        return 1, 11
    return None


def _letters(values: list[str], chain: np.ndarray) -> np.ndarray:
    """Per value: mean log likelihood and entropy of its bytes, shares of digits, capitals and small letters (ASCII)."""
    raw = [v.encode("utf-8", "replace") or b"\0" for v in values]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    all_ = np.frombuffer(b"".join(raw), dtype=np.uint8)
    of = np.repeat(np.arange(len(raw)), sizes)
    step = chain[all_[:-1], all_[1:]] * (of[1:] == of[:-1])
    likely = np.where(sizes > 1, np.bincount(of[:-1], step, len(raw)) / np.maximum(sizes - 1, 1), -3.0)
    cells, counts = np.unique(of * 256 + all_, return_counts=True)
    own = cells >> 8
    share = counts / sizes[own]
    entropy = np.bincount(own, -share * np.log2(share), len(raw))
    kind = CLASS_OF[all_]
    return np.stack([likely, entropy, *(np.bincount(of, kind == k, len(raw)) / sizes for k in (1, 2, 3))], axis=1)


def features_of(found: list[Candidate], sources: list[str], chain: np.ndarray) -> np.ndarray:
    """A row of numbers for each candidate; which format a value has is not among them."""
    letters = _letters([c.value for c in found], chain)
    rows = []
    for c, source, (likely, entropy, digits, upper, lower) in zip(found, sources, letters.tolist()):
        v = c.value
        n = max(1, len(v))
        head, any_, plain = name_kind(c.name)
        settings, tests, docs = path_kind(source)
        bare = c.kind == "bare"
        rows.append((
            1.0, likely, entropy, math.log(n), digits, upper, lower, 1.0 - digits - upper - lower,
            likely < -3.6, entropy > 3.5 and n >= 16, n < 8, min(v.count(" "), 5),
            HEX.match(v) is not None, UUID.match(v) is not None, v.isalpha(), digits > 0 and upper + lower > 0,
            head, any_ and not head, plain, not any_ and not plain,
            REFERENCE.search(v) is not None, MASKED.search(v) is not None, HOLDER.search(v) is not None, _about_secrets(v), _address(v), n > 200,
            c.kind in PLACES, bare, bare and not settings, settings, tests, docs,
        ))
    return np.array(rows, dtype=float)


def features(c: Candidate, source: str, chain: np.ndarray) -> list[float]:
    return features_of([c], [source], chain)[0].tolist()


@lru_cache(1 << 14)
def path_kind(source: str) -> tuple[bool, bool, bool]:
    """(settings, tests, documentation)"""
    path = source.lower()
    return SETTINGS.search(path) is not None, "/test" in path or "fixture" in path, path.endswith((".md", ".rst", ".txt")) or "/docs/" in path


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-5, rounds: int = 40) -> np.ndarray:
    """Coefficients of an L2-penalised logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * penalty * weight.sum()
    ridge[0, 0] *= 0.01
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge @ beta
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h + 1e-9 * np.eye(len(beta)), g)
        beta -= step
        if np.abs(step).max() < 1e-7:
            break
    return beta


class Model(NamedTuple):
    chain: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    beta: np.ndarray
    scale: float
    shift: float

    def scores(self, found: list[Candidate], source: str | list[str]) -> np.ndarray:
        """``source``: that of all candidates, or one for each."""
        x = features_of(found, [source] * len(found) if isinstance(source, str) else source, self.chain)
        z = ((x - self.mean) / self.spread) @ self.beta
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def train(rows: list[tuple[int, int, list[float]]], chain: np.ndarray) -> Model:
    """rows: (weak label, pattern, features). A fifth is held out for calibration.

    Both labels weigh the same, and so do the patterns of a label, each apart for names of secrets and for others,
    so the many plain literals don't drown the few placeholders.
    """
    width = len(features(Candidate(0, 6, "quoted", "x", "abcdef"), "", chain))
    if len({r[0] for r in rows}) < 2:  # nothing to learn from
        beta = np.zeros(width)
        beta[0], beta[20:23], beta[26] = -2.0, -4.0, 4.0
        return Model(chain, np.zeros(width), np.ones(width), beta, 1.0, 0.0)
    y = np.array([r[0] for r in rows], dtype=float)
    x = np.array([r[2] for r in rows])
    cell = 2 * np.array([r[1] for r in rows]) + (x[:, 16] + x[:, 17] > 0)
    weight = 1.0 / np.maximum(np.bincount(cell), LEAST_CELL)[cell]
    for label in (0.0, 1.0):
        weight[y == label] *= 0.5 * len(y) / weight[y == label].sum()
    mean, spread = x.mean(0), x.std(0)
    mean[0], spread[spread < 1e-9] = 0.0, 1.0
    x = (x - mean) / spread
    x[:, 0] = 1.0
    spread[0] = 1.0
    held = np.arange(len(y)) % 5 == 0
    beta = fit(x[~held], y[~held], weight[~held])
    z = x[held] @ beta
    platt = fit(np.stack([np.ones_like(z), z], 1), y[held], weight[held], penalty=1e-2) if len(set(y[held])) > 1 else np.array([0.0, 1.0])
    return Model(chain, mean, spread, beta, float(max(platt[1], 0.1)), float(platt[0]))


def _source(metadata: str | None) -> str:
    try:
        return str((json.loads(metadata) or {}).get("source") or "") if metadata else ""
    except (ValueError, AttributeError):
        return ""


def all_items(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """item_kind, item_id, text, meta (JSON or path), ingested_at of chunks and blocks."""
    a = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text", F.col("metadata").alias("meta"), "ingested_at")
    b = blocks.select(F.lit("block").alias("item_kind"), F.col("block_id").alias("item_id"), F.col("content").alias("text"), F.to_json(F.struct("source")).alias("meta"), "ingested_at")
    return a.unionByName(b).where("item_id is not null")


def chain_of(items: DataFrame) -> np.ndarray:
    """Log likelihoods of byte transitions, counted over all texts (a table of 65,536 cells, whatever the corpus)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            raw = np.frombuffer("\n".join(t for t in batch.column(0).to_pylist() if t).encode("utf-8", "replace"), dtype=np.uint8)
            for lo in range(0, max(0, len(raw) - 1), 1 << 22):
                part = raw[lo : lo + (1 << 22) + 1].astype(np.int32)
                total += np.bincount(part[:-1] * 256 + part[1:], minlength=1 << 16)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "n": pa.array(total[cells], pa.int64())})

    table = items.select("text").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.full(1 << 16, 0.5)
    n[table.column("cell").to_numpy()] += table.column("n").to_numpy()
    n = n.reshape(256, 256)
    return np.log(n / n.sum(1, keepdims=True))


def learn(items: DataFrame) -> Model:
    chain = chain_of(items)
    total = items.count()
    share = min(1.0, SAMPLE_ITEMS / max(1, total))
    picked = items.where(F.pmod(F.xxhash64("item_kind", "item_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                ys, found, sources = [], [], []
                for text, meta in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for c in candidates(text) if text else []:
                        if (y := weak_label(c)) is not None and (y[1] not in PLAIN or zlib.crc32(c.value.encode("utf-8", "replace")) % PLAIN_ONE_IN == 0):
                            ys.append(y)
                            found.append(c)
                            sources.append(_source(meta))
                if found:
                    xs = pa.array(features_of(found, sources, chain).tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*(pa.array([y[k] for y in ys], pa.int32()) for k in range(2)), xs], names=["y", "pattern", "x"])

    table = picked.select("text", "meta").mapInArrow(label, "y int, pattern int, x array<double>").toArrow()
    rows = sorted(zip(*(table.column(k).to_pylist() for k in ("y", "pattern", "x"))))
    return train(rows, chain)


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with all characters of the spans but line breaks replaced by asterisks."""
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], re.sub(r"[^\r\n]", "*", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def find(items: DataFrame, model: Model | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """item_kind, item_id, line_no, start, length (characters), place, score of each credential."""
    return _latest_only(_scan(items, model or learn(items), least, False), items).drop("ingested_at")


def redact(items: DataFrame, model: Model | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """item_kind, item_id, masked (number of credentials), text of the items in which some are masked."""
    return _latest_only(_scan(items, model or learn(items), least, True), items).drop("ingested_at")


def _scan(items: DataFrame, model: Model, least: float, masked: bool) -> DataFrame:
    shared = items.sparkSession.sparkContext.broadcast(model)
    keys = "item_kind string, item_id bigint, ingested_at timestamp, "
    schema = keys + ("masked int, text string" if masked else "line_no int, start int, length int, place string, score double")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, TEXTS) for b in batches for lo in range(0, b.num_rows, TEXTS)):
            texts = batch.column(3).to_pylist()
            found, of, sources = [], [], []
            for i, (text, meta) in enumerate(zip(texts, batch.column(4).to_pylist())):
                own = candidates(text) if text else []
                if own:
                    found += own
                    of += [i] * len(own)
                    sources += [_source(meta)] * len(own)
            kept: dict[int, list[tuple[Candidate, float]]] = {}
            for c, i, score in zip(found, of, shared.value.scores(found, sources).tolist() if found else []):
                if score >= least:
                    kept.setdefault(i, []).append((c, score))
            at, rows = [], []
            for i, own in kept.items():
                text = texts[i]
                if masked:
                    at.append(i)
                    rows.append((len(own), mask(text, [(PRIVATE.match(text, c.start).end() if c.kind == "private" else c.start, c.end) for c, _ in own])))
                else:
                    for c, score in own:
                        at.append(i)
                        rows.append((text.count("\n", 0, c.start) + 1, c.start, c.end - c.start, c.kind, score))
            keys_ = batch.select(["item_kind", "item_id", "ingested_at"]).take(pa.array(at, pa.int64()))
            names = ["masked", "text"] if masked else ["line_no", "start", "length", "place", "score"]
            types = [pa.int32(), pa.string()] if masked else [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*keys_.columns, *columns], names=["item_kind", "item_id", "ingested_at", *names])

    return items.select("item_kind", "item_id", "ingested_at", "text", "meta").mapInArrow(scan, schema)


def _latest_only(found: DataFrame, items: DataFrame) -> DataFrame:
    """Findings in the latest arrival of each item; rows repeated with the same arrival count once."""
    newest = items.groupBy("item_kind", "item_id").agg(F.max("ingested_at").alias("newest"), F.count("*").alias("n")).where("n > 1")
    joined = found.join(newest, ["item_kind", "item_id"], "left")
    return joined.where("newest is null or ingested_at <=> newest").drop("newest", "n").distinct()
