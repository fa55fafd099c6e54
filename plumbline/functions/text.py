"""Text functions as Spark columns: tokens, words, terms, code symbols, extensions, byte lengths, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never become expansion terms.
STOPWORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might must shall can need dare ought used "
    "to of in for on with at by from as into through during before after above below between under again further then once here there when "
    "where why how all each few more most other some such no nor not only own same so than too very just and but if or because until while "
    "this that these those it its i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself they them their theirs themselves what which who whom any both also about like using based within without"
).split()

#: Words that count as code.
CODE_WORDS = (
    "let const var fn func def pub mut impl struct enum type trait class interface async await return match case break continue loop while for "
    "if else elif try catch throw import export from require module use mod self super true false null none nil void int str bool float vec map "
    "set list dict assert assert_eq println print printf console log"
).split()

#: Where a definition names a symbol (group 1), for Rust, Python, JavaScript, Go, Java and C#.
SYMBOL_PATTERNS = [
    r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)",
    r"(?:pub\s+)?struct\s+(\w+)",
    r"(?:pub\s+)?enum\s+(\w+)",
    r"(?:pub\s+)?trait\s+(\w+)",
    r"(?:async\s+)?def\s+(\w+)",
    r"class\s+(\w+)",
    r"(?:async\s+)?function\s+(\w+)",
    r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(",
    r"func\s+(?:\([^)]+\)\s+)?(\w+)",
    r"type\s+(\w+)\s+(?:struct|interface)",
    r"(?:public|private|protected)?\s*(?:static\s+)?(?:class|interface)\s+(\w+)",
]

#: Language of a file extension.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala", "cs": "csharp",
}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: str | Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased, of two or more characters; null gives null."""
    runs = F.regexp_extract_all(_c(text), F.lit("[a-zA-Z0-9]+"), F.lit(0))
    return F.filter(F.transform(runs, F.lower), lambda t: F.length(t) > 1)


def words(text: str | Column) -> Column:
    """Lower-case runs of Unicode letters and digits."""
    return F.filter(F.split(F.lower(_c(text)), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")


def query_words(text: str | Column) -> Column:
    """Runs without Unicode white space."""
    return F.filter(F.split(_c(text), r"\p{IsWhite_Space}+"), lambda w: w != "")


def is_short_query(text: str | Column) -> Column:
    """Three words or fewer: such queries are expanded and searched in hybrid mode by default."""
    return F.size(query_words(text)) <= 3


def looks_like_code(term: str | Column) -> Column:
    t = _c(term)
    return t.contains("_") | (t.rlike("[0-9]") & t.rlike(r"\p{IsAlphabetic}")) | t.isin(CODE_WORDS)


def is_key_term(term: str | Column) -> Column:
    """At least four bytes, no stopword, not all digits, nothing that looks like code."""
    t = _c(term)
    return (F.octet_length(t) >= 4) & ~t.isin(STOPWORDS) & ~t.rlike(r"^\p{N}+$") & ~looks_like_code(t)


def symbols(text: str | Column) -> Column:
    """Names of definitions, once per pattern that finds them; short, private and test names are left out."""
    found = F.concat(*[F.regexp_extract_all(_c(text), F.lit("(?U)" + p), F.lit(1)) for p in SYMBOL_PATTERNS])
    return F.filter(found, lambda s: (F.octet_length(s) >= 3) & ~s.startswith("test_") & ~s.startswith("_"))


def extension(path: str | Column) -> Column:
    """Extension with its dot; '' without one."""
    return F.regexp_extract(_c(path), r"[^/](\.[^./]+)$", 1)


def language(path: str | Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[F.substring(extension(path), 2, 100)]


def preview(text: str | Column, size: int) -> Column:
    """At most ``size`` characters, then an ellipsis."""
    t = _c(text)
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit("..."))).otherwise(t)
