"""Text, path and number expressions that the operators share. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Question words that carry no meaning for a search.
STOP_WORDS = (
    "how", "does", "the", "is", "a", "an", "in", "to",
    "of", "and", "or", "what", "where", "when", "why",
    "which", "this", "that", "with", "for", "from", "are",
    "do", "it", "be", "has", "have", "was", "were", "been",
    "can", "could", "would", "should", "will", "may", "might",
    "not", "but", "if", "then", "so", "about", "up", "out",
    "on", "at", "by", "into", "all", "my", "its", "no", "i",
)

SEPARATORS = r"""[\s_\\\-./,:;!?'"()\[\]{}]+"""

#: Extensions by kind of file. Fixed values.
KINDS_OF_FILE = {
    "code": ("py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "go", "rs", "java", "rb", "c", "h", "cc", "cpp", "hpp", "cs", "kt", "scala", "php", "swift", "lua", "zig", "ex", "exs", "jl", "ps1", "m", "mm", "toc"),
    "document": ("md", "txt", "rst", "docx", "xlsx"),
    "paper": ("pdf",),
    "image": ("png", "jpg", "jpeg", "gif", "svg", "webp"),
    "audio": ("mp3", "wav", "flac", "ogg", "aac", "m4a"),
    "video": ("mp4", "mov", "avi", "mkv", "webm"),
}


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Words of an identifier or a sentence: camel case split, lower case, of two characters or more."""
    split = F.split(F.lower(F.regexp_replace(c(text), "([a-z])([A-Z])", "$1 $2")), SEPARATORS)
    return F.filter(split, lambda t: F.length(t) > 1)


def question_tokens(text: Column | str) -> Column:
    """Tokens without stop words, order and repeats kept."""
    return F.filter(tokens(text), lambda t: ~t.isin(*STOP_WORDS))


def match_count(token: Column, labels: Column) -> Column:
    """How many label tokens begin with ``token`` or begin it."""
    return F.size(F.filter(labels, lambda t: t.startswith(token) | token.startswith(t)))


def slug(*parts: Column | str) -> Column:
    """An identifier: parts without edge ``_`` and ``.``, joined, other characters as ``_``, lower case."""
    trimmed = [F.regexp_replace(c(p), r"^[_.]+|[_.]+$", "") for p in parts]
    joined = F.regexp_replace(F.concat_ws("_", *trimmed), "[^A-Za-z0-9]+", "_")
    return F.lower(F.regexp_replace(joined, "^_+|_+$", ""))


def round_half_up(x: Column, places: int = 2) -> Column:
    """``floor(x * 10^n + 0.5) / 10^n`` on doubles, which differs from SQL's round on values like 0.285."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(c(path), "/"), -1)


def top_directory(path: Column | str) -> Column:
    """The first part of a path with a slash, else the path."""
    return F.element_at(F.split(c(path), "/"), 1)


def extension(path: Column | str) -> Column:
    """Lower-case text behind the last dot; empty without one."""
    return F.when(c(path).contains("."), F.lower(F.element_at(F.split(c(path), r"\."), -1))).otherwise("")


def file_category(path: Column | str) -> Column:
    """code, paper, image, audio, video or doc by extension."""
    ext = extension(path)
    out = F.lit("doc")
    for kind in ("video", "audio", "image", "paper", "code"):
        out = F.when(ext.isin(*KINDS_OF_FILE[kind]), kind).otherwise(out)
    return out


def line_range(location: Column | str) -> Column:
    """``L10-L20`` or ``L10`` as a struct of first and last line; null for anything else."""
    first = F.regexp_extract(c(location), r"^L(\d+)(?:-L?(\d+))?$", 1)
    last = F.regexp_extract(c(location), r"^L(\d+)(?:-L?(\d+))?$", 2)
    span = F.struct(first.cast("int").alias("first"), F.when(last == "", first).otherwise(last).cast("int").alias("last"))
    return F.when(first != "", span)


def escape_xml(text: Column | str) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(c(text), F.lit(a), F.lit(b))
    return c(text)


def escape_cypher(text: Column | str) -> Column:
    return F.replace(F.replace(c(text), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def sanitized(text: Column | str, longest: int = 256) -> Column:
    """Without control characters, and no longer than ``longest``."""
    return F.left(F.regexp_replace(c(text), r"[\x00-\x1f\x7f]", ""), F.lit(longest))


def words_in(text: Column | str) -> Column:
    return F.size(F.filter(F.split(c(text), r"\s+"), lambda w: w != ""))


def title_words(text: Column | str) -> Column:
    """A name as words: camel case and separators split, each word capitalised."""
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(c(text), r"\(\)$", ""), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.initcap(F.trim(F.regexp_replace(spaced, "[^A-Za-z0-9]+", " ")))


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a of a string's UTF-16 code units, for strings of ASCII."""
    units = F.transform(F.split(c(text), ""), lambda ch: F.ascii(ch).cast("long"))
    step = lambda h, u: (h.bitwiseXOR(u) * F.lit(16777619)) % F.lit(1 << 32)
    return F.aggregate(F.filter(units, lambda u: u > 0), F.lit(2166136261).cast("long"), step)


def all_of(*conditions: Column) -> Column:
    return reduce(Column.__and__, conditions)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 for empty, unequal or zero ones."""
    a, b = c(a), c(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)
