"""Text expressions: canonical form, stable hashes and splits, tokens, lexicons."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typographic quotes and dashes, and what they count as.
CURLY, STRAIGHT = "‘’“”–—", "''\"\"--"
# Bands of the three-way split, in percent.
TRAIN_BELOW, VALIDATION_BELOW = 70, 85


def normalise_text(text: Column) -> Column:
    """Fold quotes and dashes, lower-case, collapse white space, strip final ``.!?``; all in the JVM."""
    plain = F.lower(F.translate(text, CURLY, STRAIGHT))
    return F.regexp_replace(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")), r"[.!?\s]+$", "")


#: Rows of a batch that are Python strings at one time.
AT_ONCE = 64


@F.arrow_udf(T.StringType())
def normalise_unicode(text: pa.Array) -> pa.Array:
    """The same with NFKC and full case folding, for which Spark has no expression. Of a batch, few texts at a time are Python strings."""
    straight = str.maketrans(CURLY, STRAIGHT)

    def form(t: str) -> str:
        plain = unicodedata.normalize("NFKC", t).translate(straight).casefold()
        return re.sub(r"[.!?\s]+$", "", re.sub(r"\s+", " ", plain).strip())

    pieces = (text.slice(i, AT_ONCE) for i in range(0, len(text), AT_ONCE))
    return pa.concat_arrays([pa.array([None if t is None else form(t) for t in p.to_pylist()], pa.string()) for p in pieces] or [pa.array([], pa.string())])


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def hash_int(key: Column) -> Column:
    """The first 32 bits of SHA-256, as a long."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long")


def salted(key: Column, salt: str = "") -> Column:
    return F.concat_ws(":", F.lit(salt), key) if salt else key.cast("string")


def stable_bucket(key: Column, buckets: int, salt: str = "") -> Column:
    """Bucket of a key; adding other keys never moves it."""
    return F.pmod(hash_int(salted(key, salt)), F.lit(buckets))


def assign_split(key: Column, salt: str = "") -> Column:
    """train, val or test by percent bands."""
    bucket = stable_bucket(key, 100, salt)
    return F.when(bucket < TRAIN_BELOW, "train").when(bucket < VALIDATION_BELOW, "val").otherwise("test")


def assign_fold(key: Column, folds: int, fold: int, salt: str = "") -> Column:
    """Bucket ``fold`` is test, the next one val, the others train."""
    bucket = stable_bucket(key, folds, salt)
    return F.when(bucket == fold, "test").when(bucket == (fold + 1) % folds, "val").otherwise("train")


def fragment_id(library: Column, normal: Column) -> Column:
    return F.concat_ws(":", library, F.substring(F.sha1(normal), 1, 8))


def cluster_key(tag: Column, normal: Column) -> Column:
    """The tag, or the normalised text where there is none."""
    return F.coalesce(F.nullif(tag, F.lit("")), normal)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9']+"))


def whitespace_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def fold_token(word: Column) -> Column:
    """Apostrophes straightened, lower-cased, edge punctuation stripped."""
    return F.regexp_replace(F.lower(F.translate(word, CURLY, STRAIGHT)), r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")


def word_parts(text: Column) -> Column:
    """Array of (prefix, word, suffix) of the white-space-separated chunks."""
    part = lambda i: lambda w: F.regexp_extract(w, r"^(\W*)(.*?)(\W*)$", i)
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.struct(part(1)(w).alias("prefix"), part(2)(w).alias("word"), part(3)(w).alias("suffix")))


def bounded(term: str) -> str:
    """Pattern of a term at word boundaries."""
    return r"\b" + "".join("\\" + c if c in r"\.^$*+?()[]{}|-" else c for c in term) + r"\b"


def lexicon_hits(text: Column, terms: list[str]) -> Column:
    """Sorted array of the terms that occur in lower-cased ``text``."""
    return F.array_compact(F.array(*[F.when(text.rlike(bounded(t)), F.lit(t)) for t in sorted(terms)]))


def cooccurrence(text: Column, anchors: list[str], modifiers: list[str]) -> Column:
    """``a/b+c/d`` of the anchors and modifiers present, null unless there is one of each."""
    a, m = lexicon_hits(text, anchors), lexicon_hits(text, modifiers)
    return F.when((F.size(a) > 0) & (F.size(m) > 0), F.concat_ws("+", F.array_join(a, "/"), F.array_join(m, "/")))


def assemble(parts: Column) -> Column:
    """Sentences joined by a space; each ends in ``.`` unless it ends in ``.!?``."""
    trimmed = F.transform(parts, lambda x: F.trim(x))
    return F.array_join(F.transform(trimmed, lambda x: F.when(x.rlike(r"[.!?]$"), x).otherwise(F.concat(x, F.lit(".")))), " ")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def visible_text(html: Column) -> Column:
    """Tags removed, white space collapsed; empty for markup without text."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", ""), r"\s+", " "))


# What cleaned markup may hold, and what a kept link says of where it leads.
KEPT_TAGS = ("p", "strong", "em", "a", "ul", "ol", "li", "br")
LINK_REL = "noopener noreferrer"
#: Parts that go with what they hold: comments, declarations, scripts and styles, up to their end or the text's.
DROPPED = [r"(?s)<!--.*?(-->|\z)", r"(?is)<script[\s/>].*?(</script[^>]*>|\z)", r"(?is)<style[\s/>].*?(</style[^>]*>|\z)", r"(?s)<[!?][^>]*(>|\z)"]
#: A tag whose quotes are closed, a run of text, or a lone angle bracket.
PIECE = r"""<[a-zA-Z/](?:"[^"]*"|'[^']*'|[^<>"'])*>|[^<]+|<"""
ATTRIBUTE = r"""[^\s"'=<>/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>`]+))?"""
#: Addresses of the two schemes, and relative ones; a colon or reference before the path might hide another scheme.
KEPT_ADDRESS = r"^(?i)(?:https?:|[/?#]|[^:&\x00-\x20]*$)"
ENTITY = r"&(#?[a-zA-Z0-9]+;)"


def escaped(text: Column) -> Column:
    """Text whose angle brackets and bare ampersands are written as references; references stay."""
    kept = F.regexp_replace(text, ENTITY, "\x01$1")
    return F.replace(F.replace(F.replace(F.replace(kept, F.lit("&"), F.lit("&amp;")), F.lit("\x01"), F.lit("&")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _attribute(attributes: Column, name: str) -> Column:
    """The first value of an attribute without its quotes; null if there is none."""
    own = F.try_element_at(F.filter(attributes, lambda a: a.rlike(rf"^(?i){name}\s*=")), F.lit(1))
    value = F.regexp_replace(own, r"^[^=]*=\s*", "")
    return F.when(value.rlike("""^["']"""), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def clean_html(html: Column) -> Column:
    """Markup reduced to ``KEPT_TAGS``, with address and target of links; everything else is dropped but for its text.

    Tags come out in lower case and without other attributes, links with addresses of other schemes
    without an address. What is no complete tag is text. Tags are not balanced. Null stays null.
    """
    bare = F.replace(html, F.lit("\x01"), F.lit(""))
    for pattern in DROPPED:
        bare = F.regexp_replace(bare, pattern, "")
    quoted = lambda v: F.replace(escaped(v), F.lit('"'), F.lit("&quot;"))

    def cleaned(piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, r"^</?([a-zA-Z]+)(?:[\s/>])", 1))
        attributes = F.regexp_extract_all(F.regexp_replace(piece, r"^</?[a-zA-Z]+|>$", ""), F.lit(ATTRIBUTE), F.lit(0))
        href, target = _attribute(attributes, "href"), _attribute(attributes, "target")
        link = F.concat(F.lit("<a"), F.coalesce(F.concat(F.lit(' href="'), quoted(F.when(F.trim(href).rlike(KEPT_ADDRESS), F.trim(href))), F.lit('"')), F.lit("")), F.coalesce(F.concat(F.lit(' target="'), quoted(target), F.lit('"')), F.lit("")), F.lit(f' rel="{LINK_REL}">'))
        kept = F.when(~name.isin(*KEPT_TAGS), "").when(F.startswith(piece, F.lit("</")), F.concat(F.lit("</"), name, F.lit(">"))).when(name == "a", link).otherwise(F.concat(F.lit("<"), name, F.lit(">")))
        return F.when(piece.rlike("^<[a-zA-Z/]"), kept).otherwise(escaped(piece))

    return F.array_join(F.transform(F.regexp_extract_all(bare, F.lit(PIECE), F.lit(0)), cleaned), "")
