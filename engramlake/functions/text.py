"""Text functions as column expressions; nothing here leaves the JVM but :func:`hash_embedding`."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers whose presence in one of two texts suggests that they disagree.
NEGATION_MARKERS = [
    "no ", "not ", "never ", "don't", "doesn't", "isn't", "wasn't", "ya no", "no es", "no usa", "no tiene",
    "reemplazado", "deprecated", "replaced", "removed", "instead of", "en vez de", "eliminado",
]

# Words that are never tags.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can "
    "for and but or nor not no so yet both either neither each every all any few more most other some such than "
    "too very just about above after again also as at before between by from how in into it its of on only out "
    "over own same that this these those through to under until up what when where which while who whom why with "
    "el la los las un una unos unas de del en con por para es son fue ser estar que se si como pero mas ya entre "
    "cuando todo esta desde su sus le les"
).split()

# Phrases that make a query global, or a question over several hops.
GLOBAL_PHRASES = [
    "temas principales", "main themes", "resumen del corpus", "overview of", "comunidades", "communities", "qué cubre",
    "what are the themes",
]
HOP_PHRASES = [
    "cómo se relaciona", "como se relaciona", "how does", "how is", "relaciona", "relacion", "relación", "depende de",
    "depende", "depends on", "conecta", "que une", "ligado", "por qué", "por que", "why does", "cadena", "multi-hop",
    "camino entre", "path between", "causas de", "causes of",
]

# Keywords that tell the kind of a paragraph, in order of precedence.
PARAGRAPH_KINDS = [
    ("decision", ["decided", "decision", "chose"]),
    ("lesson", ["learned", "lesson", "takeaway"]),
    ("error", ["error", "bug", "failed"]),
    ("solution", ["fix", "solution", "resolved"]),
    ("preference", ["prefer", "preference", "always use"]),
]

_NOT_ALNUM = r"[^\p{L}\p{N}]+"


def words(c: Column) -> Column:
    """Runs of letters and digits, case kept."""
    return F.filter(F.split(c, _NOT_ALNUM), lambda w: w != "")


def tokens(c: Column) -> Column:
    return words(F.lower(c))


def entropy_bits(items: Column) -> Column:
    """Shannon entropy of a short array's elements (a query); long texts are counted by grouping instead."""
    n = F.size(items)
    share = F.transform(F.array_distinct(items), lambda w: F.size(F.filter(items, lambda x: x == w)) / n)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def density_from_counts(entropy: Column, total: Column, vocabulary: Column) -> Column:
    return F.when((total <= 1) | (vocabulary <= 1), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), entropy / F.log2(vocabulary))))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """|A n B| / min(|A|, |B|) over lower-case token sets; 0 if either is empty."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / least)


def long_tokens(c: Column, more_than_bytes: int = 2) -> Column:
    return F.array_distinct(F.filter(tokens(c), lambda w: F.octet_length(w) > more_than_bytes))


def jaccard(x: Column, y: Column) -> Column:
    """Of two arrays of distinct elements; 0 if both are empty."""
    def of(shared: Column) -> Column:
        union = F.size(x) + F.size(y) - shared
        return F.when(union == 0, 0.0).otherwise(shared / union)

    return let(F.size(F.array_intersect(x, y)), of)


def trigrams(c: Column) -> Column:
    """Distinct 3-grams of each word with two blanks before and one behind; a repeated word is taken apart once.

    The distinct words stand in lines of one text, and one expression finds the windows that stay within a line.  It
    steps by UTF-16 units, so texts with characters of two units are taken apart by position."""
    lines = F.concat(F.lit("  "), F.concat_ws(" \n  ", F.array_distinct(F.split(F.lower(c), _NOT_ALNUM))), F.lit(" "))
    found = F.array_remove(F.array_distinct(F.regexp_extract_all(lines, F.lit("(?=(...))"), F.lit(1))), "   ")
    return F.when(F.isnull(c), F.lit(None)).when(F.rlike(c, F.lit("[\\x{10000}-\\x{10FFFF}]")), _trigrams_by_position(c)).otherwise(found)


def _trigrams_by_position(c: Column) -> Column:
    padded = F.transform(F.array_distinct(tokens(c)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def letters(spark) -> str:
    """All characters that words are made of, by the engine's own pattern."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return spark.createDataFrame([(every,)], "c string").select(F.regexp_replace("c", _NOT_ALNUM, "").alias("c")).collect()[0].c


def trigrams_of(text: str) -> list[str]:
    found = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return sorted({f"  {w} "[i : i + 3] for w in found for i in range(len(w) + 1)})


def text_array(items: list[str]) -> Column:
    return F.array(*(F.lit(x) for x in items)) if items else F.array().cast("array<string>")


def trigram_similarity(c: Column, other: Column | str) -> Column:
    x = trigrams(c)
    y = text_array(trigrams_of(other)) if isinstance(other, str) else trigrams(other)
    return let(x, lambda g: jaccard(g, y))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def explode_if(value: Column, keep) -> Column:
    """A generator of ``value`` in the rows where ``keep(value)`` holds.  Unlike a filter over a computed column, which is
    pushed below the projection and computes it again, it computes the value once."""
    return F.explode(F.filter(F.array(value), keep))


def _counts(c: Column, terms: list[str], body) -> Column:
    """``body`` of the frequencies of the terms; the text is split once."""
    def of(hits: Column) -> Column:
        def count(term: str) -> Column:
            return F.size(F.filter(hits, lambda w: w == term))

        return body([count(t) for t in terms])

    return let(F.filter(F.split(F.lower(c), _NOT_ALNUM), lambda w: w.isin(terms)), of)


def rank_any(c: Column, terms: list[str]) -> Column:
    """Rank of a query that matches any term: the mean over terms of 0.1 * sum(1 / j^2, j <= frequency) / 1.64493."""
    def body(counts: list[Column]) -> Column:
        parts = [F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, j: a + F.lit(1.0) / (j * j))).otherwise(0.0) for n in counts]
        return sum(parts[1:], parts[0]) * 0.1 / 1.64493 / len(terms)

    return _counts(c, terms, body)


def cover_density(c: Column, terms: list[str]) -> Column:
    """0.1 for every matching position."""
    return _counts(c, terms, lambda counts: sum(counts[1:], counts[0]) * 0.1)


def matches_any(c: Column, terms: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(c), _NOT_ALNUM), text_array(terms))


def normalize_mention(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "-_/.", "    "), r"\s+", " "))


def entity_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, _NOT_ALNUM, ""))


def slug(c: Column, empty: str = "procedimiento") -> Column:
    s = F.regexp_replace(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "-")), "^-+|-+$", "")
    return F.when(s == "", empty).otherwise(s)


def negation_differs(a: Column, b: Column) -> Column:
    """One text holds a marker that the other lacks."""
    x, y = F.lower(a), F.lower(b)
    out = F.lit(False)
    for m in NEGATION_MARKERS:
        out = out | (F.contains(x, F.lit(m)) != F.contains(y, F.lit(m)))
    return out


def _any_phrase(c: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def classify_paragraph(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit("fact")
    for kind, keys in reversed(PARAGRAPH_KINDS):
        out = F.when(_any_phrase(low, keys), kind).otherwise(out)
    return out


def classify_query(c: Column) -> Column:
    low = F.lower(c)
    return F.when(_any_phrase(low, GLOBAL_PHRASES), "global").when(_any_phrase(low, HOP_PHRASES), "multi_hop").otherwise("factoid")


def token_estimate(c: Column) -> Column:
    """ceil(characters / 4): an estimate, for budgets."""
    return F.ceil(F.length(c) / 4).cast("long")


def line_of_offset(c: Column, offset: Column) -> Column:
    """1 + line feeds before the 0-based character offset."""
    head = F.substr(c, F.lit(1), offset)
    return 1 + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def cut(c: Column, characters: int) -> Column:
    return F.substring(c, 1, characters)


def cut_bytes(c: Column, most: int) -> Column:
    """The longest beginning of whole characters in at most ``most`` bytes of UTF-8."""
    b = F.encode(c, "UTF-8")

    def inside(at: int) -> Column:
        """Byte ``at`` (from 0) goes on with a character."""
        return F.hex(F.substring(b, at + 1, 1)).between("80", "BF")

    end = F.when(~inside(most), most).when(~inside(most - 1), most - 1).when(~inside(most - 2), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.substring(b, F.lit(1), end), "UTF-8"))


def clean_offsets(c: Column, needle: str) -> Column:
    return F.size(F.split(c, re.escape(needle))) - 1


def patch_once(c: Column, find: str, put: str) -> Column:
    """Replaces ``find`` where it occurs exactly once, else leaves the text."""
    return F.when(clean_offsets(c, find) == 1, F.replace(c, F.lit(find), F.lit(put))).otherwise(c)


def embed_words(text: str | None, dims: int) -> list[float]:
    """Words hashed to dimensions with weight 1 / (1 + position), at unit length."""
    out = [0.0] * dims
    for i, w in enumerate((text or "").lower().split()):
        h = 0
        for b in w.encode():
            h = (h * 31 + b) & 0xFFFFFFFF
        out[h % dims] += 1.0 / (1.0 + i)
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm > 0 else out


def hash_embedding(dims: int = 64):
    """Arrow-batched fallback embedder."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: embed_words(t, dims))

    return run
