"""Column expressions on text: trimming, hashing, trigrams, keywords, number formats."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from evgraph import vocab


# --- fixed values: characters that count as white space at the ends of a text ---
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` alone removes blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def words(values: list[str]) -> Column:
    """Constant array of texts as one literal, which the optimizer folds."""
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def content_hash(c: Column) -> Column:
    """PRJ-02: SHA-256 hex digest of the whole text."""
    return F.sha2(c, 256)


def claim_hash(c: Column) -> Column:
    """Sixteen hex characters of the digest of the stripped lower-case claim."""
    return F.substring(F.sha2(F.lower(strip(c)), 256), 1, 16)


def trigrams(c: Column) -> Column:
    """SIM-01: distinct trigrams of the lower-case words, each padded by two blanks and one."""
    parts = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    grams = F.transform(
        parts,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both texts; 0 when neither has any."""
    return set_similarity(trigrams(a), trigrams(b))


def set_similarity(x: Column, y: Column) -> Column:
    """Jaccard ratio of two distinct arrays."""
    both = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - both
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def contains_any(text: Column, values: list[str]) -> Column:
    """True when any literal word occurs in ``text`` as a substring."""
    return F.exists(words(values), lambda w: F.contains(text, w))


def keyword_count(text: Column, values: list[str]) -> Column:
    """How many list entries occur in ``text``; a repeated entry counts each time."""
    return F.size(F.filter(words(values), lambda w: F.contains(text, w)))


def best_dimension(text: Column) -> Column:
    """SIM-09: the dimension with most keyword hits, first on ties, default when none."""
    low = F.lower(text)
    scores = F.array(
        *[
            F.struct(
                keyword_count(low, vocab.DIMENSION_KEYWORDS[d]).alias("n"),
                F.lit(-i).alias("o"),
                F.lit(d).alias("d"),
            )
            for i, d in enumerate(vocab.DIMENSIONS)
        ]
    )
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["d"]).otherwise(F.lit(vocab.DEFAULT_DIMENSION))


def all_dimensions(text: Column) -> Column:
    """SIM-08: every dimension with a keyword hit, or the default one."""
    low = F.lower(text)
    hits = F.array_compact(
        F.array(
            *[
                F.when(contains_any(low, vocab.DIMENSION_KEYWORDS[d]), F.lit(d))
                for d in vocab.DIMENSIONS
            ]
        )
    )
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(vocab.DEFAULT_DIMENSION)))


def dimension_label(c: Column) -> Column:
    """Readable name of a dimension key."""
    return lookup(vocab.DIMENSION_LABELS, c, F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))


def lookup(values: dict, key: Column, default: Column | None = None) -> Column:
    """Constant dictionary lookup; the dictionary is one literal, which the optimizer folds."""
    kind = {str: "string", int: "int", float: "double"}[type(next(iter(values.values())))]
    table = F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def edge_verb(c: Column) -> Column:
    """Verb phrase of an edge type."""
    return lookup(vocab.EDGE_VERBS, c, F.replace(c, F.lit("_"), F.lit(" ")))


def grouped_number(c: Column) -> Column:
    """Four decimals with thousands separators, trailing zeros removed."""
    return F.regexp_replace(F.format_number(c, 4), r"\.?0+$", "")


def short_number(c: Column) -> Column:
    """Six significant digits, trailing zeros removed (the ``g`` format)."""
    magnitude = F.floor(F.log10(F.abs(c)))
    plain = F.when(
        c == 0, F.lit("0")
    ).otherwise(
        F.regexp_replace(
            F.regexp_replace(
                F.format_string("%.10f", F.round(c * F.pow(F.lit(10.0), 5 - magnitude), 0)
                                / F.pow(F.lit(10.0), 5 - magnitude)),
                r"0+$", ""),
            r"\.$", "")
    )
    mantissa = F.regexp_replace(
        F.regexp_replace(F.format_string("%.5e", c), r"\.?0+e", "e"), r"e([+-])(\d)$", "e$1" + "0$2"
    )
    return F.when((c != 0) & ((magnitude < -4) | (magnitude >= 6)), mantissa).otherwise(plain)


def signed_percent(pct: Column) -> Column:
    """Two decimals with a plus sign for rises."""
    return F.concat(F.when(pct > 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.2f%%", pct))
