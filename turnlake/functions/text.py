"""Text column functions: whitespace strip, context-tag strip, tokens, keyword score,
previews and tag lists (SURVEY C3-C6, C11, C12)."""

from __future__ import annotations

import regex as _re
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must match the reference's behaviour):
#  - trim()/strip() remove Unicode White_Space at both ends.
#  - context tags look like <name>...</name> with lower-case ASCII letters and '_' in the name,
#    matched lazily across lines, together with the whitespace after the closing tag.
#  - tokens are runs of alphabetic or numeric characters longer than one UTF-8 byte, lower-cased.
#  - previews are cut on characters and end in the ellipsis character.
WS_CLASS = r"\p{IsWhite_Space}"
CONTEXT_TAG_PATTERN = r"(?s)<[a-z_]+>.*?</[a-z_]+>\s*"
TOKEN_SPLIT_PATTERN = r"[^\p{IsAlphabetic}\p{N}]+"
ELLIPSIS = "…"
NO_PROMPT = "<no prompt>"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col: Column | str) -> Column:
    """Remove Unicode whitespace at both ends (Rust ``trim``, Python ``strip``)."""
    return F.regexp_replace(_c(col), rf"^{WS_CLASS}+|{WS_CLASS}+$", "")


def is_blank(col: Column | str) -> Column:
    return F.length(strip_ws(col)) == 0


def strip_context(col: Column | str) -> Column:
    """Drop ``<tag>...</tag>`` blocks (and following whitespace), then strip."""
    return strip_ws(F.regexp_replace(_c(col), CONTEXT_TAG_PATTERN, ""))


def tokenize(col: Column | str) -> Column:
    """C5 as a column: ARRAY<STRING> of lower-cased tokens longer than one byte, repeats kept."""
    parts = F.split(_c(col), TOKEN_SPLIT_PATTERN)
    return F.transform(F.filter(parts, lambda w: F.octet_length(w) > 1), lambda w: F.lower(w))


def tokenize_py(text: str) -> list[str]:
    """C5 for a literal query string on the driver (a parameter, not data)."""
    parts = _re.split(r"[^\p{Alphabetic}\p{N}]+", text)
    return [w.lower() for w in parts if len(w.encode("utf-8")) > 1]


def keyword_score(text: Column | str, words: list[str] | Column) -> Column:
    """Share of query tokens that are substrings of the lower-cased text; 0 without tokens.

    With a literal word list the expression is a flat sum of ``contains`` tests, which stays
    inside whole-stage codegen and lowers the text once (common subexpression)."""
    lowered = F.lower(_c(text))
    if isinstance(words, Column):
        n = F.size(words)
        hits = F.size(F.filter(words, lambda w: F.contains(lowered, w)))
        return F.when(n == 0, F.lit(0.0)).otherwise(hits.cast("double") / n.cast("double"))
    if not words:
        return F.lit(0.0)
    hits = sum((F.contains(lowered, F.lit(w)).cast("int") for w in words), F.lit(0))
    return hits.cast("double") / F.lit(float(len(words)))


def truncate_chars(col: Column | str, n: int) -> Column:
    """C11: first ``n`` characters plus an ellipsis when the text is longer."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ELLIPSIS))).otherwise(c)


def format_tags(col: Column | str) -> Column:
    """`` [a, b]`` or the empty string."""
    c = _c(col)
    return F.when(F.size(c) > 0, F.concat(F.lit(" ["), F.array_join(c, ", "), F.lit("]"))).otherwise(F.lit(""))


def short_id(col: Column | str, n: int = 8) -> Column:
    """First 8 characters of an id."""
    return F.substring(_c(col), 1, n)


def flatten_content(col: Column | str) -> Column:
    """C4: message content, a VARIANT: a JSON string stays as it is, whatever it looks like; a list of
    blocks gives the ``text`` of its ``type = 'text'`` blocks joined by newlines; anything else is
    empty."""
    v = _c(col)
    kind = F.schema_of_variant(v)
    blocks = F.try_variant_get(v, "$", "array<struct<type:string,text:string>>")
    joined = F.array_join(
        F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))),
        "\n",
    )
    return (
        F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
        .when(kind.startswith("ARRAY"), F.coalesce(joined, F.lit("")))
        .otherwise(F.lit(""))
    )


def score_band(col: Column | str) -> Column:
    """High >= 0.8, mid >= 0.6, else low."""
    c = _c(col)
    return F.when(c >= 0.8, "high").when(c >= 0.6, "mid").otherwise("low")
