"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for lexical search.
STOPWORDS = tuple(
    "a an and are as at be by for from has have in is it its of on or that the this to was were what which with how why "
    "when did does do there their been any".split()
)
#: Words that the hashed embedding leaves out.
EMBEDDING_STOPWORDS = tuple(
    "the a an of in on to for by with and or is are was were be been has have had do does did what which how why when who "
    "this that these those it its as at from according".split()
)
TOKEN = r"[a-z0-9]+(?:[./-][a-z0-9]+)*"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def collapse(c: Column) -> Column:
    """White space, no-break space included, collapsed and trimmed; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"[\s ]+", " ")), F.lit(""))


def strip_html(c: Column) -> Column:
    """Text of markup: scripts and styles go, tags become spaces, common entities are decoded."""
    out = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def identifier(c: Column, upper: bool = False) -> Column:
    """A trimmed identifier; one with white space inside is null."""
    out = collapse(c)
    out = F.when(~out.rlike(r"\s"), out)
    return F.upper(out) if upper else out


def decimal_text(c: Column) -> Column:
    """A decimal without trailing zeros; null reads 'not stated'."""
    whole = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(whole, F.lit("not stated"))


def title_case(c: Column) -> Column:
    """An enumeration's name in words."""
    return F.initcap(F.regexp_replace(c, r"[_\-]+", " "))


def dehyphenated(c: Column) -> Column:
    """Words that a hyphen at a line's end splits are joined."""
    return F.regexp_replace(c, r"(?<=[a-z])-\n(?=[a-z])", "")


def line_signature(c: Column) -> Column:
    """A line with its digits masked: repeated headers and footers agree in it."""
    return F.lower(F.regexp_replace(c, r"\d+", "#"))


def alphanumeric(c: Column) -> Column:
    """Lower-case ASCII words joined by single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def search_tokens(c: Column) -> Column:
    """Tokens of lexical search: compounds as they are and in parts, without stopwords."""
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    # most texts have no compound: their tokens are not looked at one by one
    parts = F.when(~F.lower(c).rlike(r"[a-z0-9][./-][a-z0-9]"), found).otherwise(_with_parts(found))
    return F.filter(parts, lambda t: ~t.isin(*STOPWORDS))


def _with_parts(found: Column) -> Column:
    return F.flatten(F.transform(found, lambda t: F.when(t.rlike(r"[./-]"), F.concat(F.array(t), F.split(t, r"[./-]"))).otherwise(F.array(t))))


def jaccard(a: Column, b: Column) -> Column:
    """Share of two token arrays' distinct tokens that both have; null if neither has any."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def record_key(*columns: Column) -> Column:
    """32 hex digits that identify a row by its natural key, null being a value of its own."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *(F.coalesce(c.cast("string"), F.lit("␀")) for c in columns)), 256), 1, 32)
