"""Text and identity expressions, all built-in (no Python in the plan)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words left out of lexical ranking, and of lexical overlap (the lists differ).
RANKING_STOPWORDS = ["a", "an", "and", "are", "as", "at", "for", "from", "in", "is", "of", "on", "or", "the", "to", "with"]
OVERLAP_STOPWORDS = ["a", "an", "and", "are", "for", "how", "in", "is", "of", "on", "or", "the", "to", "with"]

# Parts of a section title's slug and the section kind, first match wins.
SECTION_KINDS = [
    ("abstract", "abstract"), ("highlight", "highlights"), ("introduction", "introduction"), ("background", "background"), ("related-work", "related_work"),
    ("literature-review", "related_work"), ("method", "methods"), ("result", "results"), ("discussion", "discussion"), ("conclusion", "conclusion"),
    ("appendix", "appendix"), ("supplement", "supplement"), ("acknowledg", "acknowledgements"),
]

WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_+-]*"
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
_WHITE = r"[\s\u00a0\u2007\u202f\u2009]+"


def collapse(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, _WHITE, " "))


def tidy(c: Column) -> Column:
    """:func:`collapse`, and no space before a punctuation mark."""
    return F.regexp_replace(collapse(c), r" ([,.;:!?])", "$1")


def slug(c: Column) -> Column:
    """Lower case, runs of other characters become one dash; ``unknown`` when nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def title_key(c: Column) -> Column:
    """Lower case letters and digits, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def stable_id(prefix: str | Column, *parts: Column) -> Column:
    """``prefix-`` and 16 hex digits of the SHA-1 of the parts joined by ``::``; null parts are empty."""
    joined = F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("-"), F.substring(F.sha1(joined), 1, 16))


def section_type(title: Column) -> Column:
    s = slug(title)
    return reduce(lambda acc, k: acc.when(F.contains(s, F.lit(k[0])), k[1]), SECTION_KINDS[1:], F.when(F.contains(s, F.lit(SECTION_KINDS[0][0])), SECTION_KINDS[0][1])).otherwise("body")


def sentences(c: Column) -> Column:
    """Sentences: cut at white space after a full stop, exclamation or question mark."""
    return F.filter(F.transform(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def first_sentence(c: Column) -> Column:
    """Up to the first end mark, else the first 24 words; null for an empty text."""
    t = collapse(c)
    hit = F.regexp_extract(t, r"^(.+?[.!?])(?:\s|$)", 1)
    return F.when(t == "", None).when(hit != "", hit).otherwise(F.array_join(F.slice(F.split(t, " "), 1, 24), " "))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({WORD})"), 1)


def word_count(c: Column) -> Column:
    return F.size(words(c))


def tail_words(c: Column, n: int) -> Column:
    """The last ``n`` words joined by spaces."""
    w = words(c)
    return F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), F.lit(n)), " ") if n > 0 else F.lit("")


def base_salience(c: Column) -> Column:
    """.35, plus for citations, numbers and upper-case words; at most 1, three digits."""
    w = words(c)
    n = F.greatest(F.size(w), F.lit(1))
    cites = F.length(c) - F.length(F.regexp_replace(c, r"\[", ""))
    digits = F.size(F.filter(w, lambda t: t.rlike(r"^\d+$")))
    upper = F.size(F.filter(w, lambda t: (F.length(t) > 1) & (t == F.upper(t)) & (t != F.lower(t))))
    return F.bround(F.least(F.lit(0.35) + F.least(cites, F.lit(5)) * 0.05 + F.least(digits / n, F.lit(0.2)) + F.least(upper / n, F.lit(0.15)), F.lit(1.0)), 3)


def tokens(c: Column) -> Column:
    """Lower-case ASCII tokens."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({TOKEN})"), 1), F.lower)


def ranking_tokens(c: Column, stopwords: list[str] | None = None) -> Column:
    """Tokens of more than two characters that are no stop words."""
    stop = F.array(*[F.lit(w) for w in (stopwords or RANKING_STOPWORDS)])
    return F.filter(tokens(c), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def lexical_overlap(query: str, text: Column) -> Column:
    """Share of the query's distinct terms that the text's tokens hold."""
    q = F.array_distinct(ranking_tokens(F.lit(query), OVERLAP_STOPWORDS))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(F.lit(0.0))


def label_key(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def doi_in(c: Column) -> Column:
    """The first DOI in a text, lower case, without a final point; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(c, rf"\b({DOI})\b", 1)), r"\.+$", ""), F.lit(""))


def acronym(c: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), "")


def label_similar(a: Column, b: Column) -> Column:
    """Equal, contained, or the acronym of the first in that of the second."""
    la, lb, ka, kb = F.lower(a), F.lower(b), acronym(a), acronym(b)
    return F.contains(la, lb) | F.contains(lb, la) | ((ka != "") & (kb != "") & F.contains(kb, ka))


def cut_words(c: Column, n: Column | int) -> Column:
    """The first ``n`` words by white space."""
    return F.array_join(F.slice(F.split(F.trim(c), r"\s+"), F.lit(1), F.lit(n) if isinstance(n, int) else n), " ")


def spaced_words(c: Column) -> Column:
    """Number of words by white space."""
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))


def numeric_text(c: Column) -> Column:
    """The first number of a text such as a range, as a double."""
    return F.regexp_extract(c, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def unfenced(c: Column) -> Column:
    """JSON text without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*|\s*```$", ""))


def without_markup(c: Column) -> Column:
    """The text without scripts, styles, comments and tags, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
