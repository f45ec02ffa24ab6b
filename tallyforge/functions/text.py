"""Column functions for text, ids, times and counts; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = "https://www.reddit.com"


def collapse(c: Column) -> Column:
    """White space of any kind collapsed to single blanks, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def evidence_norm(c: Column) -> Column:
    """Lower case, links dropped, everything but a-z, 0-9 and blanks replaced, collapsed."""
    lower = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"https?://\S+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(lower, r"[^a-z0-9\s]", " "), r"\s+", " "))


def keyword_tokens(c: Column) -> Column:
    """Runs of a-z and 0-9 in lower case; hyphens split."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))


def keyword_norm(c: Column) -> Column:
    return F.array_join(keyword_tokens(c), " ")


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` tokens as strings; empty where the text is shorter."""
    n = F.size(tokens)

    def of(k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))
        return F.when(n >= k, runs).otherwise(F.array().cast("array<string>"))

    sizes = [of(k) for k in range(low, high + 1)]
    return F.concat(*sizes)


def contains_phrase(norm: Column, phrase: Column | str) -> Column:
    """Whether a normalised text has a normalised phrase on token borders."""
    p = F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.contains(F.concat(F.lit(" "), norm, F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))


def _quoted(term: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term)


def any_of(terms: list[str] | tuple[str, ...]) -> str:
    """A pattern that finds any of the terms on word borders; one that finds nothing for no terms."""
    return r"(?U)\b(?:" + "|".join(_quoted(t.lower()) for t in terms) + r")\b" if terms else r"(?!)"


def hits(text: Column, terms: list[str] | tuple[str, ...]) -> Column:
    """The terms a lower-cased text holds on word borders, in dictionary order."""
    return F.array_compact(F.array(*[F.when(text.rlike(any_of([t])), F.lit(t.lower())) for t in terms])) if terms else F.array().cast("array<string>")


def sentences(c: Column) -> Column:
    """Sentences of eight characters or more, without dashes at their ends."""
    parts = F.split(collapse(F.coalesce(c, F.lit(""))), r"(?<=[.!?])\s+")
    return F.transform(F.filter(parts, lambda s: F.length(F.trim(s)) >= 8), lambda s: F.regexp_replace(s, r"^[ \-—]+|[ \-—]+$", ""))


def slug(c: Column, most: int) -> Column:
    """a-z and 0-9 joined by underscores, at most so many characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, most)


def topic_id(community: Column, key: Column) -> Column:
    return F.concat(F.lit("topic_"), F.substring(F.sha2(F.concat_ws(":", community, key), 256), 1, 16))


def post_id(c: Column) -> Column:
    """'t3_' and the bare id; null for null and blank."""
    bare = F.regexp_replace(collapse(F.lower(c)), "^t3_", "")
    return F.when(bare != "", F.concat(F.lit("t3_"), bare))


def community_key(c: Column) -> Column:
    """Lower case without surrounding blanks and leading r/."""
    return blank_to_null(F.regexp_replace(collapse(F.lower(c)), "^/?r/", ""))


def canonical_url(c: Column, host: str = HOST) -> Column:
    """https, host in lower case, no query, fragment or trailing slash; relative paths get ``host``; null for null and blank."""
    raw = collapse(c)
    absolute = F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit(host), F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit("/"), raw))))
    where = F.lower(F.regexp_extract(absolute, r"(?i)^https?://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(absolute, r"(?i)^https?://[^/?#]*([^?#]*)", 1), "/+$", "")
    return F.when(raw != "", F.concat(F.lit("https://"), where, path))


def parse_time(c: Column) -> Column:
    """Epoch seconds or ISO text (zone-less: UTC) as a timestamp; null where neither."""
    return F.coalesce(F.try_to_timestamp(F.replace(c, F.lit("Z"), F.lit("+00:00"))), F.timestamp_seconds(c.try_cast("double")))


def published_date(c: Column) -> Column:
    """The date in the first ten characters, or null."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def non_negative(c: Column) -> Column:
    """A count as BIGINT, at least 0; null and text that is no number are 0."""
    return F.greatest(F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def first_nonzero(*cs: Column) -> Column:
    """The first count that is neither null nor 0, else 0."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in cs], F.lit(0))


def text_list(c: Column, most: int = 5, length: int = 500) -> Column:
    """Distinct non-blank texts in order, clipped, at most so many."""
    return F.slice(F.array_distinct(F.filter(F.transform(c, lambda x: F.substring(collapse(x), 1, length)), lambda x: F.length(x) > 0)), 1, most)


def clip(c: Column, most: int) -> Column:
    return F.substring(collapse(F.coalesce(c, F.lit(""))), 1, most)


def has_cjk(c: Column) -> Column:
    return c.rlike("[\\x{4e00}-\\x{9fff}]")


def first_value(values: Column) -> Column:
    """The first non-blank value of an array."""
    return F.get(F.filter(values, lambda x: F.length(F.trim(x)) > 0), F.lit(0))


def platform(community: Column, ladder: list[tuple[str, str]], default: str) -> Column:
    """The label of the first part a community's key holds."""
    key = community_key(community)
    out = F.when(F.contains(key, F.lit(ladder[0][0])), F.lit(ladder[0][1])) if ladder else None
    for part, label in ladder[1:]:
        out = out.when(F.contains(key, F.lit(part)), F.lit(label))
    return F.coalesce(out.otherwise(F.lit(default)), F.lit(default)) if out is not None else F.lit(default)
