"""Text functions as Column expressions; Pandas UDFs only where Spark has no built-in."""

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as scripts on web pages see it: Java's ``\s`` alone has only ASCII.
SPACE = r"[\s   -     　﻿]"


def collapsed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    # An ordinary space that stands alone is not matched, so that most texts need few replacements.
    return F.trim(F.regexp_replace(c, f"{SPACE}{{2,}}|[{SPACE}&&[^ ]]", " "))


def paragraphs(c: Column) -> Column:
    """The strings of a JSON array; null for null or unreadable text."""
    return F.from_json(c, "array<string>")


def body(c: Column) -> Column:
    """The form in which bodies are compared: paragraphs joined by a space, collapsed, lower case."""
    return F.lower(collapsed(F.array_join(paragraphs(c), " ")))


def digest16(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units; Spark's ``length`` counts code points."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def word_count(c: Column) -> Column:
    return F.when(collapsed(c) == "", F.lit(0)).otherwise(F.size(F.split(collapsed(c), " ")))


def link_count(c: Column) -> Column:
    return F.regexp_count(F.lower(c), F.lit(r"https?://|www\."))


def number_in_title(c: Column) -> Column:
    """The number of "Chapter N" or "Ch. N" at the start of a title, its fraction left out; null if there is none."""
    return F.regexp_extract(c, r"(?i)^\s*ch(?:apter|\.)?\s*([0-9]{1,9})(?:[^0-9]|$)", 1).try_cast("int")


def unprefixed_title(c: Column) -> Column:
    """A title without a first number that a second one contradicts, and without zero-width characters."""
    plain = F.regexp_replace(c, r"[​-‍⁠﻿]", "")
    return F.regexp_replace(plain, rf"(?i)^{SPACE}*chapter{SPACE}+[0-9.]+{SPACE}*:{SPACE}*(chapter{SPACE}+[0-9]+)", "$1")


def titled(number: Column, title: Column) -> Column:
    """"Chapter N: title"; the prefix is added only where it is missing."""
    base = F.concat(F.lit("Chapter "), number.cast("string"))
    return (
        F.when(title.isNull() | (F.trim(title) == ""), base)
        .when(F.lower(F.trim(title)).startswith("chapter"), F.trim(title))
        .otherwise(F.concat(base, F.lit(": "), F.trim(title)))
    )


def html_escaped(c: Column) -> Column:
    """Text for HTML: the ampersand first."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def sql_quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def script_safe(c: Column) -> Column:
    """JSON that may stand in a script element."""
    return F.replace(c, F.lit("<"), F.lit("\\u003c"))


def visible_text(html: Column) -> Column:
    """Text of HTML: scripts, styles and comments go first, because they may hold tags; the five common references are read."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
    return collapsed(reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, bare))


def attribute_values(html: Column, name: str) -> Column:
    """All values of one attribute."""
    return F.regexp_extract_all(html, F.lit(rf'(?i)\b{name}\s*=\s*"([^"]*)"'), 1)


def first_heading(html: Column, fallback: Column) -> Column:
    """The first h1, else the og:title, else ``fallback``."""

    def some(x: Column) -> Column:
        return F.when(x != "", x)

    heading = visible_text(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    meta = F.regexp_extract(html, r'(?i)<meta\s+property="og:title"\s+content="([^"]*)"', 1)
    return F.coalesce(some(heading), some(meta), fallback)


_UNITS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400, "week": 604800}


def age_seconds(c: Column) -> Column:
    """Seconds of "just now", "yesterday", "an hour ago", "5 mins ago"; null for anything else.  At most three digits."""
    low = F.lower(F.trim(c))
    form = r"^(?:updated\s+)?(a|an|one|[0-9]{1,3})\s+(second|sec|minute|min|hour|day|week)s?\s+ago$"
    amount, unit = F.regexp_extract(low, form, 1), F.regexp_extract(low, form, 2)
    n = F.when(amount.isin("a", "an", "one"), F.lit(1)).otherwise(amount.try_cast("int"))
    seconds = F.create_map(*[F.lit(x) for kv in _UNITS.items() for x in kv])
    return (
        F.when(low.isin("just now", "updated just now"), F.lit(0))
        .when(low.isin("yesterday", "updated yesterday"), F.lit(86400))
        .otherwise(n * F.try_element_at(seconds, unit))
        .cast("long")
    )


def age_label(seconds: Column) -> Column:
    """The opposite: a label for people."""

    def some(size: int, unit: str) -> Column:
        n = F.floor(seconds / size).cast("string")
        return F.concat(n, F.when(n == "1", F.lit(f" {unit} ago")).otherwise(F.lit(f" {unit}s ago")))

    return (
        F.when(seconds.isNull() | (seconds < 0), F.lit("Time unavailable"))
        .when(seconds < 60, F.lit("Just now"))
        .when(seconds < 3600, some(60, "min"))
        .when(seconds < 86400, some(3600, "hour"))
        .when(seconds < 172800, F.lit("Yesterday"))
        .otherwise(some(86400, "day"))
    )


def matching_rules(c: Column, rules: list[tuple[str, list[str]]], otherwise: str, most: int) -> Column:
    """The names, in order and at most ``most``, of all rules one of whose words stands in the text; ``otherwise`` if there is none."""
    low = F.lower(c)
    hits = [F.when(reduce(lambda x, y: x | y, [low.contains(p) for p in parts]), F.lit(name)) for name, parts in rules]
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) == 0, F.array(F.lit(otherwise))).otherwise(F.slice(found, 1, most))


def shortened(c: Column, most: int) -> Column:
    """Collapsed text of at most ``most`` characters."""
    return F.substring(collapsed(c), 1, most)


def chunk_name(prefix: Column, chunk: Column) -> Column:
    """File of a chunk: the number has at least two digits; ``lpad`` alone would cut longer ones."""
    n = chunk.cast("string")
    return F.concat(prefix, F.lpad(n, F.greatest(F.lit(2), F.length(n)), F.lit("0")), F.lit(".js"))


def safe_path(c: Column) -> Column:
    """Whether a relative path keeps to plain names."""
    return c.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]*(?:/[A-Za-z0-9][A-Za-z0-9._-]*)*-?$") & ~c.contains("..")


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """NFKC with white space collapsed."""
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).split()), na_action="ignore")


@F.pandas_udf(StringType())
def slug(texts: pd.Series) -> pd.Series:
    """ASCII letters and digits of the NFKD form in lower case, other runs as one hyphen, at most 100 characters."""

    def one(t: str) -> str:
        plain = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()
        return "-".join("".join(c if c.isalnum() else " " for c in plain).split())[:100].strip("-")

    return texts.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def title_key(texts: pd.Series) -> pd.Series:
    """Letters and digits of the case-folded text."""
    return texts.map(lambda t: "".join(c for c in t.casefold() if c.isalnum()), na_action="ignore")
