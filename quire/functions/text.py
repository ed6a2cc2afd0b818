"""Column functions that several operators share; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a Python string method sees it.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0  -     　]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def n_words(x: Column | str) -> Column:
    """Words between white spaces; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(col(x), SPACE), lambda w: w != "")), F.lit(0))


def token_estimate(x: Column | str) -> Column:
    """1.3 tokens for each word, cut to an int."""
    return F.floor(n_words(x) * 13 / 10).cast("int")


def stripped(x: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(col(x), "^" + SPACE, ""), SPACE + "$", "")


def unescape(x: Column | str) -> Column:
    """Drops each backslash that escapes something."""
    return F.regexp_replace(col(x), r"(?s)\\(.)", "$1")


def escape_attr(x: Column | str) -> Column:
    """For use inside double quotes."""
    return F.replace(F.replace(col(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def escape_chars(x: Column | str, chars: str) -> Column:
    """Backslashes before backslashes and each of ``chars``."""
    out = F.replace(col(x), F.lit("\\"), F.lit("\\\\"))
    for c in chars:
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def html_escape(x: Column | str) -> Column:
    out = F.coalesce(col(x), F.lit(""))
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(c), F.lit(entity))
    return out


def inline_html(x: Column | str) -> Column:
    """Bold, italic, code and links of a line of text, escaped; only links to the web, to mail or
    within the page are kept, others leave their text."""
    t = html_escape(x)
    for pattern, tag in ((r"\*\*(.+?)\*\*", "strong"), (r"\*(.+?)\*", "em"), (r"`(.+?)`", "code")):
        t = F.regexp_replace(t, "(?d)" + pattern, f"<{tag}>$1</{tag}>")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\(((?i:https?://|mailto:|#)[^)]*)\)", '<a href="$2">$1</a>')
    return F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")


def try_int(x: Column | str, default: int | None = 0) -> Column:
    return F.coalesce(col(x).try_cast("int"), F.lit(default)) if default is not None else col(x).try_cast("int")


def try_double(x: Column | str) -> Column:
    return col(x).try_cast("double")


def clamp(x: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def joined_in_order(parts: Column, order: Column, sep: str) -> Column:
    """Aggregate: non-null parts of a group, joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), parts.alias("s"))))
    return F.array_join(F.transform(rows, lambda r: r["s"]), sep)


def num_cols(rows: Column | str) -> Column:
    """Columns of a table: the widest row, spans counted."""
    widths = F.transform(col(rows), lambda r: F.aggregate(r["cells"], F.lit(0), lambda a, c: a + F.greatest(F.lit(1), c["colspan"])))
    return F.coalesce(F.array_max(widths), F.lit(0))


def header_rows(rows: Column | str) -> Column:
    return F.filter(col(rows), lambda r: r["is_header"])


def data_rows(rows: Column | str) -> Column:
    return F.filter(col(rows), lambda r: ~r["is_header"])


def overlap_join(a: Column, b: Column) -> Column:
    """Two halves of a paragraph as one: a hyphen before a small letter goes; otherwise the longest
    end of the first (30 to 6 letters) that begins the second is written once; otherwise a space joins them."""
    hyphen = a.endswith("-") & F.substring(b, 1, 1).rlike(r"^\p{Ll}")
    shared = F.aggregate(
        F.sequence(F.lit(30), F.lit(6), F.lit(-1)),
        F.lit(0),
        lambda best, k: F.when(best > 0, best).when((F.length(a) >= k) & (F.length(b) >= k) & (F.right(a, k) == F.left(b, k)), k).otherwise(0),
    )
    apart = F.when(shared > 0, F.concat(a, F.expr("''"), F.substring(b, shared + 1, F.length(b)))).otherwise(F.concat_ws(" ", a, b))
    return F.when(hyphen, F.concat(F.left(a, F.length(a) - 1), b)).otherwise(apart)
