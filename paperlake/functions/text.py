"""Text, date and author expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"\A\d{4}-\d{2}-\d{2}\z"
_INSTANT = r"\A(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:[.,](\d{1,6})\d*)?(?:Z|[+-]\d{2}:\d{2})\z"

# The characters with the Unicode property White_Space.
SPACES = (
    "\t\n\v\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def trimmed(text) -> Column:
    """Trim every Unicode space, not only the ASCII one. Looks at the ends of the text only."""
    return F.btrim(as_column(text), F.lit(SPACES))


def clean_text(text) -> Column:
    """Trim, then turn runs of space, tab, CR and LF into one space.

    The pattern leaves single spaces alone, which are nearly all of the matches otherwise.
    """
    return F.regexp_replace(trimmed(text), r"[ \n\r\t]{2,}|[\n\r\t]", " ")


def parse_date(text) -> Column:
    """A date, or an ISO instant read as wall-clock time; NULL for anything else."""
    text = as_column(text)
    seconds = F.regexp_extract(text, _INSTANT, 1)
    fraction = F.rpad(F.regexp_extract(text, _INSTANT, 2), 6, "0")
    wall_clock = F.concat(seconds, F.lit("."), fraction)
    return F.when(
        text.rlike(_DATE) | text.rlike(_INSTANT),
        F.when(text.rlike(_DATE), text).otherwise(wall_clock).try_cast("timestamp_ntz"),
    )


def format_authors(authors) -> Column:
    """Join `forenames keyname` of each author with a comma; NULL or empty list gives ''."""
    def full_name(author):
        fore = F.coalesce(author["forenames"], F.lit(""))
        key = F.coalesce(author["keyname"], F.lit(""))
        return trimmed(F.concat(fore, F.lit(" "), key))

    names = F.filter(F.transform(authors, full_name), lambda name: name != "")
    return F.coalesce(F.array_join(names, ", "), F.lit(""))


def shortened(text, width) -> Column:
    """Text no longer than `width` characters, the last three being dots when cut."""
    cut = F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    return F.when(F.length(text) > width, cut).otherwise(F.coalesce(text, F.lit("")))


def day(timestamp) -> Column:
    return F.coalesce(F.date_format(timestamp, "yyyy-MM-dd"), F.lit(""))


def searchable_text(title="title", abstract="abstract") -> Column:
    """Null-safe title and abstract joined by a space."""
    return F.concat(
        F.coalesce(as_column(title), F.lit("")),
        F.lit(" "),
        F.coalesce(as_column(abstract), F.lit("")),
    )


def full_text_body(abstract, tldr) -> Column:
    """The abstract, followed by the short summary when there is one."""
    summary = F.when(tldr != "", F.concat(F.lit("\n\nTL;DR: "), tldr)).otherwise("")
    return F.concat(F.coalesce(abstract, F.lit("")), summary)


def embedding_text(title="title", abstract="abstract") -> Column:
    return F.concat(
        F.coalesce(as_column(title), F.lit("")),
        F.lit("\n\n"),
        F.coalesce(as_column(abstract), F.lit("")),
    )
