"""Text functions. All are built-in column expressions; none calls Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Every character Python counts as white space; all lie below U+3001.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_TAG = r"<[^>]+>"


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_space(c: ColumnOrName) -> Column:
    """Remove all Unicode whitespace from both ends."""
    return F.btrim(_col(c), F.lit(_SPACES))


def strip_html(c: ColumnOrName) -> Column:
    """Replace every tag by one space and strip the ends; null gives ''.

    Inner runs of spaces, entities, and script and style text are left alone.
    """
    return strip_space(F.regexp_replace(F.coalesce(_col(c), F.lit("")), _TAG, " "))


def truncate(c: ColumnOrName, n: int) -> Column:
    """The first ``n`` code points."""
    return F.left(_col(c), F.lit(n))


def snippet(c: ColumnOrName, n: int = 300) -> Column:
    """The first ``n`` code points, with an ellipsis only when something was cut."""
    c = F.coalesce(_col(c), F.lit(""))
    return F.when(F.length(c) > n, F.concat(truncate(c, n), F.lit("…"))).otherwise(c)


def search_text(title: ColumnOrName, description: ColumnOrName, company: ColumnOrName) -> Column:
    """Lower-cased 'title description company'; an empty part keeps its separator."""
    parts = [F.coalesce(_col(c), F.lit("")) for c in (title, description, company)]
    return F.lower(F.concat_ws(" ", *parts))


def or_default(c: ColumnOrName, default: str) -> Column:
    """``default`` where the value is null or empty."""
    return F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(default))


def split_title(c: ColumnOrName, unknown: str = "Unknown") -> tuple[Column, Column]:
    """(company, title) of 'Company: Title', cut at the first ': '."""
    c = _col(c)
    parts = F.split(c, ": ", 2)
    has_company = F.size(parts) == 2
    company = F.when(has_company, strip_space(parts[0])).otherwise(F.lit(unknown))
    return company, F.when(has_company, F.get(parts, F.lit(1))).otherwise(c)


def posting_url(token: ColumnOrName, posting_id: ColumnOrName) -> Column:
    """Public page of one posting on a hosted board that publishes only ids."""
    return F.concat(F.lit("https://jobs.ashbyhq.com/"), _col(token), F.lit("/"), _col(posting_id))


def render_list(c: ColumnOrName, separator: str = ", ", first: int | None = None) -> Column:
    """Join a list for display, optionally only its first entries."""
    c = _col(c)
    return F.array_join(c if first is None else F.slice(c, 1, first), separator)


def iso_utc(c: ColumnOrName) -> Column:
    """ISO-8601 text of an instant; the session time zone must be UTC."""
    c = _col(c)
    whole = c == F.date_trunc("second", c)
    body = F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    return F.concat(body, F.lit("+00:00"))
