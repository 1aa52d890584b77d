"""The identity of a listing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_DIGITS = 16  # fixed value: length of the printed id


def listing_digest(title="title", company="company", url="url") -> Column:
    """SHA-1 over lower(title)|lower(company)|url, UTF-8, as 40 hex digits.

    The URL keeps its case. Null parts count as empty. This is what listings are
    compared by.
    """
    title, company, url = (
        F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (title, company, url)
    )
    return F.sha1(F.concat_ws("|", F.lower(title), F.lower(company), url))


def listing_key(title="title", company="company", url="url") -> Column:
    """The printed id: the first 16 digits of the digest. Two listings may share it."""
    return F.left(listing_digest(title, company, url), F.lit(ID_DIGITS))
