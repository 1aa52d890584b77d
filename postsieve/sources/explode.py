"""Shared steps of the normalisers: status routing, isolation of records, output shape.

A normaliser turns payload rows into STAGED rows in one pass over the bodies. A row
without a ``reason`` is a listing; a row with one belongs in quarantine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.schemas import STAGED

NOT_FOUND = "not_found"
HTTP_ERROR = "http_error"
UNPARSEABLE = "unparseable_body"
BAD_RECORD = "bad_record"
BAD_ITEM = "bad_item"
UNSUPPORTED = "unsupported_kind"
RAW_CHARS = 4000  # of a body that cannot be read; the endpoint leads to the rest

# The JSON reader takes no text of over 20 million characters by itself: a whole body would be
# unreadable for one long text in it.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}

_LISTING_FIELDS = ("title", "company", "location", "url", "source", "description")


def route_status(absent: Sequence[int] = (404,)) -> Column:
    """Reason why a response cannot be read, null for a good one."""
    return (
        F.when(F.col("status_code").isin(*absent), F.lit(NOT_FOUND))
        .when(F.col("error").isNotNull(), F.lit(HTTP_ERROR))
        .when(~F.coalesce(F.col("status_code").between(200, 299), F.lit(False)), F.lit(HTTP_ERROR))
    )


def json_object(body: Column, field: str, kind: str) -> Column:
    """A JSON object with one field, parsed to ``kind``, and its text where it is malformed."""
    options = {"columnNameOfCorruptRecord": "_malformed", **ANY_LENGTH}
    return F.from_json(body, f"{field} {kind}, _malformed string", options)


def json_array(body: Column) -> Column:
    """A JSON array as the texts of its elements, null where it is malformed."""
    return F.from_json(body, "array<string>", ANY_LENGTH)


def records(
    payloads: DataFrame, body: Column, reason: Column, record: str, elements: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per element of each good body, one row with a reason per bad body.

    ``body`` is the parsed body: an array of unparsed records, or an object of
    ``json_object`` of which ``elements`` takes that array, so that one bad record does not
    take the others with it. Bodies without elements give no rows. ``_r`` is the record
    parsed to the schema ``record``, ``_object`` tells whether it is an object, and ``_raw`` is
    the text of what is none.

    Records are parsed before they are rows of their own: whatever is asked of their fields
    afterwards, a body and a record are each read once.
    """
    parsed = payloads.withColumn("reason", reason).withColumn("_parsed", F.when(F.col("reason").isNull(), body))
    whole = F.col("_parsed")
    malformed = whole.isNull() | whole["_malformed"].isNotNull() if elements else whole.isNull()
    each = lambda raw: F.struct(
        is_object(raw).alias("object"), F.when(~is_object(raw), raw).alias("raw"), F.from_json(raw, record, ANY_LENGTH).alias("r")
    )
    found = F.transform(elements(whole) if elements else whole, each)
    judged = parsed.withColumn(
        "_body", F.when(F.col("reason").isNull(), F.struct(found.alias("elements"), malformed.alias("malformed")))
    )
    detail = F.coalesce(F.col("error"), F.col("status_code").cast("string"))
    judged = judged.select(
        "source_kind",
        "company",
        "token",
        "endpoint",
        "src_rank",
        "endpoint_ord",
        F.when(F.col("_body.malformed"), F.left("body", F.lit(RAW_CHARS))).alias("_unread"),
        F.when(F.col("reason").isNotNull(), detail).alias("detail"),
        F.when(F.col("_body.malformed"), F.lit(UNPARSEABLE)).otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("_body.malformed"), F.lit(None)).otherwise(F.col("_body.elements")).alias("_elements"),
    )
    return (
        judged.select("*", F.posexplode_outer("_elements").alias("src_pos", "_element"))
        .withColumns(
            {
                "_raw": F.coalesce("_element.raw", "_unread"),
                "_object": F.coalesce("_element.object", F.lit(False)),
                "_r": F.col("_element.r"),
            }
        )
        .drop("_elements", "_element", "_unread")
        .filter(F.col("reason").isNotNull() | F.col("src_pos").isNotNull())
    )


def is_object(raw: Column) -> Column:
    return F.coalesce(F.ltrim(raw).startswith("{"), F.lit(False))


def staged(rows: DataFrame, untitled: bool = False, **fields: Column) -> DataFrame:
    """Project to STAGED and drop records that lack a title or a URL; with ``untitled``, only
    those that lack a URL.

    Rows with a reason keep their raw text and get no listing fields.
    """
    good = F.col("reason").isNull()
    shaped = rows.select(
        *[F.when(good, fields[name]).cast("string").alias(name) for name in _LISTING_FIELDS],
        F.col("src_rank").cast("int").alias("src_rank"),
        F.col("endpoint_ord").cast("int").alias("endpoint_ord"),
        F.col("src_pos").cast("bigint").alias("src_pos"),
        "source_kind",
        "token",
        "endpoint",
        "reason",
        "detail",
        F.when(~good, F.col("_raw")).alias("raw"),
    )
    present = F.col("url").isNotNull() & (F.col("url") != "")
    if not untitled:
        present &= F.col("title").isNotNull() & (F.col("title") != "")
    return shaped.filter(F.col("reason").isNotNull() | present).select(*STAGED.fieldNames())
