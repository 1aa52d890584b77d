"""Small builders for payload and listing rows."""

import json

from postsieve.schemas import LISTING, RAW_PAYLOAD


def payload(kind, body=None, token=None, status=200, error=None, endpoint_ord=None):
    if body is not None and not isinstance(body, str):
        body = json.dumps(body)
    return (kind, None, token, None, status, error, body, None, None, endpoint_ord)


def payload_frame(spark, *rows):
    return spark.createDataFrame(list(rows), RAW_PAYLOAD)


def listing(title, company="C", url="u", description="", source="s", rank=0, endpoint=0, pos=0, location=""):
    return (title, company, location, url, source, description, rank, endpoint, pos)


def listing_frame(spark, *rows):
    return spark.createDataFrame(list(rows), LISTING)


def rss(items):
    return f'<?xml version="1.0"?><rss version="2.0"><channel><title>F</title>{items}</channel></rss>'
