"""Company boards: three JSON formats. The company name comes from the roster. With
``untitled``, postings without a title are listings too."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.functions.text import or_default, posting_url, strip_html, strip_space
from postsieve.sources.explode import BAD_RECORD, json_array, json_object, records, route_status, staged


def _reject_scalars(rows: DataFrame) -> DataFrame:
    bad = F.col("reason").isNull() & ~F.col("_object")
    return rows.withColumn("reason", F.when(bad, F.lit(BAD_RECORD)).otherwise(F.col("reason")))


def greenhouse(payloads: DataFrame, untitled: bool = False) -> DataFrame:
    """Object with a ``jobs`` array."""
    body = json_object(F.col("body"), "jobs", "array<string>")
    job = "title string, absolute_url string, location struct<name string>, content string"
    rows = _reject_scalars(records(payloads, body, route_status(), job, lambda b: b["jobs"]))
    return staged(
        rows,
        untitled,
        title=F.col("_r.title"),
        company=F.col("company"),
        location=F.coalesce(F.col("_r.location.name"), F.lit("")),
        url=F.col("_r.absolute_url"),
        source=F.concat(F.lit("Greenhouse/"), "token"),
        description=strip_html("_r.content"),
    )


def lever(payloads: DataFrame, untitled: bool = False) -> DataFrame:
    """Top-level array of postings, with further text in ``lists``."""
    posting = (
        "text string, hostedUrl string, categories struct<location string>,"
        " descriptionPlain string, lists array<struct<content string>>"
    )
    rows = _reject_scalars(records(payloads, json_array(F.col("body")), route_status(), posting))
    lists = F.coalesce(F.col("_r.lists"), F.array().cast("array<struct<content:string>>"))
    description = F.aggregate(
        lists,
        F.coalesce(F.col("_r.descriptionPlain"), F.lit("")),
        lambda text, part: F.concat(text, F.lit(" "), strip_html(part["content"])),
    )
    return staged(
        rows,
        untitled,
        title=F.col("_r.text"),
        company=F.col("company"),
        location=F.coalesce(F.col("_r.categories.location"), F.lit("")),
        url=F.col("_r.hostedUrl"),
        source=F.concat(F.lit("Lever/"), "token"),
        description=strip_space(description),
    )


def ashby(payloads: DataFrame, untitled: bool = False) -> DataFrame:
    """Query result with ``data.jobBoard.jobPostings``; no descriptions."""
    body = json_object(F.col("body"), "data", "struct<jobBoard struct<jobPostings array<string>>>")
    posting = "id string, title string, locationName string, workplaceType string"
    postings = lambda b: b["data"]["jobBoard"]["jobPostings"]
    rows = _reject_scalars(records(payloads, body, route_status(absent=(401, 403, 404)), posting, postings))
    place = F.coalesce(F.col("_r.locationName"), F.lit(""))
    remote = (F.col("_r.workplaceType") == "Remote") & (place == "")
    return staged(
        rows,
        untitled,
        title=F.col("_r.title"),
        company=F.col("company"),
        location=F.when(remote, F.lit("Remote")).otherwise(place),
        url=posting_url("token", F.nullif(F.col("_r.id"), F.lit(""))),
        source=F.concat(F.lit("Ashby/"), "token"),
        description=F.lit(""),
    )


def remoteok(payloads: DataFrame, untitled: bool = False) -> DataFrame:
    """Top-level array whose first element is metadata; other elements that are not
    objects are skipped."""
    item = "position string, company string, url string, location string, description string"
    rows = records(payloads, json_array(F.col("body")), route_status(absent=()), item)
    rows = rows.filter(F.col("reason").isNotNull() | ((F.col("src_pos") > 0) & F.col("_object")))
    return staged(
        rows,
        untitled,
        title=F.col("_r.position"),
        company=F.coalesce(F.col("_r.company"), F.lit("")),
        location=or_default("_r.location", "Remote"),
        url=F.col("_r.url"),
        source=F.lit("RemoteOK"),
        description=strip_html("_r.description"),
    )
