"""Endpoint health: which rostered boards still yield listings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.embedded import embedded_json, json_count
from postsieve.functions.text import truncate

OK, EMPTY, HTTP_ERR, ERR = "OK", "EMPTY", "HTTP_ERR", "ERR"
AUDITED_KINDS = ("greenhouse", "lever", "ashby")
_INVALID = "invalid JSON"
NO_RESPONSE = "no response"
DETAIL_CHARS = 60  # fixed value


def _not_json(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text).isNull(), F.lit(True))


def classify(responses: DataFrame) -> DataFrame:
    """(ats, token, fetched_at, status, detail) of each response of an audited kind.

    ``detail`` is the listing count, HTTP code, or error text. Bodies go no further than
    this. Boards publish a ``jobs`` array (greenhouse), a page with embedded data (ashby)
    or a top-level array (lever).
    """
    probed = responses.filter(F.col("source_kind").isin(*AUDITED_KINDS)).withColumn("ats", F.col("source_kind"))
    page = F.col("ats") == "ashby"
    read = probed.withColumn("_json", F.when(page, embedded_json("body")).otherwise(F.col("body")))
    failed = ~F.coalesce(F.col("status_code").between(200, 299), F.lit(False))
    no_data = page & F.col("_json").isNull() & F.col("body").isNotNull()
    count = (
        F.when(page, json_count("_json", "$.jobBoard.jobPostings"))
        .when(F.col("ats") == "greenhouse", json_count("_json", "$.jobs"))
        .otherwise(json_count("_json"))
    )
    message = F.coalesce(F.col("error"), F.when(F.col("status_code").isNull(), F.lit(NO_RESPONSE)))
    judged = read.withColumn(
        "_problem",
        F.when(message.isNotNull(), message).when(~failed & ~no_data & _not_json(F.col("_json")), F.lit(_INVALID)),
    ).withColumn("_count", count)
    http = failed & F.col("status_code").isNotNull()
    status = (
        F.when(http, F.lit(HTTP_ERR))
        .when(F.col("_problem").isNotNull(), F.lit(ERR))
        .when(F.col("_count") > 0, F.lit(OK))
        .otherwise(F.lit(EMPTY))
    )
    detail = (
        F.when(http, F.col("status_code").cast("string"))
        .when(F.col("_problem").isNotNull(), truncate("_problem", DETAIL_CHARS))
        .otherwise(F.col("_count").cast("string"))
    )
    return judged.select("ats", "token", "fetched_at", status.alias("status"), detail.alias("detail"))


def endpoints(roster: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every roster entry of an audited kind with the status of its endpoint.

    The newest response of an endpoint counts (of equally new ones the largest status,
    detail), and is picked before the shuffle as far as it can be. Entries that share an
    endpoint are all kept; an entry without a response is an error.
    """
    newest = (
        classify(payloads)
        .groupBy("ats", "token")
        .agg(F.max(F.struct("fetched_at", "status", "detail")).alias("_r"))
        .select("ats", "token", "_r.status", "_r.detail")
    )
    kinds = roster.filter(F.col("ats").isin(*AUDITED_KINDS))
    return kinds.join(newest, ["ats", "token"], "left").select(
        "ord",
        "name",
        "ats",
        "token",
        F.coalesce("status", F.lit(ERR)).alias("status"),
        F.when(F.col("status").isNull(), F.lit(NO_RESPONSE)).otherwise(F.col("detail")).alias("detail"),
    )


def tally(classified: DataFrame) -> DataFrame:
    """Endpoints per bucket: ok, empty, broken."""
    bucket = F.when(F.col("status") == OK, "ok").when(F.col("status") == EMPTY, "empty").otherwise("broken")
    return classified.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("endpoints"))


def repairs(classified: DataFrame) -> DataFrame:
    """Broken endpoints with the public page on which to look for the right token."""
    page = (
        F.when(F.col("ats") == "greenhouse", F.lit("https://boards.greenhouse.io/"))
        .when(F.col("ats") == "ashby", F.lit("https://jobs.ashbyhq.com/"))
        .otherwise(F.lit("https://jobs.lever.co/"))
    )
    return classified.filter(F.col("status").isin(HTTP_ERR, ERR)).select(
        "ord", "name", "ats", "token", "status", "detail", F.concat(page, "token").alias("suggested_url")
    )
