"""Webhook payloads of alerts and run summaries, as structs and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve import defaults
from postsieve.functions.text import iso_utc, or_default, render_list, snippet
from postsieve.functions.tiers import tier_colour, tier_label

SNIPPET_CHARS = 300
SHOWN_ERRORS = 10
FOOTER = "listing alerts"
SUMMARY_TITLE = "Run complete"


def _fields(*entries: tuple[str, Column, bool]) -> Column:
    return F.array(
        *[F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(i).alias("inline")) for n, v, i in entries]
    )


def alert_embed(run_ts: Column, footer: str = FOOTER) -> Column:
    """The embed of one stored listing: title, link, tier colour and six fields."""
    score = F.col("score")
    return F.struct(
        F.col("title").alias("title"),
        F.col("url").alias("url"),
        tier_colour(score).alias("color"),
        _fields(
            ("Company", F.col("company"), True),
            ("Location", or_default("location", "Not listed"), True),
            ("Score", F.concat(score.cast("string"), F.lit(" — "), tier_label(score)), True),
            ("Source", F.coalesce("source", F.lit("unknown")), True),
            ("Keywords Matched", or_default(render_list("keywords"), "none"), False),
            ("Description", or_default(snippet("description", SNIPPET_CHARS), "No description"), False),
        ).alias("fields"),
        iso_utc(run_ts).alias("timestamp"),
        F.struct(F.lit(footer).alias("text")).alias("footer"),
    )


def alert_payloads(jobs: DataFrame, run_ts: Column, footer: str = FOOTER) -> DataFrame:
    """Add ``embed`` (struct) and ``payload`` (the JSON body to post)."""
    with_embed = jobs.withColumn("embed", alert_embed(run_ts, footer))
    return with_embed.withColumn("payload", F.to_json(F.struct(F.array("embed").alias("embeds"))))


def summary_payload(
    run: DataFrame, run_ts: Column, title: str = SUMMARY_TITLE, footer: str = FOOTER
) -> DataFrame:
    """Add ``embed`` and ``payload`` to RUNS rows: five fields, coloured by outcome,
    showing the first errors only."""
    clean = F.size("errors") == 0
    count = lambda c: F.col(c).cast("string")
    embed = F.struct(
        F.lit(title).alias("title"),
        F.when(clean, F.lit(defaults.SUMMARY_OK_COLOUR)).otherwise(F.lit(defaults.SUMMARY_ERROR_COLOUR)).alias("color"),
        _fields(
            ("Run Started", iso_utc("started_at"), True),
            ("Jobs Found", count("jobs_found"), True),
            ("New Jobs", count("jobs_new"), True),
            ("Alerts Sent", count("jobs_alerted"), True),
            ("Errors", or_default(render_list("errors", "\n", first=SHOWN_ERRORS), "None"), False),
        ).alias("fields"),
        iso_utc(run_ts).alias("timestamp"),
        F.struct(F.lit(footer).alias("text")).alias("footer"),
    )
    return run.withColumn("embed", embed).withColumn("payload", F.to_json(F.struct(F.array("embed").alias("embeds"))))
