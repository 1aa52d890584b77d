"""RSS feeds. A feed document is read as a whole when it is well-formed, otherwise item
by item, so that a cut-off or broken document still yields the items that can be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.functions.text import or_default, split_title, strip_html, strip_space, truncate
from postsieve.schemas import RAW_PAYLOAD
from postsieve.sources.explode import BAD_ITEM, HTTP_ERROR, RAW_CHARS, UNPARSEABLE, staged

_TEXTS = ("title", "link", "description", "summary", "author", "dc:creator", "location")
ITEM = T.StructType(
    [T.StructField(name, T.StringType()) for name in _TEXTS]
    + [T.StructField("category", T.ArrayType(T.StringType()))]
)
# Holds the text of an item that cannot be read.
UNREAD = "_unread"
_READ = T.StructType([*ITEM.fields, T.StructField(UNREAD, T.StringType())])
_CHANNEL = T.StructType([T.StructField("channel", T.StructType([T.StructField("item", T.ArrayType(_READ))]))])

AVIXA_DESCRIPTION_CHARS = 2000  # fixed value


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Feed files straight from storage, one row per item. A file is read by one task,
    item by item; tasks spread over files."""
    return spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)


def file_payloads(spark: SparkSession, path: str, source_kind: str, stream: bool = False) -> DataFrame:
    """Feed files as payload rows, one per file; with ``stream``, those that arrive. A broken
    file is then read item by item, and what cannot be read goes to quarantine, as for
    fetched feeds."""
    reader = spark.readStream if stream else spark.read
    values = {"source_kind": F.lit(source_kind), "endpoint": F.col("_metadata.file_path"), "status_code": F.lit(200), "body": F.col("value")}
    columns = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_PAYLOAD.fields]
    return reader.format("text").option("wholetext", True).load(path).select(*columns)


def items(payloads: DataFrame) -> DataFrame:
    """One row per item with ``_r`` of type ITEM; documents without items that could
    not be fetched or parsed give one row with a reason."""
    whole = F.from_xml("body", _CHANNEL)
    parsed = payloads.withColumn("_channel", whole["channel"])
    broken = F.col("_channel").isNull()
    single = F.transform(
        F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?s)<item[\s>].*?</item>"), F.lit(0)),
        lambda raw: F.struct(F.from_xml(raw, _READ, {"columnNameOfCorruptRecord": UNREAD}).alias("item"), raw.alias("raw")),
    )
    read = F.transform(F.col("_channel.item"), lambda i: F.struct(i.alias("item"), F.lit(None).cast("string").alias("raw")))
    found = parsed.select(
        "source_kind",
        "token",
        "endpoint",
        "src_rank",
        "endpoint_ord",
        "status_code",
        "error",
        F.when(broken, F.left("body", F.lit(RAW_CHARS))).alias("_body"),
        F.when(broken, single).otherwise(read).alias("_items"),
        broken.alias("_broken"),
    )
    empty = F.coalesce(F.size("_items"), F.lit(0)) <= 0
    reason = F.when(empty & F.col("error").isNotNull(), F.lit(HTTP_ERROR)).when(
        empty & F.col("_broken"), F.lit(UNPARSEABLE)
    )
    exploded = (
        found.withColumn("reason", reason)
        .withColumn("detail", F.when(reason.isNotNull(), F.coalesce("error", F.col("status_code").cast("string"))))
        .select("*", F.posexplode_outer("_items").alias("src_pos", "_item"))
        .filter(F.col("reason").isNotNull() | F.col("src_pos").isNotNull())
    )
    # an item of a broken document that cannot be read alone either
    unread = F.col("_item.item").isNull() | F.col(f"_item.item.{UNREAD}").isNotNull()
    lost = F.col("src_pos").isNotNull() & unread & F.col("_item.raw").isNotNull()
    return exploded.select(
        *[c for c in exploded.columns if c not in ("reason", "_item", "_items", "_body")],
        F.when(lost, F.lit(BAD_ITEM)).otherwise(F.col("reason")).alias("reason"),
        F.col("_item.item").alias("_r"),
        F.when(F.col("reason") == UNPARSEABLE, F.col("_body")).otherwise(F.col("_item.raw")).alias("_raw"),
    )


def _summary() -> Column:
    return F.coalesce(F.col("_r.summary"), F.col("_r.description"))


def wwr_items(rows: DataFrame) -> DataFrame:
    """Items titled 'Company: Job'."""
    company, title = split_title(F.coalesce(F.col("_r.title"), F.lit("")))
    return staged(
        rows,
        title=title,
        company=company,
        location=F.lit("Remote"),
        url=F.col("_r.link"),
        source=F.lit("WeWorkRemotely"),
        description=strip_html(_summary()),
    )


def avixa_items(rows: DataFrame) -> DataFrame:
    """Items whose company is the author, else the first tag, else the board itself."""
    author = F.nullif(strip_space(F.coalesce(F.col("_r.author"), F.col("_r").getField("dc:creator"))), F.lit(""))
    tags = F.filter(F.col("_r.category"), lambda t: strip_space(t) != "")
    tag = strip_space(F.get(tags, F.lit(0)))
    return staged(
        rows,
        title=strip_space("_r.title"),
        company=or_default(F.coalesce(author, tag), "AVIXA Board"),
        location=F.coalesce(F.col("_r.location"), F.lit("")),
        url=strip_space("_r.link"),
        source=F.lit("AVIXA"),
        description=truncate(strip_html(_summary()), AVIXA_DESCRIPTION_CHARS),
    )


def weworkremotely(payloads: DataFrame) -> DataFrame:
    return wwr_items(items(payloads))


def avixa(payloads: DataFrame) -> DataFrame:
    return avixa_items(items(payloads))


def from_files(item_rows: DataFrame, source_kind: str, src_rank: int, endpoint_ord: int = 0) -> DataFrame:
    """Give rows of ``read_items`` the shape the item normalisers take.

    Position within the feed is the row's place in its file split.
    """
    return item_rows.select(
        F.lit(source_kind).alias("source_kind"),
        F.lit(None).cast("string").alias("token"),
        F.input_file_name().alias("endpoint"),
        F.lit(src_rank).alias("src_rank"),
        F.lit(endpoint_ord).alias("endpoint_ord"),
        F.lit(None).cast("string").alias("reason"),
        F.lit(None).cast("string").alias("detail"),
        F.monotonically_increasing_id().alias("src_pos"),
        F.lit(None).cast("string").alias("_raw"),
        F.struct(*[F.col(f"`{n}`") for n in ITEM.fieldNames()]).alias("_r"),
    )
