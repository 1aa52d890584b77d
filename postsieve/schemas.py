"""Explicit schemas of every table the library reads or writes."""

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def _struct(spec: str) -> T.StructType:
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _TYPES[kind], True))
    return T.StructType(fields)


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
}

# One fetched response. Boards are identified by (source_kind, token); feeds by
# source_kind and endpoint_ord.
RAW_PAYLOAD = _struct(
    "source_kind string, company string, token string, endpoint string, status_code int,"
    " error string, body string, fetched_at timestamp, src_rank int, endpoint_ord int"
)

# One normalised listing. (src_rank, endpoint_ord, src_pos) is the arrival order
# that decides which copy of a listing wins.
LISTING = _struct(
    "title string, company string, location string, url string, source string,"
    " description string, src_rank int, endpoint_ord int, src_pos bigint"
)

# A listing, or (reason not null) something that could not become one.
STAGED = T.StructType(
    LISTING.fields
    + _struct("source_kind string, token string, endpoint string, reason string, detail string, raw string").fields
)

# Where something came from, and what could not be read of it.
QUARANTINE = _struct(
    "source_kind string, token string, endpoint string, endpoint_ord int, reason string, detail string, raw string"
)

ROSTER = _struct("ord int, name string, ats string, token string")
LEXICON = _struct("ord int, phrase string, weight int")

JOBS = _struct(
    "job_key string, job_id string, title string, company string, location string, url string, source string,"
    " score int, keywords strings, description string, blocked boolean, is_target boolean,"
    " seen_at timestamp"
)
# A listing as a stream scored it, copies included.
SCORED = _struct(
    "job_key string, job_id string, title string, company string, location string, url string, source string,"
    " description string, src_rank int, endpoint_ord int, src_pos bigint, source_kind string, token string,"
    " endpoint string, blocked boolean, is_target boolean, score int, keywords strings"
)
DELIVERIES = _struct("job_key string, job_id string, delivered_at timestamp, ok boolean")
RUNS = _struct(
    "started_at timestamp, finished_at timestamp, jobs_found bigint, jobs_new bigint,"
    " jobs_alerted bigint, errors strings"
)
OUTBOX = _struct("seq bigint, job_key string, job_id string, score int, mode string, payload string")
SUMMARIES = _struct("mode string, payload string")
CLOCKS = _struct("started_at timestamp")
STEPS = _struct("mode string")  # written once the outbox of a run is complete
SOURCE_COUNTS = _struct("level int, source_kind string, endpoint_ord int, listings bigint")
ZERO_YIELD = _struct("ord int, name string, ats string, token string, label string")


def partitioned(schema: T.StructType, column: str) -> T.StructType:
    """The schema as stored: its columns plus a string partition column."""
    return T.StructType(schema.fields + [T.StructField(column, T.StringType(), True)])


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """Rows given in the program as a local relation: its size is known to the optimizer
    and reading it takes no job."""
    columns = list(zip(*rows)) or [()] * len(schema.fields)
    return spark.createDataFrame(
        pa.table([list(c) for c in columns], schema=to_arrow_schema(schema)), schema
    )
