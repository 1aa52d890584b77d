"""JSON found inside other text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the script variable that holds a hosted board's data. The match is
# non-greedy, so it ends at the first '};'.
_APP_DATA = r"(?s)window\.__appData\s*=\s*(\{.*?\});"


def embedded_json(html) -> Column:
    """The JSON object assigned in the page's script; null when there is none."""
    html = F.col(html) if isinstance(html, str) else html
    return F.nullif(F.regexp_extract(html, _APP_DATA, 1), F.lit(""))


def json_count(json, path: str = "$") -> Column:
    """Length of the array at ``path``; 0 when absent or not an array."""
    json = F.col(json) if isinstance(json, str) else json
    target = json if path == "$" else F.get_json_object(json, path)
    return F.coalesce(F.json_array_length(target), F.lit(0))
