"""Secret scan with multipart credential linking.

Strong findings (three base patterns) stand alone. Weak parts (account names, opaque
strings, endpoints) count only when a complementary part lies in the same scope, which an
interval join over the parts of each text decides.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import cut

SCOPE = 200  # code points between two parts of one credential, at most

# The base patterns, kinds in the order given, and shortest lengths.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # of 20 and more characters; a run starts only once
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE = 6

# Weak parts, of this library's own choice.
IDENT = re.compile(r"""(?ai)(?<![a-z0-9])(?:client_?id|account_?(?:id|name)|user_?(?:id|name)?|login)["']?\x20*[:=]\x20*["']?[a-z0-9._@-]{3,}""")
OPAQUE = re.compile(r"(?a)(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
ENDPOINT = re.compile(r"""(?ai)\b(?:https?|ftp|amqps?|redis|mongodb|postgres(?:ql)?|mysql)://[^\s"'<>]+""")

KINDS = ["assign", "access", "hex", "ident", "opaque", "endpoint"]
ROLES = ["secret", "name", "secret", "name", "secret", "place"]
BASE = 3


def parts_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all parts, base kinds first come first served.

    Weak parts that touch a base span are the same finding and left out.
    """
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    weak = []
    if "=" in text or ":" in text:
        weak += [(m.start(), 3, m.end()) for m in IDENT.finditer(text)]
    weak += [(m.start(), 4, m.end()) for m in OPAQUE.finditer(text)]
    if "://" in text:
        weak += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]
    if weak and base:
        weak = [w for w in weak if all(w[2] <= b[0] or b[2] <= w[0] for b in base)]
    return sorted(base + weak)


FOUND = "doc_id long, text_hash long, parts array<struct<start:int,kind:int,end:int>>"


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The parts of every whole text: FOUND columns, one row per row of ``docs``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [[{"start": a, "kind": k, "end": b} for a, k, b in parts_of(t or "")] for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text_hash": frame["text_hash"], "parts": parts})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, FOUND)


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with a complementary part in scope: (doc_id, text_hash, start, kind, end).

    Names and places need a secret, opaque strings a name or place. The join is on
    the text and a bin of ``scope`` code points; a bin holds at most ``scope`` parts, so
    no key grows with the data.
    """
    part = found.select("doc_id", "text_hash", F.explode("parts").alias("p")).select("doc_id", "text_hash", "p.*").distinct()
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("kind") + 1)
    part = part.withColumn("secret", role == "secret")
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope)))
    weak = part.filter(F.col("kind") >= BASE).withColumn("bin", bins(F.col("start"), F.col("end")))
    near = part.select(
        *[F.col(c).alias(f"other_{c}") for c in ("doc_id", "text_hash", "start", "end", "secret")],
        bins(F.col("start") - scope, F.col("end") + scope).alias("other_bin"),
    )
    match = (
        F.col("doc_id").eqNullSafe(F.col("other_doc_id"))
        & (F.col("text_hash") == F.col("other_text_hash"))
        & (F.col("bin") == F.col("other_bin"))
        & (F.col("secret") != F.col("other_secret"))
        & (F.col("other_start") - F.col("end") <= scope)
        & (F.col("start") - F.col("other_end") <= scope)
    )
    return weak.join(near, match, "left_semi").select("doc_id", "text_hash", "start", "kind", "end").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_assign, n_access, n_hex, base_sha256, spans).

    Null texts count as empty: no spans. Rows that repeat an id with another text are
    told apart by the text; rows that repeat both get equal results. Null ids stay null.
    Columns beside id and text are not read.
    """
    found = cut(find_parts(docs, id_col, text_col))
    linked = link(found, scope).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak"))
    linked = linked.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    rows = found.join(linked, same, "left")
    base = F.filter("parts", lambda p: p["kind"] < BASE)
    names = F.array(*map(F.lit, KINDS))
    said = lambda parts: F.concat_ws(
        ",", F.transform(F.array_sort(parts), lambda p: F.concat_ws(":", F.element_at(names, p["kind"] + 1), p["start"].cast("string"), p["end"].cast("string")))
    )
    count = lambda kind: F.size(F.filter("parts", lambda p: p["kind"] == kind)).cast("long")
    everything = F.concat(base, F.coalesce("weak", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(said(base), 256).alias("base_sha256"),
        said(everything).alias("spans"),
    )


def digest_of(parts: list[tuple[int, int, int]]) -> str:
    """base_sha256 of parts, for tests."""
    said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(parts) if k < BASE)
    return hashlib.sha256(said.encode()).hexdigest()
