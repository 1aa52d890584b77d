"""Chat formatting of typed content parts, with a reversible template and a loss mask.

A conversation becomes one text. Each turn is ``<turn role>`` + content + ``</turn>`` and
a line feed. Inside roles and contents a backslash goes before every backslash, ``<`` and
``>``, so that no text can spell a control string and dropping those backslashes gives
the text back. Placeholders of attachments are control strings, too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
# Units of attachments that one token stands for, by kind: pixels, milliseconds, bytes.
TOKEN_UNITS = {"image": 28 * 28, "audio": 40, "document": 4}

_ESCAPED = re.compile(r"[\\<>]")
_PLAIN = r"[^\\<>]*(?:\\.[^\\<>]*)*"
_HEAD = re.compile(rf"<turn ({_PLAIN})>", re.S)
_MARK = re.compile(rf"<\|(\w+):(\d+)\|>|({_PLAIN})", re.S)
_BACK = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


@dataclass
class Flattener:
    """Visits the parts of a conversation in order; one method per kind of part."""

    attachments: list[tuple[str, str, int]] = field(default_factory=list)

    def visit(self, part: dict) -> str:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"no such kind of part: {kind}")
        return method(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        return self._placeholder("image", part)

    def visit_audio(self, part: dict) -> str:
        return self._placeholder("audio", part)

    def visit_document(self, part: dict) -> str:
        return self._placeholder("document", part)

    def _placeholder(self, kind: str, part: dict) -> str:
        tokens = max(1, -(-int(part.get("size") or 0) // TOKEN_UNITS[kind]))
        self.attachments.append((kind, part.get("uri") or "", tokens))
        return f"<|{kind}:{len(self.attachments) - 1}|>"


@dataclass
class Formatted:
    text: str
    loss: list[tuple[int, int]]  # spans of ``text`` under the loss mask
    attachments: list[tuple[str, str, int]]  # kind, reference, expanded token count


def format_turns(turns: list[tuple[str, list[dict]]], loss_role: str = "assistant") -> Formatted:
    """``turns`` are (role, parts); the loss mask covers the contents of ``loss_role``."""
    visitor, out, loss, at = Flattener(), [], [], 0
    for role, parts in turns:
        head = f"<turn {escape(role)}>"
        body = "".join(visitor.visit(p) for p in parts)
        if role == loss_role:
            loss.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return Formatted("".join(out), loss, visitor.attachments)


def read_parts(text: str, at: int, attachments: list[tuple[str, str, int]]) -> tuple[list[dict], int]:
    """The parts that begin at ``at``, and where they end (at another control string)."""
    parts = []
    while (m := _MARK.match(text, at)) and m.end() > at:
        if m[1]:
            kind, uri, tokens = attachments[int(m[2])]
            parts.append({"type": kind, "uri": uri, "tokens": tokens})
        else:
            parts.append({"type": "text", "text": unescape(m[3])})
        at = m.end()
    return parts, at


def read_turns(text: str, attachments: list[tuple[str, str, int]]) -> list[tuple[str, list[dict]]]:
    """The inverse of format_turns, up to merging neighbouring text parts."""
    turns, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        if not head:
            raise ValueError(f"no turn at {at}")
        parts, end = read_parts(text, head.end(), attachments)
        if not text.startswith(END, end):
            raise ValueError(f"no end of turn at {end}")
        turns.append((unescape(head[1]), parts))
        at = end + len(END)
    return turns


def spoken(parts: list[dict]) -> str:
    """The text parts alone."""
    return "".join(p.get("text", "") for p in parts)


PARTS = "array<struct<type:string,text:string,uri:string,size:bigint>>"
FORMATTED = (
    "conv_id long, n_turns long, formatted string, loss array<struct<start:int,end:int>>, "
    "attachments array<struct<kind:string,uri:string,tokens:bigint>>, n_tokens_attached long"
)


def format_conversations(rows: DataFrame) -> DataFrame:
    """One formatted text per conversation: FORMATTED columns.

    ``rows``: conv_id, turn, role, and ``text`` or ``parts`` (PARTS; used where not null).
    Turns go by (turn, role, text or parts), nulls first; rows that repeat a turn all
    stay. Null roles and texts count as empty; rows with a null conv_id form one
    conversation of their own. Other columns are not read. The turns of a conversation
    meet in one row, as its output is one value; conversations spread over tasks by id.
    """
    text = F.col("text") if "text" in rows.columns else F.lit(None).cast("string")
    parts = F.col("parts") if "parts" in rows.columns else F.lit(None).cast(PARTS)
    turn = F.struct(F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), parts.cast(PARTS).alias("parts"))
    talks = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv_id, turns in zip(frame["conv_id"], frame["turns"], strict=True):
                done = format_turns([(t["role"], [{"type": "text", "text": t["text"]}] if t["parts"] is None else list(t["parts"])) for t in turns])
                spans = [{"start": a, "end": b} for a, b in done.loss]
                files = [dict(zip(("kind", "uri", "tokens"), a, strict=True)) for a in done.attachments]
                out.append((None if pd.isna(conv_id) else int(conv_id), len(turns), done.text, spans, files, sum(a[2] for a in done.attachments)))
            result = pd.DataFrame(out, columns=["conv_id", "n_turns", "formatted", "loss", "attachments", "n_tokens_attached"])
            yield result.astype({"conv_id": "Int64"})

    return talks.mapInPandas(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts say, by parsing them: DIGESTS columns."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", errors="surrogatepass")).hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv_id, text, spans, files in zip(frame["conv_id"], frame["formatted"], frame["loss"], frame["attachments"], strict=True):
                known = [(f["kind"], f["uri"], f["tokens"]) for f in files]
                turns = read_turns(text, known)
                said = "".join(f"{role}\n{spoken(parts)}\n" for role, parts in turns)
                lost = "".join(spoken(read_parts(text[s["start"] : s["end"]], 0, known)[0]) for s in spans)
                out.append((None if pd.isna(conv_id) else int(conv_id), len(turns), sha(said), len(lost), sha(lost), len(text), len(known)))
            result = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments"])
            yield result.astype({"conv_id": "Int64"})

    return formatted.mapInPandas(run, DIGESTS)
