"""Removal of repeated byte strings by external induced suffix sorting.

Only suffixes that can matter are sorted. Every window of ``length`` bytes names one
anchor: the position of its smallest gram hash, which equal windows share. Anchors whose
gram occurs once lead nowhere. The suffixes at the others are sorted from a disk-backed
priority queue by gram and right context, with the common-prefix lengths of neighbours.
From them the order of the suffixes one byte to the left is induced by a stable pass over
the preceding bytes, with prefix lengths from range minima; and again from those, back to
the leftmost window of each anchor. A window repeats when its suffix shares ``length``
bytes with a neighbour. Grams decide where a suffix goes, so each task sorts its own.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm.common import RollingBytes, as_bytes, byte_pieces, cut

LENGTH = 200
GRAM = 32
HOT = 5_000  # contexts of one gram that a task sorts together (a few MB); beyond it windows go by digests
QUEUE_BYTES = 48 << 20
BATCH = 8_000
BROADCAST_IDS = 1_000_000
SECOND_BASE = np.uint64(0xE7037ED1A0B428DB)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(texts: list[bytes], length: int, gram: int) -> dict[str, np.ndarray]:
    """The windows of all texts by anchor: arrays text, gram, context, start, many, off.

    One entry stands for ``many`` consecutive windows from byte ``start`` of the text,
    whose anchor lies ``off`` bytes after ``start``; ``context`` hashes their bytes.
    """
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return {"text": empty, "gram": empty, "context": empty, "start": empty, "many": empty, "off": empty}
    rolling = RollingBytes(data)
    hashes = rolling.all(gram)
    width = length - gram + 1
    least = sliding_min(hashes, width)  # of each window
    ends = np.cumsum(sizes)
    begins = ends - sizes
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - length + 1, 0))
    window = np.arange(len(owner)) + np.repeat(begins - np.concatenate(([0], np.cumsum(np.maximum(sizes - length + 1, 0))))[:-1], np.maximum(sizes - length + 1, 0))
    if not len(window):
        return {"text": empty, "gram": empty, "context": empty, "start": empty, "many": empty, "off": empty}
    value = least[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(window)])) - 1
    start, stop, text = window[first], window[last], owner[first]
    views = np.lib.stride_tricks.sliding_window_view(hashes, width)
    at = np.concatenate([start[i : i + 4096] + views[start[i : i + 4096]].argmin(1) for i in range(0, len(start), 4096)])
    tied = np.flatnonzero(at < stop)  # the same hash comes again before the run ends
    if len(tied):
        extra = []
        for r in tied.tolist():
            same = start[r] + np.flatnonzero(hashes[start[r] : stop[r] + width] == hashes[at[r]])
            low = np.concatenate(([start[r]], same[:-1] + 1))
            high = np.minimum(same, stop[r])
            good = low <= high
            extra.append((np.full(good.sum(), text[r]), low[good], high[good], same[good]))
        rest = np.ones(len(start), bool)
        rest[tied] = False
        joined = [np.concatenate([x[rest], *(e[i] for e in extra)]) for i, x in enumerate((text, start, stop, at))]
        text, start, stop, at = joined
    return {
        "text": text,
        "gram": hashes[at].view(np.int64),
        "context": rolling.of(start, stop + length).view(np.int64),
        "start": start - begins[text],
        "many": stop - start + 1,
        "off": at - start,
    }


class DiskQueue:
    """A priority queue of tuples that keeps at most ``memory`` bytes of them and sorts the
    rest out to a temporary file of the task, gone when the queue is closed."""

    def __init__(self, memory: int = QUEUE_BYTES):
        self.memory, self.held, self.used, self.runs = memory, [], 0, []
        self.file = None

    def push(self, item: tuple, size: int) -> None:
        self.held.append(item)
        self.used += size
        if self.used >= self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.held.sort()
        blocks = []
        for i in range(0, len(self.held), 2000):
            blob = pickle.dumps(self.held[i : i + 2000], protocol=pickle.HIGHEST_PROTOCOL)
            self.file.seek(0, 2)
            blocks.append((self.file.tell(), len(blob)))
            self.file.write(blob)
        self.runs.append(blocks)
        self.held, self.used = [], 0

    def _read(self, blocks: list[tuple[int, int]]) -> Iterator[tuple]:
        for at, size in blocks:
            self.file.seek(at)
            yield from pickle.loads(self.file.read(size))  # noqa: S301  written by this task

    def drain(self) -> Iterator[tuple]:
        """All tuples in ascending order."""
        self.held.sort()
        yield from heapq.merge(self.held, *(self._read(b) for b in self.runs)) if self.runs else self.held

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high]) for low < high, from a table of doubled ranges."""
    if not len(low):
        return values[:0]
    level = np.int64(np.log2(np.maximum(high - low, 1)) + 1e-9)
    out = np.empty(len(low), values.dtype)
    table = values
    for k in range(int(level.max()) + 1):
        now = level == k
        if now.any():
            out[now] = np.minimum(table[low[now]], table[high[now] - (1 << k)])
        if k < level.max():
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def induce(contexts: list[bytes], group: np.ndarray, off: np.ndarray, many: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(element, distance) of every repeated window, distance counted left from the anchor.

    ``contexts`` are in the order of (group, bytes from the anchor on); the anchor of
    element x lies ``off[x]`` bytes into its context, and its windows begin at distances
    off - many + 1 .. off.
    """
    n = len(contexts)
    widest = int(off.max()) if n else 0
    right = [c[o:] for c, o in zip(contexts, off.tolist(), strict=True)]
    sizes = np.array([len(r) for r in right])
    table = np.zeros((n, length), np.uint8)
    left = np.zeros((n, widest + 1), np.uint8)  # left[x, d]: the byte d + 1 before the anchor
    for x, (c, o) in enumerate(zip(contexts, off.tolist(), strict=True)):
        table[x, : sizes[x]] = np.frombuffer(right[x], np.uint8)
        left[x, :o] = np.frombuffer(c[:o], np.uint8)[::-1]
    same = table[1:] == table[:-1]
    common = np.where(same.all(1), length, same.argmin(1))
    common = np.minimum(common, np.minimum(sizes[1:], sizes[:-1]))
    common[group[1:] != group[:-1]] = 0
    order = np.arange(n)
    shared = np.concatenate(([0], common)).astype(np.int32)  # with the one before in order
    nearest = off - many + 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for distance in range(widest + 1):
        best = np.maximum(shared, np.concatenate((shared[1:], [0])))
        hit = order[(best >= length) & (nearest[order] <= distance)]
        if len(hit):
            found.append((hit, np.full(len(hit), distance)))
        # a suffix goes on while bytes to its left remain and could still make it repeat
        on = (off[order] > distance) & (best + off[order] - distance >= length)
        old = np.flatnonzero(on)
        if not len(old):
            break
        kept = order[old]
        byte = left[kept, distance]
        # a stable pass by group and preceding byte keeps the order of what follows
        key = group[kept].astype(np.int64) * 256 + byte
        turn = np.argsort(key, kind="stable")
        place, key = old[turn], key[turn]
        equal = np.flatnonzero(key[1:] == key[:-1])
        fresh = np.zeros(len(place), np.int32)
        fresh[equal + 1] = 1 + _range_min(shared, place[equal] + 1, place[equal + 1] + 1)
        order, shared = kept[turn], fresh
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _stretches(doc: np.ndarray, mark: np.ndarray, window: np.ndarray, length: int) -> pd.DataFrame:
    """Windows joined to stretches of covered bytes: (doc, mark, low, high)."""
    order = np.lexsort((window, mark, doc))
    doc, mark, window = doc[order], mark[order], window[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (window[1:] > window[:-1] + length)
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return pd.DataFrame({"doc": doc[first], "mark": mark[first], "low": window[first], "high": window[last] + length})


STRETCH = "doc long, mark int, low long, high long"
ANCHOR = "doc long, mark int, gram long, context long, start long, many int, off int"


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """ANCHOR rows of ``texts`` (doc, mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part, blobs in byte_pieces(batch.column(2), 1_000_000):
                found = anchors(blobs, length, gram)
                owner = found["text"] + part.start
                arrays = [doc[owner], mark[owner], found["gram"], found["context"], found["start"].astype(np.int64), found["many"].astype(np.int32), found["off"].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["doc", "mark", "gram", "context", "start", "many", "off"])

    return texts.mapInArrow(run, ANCHOR)


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``texts`` of the given (doc, mark), broadcast when there are few enough."""
    ids = cut(ids.select("doc", "mark").distinct())
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["doc", "mark"], "left_semi")


def _contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes around the ``wanted`` anchors: (gram, doc, mark, start, many, off, bytes)."""
    per = wanted.groupBy("doc", "mark").agg(F.collect_list(F.struct("gram", "start", "many", "off")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, mark, text, asked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                blob = (text or "").encode("utf-8")
                out += [(a["gram"], doc, mark, a["start"], a["many"], a["off"], blob[a["start"] : a["start"] + a["many"] - 1 + length]) for a in asked]
                if len(out) > 20_000:
                    yield _packed(out)
                    out = []
            if out:
                yield _packed(out)

    return _only(texts, wanted).join(per, ["doc", "mark"]).select("doc", "mark", "text", "wanted").mapInArrow(run, _CONTEXT)


_CONTEXT = "gram long, doc long, mark int, start long, many int, off int, bytes binary"
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    names = ["gram", "doc", "mark", "start", "many", "off", "bytes"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=names)


def sorted_stretches(contexts: DataFrame, length: int, memory: int = QUEUE_BYTES) -> DataFrame:
    """STRETCH rows of the repeated windows among contexts that meet by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        queue = DiskQueue(memory)
        try:
            for frame in batches:
                for gram, doc, mark, start, many, off, blob in frame.itertuples(index=False, name=None):
                    # ordered by gram, then by what follows the anchor
                    queue.push((gram, blob[off:], doc, mark, start, many, off, blob[:off]), 2 * len(blob) + 300)
            held: list[tuple] = []
            for item in queue.drain():
                if len(held) >= BATCH and held[-1][0] != item[0]:
                    yield finish(held)
                    held = []
                held.append(item)
            if held:
                yield finish(held)
        finally:
            queue.close()

    def finish(held: list[tuple]) -> pd.DataFrame:
        gram, right, doc, mark, start, many, off, before = zip(*held, strict=True)
        gram, doc, mark, start, many, off = (np.array(x, np.int64) for x in (gram, doc, mark, start, many, off))
        group = np.concatenate(([0], np.cumsum(gram[1:] != gram[:-1])))
        element, distance = induce([a + b for a, b in zip(before, right, strict=True)], group, off, many, length)
        return _stretches(doc[element], mark[element], start[element] + off[element] - distance, length)

    return contexts.repartition("gram").mapInPandas(run, STRETCH)


def digest_stretches(contexts: DataFrame, length: int) -> DataFrame:
    """The same for grams with very many contexts: each window goes by two hashes of its
    bytes, counted with partial sums, so that no task holds a gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4, 6)), strict=True))
            for i in range(0, len(rows), 2000):
                some = rows[i : i + 2000]
                data = np.frombuffer(b"".join(r[4] for r in some), np.uint8)
                many = np.array([r[3] for r in some])
                begin = np.cumsum([0, *(len(r[4]) for r in some)])[:-1]
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                at = np.repeat(begin, many) + step
                first, second = (RollingBytes(data, base).of(at, at + length).view(np.int64) for base in (RollingBytes.__init__.__defaults__[0], SECOND_BASE))
                arrays = [first, second, np.repeat([r[0] for r in some], many), np.repeat(np.array([r[1] for r in some], np.int32), many), np.repeat([r[2] for r in some], many) + step]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["first", "second", "doc", "mark", "low"])

    windows = cut(contexts.mapInArrow(run, "first long, second long, doc long, mark int, low long"))
    twice = cut(windows.groupBy("first", "second").count().filter("count > 1").select("first", "second"))
    return windows.join(twice, ["first", "second"], "left_semi").select("doc", "mark", "low", (F.col("low") + length).alias("high"))


def repeated_stretches(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """STRETCH rows that cover every byte in a window of ``length`` bytes that also begins
    anywhere else; ``texts`` has doc, mark (together one text) and text. Rows overlap."""
    every = cut(anchor_rows(texts, length, gram))
    twice = cut(every.groupBy("gram").count().filter("count > 1").select("gram"))
    live = cut(every.join(twice, "gram", "left_semi"))
    classes = cut(
        live.groupBy("gram", "context").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "mark", "start", "many", "off")).alias("one"))
    )
    # the whole context stands elsewhere: all its windows do
    whole = live.join(classes.filter("copies > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    settled = whole.select("doc", "mark", F.col("start").alias("low"), (F.col("start") + F.col("many") - 1 + length).alias("high"))
    # one context of each kind takes part where a gram has several
    groups = cut(classes.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    wanted = classes.join(groups, "gram").select("gram", "kinds", "one.*")
    near = sorted_stretches(_contexts(texts, wanted.filter(F.col("kinds") <= hot), length), length)
    parts = settled.union(near)
    if not groups.filter(F.col("kinds") > hot).isEmpty():
        parts = parts.union(digest_stretches(_contexts(texts, wanted.filter(F.col("kinds") > hot), length), length))
    return cut(parts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept).

    ``kept`` is what remains of the text as bytes. Null and short texts lose nothing; null
    counts as empty. Every row is a text of its own: where ids repeat or are null, rows are
    numbered first, and rows that repeat id and text are copies of each other, so whole
    windows of them go. Null ids stay. Other columns are not read; an empty table gives an
    empty result.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ids.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).isEmpty():
        texts = ids.select(F.col("doc_id").alias("doc"), F.lit(0).alias("mark"), "text", "doc_id")
    else:
        texts = cut(ids.select(F.monotonically_increasing_id().alias("doc"), F.lit(0).alias("mark"), "text", "doc_id"))
    plain = texts.select("doc", "mark", "text")
    stretches = repeated_stretches(plain, length, gram, hot)
    per = stretches.groupBy("doc", "mark").agg(F.collect_list(F.struct("low", "high")).alias("stretches"))
    touched = cut(stretches.select("doc", "mark").distinct())
    few = F.broadcast(touched) if touched.count() <= BROADCAST_IDS else touched
    clean = texts.join(few, ["doc", "mark"], "left_anti")
    clean = clean.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
        F.encode("text", "UTF-8").alias("kept"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, blobs = batch.column(0), as_bytes(batch.column(1).to_pylist())
            out = [trim(b, s) for b, s in zip(blobs, batch.column(2).to_pylist(), strict=True)]
            columns = [
                ids,
                pa.array([len(b) for b in blobs], pa.int64()),
                pa.array([len(b) - len(o[0]) for b, o in zip(blobs, out, strict=True)], pa.int64()),
                pa.array([o[1] for o in out], pa.int64()),
                pa.array([hashlib.sha256(o[0]).hexdigest() for o in out], pa.string()),
                pa.array([o[0] for o in out], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    cutting = texts.join(few, ["doc", "mark"], "left_semi").join(per, ["doc", "mark"]).select("doc_id", "text", "stretches")
    trimmed = cutting.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return clean.union(trimmed)


def trim(blob: bytes, stretches: list[dict]) -> tuple[bytes, int]:
    """``blob`` without the stretches, and the number of maximal removed runs."""
    kept, at, runs = [], 0, 0
    reach = -1
    for s in sorted((s["low"], s["high"]) for s in stretches):
        if s[0] > reach:  # a gap, so another run
            runs += 1
            kept.append(blob[at : s[0]])
        reach = max(reach, s[1])
        at = reach
    kept.append(blob[at:])
    return b"".join(kept), runs
