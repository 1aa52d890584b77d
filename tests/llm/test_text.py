"""BPE, chat formatting, toxicity and mixing against other implementations."""

import base64
import hashlib
import random
import zlib
from itertools import islice

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
import tiktoken
from pyspark.errors import PySparkException

from postsieve.llm import byte_bpe, chat, mixing, toxicity
from postsieve.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = [None, "", " ", "\n\n  \t x", "a" * 5000, " " * 3000, "ééé ñandú  東京タワー 🙂🙂", "<|endoftext|> <unk> ▁x", "it's WE'LL 1234567890", "\x00\x01�­", "é" * 777 + "ñ" * 778]


def test_ids_equal_tiktoken(spark, encoding):
    rng = random.Random(1)
    texts = HARD + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x24F), rng.randint(0x4E00, 0x4F00), 0x1F600, 32])) for _ in range(300)) for _ in range(30)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    blob = byte_bpe.rank_file(PATH)
    rows = byte_bpe.encode_texts(frame, blob, public_tokenizers.PATTERN)
    for r in rows.collect():
        text = texts[r.doc_id] or ""
        assert byte_bpe.ids_of(r.ids) == encoding.encode_ordinary(text)
        assert r.n_tokens == len(r.ids) // 4
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = byte_bpe.decode_frame(rows, blob, public_tokenizers.PATTERN)
    assert all(r.decoded == (texts[r.doc_id] or "") for r in back.collect())
    assert byte_bpe.encode_texts(frame.limit(0), blob, public_tokenizers.PATTERN).count() == 0


def test_model_needs_all_bytes():
    with pytest.raises(ValueError):
        byte_bpe.serialise_model({b"a": 0})


def test_bpe_query(spark, encoding):
    texts = pd.read_parquet(f"{SF}/documents.parquet")
    want = sorted((i, len(ids := encoding.encode_ordinary(t)), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(texts.doc_id, texts.text, strict=True))
    assert sorted(map(tuple, QUERIES["op8_byte_bpe"](spark, SF).collect())) == want


# chat


def test_escapes_are_reversible():
    rng = random.Random(2)
    tokens = ["<turn user>", "</turn>", "\n", "\\", "<", ">", "<|image:0|>", "\\<", "é", "x", "|>"]
    for _ in range(300):
        turns = [("".join(rng.choices(tokens, k=rng.randint(0, 3))), "".join(rng.choices(tokens, k=rng.randint(0, 9)))) for _ in range(rng.randint(0, 5))]
        done = chat.format_turns([(r, [{"type": "text", "text": t}]) for r, t in turns])
        assert [(r, chat.spoken(p)) for r, p in chat.read_turns(done.text, done.attachments)] == turns


def test_typed_parts():
    parts = [
        {"type": "text", "text": "see <|image:0|>"},
        {"type": "image", "uri": "a.png", "size": 28 * 28 * 10},
        {"type": "audio", "uri": "b.wav", "size": 401},
        {"type": None, "text": None},
        {"type": "document", "uri": "c.pdf", "size": 0},
    ]
    done = chat.format_turns([("user", parts), ("assistant", [{"text": "ok"}])])
    assert done.attachments == [("image", "a.png", 10), ("audio", "b.wav", 11), ("document", "c.pdf", 1)]
    assert done.text.count("<|image:0|>") == 1 and done.text.index("<|image:0|>") < done.text.index("<|audio:1|>")
    assert [done.text[a:b] for a, b in done.loss] == ["ok"]
    read = chat.read_turns(done.text, done.attachments)
    assert [p["type"] for p in read[0][1]] == ["text", "image", "audio", "document"]
    with pytest.raises(ValueError):
        chat.format_turns([("user", [{"type": "video"}])])


def plain_chat(rows):
    talks = {}
    for r in rows:
        talks.setdefault(r[0], []).append(r)
    out = []
    for conv, turns in talks.items():
        turns = sorted(((-1 if t is None else t), r or "", x or "") for _, t, r, x in turns)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        lost = "".join(x for _, r, x in turns if r == "assistant")
        out.append((-99 if conv is None else conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest()))
    return sorted(out)


def read_digests(frame):
    return sorted((-99 if r.conv_id is None else r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in frame.collect())


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (2, None, "system", ""), (None, 0, "assistant", "<>\\" * 50_000), (3, 0, "assistant", "é🙂"), (3, 1, "assistant", "</turn>\n")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    assert read_digests(chat.read_back(chat.format_conversations(frame))) == plain_chat(rows)
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0
    typed = spark.createDataFrame([(1, 0, "user", [("image", None, "u", 5)])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    row = chat.format_conversations(typed).first()
    assert row.formatted == "<turn user><|image:0|></turn>\n" and row.n_tokens_attached == 1


def test_chat_query(spark):
    t = pd.read_parquet(f"{SF}/conversations.parquet")
    said = r"\### Assistant: </turn> ok"
    rows = [*zip(t.conv_id, t.turn, t.role, t.text, strict=True), (-7, 0, "user", said), (-7, 1, "assistant", said)]
    assert read_digests(QUERIES["op9_chat_format"](spark, SF)) == plain_chat(rows)


# toxicity


def test_held_out_accuracy_and_misspellings(spark):
    rng = random.Random(4)
    bad, good = ["idiot", "moron", "worthless"], ["".join(rng.choices("abcdefgnorst", k=rng.randint(2, 8))) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(good, k=rng.randint(5, 60))
        if i % 3 == 0:
            for _ in range(max(1, len(words) // 12)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame([*rows, (2000, None), (2001, "a bunch of idiotts and morrons"), (None, "x"), (2002, " ".join(good * 200))], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int"))
    out = {r.doc_id: r for r in toxicity.judge(docs, model).collect()}
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(900)) and out[None].held_out is False
    held = [i for i in range(900) if out[i].held_out]
    assert np.mean([out[i].predicted == (i % 3 == 0) for i in held]) > 0.95
    assert out[2001].score > 0.5 > out[2002].score
    again = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (again.weights == model.weights).all()


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.judge(docs, toxicity.fit(docs, none)).first().predicted == 0
    assert toxicity.judge(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_toxicity_query_on_held_out_labels(spark):
    """The registered query over whole tables: ids, folds, cuts, and labels it never saw."""
    folder = "/root/testdata/sf0.1"
    ids = pd.read_parquet(f"{folder}/documents.parquet", columns=["doc_id"]).doc_id
    got = QUERIES["op5_toxicity"](spark, folder).toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(ids)
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    known = pd.read_parquet(f"{folder}/labels.parquet").set_index("doc_id").join(got, how="inner")
    unseen = known[known.held_out]
    toxic, clean = unseen[unseen.toxic == 1], unseen[unseen.toxic == 0]
    auc = np.mean([(s > clean.score).mean() for s in toxic.score])
    assert len(toxic) > 100 and auc >= 0.93 and clean.predicted.mean() <= 0.03 and toxic.predicted.mean() >= 0.5


def test_toxicity_sends_one_text_per_document(spark, monkeypatch):
    rows = [(1, f"vile slur number {i}") for i in range(500)] + [(2, "a kind word"), (2, None)]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda features, labels: seen.append((len(features), labels.tolist())))
    chosen = [i for i in (1, 2) if zlib.crc32(str(i).encode()) % 3 != 1]
    toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert seen == [(len(chosen), [2 - i for i in chosen])]


def test_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BUCKET_BITS), 0.1)
    texts = ["", "a", "hello world", "x" * 1000, "É ñ Straße İ", "..", "ab cd"]
    one = np.concatenate([model.scores([t]) for t in texts])
    assert np.allclose(model.scores(texts), one)


# mixing


def test_every_prefix_deviates_by_less_than_a_block():
    for seed in range(60):
        rng = random.Random(seed)
        shares = mixing.shares_of({f"s{i}": rng.random() ** 3 + 1e-4 for i in range(rng.randint(1, 30))}, rng.choice([64, 257]))
        period, done = sum(shares.values()), dict.fromkeys(shares, 0)
        for slot, (s, j) in enumerate(mixing.schedule(shares), 1):
            assert j == done[s] and j * period // shares[s] < slot <= -(-(j + 1) * period // shares[s])
            done[s] += 1
            assert all(abs(done[x] - slot * shares[x] / period) < 1 for x in shares)
        assert done == shares


def check_mix(frame, rows, weights, block, period):
    out = mixing.mix_sources(frame, weights, block_rows=block, period=period, bins=16).collect()
    assert sorted((str(r.doc_id), str(r.source)) for r in out) == sorted((str(i), str(s)) for i, s in rows)
    places = sorted((r.mix_slot, r.mix_place, r.source or "", r.mix_balanced) for r in out)
    assert len({p[:2] for p in places}) == len(places)
    blocks = {}
    for slot, place, source, balanced in places:
        assert blocks.setdefault(slot, (source, balanced, [])) [:2] == (source, balanced)
        blocks[slot][2].append(place)
    shares = mixing.shares_of(weights, period)
    full = [s for s in sorted(blocks) if blocks[s][1]]
    assert full == list(range(len(full)))
    done = dict.fromkeys(weights, 0)
    for slot in full:
        assert blocks[slot][2] == list(range(block))
        done[blocks[slot][0]] += 1
        assert all(abs(done[s] - (slot + 1) * shares[s] / sum(shares.values())) < 1 for s in weights)
    return len(full)


def test_mixture(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(700)] + [(None, "a"), (5, "b"), (5, "b")]
    frame = spark.createDataFrame([(i, s, "x") for i, s in rows], "doc_id long, source string, mix_slot string")
    assert check_mix(frame, rows, {"a": 1.0, "b": 2.0, "c": 1.5, "": 0.5}, 4, 37) > 20
    assert check_mix(frame, rows, mixing.proportional(frame), 4, 64) > 100
    assert mixing.mix_sources(frame.limit(0), {"a": 1.0}).count() == 0
    with pytest.raises(PySparkException):
        mixing.mix_sources(frame, {"a": 1.0}).collect()
    with pytest.raises(ValueError):
        mixing.mix_sources(frame, {"a": 0.0})


def test_exact_weights_hold_over_many_periods():
    for hot, n in ((0.203, 40_000), (0.9, 40_000)):
        weights = {"hot": hot, "rare": 0.0001, **{f"s{i}": (1 - hot - 0.0001) / 18 for i in range(18)}}
        total, done = sum(weights.values()), dict.fromkeys(weights, 0)
        seen = mixing.deal(mixing.exact(weights), dict.fromkeys(weights, n))
        for at, (s, j, slot, balanced) in enumerate(islice(seen, n)):
            assert (slot, j, balanced) == (at, done[s], True)
            done[s] += 1
            assert all(abs(done[x] - (slot + 1) * w / total) < 1 + 1e-9 for x, w in weights.items())


def test_blocks_keep_their_windows_when_sources_run_out():
    for seed in range(40):
        rng = random.Random(seed)
        weights = {f"s{i}": 10 ** rng.uniform(-6, 0) for i in range(rng.randint(1, 12))}
        rows = {s: rng.choice([0, 3, 4, 100, 400]) for s in weights}
        parts = mixing.exact(weights)
        total, slots, out = sum(parts.values()), set(), 0
        first = {s: rows[s] // 4 * total // parts[s] for s in parts}
        late = min(-(-(rows[s] // 4 + 1) * total // parts[s]) for s in parts)
        for s, j, slot, balanced in mixing.deal(parts, rows, 4):
            assert j * total // parts[s] <= slot < -(-(j + 1) * total // parts[s])
            assert balanced or slot >= min(first.values())
            assert not balanced or slot < late
            slots.add(slot)
            out += 1
        assert len(slots) == out == sum(-(-n // 4) for n in rows.values())


def test_rows_follow_exact_weights(spark, monkeypatch):
    weights = {"hot": 0.203, **{f"s{i:02}": 0.797 / 19 for i in range(19)}}
    frame = spark.range(60_000).selectExpr("id AS doc_id", "CASE WHEN id % 1000 < 203 THEN 'hot' ELSE concat('s', lpad(id % 19, 2, '0')) END AS source")
    monkeypatch.setattr(mixing, "DEALT", 7_000)
    for broadcast in (0, 100_000):
        monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", broadcast)
        got = mixing.mix_sources(frame, weights, block_rows=2).filter("mix_balanced").toPandas()
        hot = got[got.mix_place == 0].sort_values("mix_slot")
        assert hot.mix_slot.tolist() == list(range(len(hot))) and len(hot) > 8 * mixing.PERIOD
        ahead = (hot.source == "hot").cumsum().to_numpy() - 0.203 * np.arange(1, len(hot) + 1)
        assert abs(ahead).max() < 1 + 1e-9


def test_more_sources_than_slots_of_a_period(spark):
    frame = spark.range(9_000).selectExpr("id AS doc_id", "concat('site', CASE WHEN id < 6000 THEN id % 3000 ELSE 0 END) AS source")
    weights = mixing.proportional(frame, power=0.7)
    assert len(weights) == 3_000 > mixing.PERIOD
    out = mixing.mix_sources(frame, weights, block_rows=1).toPandas()
    assert sorted(out.doc_id) == list(range(9_000)) and out.mix_slot.is_unique
    total = sum(weights.values())
    for source, rows in out.groupby("source"):
        w = weights[source] / total
        assert all(j / w - 1 < slot < (j + 1) / w + 1 for j, slot in enumerate(sorted(rows.mix_slot)))


def test_mix_query(spark):
    t = pd.read_parquet(f"{SF}/documents.parquet")
    out = QUERIES["op7_mix_sources"](spark, SF).toPandas()
    assert sorted(zip(out.doc_id, out.source, strict=True)) == sorted(zip(t.doc_id, t.source, strict=True))
    counts = t.source.value_counts()
    shares = mixing.shares_of({s: n**0.7 for s, n in counts.items()})
    slots = mixing.schedule(shares)
    for r in out.itertuples():
        assert slots[r.mix_slot % len(slots)][0] == r.source
    assert not out.duplicated(["mix_slot", "mix_place"]).any()


def test_an_encoder_keeps_few_pieces_and_the_frequent_ones(monkeypatch):
    """Two generations bound what is kept; what is asked for again is not encoded again."""
    import public_tokenizers

    from postsieve.llm import byte_bpe

    blob = byte_bpe.rank_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    plain, small = (byte_bpe.Codec(blob, public_tokenizers.PATTERN) for _ in range(2))
    texts = [f" often zq{i}xw{i * 7919} often" for i in range(300)]
    want = [plain.encode(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 40)
    made, encode = [], small.encode_piece
    monkeypatch.setattr(small, "encode_piece", lambda piece: made.append(piece) or encode(piece))
    for text, ids in zip(texts, want, strict=True):
        assert small.encode(text) == ids and small.decode(ids).decode() == text
        assert len(small.known) + len(small.known.older) < 80
    assert made.count(" often") == 1
