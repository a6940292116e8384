import hashlib
import io
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnmesh.llm import chat, media, winnow


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a:b\n", "\\###"]), st.lists(st.sampled_from([*"a\\#</turn>\n: é", "</turn>", "###", " </turn>\n### "]), max_size=20).map("".join)), max_size=5))
def test_format_is_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a", "extra": {"deep": [1]}}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": 3}, {"unknown": 1}, {"messages": []}, [],
    ]
    df = spark.createDataFrame([*[(i, json.dumps(r)) for i, r in enumerate(records)], (98, "{"), (99, None)], "layout long, record string").withColumnRenamed("layout", "conv_id")
    got = {r.conv_id: r for r in chat.format_chats(spark, df).collect()}
    assert [got[i].layout for i in range(9)] == ["messages", "conversations", "instruction", "instruction", "prompt_completion", "question_answer", None, None, None]
    assert chat.parse(got[1].formatted) == [("user", "q"), ("assistant", "a")] and chat.parse(got[5].formatted) == [("user", "q"), ("assistant", "3")]
    assert got[98].n_turns == got[99].n_turns == 0


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, 0, None, "x</turn>"), (None, 0, "user", "p"), (None, 0, "user", "q"), (None, 0, "user", "q"), (4, 0, "human", "h"), (4, 1, "bot", "b"), (3, None, "assistant", "z" * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.digests(chat.format_chats(spark, chat.records_of(df))).collect()
    one = {r.conv_id: r for r in got if r.conv_id}
    assert one[1].n_turns == 3 and one[1].loss_chars == 2 and one[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert one[2].turns_sha256 == hashlib.sha256(b"\nx</turn>\n").hexdigest() and one[3].loss_chars == 50_000
    assert sum(r.conv_id is None for r in got) == 3 and all(r.n_turns == 1 for r in got if r.conv_id is None)
    assert one[4].turns_sha256 == hashlib.sha256(b"human\nh\nbot\nb\n").hexdigest() and one[4].loss_chars == 0
    assert chat.digests(chat.format_chats(spark, chat.records_of(df.where("conv_id = 9")))).count() == 0


def test_media_round_trip(spark, docs, none):
    got = media.features(spark, media.store_media(spark, docs)).collect()
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        b = (rows[r.doc_id] or "").encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        t = pa.ipc.open_stream(io.BytesIO(r.tensors)).read_all()
        assert t.schema.field("log_mel").type.shape == [media.SPAN, media.MELS] and t["begin_ms"][0].as_py() == 0
    assert media.features(spark, media.store_media(spark, none)).count() == 0


def test_resampling_runs_and_tone(monkeypatch):
    x = ((np.sin(np.arange(20_000) * 2 * np.pi * 300 / media.RATE) + 1) * 100).astype(np.uint8)
    assert np.array_equal(media.resample(x, 0, 900)[100:700], media.resample(x, 100, 700))
    y = media.resample(x, 0, 12_000)
    want = np.sin(np.arange(12_000) * 2 * np.pi * 300 * media.DOWN / (media.RATE * media.UP)) * 100 / 128 + (100 - 128) / 128
    assert np.abs(y[200:-200] - want[200:-200]).max() < 0.05
    whole = np.concatenate(list(media.log_mel(x)))
    monkeypatch.setattr(media, "RUN", 7)
    assert np.allclose(whole, np.concatenate(list(media.log_mel(x))), atol=1e-4)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-10.0, -4.0, -3.0, -1.0, 0.0, 2.9, 3.0, 10.0]), min_size=1, max_size=40))
def test_hysteresis(levels):
    level = np.array(levels)
    want, on = [], None
    for i, x in enumerate(level - level.mean()):
        if on is None and x >= media.HIGH_DB:
            on = i
        elif on is not None and x < media.LOW_DB:
            want.append([on, i])
            on = None
    if on is not None:
        want.append([on, len(level)])
    assert media.segments(level).tolist() == want


def test_features_against_plain_formulas():
    """Log-mel frames by direct convolution and sums; spans of tensors by their frames."""
    r = np.random.default_rng(1)
    payload = bytes(r.integers(32, 127, 1920).astype(np.uint8))
    mel, segs = media.analyse(payload)
    half = media.TAPS * media.UP // 2
    t = np.arange(-half, half)
    h = np.sinc(t / max(media.UP, media.DOWN)) * np.hanning(2 * half + 1)[: 2 * half]
    h *= media.UP / h.sum()
    x = np.zeros(len(payload) * media.UP)
    x[:: media.UP] = (np.frombuffer(payload, np.uint8) - 128.0) / 128
    y = np.convolve(x, h)[half:][: len(x)][:: media.DOWN]
    frames = max(1, -(-(len(y) - media.WINDOW) // media.HOP) + 1)
    y = np.append(y, np.zeros(media.WINDOW + media.HOP))
    rate = media.RATE * media.UP / media.DOWN
    edge = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), media.MELS + 2) / 2595) - 1)
    assert len(mel) == frames
    for f in range(frames - 1):  # the last frame also holds what the filter makes of the payload's end
        power = np.abs(np.fft.rfft(y[f * media.HOP :][: media.WINDOW] * np.hanning(media.WINDOW))) ** 2
        hz = np.arange(len(power)) * rate / media.WINDOW
        want = [sum(p * max(0, min((z - edge[k]) / (edge[k + 1] - edge[k]), (edge[k + 2] - z) / (edge[k + 2] - edge[k + 1]))) for p, z in zip(power, hz, strict=True)) for k in range(media.MELS)]
        assert np.allclose(mel[f], 10 * np.log10(np.array(want) + 1e-6), atol=0.05)
    table = pa.ipc.open_stream(io.BytesIO(media.tensors(mel, segs))).read_all()
    ms = 1000 * media.HOP / rate
    assert np.allclose(table["begin_ms"].to_numpy(), np.arange(len(table)) * media.SPAN * ms) and table["end_ms"][len(table) - 1].as_py() == pytest.approx(frames * ms)
    assert sum(table["active_frames"].to_pylist()) == sum(b - a for a, b in segs)
    flat = table["log_mel"].combine_chunks().to_numpy_ndarray().reshape(-1, media.MELS)
    assert np.array_equal(flat[:frames], mel)


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    hit, names = set(), set()
    for i, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        m = min(len(v), 13)
        for a in range(len(v) - m + 1 if m else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == v[a : a + m]:
                    hit |= set(range(p, p + m))
                    names.add(str(i))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_winnowing_matches_brute_force(spark, docs, none):
    base = [r.text for r in docs.orderBy("doc_id").collect() if r.text and len(r.text.split()) > 30]
    items = [(1, " ".join(base[2].split()[5:25])), (2, "one"), (3, "two, WORDS!"), (4, None), (5, "..."), (10, " ".join(base[3].split()[:13])), (10, " ".join(base[3].split()[:13])), (12, "never seen in any text of these at all " * 3), (13, "word " * 20)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", winnow.F.lit(1))
    rows = docs.where("doc_id is not null")
    want = {r.doc_id: brute_hits(r.text, items) for r in rows.collect()}
    got = winnow.hits(spark, rows, bench).collect()
    assert len(got) == rows.count()
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]
    clean = winnow.clean(spark, rows, bench)
    assert clean.columns == rows.columns and {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w[4]}
    assert winnow.hits(spark, docs, bench.where("item_id < 0")).where("n_hit > 0 or contaminated").count() == 0
    assert winnow.hits(spark, none, bench).count() == 0
