"""Every registered operator query over the smallest tables, against DuckDB's SQL or plain Python."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cairnmesh.llm import quality, toxic
from cairnmesh.llm.queries import ORACLES, QUERIES, vocabulary
from cairnmesh.llm.store import documents

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {i: t or "" for i, t in duck.execute("select doc_id, text from documents").fetchall()}


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(plain(r) for r in got.select(*names).collect()) == sorted(plain(r) for r in want.fetchall())


def test_op1(spark, texts):
    """Probabilities follow from the evidence and the rates of the row; labelled documents are told apart."""
    post = quality.Posterior(spark, documents(spark, SF), documents(spark, SF, "labels"))
    got = QUERIES["op1_quality_classifier"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    logit = lambda p: math.log(p / (1 - p))
    for r in got:
        assert r.quality_p == pytest.approx(1 / (1 + math.exp(-(r.evidence + logit(r.path_rate) - logit(post.mean)))), rel=1e-9)
        assert r.evidence == pytest.approx(float(quality.log_odds([texts[r.doc_id].encode()], post.weights.value)[0]), abs=1e-9) and r.kept == (r.quality_p >= 0.5)


def test_op2(spark, texts):
    got = QUERIES["op2_media_columns"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        b = texts[r.doc_id].encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_bytes > len(p) and r.feature and r.tensors


def test_op3(spark, duck):
    turns = defaultdict(list)
    for i, n, role, text in duck.execute("select conv_id, turn, role, text from conversations").fetchall():
        turns[i].append((n, role or "", text or ""))
    probe = r"\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", probe), (1, "assistant", probe)]
    got = {r.conv_id: r for r in QUERIES["op3_chat_formatting"](spark, SF).collect()}
    assert set(got) == set(turns)
    for i, some in turns.items():
        some.sort()
        loss = "".join(t for _, role, t in some if role == "assistant")
        want = (len(some), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in some).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == want


def test_op4(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces, packs = defaultdict(list), defaultdict(list)
    for r in QUERIES["op4_packing"](spark, SF).collect():
        pieces[r.doc_id].append(r)
        packs[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    for i, some in pieces.items():
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 1]
        some.sort(key=lambda r: r.start)
        assert [r.start for r in some] == list(np.cumsum([0, *[r.length for r in some]])[:-1]) and sum(r.length for r in some) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids) for r in some)
    for spans in packs.values():
        spans.sort()
        assert [o for o, _ in spans] == list(np.cumsum([0, *[n for _, n in spans]])[:-1]) and sum(n for _, n in spans) <= 2048
    total = sum(n for spans in packs.values() for _, n in spans)
    assert total / (2048 * len(packs)) > 0.95


def test_op6(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op6_token_counts"](spark, SF).collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts.items()}


def test_op7(spark, texts):
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)), "\n"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n = sum(c.values())
    model = base = 0.0
    for r in QUERIES["op7_lm_scoring"](spark, SF).collect():
        t = tokens.pop(r.doc_id)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in t), abs=1e-6)
        model, base = model + r.held_out * r.score, base + r.held_out * r.base_score
    assert not tokens and model > base


def test_op8(spark, texts):
    net = toxic.train(spark, documents(spark, SF), documents(spark, SF, "labels"))
    got = QUERIES["op8_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.score == pytest.approx(float(toxic._scores(net, [texts[r.doc_id].encode()])[0]), abs=1e-6)
