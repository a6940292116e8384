"""Token counts by the whole-token shortcut, and token ids by a chunk table.

``count_tokens``: a vocabulary string that its library encodes alone as one
token is one token wherever it is a pre-token, since merges never cross
pre-tokens. ``proven`` establishes this for every vocabulary string before the
job, on the driver; tasks get the proven strings (a vocabulary's, so bounded).
Texts are cut into pre-tokens, those in the proven table count one each, and only the
rest is merged by the library (each distinct one once while the table of merged
ones has room; a full table steps back behind a new one, from which what recurs
is taken over, so that forgetting costs time, not results).

The pre-token pattern is run by the ``regex`` library, whose character classes
agree with the tokenizer's for the characters of KNOWN. Texts with any other
character go to the library whole. Special strings count as the library counts
them. Defined cases: null and empty texts have 0 tokens; repeated rows get
equal counts; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workers
from .store import ship
from .text import blocks

LIMIT = 512
#: Merged pre-tokens or chunks in the newer of the two tables that a worker keeps.
ROOM = 400_000
#: Characters (of ASCII, Latin, Cyrillic, punctuation and Han blocks) whose class never changed between Unicode versions.
KNOWN = "\t\n\r\x20-\x7e\xa0-ɏЀ-ӿ‐-‧一-龥"
#: Texts are worked on in parts of about so many characters.
PART = 1 << 20


@functools.cache
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def ids_of(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def proven(tokenizer) -> list[str]:
    """The vocabulary strings that the library encodes alone as their one token."""
    letters = _byte_letters()
    strings, ids = [], []
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    for word, i in tokenizer.get_vocab().items():
        if word in special or not all(c in letters for c in word):
            continue
        try:
            s = bytes(letters[c] for c in word).decode()
        except UnicodeDecodeError:
            continue
        strings.append(s)
        ids.append(i)
    return [s for s, i, got in zip(strings, ids, ids_of(tokenizer, strings), strict=True) if got == [i]]


class Counter:
    """Counts the tokens of texts for one tokenizer file; `single` are the proven strings."""

    def __init__(self, path: str, single: list[str]):
        import public_tokenizers
        import regex

        self.tokenizer = library(path)
        self.base = dict.fromkeys(single, 1)
        self.merged = dict(self.base)
        self.older: dict[str, int] = {}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.odd = re.compile(f"[^{KNOWN}]")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cut = re.compile(r"(?<=[^\s]) (?=[^\s])")

    def pretokens(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens in parts; a part ends before a single space between two other characters, where no pre-token spans."""
        at = 0
        while len(text) - at > PART:
            m = self.cut.search(text, at + PART)
            if not m:
                break
            yield self.pattern.findall(text, at, m.start())
            at = m.start()
        yield self.pattern.findall(text[at:] if at else text)

    def of_tokens(self, tokens: list[str]) -> int:
        """Tokens of pre-tokens, after `learn` has seen them."""
        return sum(map(self.merged.__getitem__, tokens))

    def learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.merged]
        if len(self.merged) - len(self.base) + len(new) > ROOM:
            self.older, self.merged = self.merged, dict(self.base)
            new = [t for t in tokens if t not in self.merged]
        known = [t for t in new if t in self.older]
        if known:
            self.merged.update(zip(known, map(self.older.__getitem__, known), strict=True))
            new = [t for t in new if t not in self.older]
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            self.merged.update(zip(some, map(len, ids_of(self.tokenizer, some)), strict=True))

    def of_texts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        lists: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if self.odd.search(text):
                out[i] = len(ids_of(self.tokenizer, [text])[0])
                continue
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            for part in parts:
                for tokens in self.pretokens(part):
                    if len(part) > PART:
                        self.learn(set(tokens))
                        out[i] += self.of_tokens(tokens)
                    else:
                        lists.append((i, tokens))
        self.learn(set().union(*(t for _, t in lists)))
        for i, tokens in lists:
            out[i] += self.of_tokens(tokens)
        return out


_counters: dict[str, Counter] = {}


def counter_of(path: str, single) -> Counter:
    """The worker's counter for a file; `single` gives the proven strings when it is made."""
    if path not in _counters:
        _counters[path] = Counter(path, single())
    return _counters[path]


def _count(path: str, single):
    def run(batches):
        counter = counter_of(path, lambda: single.value)
        for batch in batches:
            ids = batch.column(0)
            sizes, counts = [], []
            for _, some in blocks(batch.column(1).cast(pa.binary()).to_pylist()):
                sizes += [len(b) for b in some]
                counts += counter.of_texts([b.decode("utf-8", "replace") for b in some])
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of docs."""
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    single = spark.sparkContext.broadcast(proven(library(path)))
    out = rows.mapInArrow(_count(path, single), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


#: The byte-level alphabet writes bytes without a visible character (of those that letters have: 0x80 to 0xA0 and 0xAD) as characters from U+0100 on, in their order.
_BYTES = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def plain_parts(tokenizer) -> bool:
    """Whether a tokenizer only composes, puts spaces together and lower-cases, then cuts into runs of letters and others, then takes bytes."""
    told = json.loads(tokenizer.to_str())
    normal, cut = told.get("normalizer") or {}, told.get("pre_tokenizer") or {}
    steps, parts = [n["type"] for n in normal.get("normalizers", [])], cut.get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in parts] != ["Split", "ByteLevel"]:
        return False
    pattern = parts[0]["pattern"].get("Regex", "")
    return normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and r"|[\p{L}]+|" in pattern and not (parts[1]["add_prefix_space"] or parts[1]["use_regex"]) and told["model"]["type"] == "BPE"


class Chunks(dict):
    """Ids (little-endian unsigned 32-bit) of white-space-free chunks of bytes, A-Z as a-z, by the library.

    For a tokenizer that lower-cases and never joins over white space: the ids
    of a text are those of its chunks, one after the other. ASCII marks at a
    chunk's end are a pre-token of their own when a letter or digit (ASCII, or
    U+00C0 to U+00FF but the signs for times and division) stands before them:
    they are chunks too, so a word is in the table once, whatever follows it.
    Chunks of nothing but lower-case letters (a-z, U+00DF to U+00FF but the sign
    for division) are one pre-token that normalisation leaves as it is: the
    library's model merges their bytes directly (`plain_parts` looks whether the
    tokenizer's parts are the ones for which this holds).
    The library finds special strings before it lower-cases, so a chunk that
    holds one in any case keeps its case and goes to the library as it is.
    """

    #: Such marks; they stand first in the pattern, so that it is tried at few places.
    MARKS = re.compile(rb"[.,!?;:#$%&*|](?:(?<=[a-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,!?;:#$%&*|]*(?![^ \t\n\r\x0b\x0c])")

    LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = library(path)
        self.model = self.tokenizer.model if plain_parts(self.tokenizer) else None
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.older: dict[bytes, bytes] = {}
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.raw: set[bytes] = set()  # chunks to come that keep their case

    def _has_special(self, low: bytes) -> bool:
        return any(s in low for s in self.special)

    def chunks_of(self, text: bytes) -> list[bytes]:
        low = text.lower()
        if not self._has_special(low):
            return self.MARKS.sub(rb" \g<0>", low).split()
        chunks = [c if self._has_special(c.lower()) else c.lower() for c in text.split()]
        self.raw.update(c for c in chunks if self._has_special(c.lower()))
        return chunks

    def learn(self, chunks: set[bytes]) -> None:
        import numpy as np

        if len(self) + len(chunks) > ROOM:
            self.older = dict(self)
            self.clear()
        older = self.older
        new = chunks.difference(self)
        if older:
            known = [c for c in new if c in older]
            self.update(zip(known, map(older.__getitem__, known), strict=True))
            new.difference_update(known)
        for c in self.raw & new:
            self[c] = np.array(ids_of(self.tokenizer, [c.decode("utf-8", "replace")])[0], "<u4").tobytes()
        new -= self.raw
        self.raw = set()
        ask = list(new)
        if self.model is not None:
            whole, merge, packed = self.LETTERS.fullmatch, self.model.tokenize, self.packed
            letters, ask = [c for c in ask if whole(c)], [c for c in ask if not whole(c)]
            # the model takes bytes as characters; those of letters stand for themselves
            self.update((c, b"".join([packed[t.id] for t in merge(c.decode("latin-1").translate(_BYTES))])) for c in letters)
        for at in range(0, len(ask), 20_000):
            some = ask[at : at + 20_000]
            e = self.tokenizer.encode([s.decode("utf-8", "replace") for s in some], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            word = np.array(e.word_ids)
            first = (4 * np.searchsorted(word, np.arange(len(some) + 1))).tolist()
            raw = ids.tobytes()
            self.update((s, raw[a:b]) for s, a, b in zip(some, first, first[1:], strict=False))

    def of_texts(self, run: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts."""
        lists = [self.chunks_of(b) for b in run]
        self.learn(set().union(*lists))
        get = self.__getitem__
        return [b"".join(map(get, some)) for some in lists]


def chunk_table(path: str) -> Chunks:
    return workers.keep(("chunks", path), lambda: Chunks(path))
