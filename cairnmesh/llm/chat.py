"""Chat formatting by schema fingerprints.

A record is a JSON object. Its fingerprint is the hash of its sorted field
paths (list levels as []); the fingerprint selects a declarative mapping that
says which paths hold the turns. Where no mapping has that fingerprint, fields
that no mapping names are left out and the fingerprint is taken again, so extra
columns don't matter. Canonical turns (role, text) are put into the template

    ### Role: text </turn>\\n

with control strings inside roles and texts escaped by a backslash, which
``parse`` undoes. The loss mask is the list of spans of assistant texts.

Defined cases: null texts and roles are empty strings; turns are ordered by
turn, then role, then text, nulls first, and equal rows stay equal turns; each
row without a conv_id is a conversation of its own, also where such rows repeat;
roles are kept as they are but for the from/value layout's; a record that isn't JSON or
that no mapping fits has layout null and no turns; an empty table gives an
empty table. A conversation is one output value, so its turns meet in one task
by nature; conversations are dealt over all tasks by their id.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import ship

CLOSE = "</turn>"
_ESCAPE = re.compile(r"\\|###|</turn>")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>)")
_ESCAPE_ROLE = re.compile(r"\\|###|</turn>|:|\n")
_UNESCAPE_ROLE = re.compile(r"\\(\\|###|</turn>|:|\n)")
_END = re.compile(r"\\(?:\\|###|</turn>)|(</turn>)")
_END_ROLE = re.compile(r"\\(?:\\|###|</turn>|:|\n)|(: )")
#: Role names of the from/value layout; other layouts' roles stay as they are.
SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("ai", "assistant"))


@dataclass(frozen=True)
class Mapping:
    """Where a layout holds its turns.

    `turns`: path of the list of turns, with the names of role and text in it
    and what roles are renamed to; or `parts`: (role, paths whose non-empty texts are joined by an empty line).
    `examples`: the field paths of records of this layout.
    """

    name: str
    examples: tuple[tuple[str, ...], ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    parts: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())


def _listed(name: str, turns: str, role: str, text: str, roles: tuple[tuple[str, str], ...] = ()) -> Mapping:
    base = f"{turns}[]"
    return Mapping(name, ((turns, base, f"{base}.{role}", f"{base}.{text}"),), turns, role, text, roles)


def _pair(name: str, *parts: tuple[str, tuple[str, ...]], optional: tuple[str, ...] = ()) -> Mapping:
    every = tuple(p for _, paths in parts for p in paths)
    need = tuple(p for p in every if p not in optional)
    some = [()]
    for o in optional:
        some += [(*s, o) for s in some]
    return Mapping(name, tuple(tuple(sorted((*need, *s))) for s in some), parts=parts)


#: Layouts of public instruction and chat sets.
MAPPINGS = (
    _listed("messages", "messages", "role", "content"),
    _listed("turns", "turns", "role", "text"),
    _listed("conversations", "conversations", "from", "value", SPEAKERS),
    _pair("instruction", ("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)), optional=("system", "input")),
    _pair("instruction_context", ("user", ("instruction", "context")), ("assistant", ("response",)), optional=("context",)),
    _pair("prompt_completion", ("user", ("prompt",)), ("assistant", ("completion",))),
    _pair("prompt_response", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)), optional=("system",)),
    _pair("question_answer", ("user", ("context", "question")), ("assistant", ("answer",)), optional=("context",)),
)


def paths(value, at: str = "") -> set[str]:
    """Field paths of a JSON value."""
    out: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            here = f"{at}.{k}" if at else str(k)
            out.add(here)
            out |= paths(v, here)
    elif isinstance(value, list):
        out.add(f"{at}[]")
        for v in value:
            out |= paths(v, f"{at}[]")
    return out


def fingerprint(found) -> str:
    return hashlib.blake2b("\n".join(sorted(found)).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Registry:
    def __init__(self, mappings=MAPPINGS):
        self.by_print = {fingerprint(e): m for m in mappings for e in m.examples}
        self.named = [(frozenset().union(*map(set, m.examples)), m) for m in mappings]

    def find(self, record) -> Mapping | None:
        found = paths(record)
        hit = self.by_print.get(fingerprint(found))
        if hit:
            return hit
        for names, _ in self.named:
            hit = self.by_print.get(fingerprint(found & names))
            if hit:
                return hit
        return None


def canonical(record, mapping: Mapping) -> list[tuple[str, str]]:
    def text(v) -> str:
        return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    if mapping.turns:
        some = [t for t in record.get(mapping.turns) or [] if isinstance(t, dict)]
        named = dict(mapping.roles)
        turns = [(text(t.get(mapping.role)), text(t.get(mapping.text))) for t in some]
        return [(named.get(r, r), t) for r, t in turns]
    out = []
    for role, names in mapping.parts:
        held = [text(record[n]) for n in names if n in record]
        if held and (role != "system" or any(held)):
            out.append((role, "\n\n".join(h for h in held if h)))
    return out


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans of assistant texts in it)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"### {_ESCAPE_ROLE.sub(lambda m: chr(92) + m[0], role)}: "
        body = _ESCAPE.sub(lambda m: chr(92) + m[0], text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f" {CLOSE}\n"]
        at += len(head) + len(body) + len(CLOSE) + 2
    return "".join(out), spans


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith("### ", at):
            raise ValueError(f"no turn at {at}")
        mark = next(m for m in _END_ROLE.finditer(formatted, at + 4) if m[1])
        end = next(m for m in _END.finditer(formatted, mark.end()) if m[1])
        out.append((_UNESCAPE_ROLE.sub(r"\1", formatted[at + 4 : mark.start()]), unescape(formatted[mark.end() : end.start() - 1])))
        at = end.end() + 1
    return out


def _format(keep: int):
    def run(batches):
        registry = Registry()
        for batch in batches:
            names, layouts, texts, masks, counts = batch.schema.names[:keep], [], [], [], []
            for raw in batch.column(keep).to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                mapping = registry.find(record) if isinstance(record, dict) else None
                turns = canonical(record, mapping) if mapping else []
                text, spans = render(turns)
                layouts.append(mapping.name if mapping else None)
                texts.append(text)
                masks.append([{"begin": a, "end": b} for a, b in spans])
                counts.append(len(turns))
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(layouts, pa.string()), pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(masks, span)], names=[*names, "layout", "n_turns", "formatted", "loss"])

    return run


def format_chats(spark: SparkSession, records: DataFrame, record: str = "record") -> DataFrame:
    """records' other columns, layout, n_turns, formatted text and loss spans (code points) of each record."""
    ship(spark)
    rest = [c for c in records.columns if c != record]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*rest).schema.fields)
    schema = f"{fields + ', ' if fields else ''}layout string, n_turns long, formatted string, loss array<struct<begin:long,end:long>>"
    return records.select(*rest, F.col(record).cast("string")).mapInArrow(_format(len(rest)), schema)


def records_of(rows: DataFrame) -> DataFrame:
    """(conv_id, record) of rows (conv_id, turn, role, text), in the layout that sets of such conversations are published in.

    A user's turn and its answer are a prompt and a completion, with a system
    text before them a system, prompt and response; other conversations are
    lists of turns.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turn = F.struct("turn", "role", "text")
    turns = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    turns = turns.unionByName(rows.where("conv_id is null").select("conv_id", F.array(turn).alias("turns")))
    slim = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    roles = F.transform("turns", lambda t: t["role"])
    said = lambda i, name: F.try_element_at("turns", F.lit(i + 1))["text"].alias(name)
    listed = F.to_json(F.struct(slim.alias("turns")))
    pair = F.to_json(F.struct(said(0, "prompt"), said(1, "completion")))
    led = F.to_json(F.struct(said(0, "system"), said(1, "prompt"), said(2, "response")))
    is_ = lambda *names: roles == F.array(*[F.lit(n) for n in names])
    record = F.when(is_("user", "assistant"), pair).when(is_("system", "user", "assistant") & (F.length(F.try_element_at("turns", F.lit(1))["text"]) > 0), led).otherwise(listed)
    return turns.select("conv_id", record.alias("record"))


def _read_back(batches):
    for batch in batches:
        hashes, sizes, losses, lengths, counts = [], [], [], [], []
        for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[s["begin"] : s["end"]]) for s in spans)
            counts.append(len(turns))
            hashes.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            sizes.append(len(loss))
            losses.append(hashlib.sha256(loss.encode()).hexdigest())
            lengths.append(len(formatted))
        columns = [batch.column("conv_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(sizes, pa.int64()), pa.array(losses, pa.string()), pa.array(lengths, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What parsing the formatted texts gives back, as digests."""
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
