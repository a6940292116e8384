"""Conversation structure repair by lazy weighted determinisation.

A repaired conversation's role initials are (s?(ua)+)?. Edits of a row are Keep
(0), Rerole to user or assistant (3) and Delete (4, the only one for blank and
duplicate rows); an empty user or assistant text may be Inserted anywhere (3);
a truncated row that stays adds 3. Over the places between rows this is a
weighted automaton of four states: nothing yet, after s, after u, after a.

Its determinisation is built while rows are read: the vector of cheapest costs
of the four states, less its smallest, is a state, and the table of (state,
symbol) -> (state, cost) is filled when an entry is first asked for. Entries
that can be on no cheapest path are dropped (after s is never better than after
a at the same cost; nothing yet is better by 4 at most), so there are few
states, and almost every row is one look-up. Then arcs are followed backwards
from the cheapest ends where they are tight (cost before + arc = cost after),
which marks the states of all cheapest repairs; reading forward inside the
marks, the smallest letter each time gives the audit.

Rows are dealt by conversation and sorted by Spark; a task streams them and
holds a few bytes for each row of one conversation (its audit, one output value,
has as many). Texts take no part in the search: audits meet them in a second
sorted stream that holds one Arrow batch.

Defined cases: null roles and texts are one space; rows are ordered by turn
(nulls first), then role, then the text's SHA-256, repeated rows are duplicates;
rows whose conv_id is null are one conversation, with the id null; roles count
by their first character; texts of any length are hashed as they pass; an empty
table gives an empty table. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .importance import CRC, crc32_sql
from .store import Scratch, ship

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
#: The state that a kept role's initial leads to from each state, or None.
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The only role that an inserted or rerolled row can have after each state.
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_INITIALS = "sua"
#: Symbols: 0 a row that must go; else 1 + place of the initial in sua (3: another), + 4 if truncated.
DEAD = 0


def symbol(initial: str, truncated: bool) -> int:
    at = _INITIALS.find(initial) if initial else -1
    return 1 + (3 if at < 0 else at) + 4 * truncated


def _closed(v: list[int]) -> tuple[tuple[int, ...], int]:
    """(vector after insertions, without entries that no cheapest path uses, less its smallest; the smallest)."""
    start, s, u, a = v
    u = min(u, start + INSERT, s + INSERT)
    a = min(a, u + INSERT)
    u = min(u, a + INSERT)
    if start > a + DELETE:
        start = FAR
    if s > a:
        s = FAR
    least = min(start, s, u, a)
    return tuple(FAR if x >= FAR // 2 else x - least for x in (start, s, u, a)), least


class Repair:
    """The automaton; its table grows as symbols are read and serves all conversations of a task."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.table: list[list[tuple[int, int] | None]] = []
        self.back: dict[tuple[int, int, int], int] = {}
        first, least = _closed([0, FAR, FAR, FAR])
        assert least == 0
        self.first = self._id(first)

    def _id(self, vector: tuple[int, ...]) -> int:
        at = self.ids.get(vector)
        if at is None:
            at = self.ids[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * 9)
        return at

    @staticmethod
    def arcs(q: int, code: int) -> list[tuple[str, int, int]]:
        """(letter, state, cost) of each edit of a row after state q."""
        out = [("D", q, DELETE)]
        if code != DEAD:
            cut, kind = divmod(code - 1, 4)
            kept = _KEPT.get(_INITIALS[kind] if kind < 3 else "", {}).get(q)
            if kept is not None:
                out.append(("K", kept, KEEP + CUT * cut))
            out.append(("R", _NEXT[q], REROLE + CUT * cut))
        return out

    def step(self, state: int, code: int) -> tuple[int, int]:
        found = self.table[state][code]
        if found is None:
            v, to = self.vectors[state], [FAR] * 4
            for q in range(4):
                if v[q] < FAR:
                    for _, r, cost in self.arcs(q, code):
                        to[r] = min(to[r], v[q] + cost)
            vector, least = _closed(to)
            found = self.table[state][code] = (self._id(vector), least)
        return found

    def _inserted(self, state: int, mask: int) -> int:
        """The marked states and those that tight insertions lead from."""
        v, before = self.vectors[state], -1
        while mask != before:
            before = mask
            for q, r in _NEXT.items():
                if mask >> r & 1 and v[q] < FAR and v[q] + INSERT == v[r]:
                    mask |= 1 << q
        return mask

    def _before(self, state: int, code: int, mask: int) -> int:
        """The states before a row from which tight arcs reach the marked ones after it."""
        key = (state, code, mask)
        found = self.back.get(key)
        if found is None:
            (to, least), v, found = self.step(state, code), self.vectors[state], 0
            after = self.vectors[to]
            for q in range(4):
                if v[q] < FAR and any(mask >> r & 1 and v[q] + cost == after[r] + least for _, r, cost in self.arcs(q, code)):
                    found |= 1 << q
            found = self.back[key] = self._inserted(state, found)
        return found

    def run(self, codes: bytes) -> tuple[int, str]:
        """(cost, audit) of a conversation's symbols."""
        state, cost, passed = self.first, 0, [self.first]
        for c in codes:
            state, more = self.table[state][c] or self.step(state, c)
            cost += more
            passed.append(state)
        last = self.vectors[state]
        end = min(last[START], last[ASSISTANT])
        mask = self._inserted(state, sum(1 << q for q in (START, ASSISTANT) if last[q] == end))
        marks = bytearray(len(passed))
        marks[-1] = mask
        for i in range(len(codes) - 1, -1, -1):
            marks[i] = mask = self._before(passed[i], codes[i], mask)
        return cost + end, self._read(codes, passed, marks, end)

    def _read(self, codes: bytes, passed: list[int], marks: bytearray, end: int) -> str:
        out, i, q = [], 0, START
        while True:
            v = self.vectors[passed[i]]
            if i == len(codes) and q in (START, ASSISTANT) and v[q] == end:
                return "".join(out)
            moves = [("I", i, _NEXT[q])] if marks[i] >> _NEXT[q] & 1 and v[q] + INSERT == v[_NEXT[q]] else []
            if i < len(codes):
                to, least = self.step(passed[i], codes[i])
                after = self.vectors[to]
                moves += [(letter, i + 1, r) for letter, r, cost in self.arcs(q, codes[i]) if marks[i + 1] >> r & 1 and v[q] + cost == after[r] + least]
            letter, i, q = min(moves)
            out.append(letter)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of conversations after one of twenty faults by the row's place; a dropped row has 0 copies."""
    space = F.lit(" ")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = rows.withColumn("kind", kind)
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _order() -> list[Column | str]:
    return [F.col("turn").asc_nulls_first(), "role", "key"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.unhex(F.sha2("text", 256)))


def _search(batches):
    """Streams (conv_id, turn, initial, copies, dead, cut) in order; a row for each conversation when it ends."""
    repair, held, out = Repair(), None, []

    def ended():
        cost, audit = repair.run(bytes(held["codes"]))
        turns = held["last"] - held["first"] + 1 - held["turns"] if held["turns"] else 0
        out.append((held["id"], turns, *held["faults"], held["illegal"], cost, audit))

    def batch_of():
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    for batch in batches:
        for conv, turn, initial, copies, blank, again, cut in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held is None or conv != held["id"]:
                if held is not None:
                    ended()
                held = {"id": conv, "codes": bytearray(), "faults": [0, 0, 0], "illegal": 0, "initial": None, "first": None, "last": None, "turns": 0}
            for nth in range(copies):
                kind = 0 if blank else 1 if again or nth else 2 if cut else None
                if kind is not None:
                    held["faults"][kind] += 1
                held["codes"].append(DEAD if kind in (0, 1) else symbol(initial, kind == 2))
                if held["initial"] is not None and held["initial"] + initial not in ("su", "ua", "au"):
                    held["illegal"] += 1
                held["initial"] = initial
            if copies and turn is not None:
                if held["first"] is None:
                    held["first"] = turn
                held["turns"] += held["last"] != turn
                held["last"] = turn
        if len(out) >= 1000:
            yield batch_of()
            out.clear()
    if held is not None:
        ended()
    if out:
        yield batch_of()


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def search(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """SUMMARY of each conversation of rows (conv_id, turn, role, text, copies): its faults, and the cost and audit of its cheapest repair."""
    ship(spark)
    left = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    slim = _keyed(rows).select("conv_id", "turn", "role", "key", "copies", F.substring("role", 1, 1).alias("initial"), (F.length(left) == 0).alias("blank"), (~F.right(left, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    # dealt once by conversation: the numbering of equal rows and the order below only sort
    dealt = slim.repartition("conv_id").withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "role", "key").orderBy((F.col("copies") == 0), F.col("turn").asc_nulls_first())) > 1)
    ordered = dealt.sortWithinPartitions("conv_id", *_order(), "again")
    return ordered.select("conv_id", "turn", "initial", "copies", "blank", "again", "cut").mapInArrow(_search, SUMMARY)


def _edited(batches):
    """Streams (conv_id, copies, role, text), each conversation's audit first (copies null), and gives the rows of the repaired ones."""
    audit, at, q, conv, place = "", 0, START, None, 0

    def batch_of(rows):
        names = ("conv_id", "place", "edit", "role", "text")
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=names)

    for batch in batches:
        out = []

        def put(edit, role, text, to):
            nonlocal q, place
            out.append((conv, place, edit, role, text))  # noqa: B023
            q, place = to, place + 1

        def inserted():
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                to, at = _NEXT[q], at + 1
                put("I", _ROLE[to], "", to)

        for one, copies, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if copies is None:
                audit, at, q, conv, place = text, 0, START, one, 0
                inserted()
                continue
            for _ in range(copies):
                edit, at = audit[at], at + 1
                if edit == "K":
                    put("K", role, text, _KEPT[role[:1]][q])
                elif edit == "R":
                    put("R", _ROLE[_NEXT[q]], text, _NEXT[q])
                inserted()
        if out:
            yield batch_of(out)


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def repaired(spark: SparkSession, rows: DataFrame, audits: DataFrame) -> DataFrame:
    """REPAIRED: the rows of every repaired conversation, those of one together and in order, by its audit."""
    ship(spark)
    first = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("key"), F.lit(None).cast("int").alias("copies"), F.col("audit").alias("text"))
    both = first.unionByName(_keyed(rows).where("copies > 0").withColumn("kind", F.lit(1)))
    # equal rows stand together, whichever of them is the first
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())
    return ordered.select("conv_id", "copies", "role", "text").mapInArrow(_edited, REPAIRED)


def _hashed(batches):
    """SHA-256 of `role:text` lines of each conversation of a stream of REPAIRED."""
    conv, sha, out = None, None, []

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["id", "sha"])

    for batch in batches:
        for one, place, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")], strict=True):
            if place == 0:
                if sha is not None:
                    out.append((conv, sha.hexdigest()))
                conv, sha = one, hashlib.sha256()
            sha.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        if len(out) >= 1000:
            yield batch_of()
            out.clear()
    if sha is not None:
        out.append((conv, sha.hexdigest()))
    if out:
        yield batch_of()


def repair_report(spark: SparkSession, rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """SUMMARY and repaired_sha256 of every conversation of rows (conv_id, turn, role, text, copies)."""
    scratch = scratch or Scratch(spark, "repair")
    found = scratch.keep(search(spark, rows), "audits")
    hashes = repaired(spark, rows, found).mapInArrow(_hashed, "id long, sha string")
    out = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    none: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(*found.columns, F.coalesce("sha", none).alias("repaired_sha256"))


def _oracle() -> str:
    """DuckDB's SQL: a recursion over each conversation's rows that carries (cost, audit, repaired text) of the four states."""
    far = "{'c': 1000000000, 'a': '', 't': ''}"
    best = lambda *some: f"list_sort([{', '.join(some)}])[1]"
    step = lambda v, cost, letter, text: f"{{'c': {v}.c + {cost}, 'a': {v}.a || '{letter}', 't': {v}.t || {text}}}"
    ins = lambda v, role: step(v, INSERT, "I", f"'{role}:' || chr(10)")
    line = lambda role: f"{role} || ':' || text || chr(10)"
    gone = lambda v: step(v, DELETE, "D", "''")
    kept = lambda v, initial: f"case when not dead and initial = '{initial}' then {step(v, 'cut', 'K', line('role'))} else {far} end"
    rerolled = lambda v, role: f"case when not dead then {step(v, f'{REROLE} + cut', 'R', line(repr(role)))} else {far} end"

    def closed(rest: str, source: str) -> str:
        one = f"select {rest}, n, s, {best('u', ins('n', 'user'), ins('s', 'user'))} as u, a from ({source})"
        two = f"select {rest}, n, s, u, {best('a', ins('u', 'assistant'))} as a from ({one})"
        three = f"select {rest}, n, s, {best('u', ins('a', 'user'))} as u, a from ({two})"
        return f"select {rest}, n, s, u, {best('a', ins('u', 'assistant'))} as a from ({three})"

    moved = f"""select w.conv, r.i, {gone('n')} as n, {best(gone('s'), kept('n', 's'))} as s,
      {best(gone('u'), *[f(v) for v in ('n', 's', 'a') for f in (lambda v: kept(v, 'u'), lambda v: rerolled(v, 'user'))])} as u,
      {best(gone('a'), kept('u', 'a'), rerolled('u', 'assistant'))} as a
      from walk w join row_ r on r.conv = w.conv and r.i = w.i + 1"""
    begin = f"select conv, cast(0 as bigint) as i, {{'c': 0, 'a': '', 't': ''}} as n, {far} as s, {far} as u, {far} as a from conv"
    space = r"[\x20\x09-\x0D]"
    return rf"""
with recursive {CRC},
keyed as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))")} % 20 as kind from conversations, crc),
conv as (select conv_id, row_number() over () as conv from (select distinct conv_id from keyed)),
hurt as (select conv, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
  unnest(range(case when kind = 0 then 0 when kind = 3 then 2 else 1 end)) as nth from keyed join conv on conv.conv_id is not distinct from keyed.conv_id),
placed as (select *, row_number() over (partition by conv order by turn nulls first, role, sha256(text), nth) as i, row_number() over (partition by conv, role, text order by turn nulls first, nth) > 1 as again from hurt),
flagged as (select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not regexp_matches(regexp_replace(text, '{space}+$', ''), '[.!?]$') as open, left(role, 1) as initial from placed),
row_ as (select *, blank or again as dead, case when open then {CUT} else 0 end as cut, lag(initial) over (partition by conv order by i) || initial not in ('su', 'ua', 'au') as odd from flagged),
walk as ({closed("conv, i", begin)} union all {closed("conv, i", moved)}),
last as (select conv, {best("n", "a")} as e from walk join (select conv, coalesce(max(r.i), 0) as i from conv left join row_ r using (conv) group by conv) using (conv, i)),
counted as (select conv, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate, count(*) filter (open and not blank and not again) as truncated, count(*) filter (odd) as illegal,
  coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from row_ group by conv)
select conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(e.c as bigint) as cost, e.a as audit, sha256(case when e.t = '' then '' else left(e.t, cast(length(e.t) - 1 as bigint)) end) as repaired_sha256
from conv join last using (conv) left join counted using (conv)
"""


ORACLE = _oracle()
