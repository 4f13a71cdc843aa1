"""Repair of conversations by a cheapest edit script.

A conversation's rows, in the order of their turns, become a lattice: a node is the number of
rows read and what was written last (nothing, the system row, a user's, an assistant's); edges
keep, rerole or delete a row or insert an empty one. Dijkstra's search runs from both ends; once the
two heaps meet, every crossing of the same cost is finished, and of the cheapest scripts the one whose
initials (D, I, K, R) come first is taken. Scripts of one cost that read the same rows never
begin with one another, so the least script of a whole is made of least scripts of its parts.

Hence a conversation of any length is cut: the rows (without their texts) are range-partitioned
in their order, and a task solves runs of ``RUN`` rows for each pair of states at their ends
and joins them. A conversation that reaches into several partitions leaves one such
table (four by four scripts) in each, joined by its id in the end. Faults of a row are native
expressions; equal rows of a conversation are counted before any shuffle.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsim.llm.words import small_batches
from textsim.session import materialize

RUN = 256                # rows of one lattice
SHORT = 64               # characters of a short lattice, two a row
MEMO = 100_000           # short lattices whose script a task remembers
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5            # for a truncated row that stays
BLANK, DUPLICATE, CUT, SOUND = "b", "d", "t", "-"
#: States: nothing written, system row, user's row, assistant's row. What may be written next, and the state after it.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}

_VISIBLE = r"[^\x20\x09-\x0D]"


def _edges(rows: str, i: int, state: int):
    """Edges out of a node: (cost, initial, rows read, state). rows: two characters a row, initial and fault."""
    for role in "ua":
        if role in NEXT[state]:
            yield COSTS["I"], "I", i, NEXT[state][role]
    if 2 * i < len(rows):
        initial, fault = rows[2 * i], rows[2 * i + 1]
        yield COSTS["D"], "D", i + 1, state
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED if fault == CUT else 0
            if initial in NEXT[state]:
                yield COSTS["K"] + extra, "K", i + 1, NEXT[state][initial]
            for role in "ua":
                if role in NEXT[state]:
                    yield COSTS["R"] + extra, "R", i + 1, NEXT[state][role]


def script(rows: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, initials) of the cheapest, then least, script that reads all rows from state ``start`` to one of ``ends``."""
    n = len(rows) // 2
    back: dict = {}
    for i in range(n + 1):
        for state in range(4):
            for edge in _edges(rows, i, state):
                back.setdefault(edge[2:], []).append((edge[0], edge[1], i, state))
    # labels (cost, initials); a heap orders by cost, then by the distance from its own end: an
    # edge of cost 0 reads a row, so all that can still shorten a label has left the heap before it
    ahead, behind = {(0, start): (0, "")}, {(n, e): (0, "") for e in ends}
    forward, reverse = [(0, 0, start)], [(0, 0, e) for e in ends]
    heapq.heapify(reverse)
    done_ahead, done_behind = set(), set()
    best = None

    def meet(cost):
        nonlocal best
        if best is None or cost < best:
            best = cost
    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best):
        if forward[0][0] <= reverse[0][0]:
            cost, i, state = heapq.heappop(forward)
            if (i, state) in done_ahead:
                continue
            done_ahead.add((i, state))
            if (i, state) in behind:
                meet(cost + behind[i, state][0])
            text = ahead[i, state][1]
            for w, letter, j, to in _edges(rows, i, state):
                label = (cost + w, text + letter)
                if (j, to) not in ahead or label < ahead[j, to]:
                    if (j, to) not in ahead or label[0] < ahead[j, to][0]:
                        heapq.heappush(forward, (cost + w, j, to))
                    ahead[j, to] = label
        else:
            cost, left, state = heapq.heappop(reverse)
            i = n - left
            if (i, state) in done_behind:
                continue
            done_behind.add((i, state))
            if (i, state) in ahead:
                meet(cost + ahead[i, state][0])
            text = behind[i, state][1]
            for w, letter, j, source in back.get((i, state), ()):
                label = (cost + w, letter + text)
                if (j, source) not in behind or label < behind[j, source]:
                    if (j, source) not in behind or label[0] < behind[j, source][0]:
                        heapq.heappush(reverse, (cost + w, n - j, source))
                    behind[j, source] = label
    if best is None:
        return None
    # each cheapest script crosses, somewhere, from a node the forward search is done with to one the reverse search is
    # done with; the labels of their own ends were final from the beginning
    done_ahead.add((0, start))
    done_behind.update((n, e) for e in ends)
    found = [ahead[v][1] + behind[v][1] for v in done_ahead & done_behind if ahead[v][0] + behind[v][0] == best]
    for v in done_ahead:
        for w, letter, j, to in _edges(rows, *v):
            if (j, to) in done_behind and ahead[v][0] + w + behind[j, to][0] == best:
                found.append(ahead[v][1] + letter + behind[j, to][1])
    return best, min(found)


def remembered(memo: dict, rows: str, start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """``script``, solved once a task for each short lattice."""
    if len(rows) > SHORT:
        return script(rows, start, ends)
    key = (rows, start, ends)
    if key not in memo:
        if len(memo) >= MEMO:
            memo.clear()
        memo[key] = script(rows, start, ends)
    return memo[key]


def table_of(rows: str, memo: dict) -> dict:
    """{(from, to): (cost, initials)} of a run of rows for all states at its ends."""
    return {(a, b): s for a in range(4) for b in range(4) if (s := remembered(memo, rows, a, (b,))) is not None}


def joined(left: dict, right: dict) -> dict:
    """The table of two runs that follow each other."""
    out: dict = {}
    for (a, b), (cost, text) in left.items():
        for c in range(4):
            if (b, c) in right:
                label = (cost + right[b, c][0], text + right[b, c][1])
                if (a, c) not in out or label < out[a, c]:
                    out[a, c] = label
    return out


def _hidden(text: Column) -> Column:
    return F.coalesce(text, F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text; null roles and texts one space) with faults by crc32 of
    ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3
    repeats the row, 4 makes it the user's. A dropped row stays with a null text."""
    key = F.concat(_hidden(F.col("conv_id").cast("string")), F.lit(":"), _hidden(F.col("turn").cast("string")))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       _hidden(F.col("role")).alias("role"), _hidden(F.col("text")).alias("text"),
                       F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("damage"))
    text = F.when(F.col("damage") == 0, F.lit(None)).when(F.col("damage") == 1, "").when(
        F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("damage") == 3, 2).otherwise(1).alias("times")
                       ).withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def _digest() -> Column:
    """128 bits of role and text, in place of the text."""
    return F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


#: The order of a conversation's rows: turn (null first), role, digest of role and text.
_ORDER = ("conv_id", "turn", "role", "digest")


def _outline(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, initial, fault, times, later (not the first of its kind): the distinct rows without their texts."""
    blank = ~F.col("text").rlike(_VISIBLE)
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z")
    fault = F.when(F.col("text").isNull(), "x").when(blank, BLANK).when(cut, CUT).otherwise(SOUND)
    slim = rows.select("conv_id", "turn", "role", F.coalesce(_digest(), F.lit(b"")).alias("digest"), fault.alias("fault"))
    slim = materialize(slim.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count(F.lit(1)).alias("times")), "repair-rows")
    at = F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"))
    kinds = slim.where("fault <> 'x'").groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last")
    kinds = kinds.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = slim["conv_id"].eqNullSafe(kinds["c"]) & (slim["role"] == kinds["r"]) & (slim["digest"] == kinds["d"])
    return slim.join(kinds, same, "left").select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), "fault", "times",
                                                 F.coalesce(F.col("first") != at, F.lit(False)).alias("later"))


_PART = ("conv_id long, part int, rows long, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
         "turns long, low long, high long, scripts array<struct<a:int,b:int,cost:long,audit:string>>")


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Part:
    """What a partition knows of one conversation."""

    def __init__(self, conv_id, memo):
        self.memo = memo
        self.conv_id, self.rows, self.blank, self.duplicate, self.truncated, self.illegal = conv_id, 0, 0, 0, 0, 0
        self.head = self.tail = None
        self.turns, self.low, self.high = 0, None, None
        self.table, self.run = None, []

    def add(self, turn, initial, fault):
        if self.tail is not None and not _legal(self.tail, initial):
            self.illegal += 1
        self.head = initial if self.head is None else self.head
        self.tail = initial
        if turn is not None and turn != self.high:       # rows come in the order of their turns
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        self.rows += 1
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT
        self.run.append((initial or " ") + fault)
        if len(self.run) == RUN:
            self.close()

    def close(self):
        if self.run:
            table = table_of("".join(self.run), self.memo)
            self.table, self.run = table if self.table is None else joined(self.table, table), []

    def record(self, part: int, whole: bool):
        if self.table is None and whole:
            found = {(0, 0): remembered(self.memo, "".join(self.run), 0, ENDS)}
        else:
            self.close()
            found = self.table or {(a, a): (0, "") for a in range(4)}
            if whole:
                found = {(0, 0): min(found[0, e] for e in ENDS if (0, e) in found)}
        return {"conv_id": self.conv_id, "part": -1 if whole else part, "rows": self.rows, "blank": self.blank, "duplicate": self.duplicate,
                "truncated": self.truncated, "illegal": self.illegal, "head": self.head, "tail": self.tail, "turns": self.turns,
                "low": self.low, "high": self.high, "scripts": [{"a": a, "b": b, "cost": c, "audit": t} for (a, b), (c, t) in found.items()]}


def _solve(batches):
    """The parts of the conversations of one partition, whose rows come in order; only the first and the last may go on elsewhere."""
    import pyarrow as pa
    from pyspark import TaskContext

    schema = _arrow_schema()
    number = TaskContext.get().partitionId()
    now, first, out, memo = None, True, [], {}
    for batch in batches:
        for conv_id, turn, initial, fault, times, later in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    out.append(now.record(number, whole=not first))
                    first = False
                now = _Part(conv_id, memo)
            if fault == "x":
                continue
            for k in range(times):
                again = fault != BLANK and (later or k > 0)
                now.add(turn, initial, DUPLICATE if again else fault)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if now is not None:
        out.append(now.record(number, whole=False))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _arrow_schema():
    import pyarrow as pa

    number = [(n, pa.int64()) for n in ("rows", "blank", "duplicate", "truncated", "illegal")]
    scripts = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    return pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), *number, ("head", pa.string()), ("tail", pa.string()),
                      ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("scripts", scripts)])


def _join_parts(table):
    """One whole part of a conversation's parts, at most one a partition."""
    import pyarrow as pa

    whole = None
    for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
        r["scripts"] = {(s["a"], s["b"]): (s["cost"], s["audit"]) for s in r["scripts"]}
        if whole is None:
            whole = r
            continue
        if whole["tail"] is not None and r["head"] is not None and not _legal(whole["tail"], r["head"]):
            whole["illegal"] += 1
        for n in ("rows", "blank", "duplicate", "truncated", "illegal"):
            whole[n] += r[n]
        whole["turns"] += r["turns"] - (whole["high"] is not None and whole["high"] == r["low"])
        whole["head"] = r["head"] if whole["head"] is None else whole["head"]
        whole["tail"] = whole["tail"] if r["tail"] is None else r["tail"]
        whole["low"] = r["low"] if whole["low"] is None else whole["low"]
        whole["high"] = whole["high"] if r["high"] is None else r["high"]
        whole["scripts"] = joined(whole["scripts"], r["scripts"])
    cost, audit = min(whole["scripts"][0, e] for e in ENDS if (0, e) in whole["scripts"])
    whole.update(part=-1, scripts=[{"a": 0, "b": 0, "cost": cost, "audit": audit}])
    return pa.Table.from_pylist([whole], _arrow_schema())


def scripts(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text; a null text marks a dropped
    row): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    outline = materialize(_outline(rows), "repair-outline")
    placed = outline.repartitionByRange(*(F.col(c).asc_nulls_first() for c in _ORDER)).sortWithinPartitions(
        *(F.col(c).asc_nulls_first() for c in _ORDER))
    parts = materialize(placed.select("conv_id", "turn", "initial", "fault", "times", "later").mapInArrow(_solve, _PART), "repair-parts")
    split = parts.where("part >= 0").groupBy("conv_id").applyInArrow(_join_parts, _PART)
    whole = parts.where("part < 0").unionByName(split)
    # a span beyond 64 bits wraps around
    gaps = F.expr(f"coalesce(cast(pmod(cast(high as decimal(20)) - low + 1 - turns + {1 << 63}, {1 << 64}) - {1 << 63} as long), 0)")
    return whole.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("scripts")[0]["cost"].alias("cost"),
                        F.col("scripts")[0]["audit"].alias("audit"))


def apply_scripts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), edit (K, R or I), turn, role, text.

    A conversation lies in one partition and in order, so that what follows can read
    it as a stream; a task holds its script, one letter a row, and one batch of rows.
    """
    no = lambda kind: F.lit(None).cast(kind)
    steps = found.select("conv_id", F.lit(False).alias("is_row"), no("long").alias("turn"), no("string").alias("role"), no("binary").alias("digest"),
                         F.col("audit").alias("text"))
    lines = rows.where("text is not null").select("conv_id", F.lit(True).alias("is_row"), "turn", "role", _digest().alias("digest"), "text")
    order = ("conv_id", "is_row", "turn", "role", "digest")
    stream = steps.unionByName(lines).repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order))

    def run(batches):
        import pyarrow as pa

        columns = ("conv_id", "position", "edit", "turn", "role", "text")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        conv_id, audit, at, position, state = None, "", 0, 0, 0

        def inserted():
            nonlocal at, position, state
            while at < len(audit) and audit[at] == "I":
                role = _next_role(state)
                yield conv_id, position, "I", None, ROLES[role], ""
                state, at, position = NEXT[state][role], at + 1, position + 1
        for batch in batches:
            out = []
            for c, is_row, turn, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if not is_row:
                    conv_id, audit, at, position, state = c, text, 0, 0, 0
                    out += inserted()
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    if edit == "R":
                        initial = _next_role(state)
                        role = ROLES[initial]
                    else:
                        initial = role[0]
                    out.append((conv_id, position, edit, turn, role, text))
                    state, position = NEXT[state][initial], position + 1
                out += inserted()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=list(columns))
    return stream.select("conv_id", "is_row", "turn", "role", "text").mapInArrow(
        run, "conv_id long, position long, edit string, turn long, role string, text string")


def _next_role(state: int) -> str:
    """The role that an edit R or I gives: after a user's row the assistant's, else the user's."""
    return "a" if state == 2 else "u"


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of repaired rows as ``apply_scripts`` leaves them: the lines ``role:text``, joined by newlines."""
    def run(batches):
        import hashlib

        import pyarrow as pa

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())],
                                              names=["conv_id", "repaired_sha256"])
        now, state, out = None, None, []
        for batch in batches:
            for conv_id, position, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if position == 0:
                    if state is not None:
                        out.append((now, state.hexdigest()))
                    now, state = conv_id, hashlib.sha256()
                state.update((("\n" if position else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            if out:
                yield batch_of(out)
                out = []
        if state is not None:
            yield batch_of([(now, state.hexdigest())])
    return repaired.select("conv_id", "position", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scripts, repaired rows) of conversations (conv_id, turn, role, text).

    A row's faults, the first counts: blank (no character but white space), duplicate (role and
    text seen earlier), truncated (last such character not ``.!?``). Blank and duplicate rows are
    deleted; roles end as (s?(ua)+)?.

    Edge cases: rows of one turn are ordered by role, then by the digest of role and text, equal
    rows follow each other; null turns come first and count for no gap; a null conv_id is a
    conversation of its own; a null text marks a row known to be lost, and a conversation without other rows
    has zeros and an empty script; an empty table gives no rows; extra columns are ignored. The digest of
    one conversation is a sequential function, so one task streams it.
    """
    small_batches(rows.sparkSession)
    found = materialize(scripts(rows), "repair-scripts")
    return found, apply_scripts(rows, found)
