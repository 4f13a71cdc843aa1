import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textsim.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, part string"
WHITE = "\x20\t\n\x0b\x0c\r"


def plain(rows, start=0, ends=C.ENDS):
    """Bellman's recursion over all labels, without any heap: rows of (initial, fault)."""
    legal = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}

    def inserts(labels):
        for _ in range(3):
            for state, (cost, text) in list(labels.items()):
                for role in "ua":
                    if state in legal[role]:
                        to, label = legal[role][state], (cost + 5, text + "I")
                        if to not in labels or label < labels[to]:
                            labels[to] = label
        return labels
    labels = inserts({start: (0, "")})
    for initial, fault in rows:
        out = {}
        for state, (cost, text) in labels.items():
            options = [(2, "D", state)]
            if fault not in "bd":
                extra = 5 * (fault == "t")
                if state in legal.get(initial, {}):
                    options.append((extra, "K", legal[initial][state]))
                options += [(1 + extra, "R", legal[role][state]) for role in "ua" if state in legal[role]]
            for w, letter, to in options:
                label = (cost + w, text + letter)
                if to not in out or label < out[to]:
                    out[to] = label
        labels = inserts(out)
    return min((labels[e] for e in ends if e in labels), default=None)


def brute(rows):
    damaged, ids = {}, []
    for conv, turn, role, text, *_ in rows:
        damaged.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        damaged[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, kept in damaged.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults = set(), []
        for _, role, text in kept:
            body = text.rstrip(WHITE)
            faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-")
            seen.add((role, text))
        turns = {r[0] for r in kept if r[0] is not None}
        initials = [r[1][:1] for r in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain([(i or " ", f) for i, f in zip(initials, faults)])
        lines, last, at = [], "", 0
        for letter in audit:
            nxt = "assistant" if last == "u" else "user"
            if letter == "I":
                lines.append(nxt + ":")
            else:
                if letter == "K":
                    nxt = kept[at][1]
                if letter != "D":
                    lines.append(f"{nxt}:{kept[at][2]}")
                at += 1
            last = lines[-1][:1] if letter != "D" else last
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in "bdt"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, parts=4):
    damaged = C.damage(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    found, repaired = C.repair(damaged)
    d = C.digests(repaired).withColumnRenamed("conv_id", "c")
    df = found.join(d, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        *found.columns, F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hello.", "What?", "no end", "", " \t\n", "Yes! ", "É ü.", None, "Hello.", "a\nb."]) or None
            rows.append((c, rng.choice([t, t, t, t + 3, None, -t]), role, text, "clash"))
    rows += [(None, 0, "user", "x.", None), (None, 1, "assistant", "y.", None), (None, None, None, None, None)]
    rows += [(900, 5, "user", "same.", "q")] * 7 + [(901, None, "system", "only null turns.", "q")] * 3
    return rows


@pytest.mark.parametrize("length", [0, 1, 2, 3])
def test_script_is_the_cheapest_and_least_of_all(length):
    kinds = [i + f for i in "suax" for f in "-btd"]
    for rows in itertools.product(kinds, repeat=length):
        for start, ends in ((0, C.ENDS), (2, (3,)), (3, (2,)), (1, (1,))):
            assert C.script("".join(rows), start, ends) == plain(rows, start, ends), (rows, start)


def test_long_scripts_and_cut_lattices():
    rng = random.Random(7)
    for n in (5, 17, 60):
        rows = ["".join((rng.choice("suaux"), rng.choice("---tbd"))) for _ in range(n)]
        whole = plain(rows)
        assert C.script("".join(rows), 0, C.ENDS) == whole
        table = None
        for a in range(0, n, 4):
            part = C.table_of("".join(rows[a:a + 4]), {})
            table = part if table is None else C.joined(table, part)
        assert min(table[0, e] for e in C.ENDS if (0, e) in table) == whole


def test_against_brute_force(spark):
    rows = conversations()
    assert got(spark, rows) == brute(rows)


def test_a_conversation_over_many_partitions(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"line {rng.randint(0, 900)}.", "cut", "end!"]), None) for t in range(1500)]
    rows += conversations(2, 10)
    assert got(spark, rows) == brute(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "be good.", None), (1, 1, "user", "hi.", None), (1, 2, "user", "again.", None), (1, 3, "assistant", "hello.", None)]
    found, repaired = C.repair(spark.createDataFrame(rows, SCHEMA))
    assert found.select("cost", "audit").first() == (2, "KDKK")
    assert [tuple(r) for r in repaired.orderBy("position").collect()] == [
        (1, 0, "K", 0, "system", "be good."), (1, 1, "K", 2, "user", "again."), (1, 2, "K", 3, "assistant", "hello.")]


def test_empty_and_all_lost(spark):
    assert got(spark, []) == []
    lost = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    assert got(spark, [(5, lost, "user", "gone.", None)]) == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_far_turns_and_long_texts(spark):
    far = (1 << 63) - 1
    rows = [(1, -far, "user", "a" * 300_000 + ".", None), (1, far, "assistant", "b.", None)]
    (row,) = C.repair(spark.createDataFrame(rows, SCHEMA))[0].collect()
    assert (row["cost"], row["audit"]) == (0, "KK") and row["gaps"] == (2 * far - 1 + (1 << 63)) % (1 << 64) - (1 << 63)
