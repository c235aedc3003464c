"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from gleaner.llm import conversation_repair as repair
from gleaner.llm import queries

WS = " \t\n\x0b\f\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        if k == 0:
            out.append((conv, turn, role, text, True))
            continue
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(k, text)
        out += [(conv, turn, "user" if k == 4 else role, text, False)] * (2 if k == 3 else 1)
    return out


def ordered(rows):
    md5 = lambda r: hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
    return sorted((r for r in rows if not r[4]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], md5(r)))


def cheapest(lines):
    """The least (cost, audit) by best-first search, and the repaired rows."""
    heap = [(0, "", 0, "", ())]
    seen = set()
    while True:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(lines) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in seen:
            continue
        seen.add((i, last))
        due = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", i, due[0], (*out, due + ":")))
        if i == len(lines):
            continue
        role, text, fault = lines[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 * (fault == "truncated")
        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, due[0], (*out, f"{due}:{text}")))
        if (last or "-") + role[:1] in ("-s", "-u", "su", "ua", "au"):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))


def expected(rows):
    convs = defaultdict(list)
    for r in damaged(rows):
        convs[r[0]].append(r)
    out = []
    for conv, rs in convs.items():
        rs = ordered(rs)
        turns = [r[1] for r in rs if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        lines, seen = [], set()
        for _, _, role, text, _ in rs:
            bare = text.strip(WS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            lines.append((role, text, fault))
        faults = [x[2] for x in lines]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        cost, audit, whole = cheapest(lines)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(whole).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def run(spark, rows, kind="conv_id long, turn long, role string, text string"):
    return repair.repair(repair.damage(spark.createDataFrame(rows, kind)))


def test_query(spark, sf_dir):
    t = pq.read_table(f"{sf_dir}/conversations.parquet").to_pydict()
    need = expected(list(zip(t["conv_id"], t["turn"], t["role"], t["text"])))
    assert found(queries.op12_conversation_repair(spark, sf_dir)) == need and len({r[7] for r in need}) > 20


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Fine.", "Good!", "cut off", "", " \t\n", "Why?\n", None, "ünïcödé 😀"]
    out = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.choice([1, 2, 3, 5, 8, 9])):
            turn += rng.choice([0, 1, 1, 1, 3])
            out.append((conv, None if rng.random() < 0.05 else turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rows = conversations(seed, 150)
    rows += [(None, k, "user", f"{k}.") for k in range(3)] + [(None, None, None, None)]
    random.Random(seed).shuffle(rows)
    assert found(run(spark, rows)) == expected(rows)


def test_long_conversations_and_long_texts(spark):
    """One conversation holds a third of all rows and spans batches."""
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "assistant", "system"]), f"{'long ' * rng.choice([1, 1, 5000])}{k}{rng.choice('.?,')}") for k in range(3000)]
    rows += [(100 + k // 12, k % 12, "user" if k % 2 else "assistant", f"{k}.") for k in range(6000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 700)
    try:
        got = found(run(spark, rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == expected(rows)


def test_clashing_columns_string_ids_and_no_rows(spark):
    kind = "conv_id string, turn int, role string, text string, lost string, digest string, first string, part string, result string, fault string"
    rows = [(c, t, r, x, *["z"] * 6) for c, t, r, x in [("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes."), ("b", 5, "assistant", "No."), (None, None, None, None)]]
    assert found(run(spark, rows, kind)) == expected([r[:4] for r in rows])
    assert found(run(spark, rows, kind).limit(0)) == []
    assert found(repair.repair(repair.damage(spark.createDataFrame([], kind)))) == []


def test_all_rows_lost(spark):
    lost = [k for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    got = found(run(spark, [(k, 0, "user", "Hi.") for k in lost]))
    assert lost and got == [(k, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in sorted(lost, key=str)]


def test_small_tensors_give_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    ends = np.append(0, np.cumsum(rng.integers(0, 20, 300)))
    role, fault = rng.integers(0, 4, ends[-1]), rng.integers(0, 4, ends[-1])
    costs, audits = repair.solve(role, fault, ends)
    monkeypatch.setattr(repair, "CELLS", 1)
    few, same = repair.solve(role, fault, ends)
    assert (costs == few).all() and audits == same
    price = {"K": 0, "R": 1, "D": 2, "I": 5}
    for i, audit in enumerate(audits):
        used = [x for x in audit if x != "I"]
        cut = sum(f == repair.CUT and x != "D" for x, f in zip(used, fault[ends[i] : ends[i + 1]]))
        assert costs[i] == sum(price[x] for x in audit) + 5 * cut and len(used) == ends[i + 1] - ends[i]
