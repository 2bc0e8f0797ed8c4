from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from loomery.llm import conversations
from loomery.llm.conversations import conversation_trie, with_digests
from loomery.llm.lcp_merge import Entry, LoserTree, common, packed, sorted_run, unpacked

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Rows of the trie of ``rows`` (conv_id, turn, role, text) without ties of turns."""
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own[c].append((role or "", text or ""))
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in own:
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    return Counter(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in nodes.items()
    )


def result(df, **given):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in with_digests(conversation_trie(df, **given)).select(names).collect())


def some_rows(seed, convs, most):
    """Conversations over few texts, so that beginnings meet; many copies; one long one."""
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(-150, 900), convs), 100]:
        n = 40 if c == 100 else rng.choice([1, 2, 2, 3, rng.randrange(1, most)])
        turns = rng.sample(range(-3, 3 * most + 50), n)
        for k, turn in enumerate(sorted(turns)):
            rows.append((c, None if k == 0 and c % 7 == 0 else turn, rng.choice(["user", "user", None]), "a" if rng.random() < 0.7 else rng.choice(["", "bé", None, "👩‍👧"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "task_turns"), [(512, 200_000), (16, 60), (8, 25)])
def test_equals_brute_force(spark, size, task_turns):
    rows = some_rows(2, 150, 12)
    want = brute(rows)
    assert result(spark.createDataFrame(rows, SCHEMA), size=size, task_turns=task_turns) == want


def test_copies_in_small_blocks(spark, monkeypatch):
    """Thousands of copies of one conversation, whose ids make many blocks."""
    rows = [(100 * c, t, "user", f"text {t}") for c in range(3000) for t in range(3)]
    blocks = spark.createDataFrame([(1, 2, c) for c in range(500)] + [(1, 3, 7)], "end_x long, end_y long, conv_id long")
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    monkeypatch.setattr(conversations, "BLOCK", 80)
    cut = list(conversations._blocks(blocks.toArrow().to_batches()))
    assert sum(b.num_rows for b in cut) == 51
    got = {(r["end_x"], r["end_y"]): r["ends_sha256"] for b in conversations._hashed(iter(cut)) for r in b.to_pylist()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 2): sha(range(500)), (1, 3): sha([7])}


def test_odd_rows(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (2, None, None, None), (None, 1, "user", "lost"), (3, 5, "a", "w" * 300_000)]
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], SCHEMA + ", level int, turns string")
    assert result(df) == brute(rows)
    assert result(df.limit(0)) == Counter()
    tied = spark.createDataFrame([(100, 0, "user", "x"), (100, 0, "user", "y"), (200, 0, "user", "y"), (200, 0, "user", "x")], SCHEMA)
    deepest = max(result(tied), key=lambda r: r[1])
    assert deepest[3] == 2  # tied turns stand in the same order in both


def test_merge_compares_what_is_shared_once():
    rng = random.Random(1)
    shared = [rng.randrange(9) for _ in range(300)]
    found = {tuple(shared + [rng.randrange(4) for _ in range(rng.randrange(8))]) for _ in range(900)}
    entries = [Entry(list(s), [0] * len(s), 1, 0, (0, 0, 0), None) for s in found]
    rng.shuffle(entries)
    tree = LoserTree([sorted_run(entries[k::7]) for k in range(7)] + [sorted_run([])])
    merged = [(e.sequence, n) for e, n in tree]
    assert [s for s, _ in merged] == sorted(map(list, found))
    assert all(n == common(a, b) for (a, _), (b, n) in zip(merged, merged[1:]))
    assert tree.compared < 7 * 310 + 12 * len(merged)  # not the 300 shared items each time
    assert list(LoserTree([])) == []


def test_packed_integers_keep_the_order():
    values = [(x, y) for x in (-(2**63), -1, 0, 2**63 - 1) for y in (-(2**63), -5, 0, 2**63 - 1)]
    assert sorted(values) == sorted(values, key=lambda v: packed(*v))
    assert [unpacked(packed(*v)) for v in values] == values
