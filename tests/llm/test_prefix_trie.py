"""The conversations' prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from basewright.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_nodes(convs):
    """convs: id -> list of (role, text)."""
    members, ends, kids = {}, {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(turns[: d - 1]), set()).add(tuple(turns[:d]))
        ends.setdefault(tuple(turns), []).append(c)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        own = kids.get(p, ())
        leaves[p] = sum(leaves[k] for k in own) or 1
        saved[p] = sum(saved[k] for k in own) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(own), leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


def plain_turns(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).hexdigest())):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def found(df):
    rows = df.select(COLUMNS).collect()
    assert len(set(rows)) == len(rows)
    return set(map(tuple, rows))


def made(seed, n, alphabet, longest, copies=0):
    r = random.Random(seed)
    ids = r.sample(range(10 * n), n)
    common = [r.choice(alphabet) for _ in range(longest)]
    rows = []
    for k, c in enumerate(ids):
        turns = common[:3] if k < copies else [r.choice(alphabet) if r.random() < 0.3 else common[d] for d in range(r.randint(1, longest))]
        rows += [(c, d, "user" if d % 2 else "assistant", t) for d, t in enumerate(turns)]
    r.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,n,alphabet,longest,copies,turns", [(1, 60, "abc", 5, 20, 16), (2, 200, ["x", "é", "", "long text"], 7, 80, 40), (3, 40, "ab", 30, 0, 8), (4, 1, "a", 3, 0, 1), (5, 300, "a", 1, 0, 10), (6, 50, "ab", 9, 50, 4)])
def test_nodes(spark, seed, n, alphabet, longest, copies, turns):
    """Blocks of a few turns, so that nodes lie over many of them."""
    rows = made(seed, n, alphabet, longest, copies)
    df = prefix_trie.turn_lists(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert found(prefix_trie.nodes(df, block_turns=turns)) == plain_nodes(plain_turns(rows))
    assert found(prefix_trie.nodes(prefix_trie.with_shared_starts(df), block_turns=turns)) == plain_nodes(plain_rebuilt(plain_turns(rows)))


def test_many_ids_end_at_a_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 100)
    monkeypatch.setattr(prefix_trie, "SLICE", 7)
    rows = made(7, 150, "ab", 4, 120)
    assert found(prefix_trie.nodes(prefix_trie.turn_lists(spark.createDataFrame(rows, SCHEMA)), block_turns=100)) == plain_nodes(plain_turns(rows))


def test_cases(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "assistant", "b"), (2, None, "", ""), (2, 3, "user", "a"), (2, 3, "user", "a"), (3, 1, "user", "x" * 200_000), (-7, 1, "user", "x" * 200_000), (4, 1, "assistant", "x" * 200_000)]
    rows += [(9, d, "user", f"turn {d % 3}") for d in range(3000)] + [(8, d, "user", f"turn {d % 3}") for d in range(2999)]
    df = spark.createDataFrame([(*r, "k", "t", 1) for r in [*rows, (None, 1, "user", "lost")]], SCHEMA + ", `Key` string, t string, n_convs int").repartition(4)
    assert found(prefix_trie.nodes(prefix_trie.turn_lists(df))) == plain_nodes(plain_turns(rows))
    nothing = prefix_trie.turn_lists(df.limit(0))
    assert prefix_trie.nodes(nothing).count() == 0 and prefix_trie.nodes(prefix_trie.with_shared_starts(nothing)).count() == 0
    # only conversations without turns: the root is a leaf
    empty = spark.createDataFrame([(c, []) for c in (3, 10, 2)], "conv_id long, turns array<struct<hash string, bytes long>>")
    assert found(prefix_trie.nodes(empty)) == plain_nodes({3: [], 10: [], 2: []})


def test_block_minima():
    """Starts of pieces against a walk over the blocks."""
    r = random.Random(3)
    for _ in range(50):
        n = r.randint(1, 12)
        rows = [(3 * b, -1 if b == 0 else r.randint(0, 4), 0, r.choice([0, 1, 2, 3, 4, 1 << 40]), 5, 5) for b in range(n)]
        m = prefix_trie.BlockMinima(rows)
        for b in range(n):
            for depth in range(6):
                for head in (False, True):
                    at = b
                    want = 2 * rows[b][0] + 1 if not head else None
                    while want is None:
                        if rows[at][1] < depth:
                            want = 2 * rows[at][0]
                        else:
                            at -= 1
                            want = 2 * rows[at][0] + 1 if rows[at][3] < depth else None
                    got = m.start(np.array([b]), np.array([depth]), np.array([head]))
                    assert got[0] == want
