import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def sequences(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def brute(rows):
    seqs = sequences(rows)
    members = defaultdict(list)
    for c, ts in seqs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
    out = []
    for node, ms in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ms if len(seqs[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ms), len(node), parent, len(ms), len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def built(df, **how):
    return sorted(repr(tuple(r)) for r in trie.prefix_trie(*trie.rebuilt(df), **how).collect())


def conversations(seed):
    """Few texts, so that prefixes are shared; long conversations, copies of them, and all that is odd."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 90), *range(-45, 0, 3), 1 << 40, *range(4000, 4400, 7)]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a b", "c", "d  e f "])))
    long = [(t, "user", f"w{t % 3} x") for t in range(60)]
    for c in (500, 501, 502, 503, 520, 540):
        rows += [(c, *t) for t in long[: rng.choice([30, 60])]] + [(c, 100, None, f"end {c % 2}")]
    rows += [(600, t, "user", "hi") for t in range(40)] + [(620, t, "user", "hi") for t in range(41)]
    # Rows of one turn number, equal rows, nulls, and rows without a conversation.
    rows += [(700, None, None, None), (700, None, "user", None), (700, 3, "a", "x"), (700, 3, "a", "x"), (701, 1, "b", None)]
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [{}, {"limit": 1, "levels": 4, "block": 8}, {"limit": 3, "levels": 3, "block": 16}])
def test_against_plain_sets(spark, how):
    rows = conversations(7)
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'other' AS depth", "'other' AS id", "1 AS total").repartition(6)
    assert built(df, **how) == brute(rows)


def test_a_third_of_all_conversations_alike(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 4000, 20) for t in range(6)]
    rows += [(c, t, "user", f"{c % 5} {t}") for c in range(1, 4000, 10) for t in range(4)]
    df = spark.createDataFrame(rows, TURNS)
    assert built(df, limit=16) == brute(rows)


def test_conversations_without_turns(spark):
    # Conversation 21 begins with turns of 20, which is not there, and has none after them.
    rows = [(c, 0, "user", "x") for c in range(21, 40)]
    assert any(not ts for ts in sequences(rows).values())
    assert built(spark.createDataFrame(rows, TURNS)) == brute(rows)


def test_no_conversations(spark):
    assert built(spark.createDataFrame([], TURNS)) == []
    assert built(spark.createDataFrame([(None, 1, "user", "x")], TURNS)) == []
