import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strata.llm import conversation_trie as ct
from strata.llm.queries import QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth long, ka long, n_convs string, length int, place long"


def brute(data, rebuild=True):
    """Every prefix of every conversation, by dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), [])[:h] + turns[h:] if rebuild else turns
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(made[c]) == len(p)))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()]


def made_up(seed, families=4, width=30):
    r = random.Random(seed)
    out = []
    for c in [*range(-3, width), *(100 * f + k for f in range(1, families) for k in r.sample(range(100), width // 2))]:
        same = r.random() < 0.4
        turns = r.randint(1, 12)
        out += [(c, t, ["user", "assistant", None][t % 3], None if t % 7 == 5 else f"hello{t} \U0001f600" if same else f"t{r.randint(0, 2)}") for t in range(turns)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*row, 1, 2, "x", 3, 4) for row in data], SCHEMA)


@pytest.mark.parametrize(("seed", "per", "shard_nodes"), [(1, 1024, 50_000), (2, 1, 5), (3, 2, 20), (4, 5, 11)])
def test_equals_brute_force(spark, monkeypatch, seed, per, shard_nodes):
    data = made_up(seed)
    for rebuild in (True, False):
        turns = ct.hashed_turns(frame(spark, data))
        rows, convs = (ct.rebuilt if rebuild else ct.as_they_are)(turns)
        got = ct.trie_nodes(rows, convs, per=per, shard_nodes=shard_nodes)
        assert got.columns == COLUMNS
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(data, rebuild), key=repr)


def test_a_long_conversation_and_a_large_group_of_copies(spark):
    data = [(7, t, "user", f"turn {t}") for t in range(5000)] + [(c, t, "user", "hi") for c in range(300, 900) for t in range(3)]
    data += [(200_000 * c, 0, "a", "far apart") for c in range(1, 5)]
    got = ct.trie_nodes(*ct.as_they_are(ct.hashed_turns(frame(spark, data))), per=50)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(data, False), key=repr)


def test_awkward_rows(spark):
    data = [(None, 0, "user", "no conversation"), (1, None, None, None), (1, 1, "", ""), (1, 1, "", ""), (2, 0, "ab", "c"), (3, 0, "a", "bc"), (100, 0, "user", "x" * 70_000), (101, 2, "user", "only one")]
    got = ct.trie_nodes(*ct.rebuilt(ct.hashed_turns(frame(spark, data))))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(data), key=repr)
    assert ct.trie_nodes(*ct.rebuilt(ct.hashed_turns(frame(spark, [])))).count() == 0


def test_bits_and_sums():
    # a root with two children, the second of which has one, and a lone root
    depth, level = np.array([2, 1, 2, 3, 1]), np.array([1, 0, 1, 2, 0])
    key, up = np.array([21, 10, 22, 31, 11]), np.array([10, 0, 10, 22, 0])
    order, bits, degree = ct.encode(depth, level, key, key, up, up)
    assert key[order].tolist() == [10, 11, 21, 22, 31] and degree.tolist() == [2, 2, 0, 0, 1, 0]
    assert "".join(map(str, bits)) == "11011000" + "100"
    parent = ct.parents(bits)
    assert parent.tolist() == [-1, -1, 0, 0, 3]
    total = np.array([1, 10, 100, 1000, 10_000])
    ct.add_up(parent, total)
    assert total.tolist() == [11_101, 10, 100, 11_000, 10_000]


def test_shards_hold_the_trie(spark):
    data = made_up(5)
    trie = ct.Trie(*ct.rebuilt(ct.hashed_turns(frame(spark, data))), per=3, shard_nodes=10)
    shards = trie.louds_shards().collect()
    assert len(shards) > 1 and all(len(s.louds) == (2 * s.n_nodes + 8) // 8 and len(s.chars) == 8 * s.n_nodes for s in shards)
    nodes = {(d, c) for c, d, *_ in brute(data)}
    held = {(d, c) for s in shards for d, c in zip(np.frombuffer(s.depth, np.int64).tolist(), np.frombuffer(s.conv_id, np.int64).tolist(), strict=True)}
    assert held <= nodes and max(np.frombuffer(s.n_convs, np.int64).max() for s in shards) <= 3


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    data = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_trie"](spark, path)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == sorted(brute(data), key=repr)
