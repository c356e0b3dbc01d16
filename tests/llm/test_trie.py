"""Conversation prefix trie against a plain walk."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from punctua.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, k1 int, seq binary"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, b"y") for r in rows], SCHEMA).repartition(3)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, name), (role, text)))
    own = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - c % 5 if c >= 0 else c + -c % 5
        out[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    return out


def plain(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        size = len(path[-1][1].encode()) if path else 0
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = (len(members[path]) - 1) * size + sum(saved[c] for c in children[path])
    out = set()
    for path, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if convs[c] == path)
        out.add((min(own), len(path), min(members[path[:-1]]) if path else None, len(own),
                 len(children[path]), leaves[path], saved[path],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some_rows(seed, convs=60):
    rng = random.Random(seed)
    said = ["a", "bé", "ccc", "", None, "long " * 40]
    rows = []
    for c in range(-12, convs):
        for k in range(rng.randint(1, 12)):
            rows.append((c, rng.choice([k, k, k, 3, None]), rng.choice(["user", "user", None]),
                         rng.choice(said[:2] if rng.random() < 0.6 else said)))
    rows += [r for r in rows if r[0] == 20] * 2  # repeated rows
    rows += [(1000 + 5 * k, 0, "user", "a") for k in range(80)]  # a hot sequence
    rows += [(None, 0, "user", "a"), (7_000_000_000_000_000_001, 0, None, None)]
    rows += [(2000, k, "user", f"{k % 7}") for k in range(300)]  # a long conversation
    return rows


@pytest.mark.parametrize("block, ids", [(4096, 8192), (4, 3)])
def test_trie_equals_the_plain_walk(spark, monkeypatch, block, ids):
    monkeypatch.setattr(trie, "BLOCK", block)  # long conversations and end lists in pieces
    monkeypatch.setattr(trie, "IDS", ids)
    rows = some_rows(block)
    got = trie.prefix_nodes(table(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                           "n_leaves", "saved_tokens", "ends_sha256"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows)


def test_trie_without_conversations(spark):
    assert trie.prefix_nodes(table(spark, [(None, 1, "user", "a")])).count() == 0
    assert trie.prefix_nodes(table(spark, [(1, 1, "u", "a")]).limit(0)).count() == 0


def test_lookup_joins_hot_keys_whole(spark):
    from punctua.llm.lookups import lookup
    rows = spark.createDataFrame([(k % 3 if k < 300 else k, k) for k in range(400)], "key int, v int")
    one = spark.createDataFrame([(k, str(k)) for k in range(1, 350)], "key int, name string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, lookup(rows, one, ["key"], how).collect()), key=repr)
        assert got == sorted(map(tuple, rows.join(one, ["key"], how).collect()), key=repr)
