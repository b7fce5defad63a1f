import hashlib
import random
import zlib

import pytest

from labelshift.llm import prefix_trie

NAMES = "conv_id long, turn long, role string, text string, keys string, depth int"


def frame(spark, rows):
    return spark.createDataFrame([(*row, "own", 1) for row in rows], NAMES).repartition(3)


def brute(rows):
    """Nodes of the rebuilt conversations, from dictionaries of all prefixes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, mark), (role, text)))
    own = {conv: [t for _, t in sorted(turns)] for conv, turns in own.items()}
    members = {}
    ends = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        family = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        path = tuple(own.get(family, [])[:h] + turns[h:])
        ends.setdefault(path, []).append(conv)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, convs in members.items():
        size = len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(convs) - 1) * size
    return sorted(
        (
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
            len(children.get(path, [])), leaves[path], saved[path],
            hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest(),
        )
        for path, convs in members.items()
    )


def nodes(spark, rows, **options):
    conversations = prefix_trie.rebuilt(prefix_trie.turns_of(frame(spark, rows)))
    found = prefix_trie.trie_nodes(conversations, **options)
    return sorted(tuple(row) for row in found.collect())


def mixed_rows(seed):
    """Families of conversations over few turns: shared starts, copies, long chains, odd values."""
    choose = random.Random(seed)
    rows = []
    for conv in range(-8, 90):
        if conv % 7 == 3:
            continue
        kind = choose.random()
        length = 0 if kind < 0.05 else choose.randrange(1, 7)
        texts = ["Hello", "Hi ünï", "", None, "x" * 50]
        turns = [(choose.choice(["user", "assistant", None]), choose.choice(texts[: 1 + choose.randrange(5)])) for _ in range(length)]
        if kind > 0.6:  # a frequent conversation and its continuations
            turns = [("user", "Hello"), ("assistant", "Hi ünï"), ("user", "more")][: choose.randrange(1, 4)] + turns[:1]
        for n, (role, text) in enumerate(turns):
            rows.append((conv, choose.choice([n, n, n, None, 1]), role, text))
    rows += [(200 + i, n, "user", f"step {n}") for i in range(12) for n in range(3 * i)]
    rows += [(None, 0, "user", "no conversation"), (5, 0, "user", "Hello"), (5, 0, "user", "Hello")]
    return rows


@pytest.mark.parametrize("least_turns", [3, 40, 10_000])
def test_nodes_equal_a_dictionary_of_prefixes(spark, least_turns):
    rows = mixed_rows(least_turns)
    assert nodes(spark, rows, least_turns=least_turns) == brute(rows)


def test_many_members_end_at_a_head(spark):
    rows = [(i, n, "user", f"same {n}") for i in range(300) for n in range(9)] + [(900, 0, "user", "other")]
    assert nodes(spark, rows, least_turns=20) == brute(rows)


def test_small_tables(spark):
    assert nodes(spark, []) == []
    rows = [(7, 0, "user", "gone")]  # h of 7 leaves nothing of its own turn where its family is absent
    assert nodes(spark, rows) == brute(rows)


def test_sweep_of_sorted_suffixes_at_a_head():
    def keys(*turns):
        key, out = b"", b""
        for turn in turns:
            key = hashlib.md5(key + turn).digest()
            out += key
        return out

    rows = sorted(
        [(1, keys(b"h", b"a"), [1, 2], 1), (4, keys(b"h", b"a"), [1, 2], 1), (2, keys(b"h", b"a", b"b"), [1, 2, 5], 1)],
        key=lambda row: (row[1], row[0]),
    )
    child, top = list(prefix_trie.sweep(iter(rows)))
    assert child[:7] == [2, 3, 1, 1, 0, 1, 0] and child[8] is None
    assert top[:7] == [1, 2, None, 3, 1, 1, 4] and top[8] == keys(b"h")
    assert top[7] == hashlib.sha256(b"1,4").hexdigest()
