"""Operators 11 to 13: against plain twins, on edges, and with limits so small that every path is taken."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from kinograph.llm import infill, plans, prefixes, rows, simhash

from .test_edges import CLASH, ROWS, SCHEMA

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def clash(df, more=()):
    return df.withColumns({c: F.lit("x") for c in (*CLASH, *more)})


# Operator 11

def plain_trie(sequences):
    """{(prefix): row} of (conv_id, [(role, text)]) by dictionaries."""
    members = {}
    for conv, turns in sequences:
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    first = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    ends = {}
    for conv, turns in sequences:
        ends.setdefault(tuple(turns), []).append(conv)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids.get(p, []))
    return sorted(((first[p], len(p), first[p[:-1]] if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(",".join("" if c is None else str(c) for c in sorted(ends.get(p, []), key=lambda c: (c is None, c))).encode()).hexdigest())
                   for p, m in members.items()), key=str)


def got_trie(df):
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_trie_equals_dictionaries(spark, chunk):
    rng = random.Random(chunk)
    words = ["a", "b b", "c c c", "", "d\te"]
    convs = {i: [(rng.choice("ua"), rng.choice(words)) for _ in range(rng.choice((0, 1, 2, 3, 9)))] for i in range(150)}
    convs |= {200 + i: [("u", "hot start"), ("a", "same")] for i in range(60)}  # one conversation many times
    convs[300] = [("u", "hot start")] + [("a", f"turn {k}") for k in range(300)]
    given = [(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    rng.shuffle(given)
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    got = got_trie(prefixes.prefix_trie(prefixes.turn_sequences(df).repartition(5), chunk))
    assert got == plain_trie([(c, t) for c, t in convs.items() if t])


def test_trie_edges(spark):
    given = [(1, None, None, None), (1, 0, "u", "x y"), (2, 0, "u", "x y"), (2, None, "", ""), (None, 1, "a", None), (None, 0, "u", None),
             (3, 1, "a", "same"), (3, 1, "a", "same"), (4, 5, "b", "q"), (4, 5, "a", "r"), (5, 0, "u", "z" * 200_000)]
    df = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    want = plain_trie([(1, [("", ""), ("u", "x y")]), (2, [("", ""), ("u", "x y")]), (None, [("u", ""), ("a", "")]), (3, [("a", "same")] * 2),
                       (4, [("a", "r"), ("b", "q")]), (5, [("u", "z" * 200_000)])])
    assert got_trie(prefixes.prefix_trie(prefixes.turn_sequences(df))) == want
    odd = clash(df, ("words", "t", "id", "parent", "chunk", "open", "depth", "ends"))
    assert got_trie(prefixes.prefix_trie(prefixes.turn_sequences(odd))) == want
    assert prefixes.prefix_trie(prefixes.turn_sequences(df.filter("false"))).count() == 0


def test_turnless_and_absent_starts(spark):
    convs = {c: [("u", f"{c} {k}") for k in range(n)] for c, n in ((0, 2), (3, 1), (7, 4), (19, 2), (25, 1), (41, 3), (40, 5), (59, 3))}
    df = spark.createDataFrame([(c, k, r, t) for c, turns in convs.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "u", "n")],
                               "conv_id long, turn long, role string, text string")
    mixed = [(None, [("u", "n")])]
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        mixed.append((c, convs.get(c - c % 20, [])[:h] + turns[h:]))
    assert any(not t for _, t in mixed)
    assert got_trie(prefixes.prefix_trie(prefixes.shared_starts(prefixes.turn_sequences(df)))) == plain_trie(mixed)


def test_node_layouts_grow():
    tree, keys = prefixes.RadixTree(), [bytes([k]) + b"tail" * (k % 3) for k in range(256)] + [b"", b"\x05ta", b"\x05tail", b"\x05tail"]
    kinds = set()
    for i, k in enumerate(keys):
        tree.insert(k, i)
        kinds.add((type(tree.root.children).__name__, getattr(tree.root.children, "room", None)))
    assert {("Sorted", 4), ("Sorted", 16), ("Indexed", None), ("Full", None)} <= kinds
    found, todo = [], [(tree.root, b"")]
    while todo:
        node, before = todo.pop()
        here = before + node.path
        found += [(i, here) for i in node.ends]
        todo += [(child, here + bytes([b])) for b, child in (node.children.items() if node.children else ())]
    assert sorted(found) == list(enumerate(keys))


# Operator 12

def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    runs = [" ".join(w[k:k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, errors=4):
    prints = np.array(prints, np.uint64)
    label, near = np.arange(len(prints)), np.bitwise_count(prints[:, None] ^ prints[None, :]) <= errors
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label.tolist()
        label = new


def test_fingerprints_and_components(spark):
    given = [(r.doc_id, r.text) for r in rows.table(spark, DATA, "documents").collect()]
    given.sort()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in plans.QUERIES["op12_trie_join"](spark, DATA).collect()}
    prints = [plain_print(t) for _, t in given]
    label = plain_components(prints)
    assert got == {d: (f"{p:016x}", given[k][0]) for (d, _), p, k in zip(given, prints, label)}


def test_a_text_in_windows(monkeypatch):
    text = " ".join(random.Random(5).choices(["ab", "c", "défg", "HI"], k=3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_WINDOW", 50)
    assert simhash.fingerprint(text.encode()) == whole == plain_print(text)
    assert simhash.fingerprint(b"a B\tc") == plain_print("a B\tc") and simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


@pytest.mark.parametrize("errors,heavy", [(4, 10**9), (4, 10), (0, 10), (2, 10), (7, 10)])
def test_trie_join_equals_all_pairs(spark, errors, heavy):
    rng = np.random.default_rng(errors)
    made = {0, 2**64 - 1}
    for base in rng.integers(0, 2**63, 40, dtype=np.uint64).tolist():
        for _ in range(rng.integers(1, 30)):
            made.add(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)))
    made |= {base ^ k for k in range(300)}  # a dense group
    prints = np.array(sorted(made), np.uint64)
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    parent = list(range(len(prints)))
    place = {int(p): k for k, p in enumerate(prints.view(np.int64))}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in simhash.links(table, errors, heavy).collect():
        a, b = sorted((root(place[a]), root(place[b])))
        parent[b] = a
    assert [root(k) for k in range(len(prints))] == plain_components(prints, errors)


def test_budgets_meet_every_pair():
    rng = random.Random(3)
    for errors in (1, 4, 6):
        for _ in range(300):
            apart = np.zeros(64, int)
            apart[rng.sample(range(64), rng.randint(0, errors))] = 1
            turns = [0, *simhash.blocks(errors)[:-1]]
            assert any((np.cumsum(np.roll(apart, -turns[k])) <= simhash.budgets(errors, k, errors)[1:]).all() for k in range(errors + 1))


def test_near_fingerprints_edges(docs):
    got = simhash.near_fingerprints(docs).collect()
    assert len(got) == len(ROWS)
    by = {(r.doc_id, i): r for i, r in enumerate(sorted(got, key=str))}
    none = [r for r in got if r.fingerprint == "0" * 16]
    assert len(none) == 4 and {r.component_id for r in none} == {3} and by
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert sorted(map(str, simhash.near_fingerprints(clash(docs, ("print", "root", "least", "first", "left"))).collect())) == sorted(map(str, got))
    assert simhash.near_fingerprints(docs.filter("false")).count() == 0
    alone = simhash.near_fingerprints(docs.filter("doc_id is null and text is not null")).collect()
    assert [r.component_id for r in alone] == [None]


# Operator 13

def plain_infill(doc_id, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame", [4, 37, infill.FRAME])
def test_infill_equals_plain(spark, frame):
    rng = random.Random(frame)
    texts = [(i, "".join(rng.choices(["word", "Ab", " ", "é", "漢", "1", "\n", "<", "P", ">"], k=rng.randrange(60)))) for i in range(200)]
    texts += [(1000, "x" * 5000), (1001, "has <M> in it"), (1002, "<P"), (None, "nobody's"), (1003, None), (1003, None), (1004, "é" * 100), (1005, "y" * 200_000 + " end")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    out = infill.rearrange(infill.frame_store(df, frame_bytes=frame))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in infill.output_texts(out).collect()), key=str)
    assert got == sorted(((d, *plain_infill(d, t)) for d, t in texts), key=str)
    assert {r.restored for r in infill.output_texts(out).collect()} == {t or "" for _, t in texts}
    sha = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts}
    assert {r.restored_sha256 for r in infill.digests(out).collect()} == sha


def test_frames_are_independent_and_counted():
    data = ("ab" * 50 + " é1 " * 30).encode()
    frames, at, units, chars = infill._framed(data, 16, zstandard.ZstdCompressor().compress)
    texts = [zstandard.ZstdDecompressor().decompress(f) for f in frames]
    assert b"".join(texts) == data and max(map(len, texts)) <= 16
    assert units[-1] == len(re.findall("[A-Za-z]+|[^A-Za-z]", data.decode())) and chars[-1] == len(data.decode())
    text = infill._Reader(b"".join(frames), at, units, chars)
    whole = re.findall("[A-Za-z]+|[^A-Za-z]", data.decode())
    for k in range(len(whole) + 1):
        f, byte, points = text.seek(k)
        assert points == len("".join(whole[:k])) and sum(map(len, texts[:f])) + byte == len("".join(whole[:k]).encode())
    fresh = infill._Reader(b"".join(frames), at, units, chars)
    fresh.seek(40)
    assert len(fresh.open) == 1  # one frame decompressed for a cut


def test_infill_edges(docs):
    query = lambda df: infill.digests(infill.rearrange(infill.frame_store(df)))
    got = sorted(map(str, query(docs).collect()))
    assert len(got) == len(ROWS) and got == sorted(map(str, query(clash(docs, ("frames", "marked", "chars", "form"))).collect()))
    assert query(docs.filter("false")).count() == 0


def test_find_marks_across_reads(monkeypatch):
    monkeypatch.setattr(infill, "_READ", 2)
    pack = zstandard.ZstdCompressor().compress
    out = pack(b"<S>") + pack(b"some suffix") + pack(b"<P>") + pack(b"pre") + pack(b"<M>") + pack(b"mid")
    assert b"".join(infill.restored(out, "spm")) == b"premidsome suffix"
    assert pa.array([out]).type == pa.binary()
