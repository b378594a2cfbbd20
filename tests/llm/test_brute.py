"""Operators against direct computations and against planted cases, on small tables."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from kinograph.llm import backoff, chat, decontaminate, gam, graph, licenses, naming, near, packing, rows, shards, toxicity

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in rows.table(spark, DATA, "documents").collect()]


def test_every_number_has_one_query():
    names = [n for n in QUERIES if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in QUERIES


def test_differencing_beats_greedy_and_is_exact():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 10_000) for _ in range(400)] + [60_000]
    sums = np.bincount(shards.difference(sizes, 8), sizes, 8)
    assert sums.sum() == sum(sizes) and sums.max() - sums.min() <= 20
    assert shards.difference([], 4) == [] and shards.difference([5], 4)[0] in range(4)
    small = [8, 7, 6, 5, 4]  # differencing's known result for two parts: 16 and 14
    two = np.bincount(shards.difference(small, 2), small, 2)
    assert sorted(two) == [14, 16]


def test_shards(spark, documents):
    got = QUERIES["op1_karmarkar_karp"](spark, DATA).collect()
    text = dict(documents)
    assert len(got) == len(documents)
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    home, sums, slots = {}, [0] * 8, [[] for _ in range(8)]
    for r in got:
        assert home.setdefault(text[r.doc_id], r.shard) == r.shard
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sums) - min(sums) <= 50


def test_heavy_group_gets_counterweights(spark):
    given = [(i, "x" * 3000) for i in range(300)] + [(1000 + i, f"{i} " + "y" * (i % 97)) for i in range(3000)]
    got = shards.assign_shards(spark.createDataFrame(given, "doc_id long, text string")).groupBy("shard").sum("size").collect()
    sums = sorted(r[1] for r in got)
    assert len(sums) == 8 and sums[-1] == 300 * 3001 and sums[-2] - sums[0] <= 50


@pytest.mark.parametrize("name,label,limit", [("op9_additive_quality", "quality", 0.95), ("op2_string_kernel", "toxic", 0.8)])
def test_held_out_accuracy(spark, name, label, limit):
    d = "/root/testdata/sf0.1"
    given = {r.doc_id: r[label] for r in rows.table(spark, d, "labels").collect()}
    got = [r for r in QUERIES[name](spark, d).collect() if r.doc_id in given]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = sorted((r.score, given[r.doc_id]) for r in got if r.held_out)
    place = [k for k, (_, y) in enumerate(held) if y]
    n1, n0 = len(place), len(held) - len(place)
    assert (sum(place) - n1 * (n1 - 1) / 2) / (n1 * n0) > limit


def test_kernel_folds_exactly():
    words = ["idiot", "idxiot", "haneas", "thereble", "stupid", "pathetic"]
    codes, owner, inside = toxicity.windows(words)
    used, index, table = toxicity._landmark_table(codes[:3], inside[:3])
    beta = np.array([1.0, -0.5, 0.25])
    weight = np.zeros(toxicity._CODES ** toxicity.LENGTH)
    weight[used] = table[1:] @ beta
    direct = toxicity._features(codes, inside, index, table) @ beta
    folded = toxicity.KernelMachine(weight, 0.0).window_margins(codes, inside)
    assert np.allclose(direct, folded, atol=1e-5)
    # The kernel itself, by enumeration.
    a, b = "^idi", "^ixdi"
    def vector(s):
        out = {}
        for i, j, k in ((i, j, k) for i in range(len(s)) for j in range(i + 1, len(s)) for k in range(j + 1, len(s))):
            out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + toxicity.DECAY ** (k - i - 2)
        return out
    va, vb = vector(a), vector(b)
    want = sum(va[s] * vb.get(s, 0) for s in va)
    codes, _, inside = toxicity.windows([a[1:], b[1:]])
    _, index, table = toxicity._landmark_table(codes[:1], inside[:1])
    assert toxicity._features(codes[1:], inside[1:], index, table)[0, 0] * toxicity._NORM[len(a)] * toxicity._NORM[len(b)] == pytest.approx(want)


def test_inserted_characters_are_met():
    rng = random.Random(2)
    parts = ["th", "er", "ha", "on", "nd", "ing", "at", "of", "ble", "es", "in", "ly", "re"]
    clean = [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(60)) for _ in range(400)]
    label = np.array([k % 3 == 0 for k in range(400)], float)
    texts = [t + (" idiot scum" if y else "") for t, y in zip(clean, label)]
    model = toxicity.fit(texts, label)
    p = model.probability(model.margins(["haer i.d-i*o_t haon s-cum", "haer idxiot haon scuxm", "haer i d i o t haon scum", "haer haon nding", "", None]))
    assert p[0] > 0.5 and p[1] > 2 * p[3] and p[2] > 0.5 and p[3] < 0.5 and p[4] < 0.5 and p[5] < 0.5


def test_additive_tables_score_as_fitted():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # nothing but an interaction
    model = gam.fit(x, y, pairs=2)
    assert (1, 0) in [(p[0], p[1]) for p in model.pairs]
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(packing.tokenizer_json())
    given = [*documents, (-1, "Don't we've x's <|startoftext|><|ENDOFTEXT|> a,b.c... É\u0301 naïve 12,5% #tag!!! ﬁ ΣΑΣ.")]
    got = {}
    for r in packing.pack(spark.createDataFrame(given, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    bins, tokens = {}, 0
    for doc, text in given:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        tokens += len(ids)
        want = [(k, a, len(ids[a:a + 4096]), zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[doc]) == want
        for r in got[doc]:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= tokens / 4096 * 1.02 + 8


def test_special_tokens_at_a_chunks_end():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(packing.tokenizer_json())
    said = ["<|endoftext|>", "see<|endoftext|>.", "a <|startoftext|>, b", "x<|endoftext|><|startoftext|>!?", "no<|endoftext", "a|>. see."]
    got = packing.WordIds(packing.tokenizer_json()).of([t.encode() for t in said])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in said]


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert bins.place(8) == (2, 0)  # bin 1, the fullest, closed
    assert bins.place(3) == (0, 6) and bins.place(2) == (2, 8)


def test_phrases_and_proximity(spark):
    given = spark.createDataFrame([(1, "a b c d e b c"), (2, "c x b y c"), (3, "b c" * 1), (4, None)], "doc_id long, text string")
    index = decontaminate.build_index(given, shard_words=3)
    exact = {r.doc_id: [(s.start, s.length) for s in r.spans] for r in decontaminate.search(index, [("i", (b"b", b"c"))]).collect()}
    assert exact == {1: [(1, 2), (5, 2)], 2: [], 3: [(0, 2)], 4: []}
    close = {r.doc_id: [(s.start, s.length) for s in r.spans] for r in decontaminate.search(index, [("i", (b"b", b"c"))], slack=1).collect()}
    assert close == {1: [(1, 2), (5, 2)], 2: [(2, 3)], 3: [(0, 2)], 4: []}


def test_proximity_against_brute_force(spark):
    rng = random.Random(7)
    given = [(0, "a x b y z c"), (1, "a b x b y z c"), (2, "b b c"), (3, "a b"), (4, "c"), (5, None)] + [
        (k, " ".join(rng.choice("abcx") for _ in range(rng.randrange(14)))) for k in range(6, 40)]
    phrases = [(f"i{k}", tuple(w.encode() for w in p)) for k, p in enumerate(("abc", "bc", "aba", "cab", "bb", "a"))]
    index = decontaminate.build_index(spark.createDataFrame(given, "doc_id long, text string"))

    def ends(w, phrase, at, slack):  # of all matches whose first word is at this place
        if len(phrase) == 1:
            return {at}
        return {e for q in range(at + 1, min(len(w), at + slack + 2)) if w[q] == phrase[1] for e in ends(w, phrase[1:], q, slack)}

    for slack in (1, 2, 3):
        got = {r.doc_id: r for r in decontaminate.search(index, phrases, slack).collect()}
        for doc, text in given:
            w, want, covered = decontaminate.words((text or "").encode()), set(), set()
            for item, phrase in phrases:
                for at in (k for k, x in enumerate(w) if x == phrase[0]):
                    if found := ends(w, phrase, at, slack):
                        want.add((item, at, max(found) - at + 1))
                        covered |= set(range(at, max(found) + 1))
            assert {(s["item"], s.start, s.length) for s in got[doc].spans} == want
            assert got[doc].n_hit == len(covered) and got[doc]["items"] == sorted({i for i, *_ in want})


def test_null_item_ids_own_nothing(spark):
    docs = spark.createDataFrame([(1, "two words here"), (2, "three more")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two words"), ("x", "two words"), (None, "more")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (2, ["x"]), 2: (1, [])}


def test_item_blocks_agree(spark):
    docs, items = rows.table(spark, DATA, "documents"), rows.table(spark, DATA, "benchmark")
    def found(**kw):
        return sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, items, **kw).collect())
    assert found() == found(block_bytes=3000)


def _words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split()


def _components(documents, width, share):
    sets = {}
    for i, t in documents:
        w = _words(t)
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and both >= share * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                p, q = sorted((root(a), root(b)))
                low[q] = p
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("width,fraction", [(5, (4, 5)), (3, (17, 20))])
def test_near_duplicates(spark, documents, width, fraction):
    given = spark.createDataFrame(documents, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near.near_duplicates(given, width=width, similarity=fraction).collect()}
    assert got == _components(documents, width, fraction[0] / fraction[1])


def test_large_near_copy_group(spark):
    """A base text with some words changed: links are many, thin out, and run across blocks."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(80)]
    given = [(k, " ".join(rng.choice("xyz") + str(rng.random()) if rng.random() < 0.003 * (k % 12) else w for w in base)) for k in range(700)]
    got = {r.doc_id: r.component_id for r in near.near_duplicates(spark.createDataFrame(given, "doc_id long, text string"), width=3, similarity=(17, 20)).collect()}
    assert got == _components(given, 3, 0.85)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000 + rng.randrange(50), 1000 + rng.randrange(50)) for _ in range(60)] + [(5000, k) for k in range(5001, 5100)]
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert got == {k: v for k, v in low.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_block_names(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(0, 200))) for _ in range(300)]
    texts += texts[:100] + [texts[5] + " "]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = [naming.normalised(t.encode()).decode() for t in texts]
    first = {}
    for i, t in enumerate(plain):
        first.setdefault(t, i)
    for r in naming.exact_duplicates(given, block_bytes=7).collect():
        t = plain[r.doc_id]
        assert r.keep_id == first[t] and r.group_size == plain.count(t) and r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_chat_round_trip_and_rewriting_templates(spark):
    said = ["<|im_end|>", "<\\|im_start|>x", "<", "|im_end|>", "", "<<|im_|im_", "\\<|im_end|>\n", "é😀"]
    turns = [("user" if k % 2 else "assistant\n\\n", t) for k, t in enumerate(said)]
    out = chat.marked_turns(turns)
    assert out.count(chat.START) == out.count(chat.END) == len(turns)
    at, back = 0, []
    while at < len(out):
        role, text, _, stop = chat.read_turn(out[at:])
        back.append((role, text))
        at += stop + len(chat.END) + 1
    assert back == turns

    def forgetful(turns):  # shows only the last answer in full
        return "".join(f"{r}:{t if k == len(turns) - 1 else '...'};" for k, (r, t) in enumerate(turns))

    given = spark.createDataFrame([(1, k, "user", f"said {k}") for k in range(5)], "conv_id long, turn long, role string, text string")
    assert [r.rewrites for r in chat.format_turns(given, forgetful).collect()] == [False] + [True] * 4
    long = spark.createDataFrame([(1, k, "user", f"said {k}") for k in range(200)], given.schema)
    spans = chat.format_turns(long, keep=4).collect()
    assert "".join(r.span for r in spans) == chat.marked_turns([("user", f"said {k}") for k in range(200)]) and not any(r.rewrites for r in spans)


def test_templates_that_drop_turns_of_long_conversations(spark):
    def latest(turns):  # sums up what is older once there are more than 70 turns
        return "".join(f"{t};" for t in (["..."] + [t for _, t in turns[-35:]] if len(turns) > 70 else [t for _, t in turns]))

    given = spark.createDataFrame([(1, k, "user", f"said {k}") for k in range(200)], "conv_id long, turn long, role string, text string")
    assert [r.rewrites for r in chat.format_turns(given, latest).collect()] == [False] * 70 + [True] * 130
    numbered = chat.format_turns(given, lambda turns: "".join(f"{k}: {t};" for k, (_, t) in enumerate(turns))).collect()
    assert [r.span for r in numbered] == [f"{k}: said {k};" for k in range(200)] and not any(r.rewrites for r in numbered)
    whole, window = (chat.format_turns(given, keep=keep).collect() for keep in (None, 32))
    assert whole == window


def test_backoff_by_hand(spark):
    given = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r.log_score for r in backoff.backoff_scores(given, slab_words=4).collect()}
    assert got[1] == pytest.approx(np.log(3 / 9) + np.log(3 / 3) + np.log(2 / 3))
    assert got[2] == pytest.approx(np.log(3 / 9) + np.log(3 / 3) + np.log(0.4 * 0.4 * 1 / 9))


def test_licences(spark):
    files = [("r/LICENSE", licenses.TEMPLATES[1][1]), ("r/a.py", "# nothing"), ("r/sub/deep/b.py", "# nothing"), ("r/sub/COPYING", "All rights reserved."),
             ("q/c.py", "x = 1\n# Licensed under the Apache License, Version 2.0.\n"), ("q/d.py", "x"), (None, "All rights reserved."), ("LICENSE.txt", None)]
    got = {r.path: (r.license, r.origin) for r in licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"r/LICENSE": ("MIT", "file"), "r/a.py": ("MIT", "inherited"), "r/sub/deep/b.py": ("All-rights-reserved", "inherited"),
                   "r/sub/COPYING": ("All-rights-reserved", "file"), "q/c.py": ("Apache-2.0", "header"), "q/d.py": (None, None),
                   None: ("All-rights-reserved", "header"), "LICENSE.txt": (None, None)}


def test_licence_files_are_compared_line_by_line_too(spark):
    said = "x = 1\nAll rights reserved.\nwe went home over the hill and found that the old dog had eaten every cake"
    files = [("r/LICENSE", said), ("r/a.py", "nothing"), ("q/a.py", said), ("p/COPYING", licenses.TEMPLATES[1][1].replace(", ", ",\n"))]
    given = spark.createDataFrame(files, "path string, text string")
    got = {r.path: (r.license, r.origin) for r in licenses.scan_licenses(given).collect()}
    assert got == {"r/LICENSE": ("All-rights-reserved", "file"), "r/a.py": ("All-rights-reserved", "inherited"),
                   "q/a.py": ("All-rights-reserved", "header"), "p/COPYING": ("MIT", "file")}


def test_short_notices_are_compared_line_by_line_too(spark, tmp_path):
    """A notice of two lines keeps its licence in the query, and hands it down, however short the text is."""
    given = [(1, "we went home over the hill and found the old dog\nAll rights reserved.", "en", "r"), (2, "nothing to say " * 40, "en", "r"), (3, "nothing", "de", "r"),
             (4, "nothing", "en", "q"), (5, "x\nLicensed under the Apache License, Version 2.0.\n" + "y " * 400, "en", "q")]
    spark.createDataFrame(given, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.path: (r.license, r.origin) for r in QUERIES["op4_license_scan"](spark, str(tmp_path)).collect()}
    assert got == {"r/1.txt": ("All-rights-reserved", "file"), "r/2.txt": ("All-rights-reserved", "inherited"), "r/de/3.txt": ("All-rights-reserved", "inherited"),
                   "q/4.txt": (None, None), "q/5.txt": ("Apache-2.0", "header")}


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    docs = rows.table(spark, DATA, "documents")
    bad = {r.doc_id for r in rows.table(spark, DATA, "labels").filter("quality = 0").collect()}
    docs = stages["quality classifier"](spark, docs, DATA).cache()
    assert len(bad & {r.doc_id for r in docs.collect()}) <= 0.1 * len(bad) + 1
    kept = stages["exact dedup"](spark, docs, DATA).cache()
    first = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        first.setdefault(naming.normalised(r.text.encode()), r.doc_id)
    assert {r.doc_id for r in kept.collect()} == set(first.values())
    apart = stages["near dedup"](spark, kept, DATA).cache()
    assert {r.doc_id for r in apart.collect()} == set(_components([(r.doc_id, r.text) for r in kept.collect()], 5, 0.8).values())
    items = [decontaminate.words(r.text.encode()) for r in rows.table(spark, DATA, "benchmark").collect()]
    windows = {tuple(w[k:k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def hit(text):
        w = decontaminate.words(text.encode())
        return any(tuple(w[k:k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    clear = stages["decontamination"](spark, apart, DATA).cache()
    assert {r.doc_id for r in clear.collect()} == {r.doc_id for r in apart.collect() if not hit(r.text)}
    packed = stages["packing"](spark, clear, DATA)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clear.collect()}
    assert corpus_pipeline.run(spark, DATA).count() == packed.count()
