"""Operators beyond SQL against plain, slow versions."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import awkward
import numpy as np
import pytest
import xxhash
from conftest import DATA

from gridleaf.llm import chat, components, langid, lempel, licences, mixing, packing, prefixes, rules, simhash, toxicity, words
from gridleaf.llm.queries import QUERIES, tokenizer
from gridleaf.llm.tokens import encoder


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


# --- simhash ---------------------------------------------------------------


def slow_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op1_simhash_trees"](spark, DATA).collect()}
    want = {i: slow_fingerprint(t) for i, t in docs}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
    near = [(a, b) for a in want for b in want if a < b and (want[a] ^ want[b]).bit_count() <= 3]
    assert {i: r.component_id for i, r in got.items()} == slow_components(near, want)


@pytest.mark.parametrize("seed", range(3))
def test_forest_finds_all_pairs(seed):
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    bits = np.unique([centre[i % 4] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 1 + i % 4, dtype=np.uint64)) for i in range(300)])
    groups = np.sort(rng.integers(0, 3, len(bits)))
    forest = simhash.Forest(groups, bits)
    got = {(int(b), int(a)) for q, n in forest.near(3) for a, b in zip(q, n)}
    want = {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if groups[i] == groups[j] and int(bits[i] ^ bits[j]).bit_count() <= 3}
    assert got == want


def test_links_with_small_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    random.seed(4)
    fps = set()
    for _ in range(6):
        c = random.getrandbits(63)
        for _ in range(25):
            c ^= (1 << random.randrange(63)) | (1 << random.randrange(63))
            fps.add(c)
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))
    got = {r.node: r.root for r in components.components(edges).collect()}
    want = slow_components([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3], fps)
    assert {f: got.get(f, f) for f in fps} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 3), (9, 7), (200, 150)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = slow_components(edges, {x for e in edges for x in e})
    assert got == {n: r for n, r in want.items() if n != r}


# --- prefix hashes ---------------------------------------------------------


def test_spans_and_extensions():
    a, b = prefixes.Prefix(prefixes.code_points("xxabcdefgh😀zz")), prefixes.Prefix(prefixes.code_points("abcdefgh😀qq"))
    assert a.span(2, 11) == b.span(0, 9) and a.span(2, 12) != b.span(0, 10)
    assert prefixes.common_extension(a, 2, b, 0) == 9 and prefixes.common_extension(a, 0, b, 0) == 0


def test_prefix_fingerprints(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op2_prefix_fingerprints"](spark, DATA).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + following[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prefixes.fingerprint(t), prefixes.fingerprint(edited))
        assert r.near_next == prefixes.likeness(r.fingerprint, got[docs[(k + 1) % len(docs)][0]].fingerprint)
        assert (r.prefix_edited, r.prefix_next) == tuple(len(os.path.commonprefix([t, x])) for x in (edited, following))
    assert np.mean([r.near_edited for r in got.values()]) > 0.7 and np.mean([r.near_next for r in got.values()]) < 0.1


def test_ranges_keep_neighbours(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "RANGE_ROWS", 3)
    out = prefixes.fingerprinted(awkward.table(spark)).collect()
    assert len(out) == len(awkward.rows())
    assert {r.near_next for r in out if r.doc_id == awkward.BIG} == {1.0}  # an equal text follows


# --- substring deduplication -----------------------------------------------


def slow_removed(table, window):
    first = {}
    for i, t in table:
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in table:
        w = (t or "").encode().split()
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    return sorted(out)


def test_lempel_on_few_letters(spark):
    random.seed(1)
    table = [(i, " ".join(random.choice("abc") for _ in range(random.randrange(0, 90)))) for i in range(60)] + [(70 + i, "z " * (20 * i)) for i in range(8)]
    long = [(i, " ".join(random.choice("ab") * random.randrange(1, 3) for _ in range(random.randrange(40, 200)))) for i in range(100, 130)]
    base = long[0][1].split()
    long += [(140 + i, " ".join(base[i : i + 70] + ["q"] + base[:55])) for i in range(5)]
    table += long
    got = lempel.deduplicated(spark.createDataFrame(table, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == slow_removed(table, 50) and any(r[2] for r in slow_removed(table, 50))


def test_lempel_awkward(spark):
    table = [(r[0] if r[0] is not None else 1 << 62, r[1]) for r in awkward.rows()]
    got = [(r[0] if r[0] is not None else 1 << 62, *r[1:]) for r in lempel.deduplicated(awkward.table(spark)).collect()]
    assert sorted(got) == slow_removed(table, 50)


# --- packing ---------------------------------------------------------------


def check_packing(pieces, texts, size):
    encode = encoder(tokenizer()).whole
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        by_doc[p.doc_id].append(p)
    for held in sequences.values():
        end = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == end and p.length > 0
            end += p.length
        assert end <= size
    for doc_id, text in texts:
        ids = encode.encode(text or "", add_special_tokens=False).ids + [1]
        end = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == end and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[end : end + p.length], "<u4").tobytes())
            end += p.length
        assert end == len(ids)
    return sum(0 if (n := sum(p.length for p in s)).bit_count() == 1 else size - n for s in sequences.values())


def test_packing(spark, docs):
    pieces = QUERIES["op4_vector_packing"](spark, DATA).collect()
    padding = check_packing(pieces, docs, 2048)
    assert padding < 0.01 * sum(p.length for p in pieces)


def test_packing_small_limits(spark):
    texts = [(i, "word " * (i * 7 % 40)) for i in range(80)]
    limits = packing.Limits(tokens=32, segments=5, loss=24, pool=10, least=2)
    pieces = packing.pack_documents(spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1), tokenizer(), limits).collect()
    check_packing(pieces, texts, 24)
    assert max(Counter(p.sequence_id for p in pieces).values()) <= 5


def test_examples_stay_whole(spark):
    rows = [(i, 10 + i % 90, (i * 13) % 60) for i in range(300)] + [(999, 5000, 1), (1000, None, None)]
    limits = packing.Limits(tokens=256, segments=6, loss=100, pool=40)
    out = packing.pack_examples(spark.createDataFrame(rows, "id bigint, t int, l int"), limits, "id", "t", "l").collect()
    assert sorted(r.id for r in out) == sorted(r[0] for r in rows)
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append(r)
    assert [r.id for r in held.pop(None)] == [999]
    for s in held.values():
        assert sum(r.tokens for r in s) <= 256 and sum(r.loss for r in s) <= 100 and len(s) <= 6
        assert sorted(r.segment for r in s) == list(range(len(s)))


def test_token_ids(docs):
    e = encoder(tokenizer())
    odd = ["", " ", "It's DON'T 12 a1 <|endoftext|> x", "ΣΑΣ é ́x ½ ²x 漢字 a\x1cb a\x85b İ ǅ", "a​b ﻿😀 foo_bar __"]
    for t in odd + [t for _, t in docs]:
        assert list(np.frombuffer(e.ids(t), "<u4")) == e.whole.encode(t, add_special_tokens=False).ids


# --- language --------------------------------------------------------------


def test_language(spark):
    sf = DATA.replace("0.001", "0.01")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in QUERIES["op5_centroid_language"](spark, sf).collect()]
    held = [r for r in out if r.held_out]
    assert {r.held_out for r in out} == {True, False} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.accepted for r in out]) > 0.995 and all(0 <= r.score <= 1 for r in out)


def test_language_rejects_the_unknown(spark):
    base = [(i, f"the wonderful house {i} stands near another street where people walk and talk about weather " * 2, "en") for i in range(200)]
    base += [(1000 + i, f"das wunderbare Haus {i} steht neben einer anderen Strasse wo Leute gehen und reden " * 2, "de") for i in range(200)]
    docs = spark.createDataFrame(base, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, langid.remainder(docs.doc_id) != 0)
    probe = [(1, base[0][1]), (2, base[-1][1]), (3, "xqzv qzxw vvxq zzqx wqxz " * 8), (4, None), (5, "123 !!")]
    out = {r.doc_id: r for r in langid.predict(spark.createDataFrame(probe, "doc_id bigint, text string"), model).collect()}
    assert (out[1].lang_pred, out[1].accepted, out[2].lang_pred, out[2].accepted) == ("en", True, "de", True)
    assert not out[3].accepted and (out[4].lang_pred, out[5].lang_pred, out[4].score) == ("und", "und", 0.0)


# --- rules, chat, licences -------------------------------------------------


def test_repeated_words():
    w = b"a b c d e f g h".split()
    assert words.repeated_words(w * 2, 8) == 16 and words.repeated_words(w + [b"x"] + w, 8) == 16 and words.repeated_words(w, 8) == 0
    assert words.repeated_words([b"a"] * 30, 8) == 30 and words.repeated_words([], 8) == 0


def test_window_hashes():
    h = np.arange(1, 200, dtype=np.uint64) * np.uint64(7919)
    for size in (1, 2, 3, 5, 18, 50):
        want = []
        for i in range(len(h) - size + 1):
            v = 0
            for x in h[i : i + size].tolist():
                v = (v * int(words.BASE) + x) % (1 << 64)
            want.append(v)
        assert np.array_equal(words.window_hashes(h, size), words.mix(np.array(want, np.uint64)))


def test_ablations_count_masks(spark):
    book = spark.createDataFrame([(1,), (3,), (0,), (4,), (4,)], "failed bigint")
    got = {(r.policy, r.rule): (r.removed, r.removed_only_by) for r in rules.ablations(book).collect()}
    assert got["base", "few_words"] == (2, 1) and got["v1", "many_symbols"] == (2, 2) and got["base", "repeated_windows"] == (1, 0)


def test_templates():
    make = chat.compile_template("{% if 1 == 1 %}[{{ 'a' + 'b' | upper }}]{% endif %}{% for turn in turns %}{{ turn.index }}{% generation %}{{ turn.text }}{% endgeneration %};{% endfor %}")
    assert list(make([chat.Turn("user", "hi")])) == [("[aB]", False), ("0", False), ("hi", True), (";", False)]
    assert chat.fold(chat.parse("{% if false %}x{% elif true %}y{% else %}z{% endif %}")).parts[0].parts == ["y"]
    for bad in ("{{ turn.__class__ }}", "{{ open('x') }}", "{% for x in y %}{% endfor %}", "{% if 1 %}", "{{ 1 | system }}", "{% include 'x' %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


@pytest.mark.parametrize("seed", range(5))
def test_chat_round_trip(seed):
    random.seed(seed)
    parts = ["\\", "<turn>", "</turn>", "\n", "n", "a", "<", "</turn>\n", "é", "assistant"]
    turns = [chat.Turn("".join(random.choices(parts, k=3)), "".join(random.choices(parts, k=12))) for _ in range(40)]
    reader = chat.Reader()
    assert [x for t, _ in chat.compile_template(chat.TEMPLATE)(turns) for x in reader.feed(t)] == [(t.role, t.text) for t in turns]


def test_chat_awkward(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (None, 1, "user", ""), (2, 5, "assistant", "</turn>")]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, part string")
    got = {r.conv_id: r for r in chat.digests(table).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 2 and got[None].n_turns == 1 and got[2].loss_chars == 7
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nfirst\n\n\nassistant\nx\nassistant\nx\n").hexdigest()
    assert chat.digests(table.limit(0)).count() == 0 and chat.formatted(table).count() > 6


def test_licences_find_near_copies(monkeypatch):
    known = licences.classes(licences.TEMPLATES)
    text = licences.TEMPLATES["apache-2.0-terms"].replace("CONDITIONS", "TERMS")
    found = {m[0]: m for m in licences.matches((" ".join(["word"] * 333) + " " + text + " tail" * 50).encode(), known)}
    assert list(found) == ["apache-2.0-terms"] and 0.8 <= found["apache-2.0-terms"][1] < 1
    monkeypatch.setattr(licences, "PIECE", 64)  # the same across pieces
    assert [m[0] for m in licences.matches((" ".join(["word"] * 333) + " " + text + " tail" * 50).encode(), known)] == list(found)
    for c in known:
        m = min(map(len, c.sets))
        k = -(-4 * m // 5)
        assert (1 - k / (2 * c.size + m - k)) ** c.values.shape[1] <= licences.MISS
    with pytest.raises(ValueError):
        licences.classes({"short": "All rights reserved."})


# --- mixing ----------------------------------------------------------------


def slow_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, set(names)
    while True:
        rest = total - sum(out.values())
        over = {s for s in free if rest * weight[s] / sum(weight[f] for f in free) > most * sizes[s] + 1e-9}
        if not over:
            return {**out, **{s: rest * weight[s] / sum(weight[f] for f in free) for s in free}}
        for s in over:
            out[s] = most * sizes[s]
            free.discard(s)


@pytest.mark.parametrize("group", [4096, 5])
def test_mix(spark, monkeypatch, group):
    monkeypatch.setattr(mixing, "GROUP", group)
    monkeypatch.setattr(mixing, "FAN", 3)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = mixing.mix(docs, [3, 1, 2]).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = slow_targets(sizes, [3, 1, 2], 1.5, 2)
    assert len(out) == docs.count() and all(abs(target[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs.repartition(7), [3, 1, 2]).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    texts = mixing.mixed(docs, [3, 1, 2]).select("text").collect()
    assert sum(len((r.text or "").split()) for r in texts) == sum(taken.values())


def test_pivotal_keeps_sums_and_means():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 50, 40).astype(float)
    total = np.zeros(40)
    for _ in range(3000):
        p = mixing.pivotal(np.full(40, 0.3), size, rng.random(40))
        assert abs(p @ size - 0.3 * size.sum()) < 1e-6 and ((p > 0) & (p < 1)).sum() <= 1
        total += p
    assert np.abs(total / 3000 - 0.3).max() < 0.05


# --- toxicity --------------------------------------------------------------


def auc(y, s):
    order = np.argsort(np.argsort(s)) + 1
    p = sum(y)
    return (sum(o for o, v in zip(order, y) if v) - p * (p + 1) / 2) / (p * (len(y) - p))


def test_toxicity(spark):
    sf = DATA.replace("0.001", "0.1")
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = QUERIES["op10_toxic_neighbours"](spark, sf).collect()
    held = [r for r in out if r.held_out and r.doc_id in label]
    rng = np.random.default_rng(0)
    assert auc([label[r.doc_id] for r in held], [r.score + 1e-9 * rng.random() for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    brier = np.mean([(r.score - label[r.doc_id]) ** 2 for r in held])
    share = np.mean([label[r.doc_id] for r in held])
    print("brier", brier, "of", share * (1 - share), [(round(lo, 1), len(x), round(np.mean([r.score for r in x]), 3), round(np.mean([label[r.doc_id] for r in x]), 3)) for lo in np.arange(0, 1, 0.2) if (x := [r for r in held if lo <= r.score < lo + 0.2 or lo > 0.79 and r.score == 1])])
    assert brier < 0.5 * share * (1 - share)


@pytest.fixture(scope="module")
def toxic_index(spark):
    sf = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return toxicity.fit(docs, labels), [r.text for r in docs.where("doc_id % 3 = 0").select("text").collect()]


def test_block_max_is_exact(toxic_index):
    index, texts = toxic_index
    dense, held = np.zeros((len(index.names), len(index.idf))), index.postings
    dense[held.columns, np.repeat(np.arange(len(index.idf)), np.diff(held.starts))] = held.values
    for table, start in zip(index.tables, index.edges):
        dense[start : start + table.shape[1], np.flatnonzero(held.full >= 0)] = table.T
    assert np.allclose(np.linalg.norm(dense, axis=1), 1, atol=1e-5)
    for text in [*texts, "a", "", None]:
        rows, w = index.vector(text)
        query = np.zeros(len(index.idf))
        query[rows] = w
        cosines = dense @ query
        order = np.lexsort((np.arange(len(cosines)), -cosines))[: toxicity.NEAREST]
        order = order[cosines[order] > 5e-7]
        at, got = index.nearest([(rows, w)], toxicity.NEAREST)[0] if len(rows) else ([], [])
        assert np.allclose(got, cosines[order], atol=2e-6) and np.allclose(cosines[at], cosines[order], atol=2e-6)
        # the votes
        vote = index.votes[order] * cosines[order] ** 2
        want = (vote @ index.toxic[order] + toxicity.PRIOR * index.prior) / (vote.sum() + toxicity.PRIOR) if len(order) else index.prior
        assert abs(index.score([text])[0][0] - want) < 1e-3


def test_blocks_are_skipped(toxic_index):
    index, texts = toxic_index

    read = []

    class Table:
        def __init__(self, plain):
            self.plain = plain

        def __rmatmul__(self, queries):
            read.append(len(queries) * self.plain.shape[1])
            return queries @ self.plain

        __array_ufunc__ = None

    plain = index.tables
    index.tables = [Table(t) for t in plain]
    index.score(texts)
    every = len(texts) * len(index.names)
    index.tables = plain
    assert 0 < sum(read) < 0.8 * every
