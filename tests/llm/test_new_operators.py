"""Token alignment, the count-vector join and phrase mining against plain, slow versions."""

import bisect
import functools
import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import awkward
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import DATA
from test_brute_force import slow_components
from tokenizers import Tokenizer

from gridleaf.llm import alignment, bloom, counttree, phrases
from gridleaf.llm.queries import QUERIES
from gridleaf.llm.tokens import _visible_bytes

PATHS = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower(text):
    return (text or "").translate(str.maketrans(LETTERS, LETTERS.lower()))


# --- filters ---------------------------------------------------------------


@pytest.mark.parametrize("most", [19, 21, 28])
def test_filter_holds_what_it_was_given(spark, monkeypatch, most):
    monkeypatch.setattr(bloom, "MOST", most)
    rng = np.random.default_rng(1)
    values = rng.integers(-(1 << 63), 1 << 63, 300_000, dtype=np.int64)
    found = bloom.build(spark.createDataFrame([(int(v),) for v in values[:60_000]], "h bigint").repartition(5), 60_000)
    assert found.has(values[:60_000].view(np.uint64)).all() and len(found.bits) <= 1 << (most - 3)
    assert found.has(values[60_000:].view(np.uint64)).mean() < (0.05 if most > 19 else 0.2)
    assert not bloom.build(spark.createDataFrame([], "h bigint"), 0).has(values.view(np.uint64)).any()


# --- token alignment -------------------------------------------------------


@functools.cache
def tokenizers():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def slow_tokens(text):
    """(ids, bytes) of both sides, or None."""
    if not text:
        return None
    a, b = tokenizers()
    byte_of = {c: x for x, c in _visible_bytes().items()}
    left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else None


def slow_alignments(rows):
    known, links = {}, {}
    for text in {t for _, t in rows}:
        known[text] = slow_tokens(text)
        if known[text]:
            spans = []
            for side in known[text]:
                at, out = 0, []
                for i, x in side:
                    out.append((i, at, at + len(x)))
                    at += len(x)
                spans.append(out)
            owners = [[k for k, (_, p, q) in enumerate(side) for _ in range(q - p)] for side in spans]  # the token of each byte
            links[text] = [(spans[0][i][0], spans[1][j][0]) for i, j in dict.fromkeys(zip(*owners))]
            cuts = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
            member = [defaultdict(list), defaultdict(list)]
            for side, found in zip(spans, member):
                for i, _, q in side:
                    found[bisect.bisect_left(cuts, q)].append(str(i))
            groups = ["|".join(",".join(m[k]) for m in member) for k in range(len(cuts))]
            known[text] = (len(spans[0]), len(spans[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = Counter()
    for _, text in rows:
        count.update(set(links.get(text, [])))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for doc_id, text in rows:
        if not known[text]:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, digest = known[text]
        mine = links[text]
        out.append((doc_id, n_a, n_b, n_groups, len(mine), sum(count[p] == top[p[0]] for p in mine), sum(count[p] for p in mine), digest))
    return sorted(out, key=repr)


ODD = ["Hello  world\nfoo <s> x", "▁x y", "", None, " ", "  lead", "trail  ", "a\tb \n c", "It's 12,345 <|endoftext|> </s> <0x0A>", "漢字 😀 é́ x", "a\x85b \x1c c", "\x00 z", "naïve​ ok﻿", "x" * 300, "the cat", "the cat"]


@pytest.mark.parametrize("held", [1 << 22, 0])
def test_alignments(spark, monkeypatch, held):
    monkeypatch.setattr(alignment, "HELD", held)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 600").select("doc_id", "text").collect()][:60]
    rows += [(5000 + i, t) for i, t in enumerate(ODD)] + [(None, "the cat"), (5000, "the cat sat")]
    got = alignment.alignments(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), *PATHS)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_alignments(rows)


def test_units_are_independent():
    random.seed(3)
    it = alignment.Aligner(*PATHS)
    assert it.cuts
    parts = [" ", "  ", "\n", "\t", "the", "ing", ".", "'s", "é", "字", "<s>", "7", "　", "​", "A"]
    texts = ["".join(random.choices(parts, k=random.randrange(1, 30))) for _ in range(300)]
    for text, found in zip(texts, it.aligned(texts)):
        want = slow_alignments([(1, text)])[0]
        assert (want[1:5] if found else (0, 0, 0, 0)) == want[1:5]
        assert not found or (found.n_a, found.n_b, found.n_groups, len(found.links), hashlib.sha256(found.groups.encode()).hexdigest()) == (*want[1:5], want[7])


# --- Jaccard join ----------------------------------------------------------


def slow_set(text):
    w = lower(text).encode().split()
    return {b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def slow_jaccard(rows, percent=90):
    sets = [slow_set(t) for _, t in rows]
    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = slow_components(pairs, range(len(rows)))
    names = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[root[i]].append(doc_id)
    return sorted([(d, len(sets[i]), min(names[root[i]], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)], key=repr)


def near_rows(seed, n=260):
    """Families of texts that drift apart around the limit, short ones and copies too."""
    rng = random.Random(seed)
    rows, doc = [], 0
    for _ in range(14):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 2, 3, 5, 12, 19, 40, 90, 200, 420]))]
        for _ in range(n // 14):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8]) * len(words) // 100 + rng.randrange(2)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [f"x{rng.randrange(99)}"] * rng.randrange(2)
            rows.append((doc, " ".join(words)))
            doc += 1
            base = words if rng.random() < 0.3 and words else base
    return rows


@pytest.mark.parametrize("seed,percent", [(0, 90), (1, 90), (2, 70)])
def test_jaccard_components(spark, seed, percent):
    rows = near_rows(seed)
    got = counttree.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=percent)
    want = slow_jaccard(rows, percent)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len({w[2] for w in want}) < len(rows)


def test_jaccard_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(counttree, "CHUNK", 5)
    rows = near_rows(4, 200)
    got = counttree.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == slow_jaccard(rows)


def test_linked_sets_share_a_cell():
    rng = np.random.default_rng(0)
    for n in [1, 2, 3, 7, 9, 10, 11, 19, 20, 21, 60, 150, 700, 3000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            lost = rng.permutation(len(a))[: rng.integers(0, n // 9 + 1)]
            b = np.unique(np.r_[np.delete(a, lost), rng.integers(0, 1 << 63, int(rng.integers(0, n // 9 + 1)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)])
            if len(b) and counttree.linked(a, b):
                assert np.intersect1d(counttree.cells(a), counttree.cells(b)).size


def test_tree_finds_all_links():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 63, int(rng.integers(5, 400)), dtype=np.uint64)
        sets += [np.unique(np.r_[rng.permutation(base)[: len(base) - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for k in rng.integers(0, 1 + len(base) // 12, 12)]
    tree = counttree.CountTree(sets)
    everything = {tuple(sorted((int(tree.order[i]), int(tree.order[j])))) for a, b in tree.candidates(np.arange(len(sets))) for i, j in zip(a, b)}
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if counttree.linked(sets[i], sets[j])}
    assert want <= everything and len(everything) < 2500  # of 64 620
    assert slow_components(tree.links(), range(len(sets))) == slow_components(want, range(len(sets)))


# --- phrases ---------------------------------------------------------------


def slow_phrases(rows, least, top):
    import re

    f, total, first = defaultdict(Counter), Counter(), {}
    for doc_id, lang, text in rows:
        lang, at = lang or "und", 0
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    p = tuple(w[i : i + n])
                    f[lang][p] += 1
                    if doc_id is not None:
                        first[lang, p] = min(first.get((lang, p), (doc_id, at + i)), (doc_id, at + i))
            at += len(w)
    out = []
    for lang, count in f.items():
        often = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        inner = defaultdict(int)
        for p, a in often.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    inner[p[s : s + m]] = max(inner[p[s : s + m]], a)
        kept = []
        for p, a in often.items():
            if 100 * inner[p] < 80 * a or not inner[p]:
                score, _, l, r = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), l, r, first.get((lang, p))))
        out += [(lang, k + 1, p.decode(), -a, l, r, total[lang], -s, at) for k, (s, a, p, l, r, at) in enumerate(sorted(kept, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def found_phrases(spark, rows, least, top, schema="doc_id bigint, lang string, text string"):
    got = phrases.collocations(spark.createDataFrame(rows, schema).repartition(3), least, top).collect()
    return sorted([(*r[:-1], tuple(r["first"]) if r["first"] else None) for r in got], key=repr)


def phrase_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "new york", "a", "b", "É", "naïve", "x\ty", "state. of", "U,S", "I  am", "字"]
    rows = [(i, rng.choice(["en", "de", None]), rng.choice([" ", " ", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(120)]
    return rows + [(None, "xx", "null id " * 9), (3, "en", None), (4, "en", "of the  state\tof the art"), (4, "en", "of the  state\tof the art")]


def test_phrases(spark):
    rows = phrase_rows(0)
    assert found_phrases(spark, rows, 4, 50) == slow_phrases(rows, 4, 50)


def test_phrases_with_collisions_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BATCH", 300)
    monkeypatch.setattr(phrases, "WINDOW", 100)
    monkeypatch.setattr(phrases, "FOLD", 6)  # fingerprints of six bits: nearly all collide
    rows = phrase_rows(1)
    assert found_phrases(spark, rows, 5, 30) == slow_phrases(rows, 5, 30)


def test_large_products_are_exact(spark):
    big = 1 << 60
    row = spark.sql(f"select cast(2000000 as decimal(7,0)) * cast({big} as decimal(20,0)) div (cast({big + 5} as decimal(20,0)) + cast({big} as decimal(20,0))) as s").first()
    assert row.s == 2000000 * big // (2 * big + 5)


# --- awkward and empty -----------------------------------------------------

WORK = {"op11": lambda d: alignment.alignments(d, *PATHS), "op12": counttree.jaccard_components, "op13": lambda d: phrases.collocations(d, 2)}


@pytest.mark.parametrize("name", ["op11", "op12"])
def test_awkward(spark, name):
    rows = [(r[0], r[1]) for r in awkward.rows()]
    got = sorted(map(tuple, WORK[name](awkward.table(spark)).collect()), key=repr)
    assert got == (slow_alignments(rows) if name == "op11" else slow_jaccard(rows))


def test_awkward_phrases(spark):
    rows = [(r[0], r[2], r[1]) for r in awkward.rows()]
    got = phrases.collocations(awkward.table(spark), 3, 2000).collect()
    assert sorted([(*r[:-1], tuple(r["first"]) if r["first"] else None) for r in got], key=repr) == slow_phrases(rows, 3, 2000)


@pytest.mark.parametrize("name", list(WORK))
def test_empty(spark, name):
    assert WORK[name](awkward.empty(spark)).count() == 0


def test_queries(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, QUERIES["op12_count_rtree"](spark, DATA).collect()), key=repr)
    assert got == slow_jaccard(rows)
    assert QUERIES["op11_aligned_tokens"](spark, DATA).where("n_a > 0").count() > 0.95 * len(rows)
    assert QUERIES["op13_rabin_karp_phrases"](spark, DATA).count() > 0
