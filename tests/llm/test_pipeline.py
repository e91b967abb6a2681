"""The pipeline's stages on the smallest scale, each against plain Python on its own input."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest import DATA
from test_brute_force import slow_components, slow_fingerprint, slow_targets

import corpus_pipeline
from gridleaf.llm.queries import tokenizer
from gridleaf.llm.tokens import encoder


def slow_kept(table, window=50):
    """Texts without the words that a repeated window covers; texts that lose nothing stay as they are."""
    first, out = {}, {}
    for i, t in table:
        w = t.encode().split()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    for i, t in table:
        w = t.encode().split()
        gone = {p for s in range(len(w) - window + 1) if first[tuple(w[s : s + window])] < i for p in range(s, s + window)}
        out[i] = b" ".join(x for p, x in enumerate(w) if p not in gone).decode() if gone else t
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        held[name] = docs.collect()
        assert name == "pack" or docs.columns == columns
    start = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    kept = {r.doc_id: r for r in held["language"]}
    assert all(kept[i] == start[i] for i in kept) and len(kept) >= 0.99 * len(start)

    prints = {i: slow_fingerprint(r.text) for i, r in kept.items()}
    near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    names = slow_components(near, prints)
    unique = {r.doc_id: r for r in held["near_dedup"]}
    assert len(held["near_dedup"]) == len(unique) and set(unique) == set(names.values()) and all(unique[i] == kept[i] for i in unique)

    want = slow_kept([(i, r.text) for i, r in unique.items()])
    cut = {r.doc_id: r for r in held["substring_dedup"]}
    assert {i: r.text for i, r in cut.items()} == want and all(r.n_chars == (len(r.text) if r.text != unique[i].text else unique[i].n_chars) for i, r in cut.items())

    sizes, taken, copies = Counter(), Counter(), defaultdict(list)
    for r in cut.values():
        sizes[r.source] += len(r.text.encode().split())
    for r in held["mix"]:
        taken[r.source] += len(r.text.encode().split())
        copies[r.doc_id].append(r.text)
    goal = slow_targets(sizes, [3, 1, 2], 1.5, 2)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    for i, texts in copies.items():
        words = cut[i].text.encode().split()
        parts = [t for t in texts if t != cut[i].text]
        assert len(parts) <= 1 and all(t.encode().split() == words[: len(t.encode().split())] for t in parts)
        assert sum(len(t.encode().split()) for t in texts) <= 2 * len(words)

    whole = encoder(tokenizer()).whole
    tokens = Counter()
    for r in held["mix"]:
        tokens[r.doc_id] += len(whole.encode(r.text, add_special_tokens=False).ids) + 1
    packed, sequences = Counter(), defaultdict(list)
    for p in held["pack"]:
        packed[p.doc_id] += p.length
        sequences[p.sequence_id].append(p)
    assert packed == tokens
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [0, *np.cumsum([p.length for p in s])[:-1]] and sum(p.length for p in s) <= 2048
    alone = {i: t[0] for i, t in copies.items() if len(t) == 1}
    for p in held["pack"]:
        if p.doc_id in alone:
            ids = whole.encode(alone[p.doc_id], add_special_tokens=False).ids + [1]
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
