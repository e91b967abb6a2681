"""Cases that an operator once did in part only."""

import zlib

import numpy as np

from pyspark.sql import functions as F

from gridleaf.llm import langid, licences, packing, toxicity
from gridleaf.llm.notices import WHOLE
from gridleaf.llm.queries import tokenizer


def test_short_notices_and_whole_texts(spark):
    words = WHOLE["mpl-2.0"].split()
    text = "start " + " ".join(words[: len(words) // 2] + ["changed"] + words[len(words) // 2 :])
    rows = [(1, "Copyright X. All rights reserved!"), (2, "all rights, ALL RIGHTS RESERVED; all rights reserved"), (3, "all rights"), (4, text), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in licences.scan(docs, {**licences.SHORT, **licences.TEMPLATES}).collect()}
    assert {r for r in got if r[0] < 4} == {(1, "all-rights-reserved", 1.0, 1, 2), (2, "all-rights-reserved", 1.0, 2, 2)}
    assert "mpl-2.0-text" in {r[1] for r in got if r[0] == 4}


def test_every_notice_finds_itself():
    known = licences.classes(licences.TEMPLATES)
    assert len(WHOLE) > 20
    for name, text in licences.TEMPLATES.items():
        assert name in {m[0] for m in licences.matches(f"before {text} after".encode(), known)}, name
    assert all(len(licences.plain_words(t.encode())) < licences.SHINGLE for t in licences.SHORT.values())


def test_few_toxic_examples_are_evidence(spark):
    """Wording of ten labelled documents is found again, and neighbours are exact over all grams."""
    held = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"zanzibar quixotic {'abcdefghij'[k % 10] * 6}" if k < 10 else f"peaceful meadow {'klmnopqrst'[k % 10] * 6}") for k, i in enumerate(held[:20])]
    labels = spark.createDataFrame([(i, int(k < 10)) for k, (i, _) in enumerate(rows)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows + [(1000, "such zanzibar"), (1001, "meadow green"), (1002, "12")], "doc_id bigint, text string")
    index = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert got[1000].score > 0.9 and got[1001].score < 0.1 and got[1000].evidence and not got[1002].evidence
    vectors = [index.vector(t) for _, t in sorted(rows)]
    assert all(len(v[0]) for v in vectors)
    for rows_, w in vectors:
        want = sorted((sum(float(x) * dict(zip(v[0].tolist(), v[1].tolist())).get(r, 0.0) for r, x in zip(rows_.tolist(), w.tolist())) for v in vectors), reverse=True)[:15]
        assert np.allclose(index.nearest(rows_, w, 15)[1], [x for x in want if x > 0], atol=1e-5)


def test_a_language_of_copies_is_learnt(spark):
    """A text with a great hash, repeated so often that a rate by rows leaves it out."""
    probe = spark.range(200).select(F.concat(F.lit("wuxo zibra kuloma "), F.col("id").cast("string")).alias("text"))
    place = F.xxhash64("text", F.lit(5)) / F.lit(2.0**64) + F.lit(0.5)
    text = probe.orderBy(F.desc(place)).first().text
    copies = spark.range(4000).select(F.lit(text).alias("text"), F.lit("xx").alias("lang"))
    other = spark.range(50).select(F.concat(F.lit("the house by the street "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert set(langid.fit(copies.unionByName(other), F.lit(True)).langs) == {"en", "xx"}


def test_short_pieces_wait_for_a_full_sequence(spark):
    docs = spark.createDataFrame([(i, None) for i in range(3000)], "doc_id bigint, text string").coalesce(1)
    held = packing.pack_documents(docs, tokenizer()).groupBy("sequence_id").count().collect()
    assert sorted(r["count"] for r in held)[-2:] == [1024, 1024] and sum(r["count"] for r in held) == 3000
