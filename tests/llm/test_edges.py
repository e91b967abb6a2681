"""Every operator and every stage on the awkward table and on an empty one."""

import awkward
import pytest

import corpus_pipeline
from gridleaf.llm import batches, langid, lempel, licences, mixing, packing, prefixes, rules, simhash, toxicity
from gridleaf.llm.queries import tokenizer

LABELS = "doc_id bigint, toxic int"
WORK = {
    "simhash": simhash.near_duplicates,
    "prefixes": prefixes.fingerprinted,
    "lempel": lempel.deduplicated,
    "packing": lambda d: packing.pack_documents(d, tokenizer()),
    "langid": langid.identify,
    "rules": rules.rule_ledger,
    "mixing": lambda d: mixing.mix(d, [3, 1, 2]),
    "toxicity": lambda d: toxicity.scored(d, d.sparkSession.createDataFrame([(1, 1), (2, 0), (6, None), (None, 1)], LABELS)),
}


@pytest.mark.parametrize("name", list(WORK))
def test_rows(spark, name):
    out = WORK[name](awkward.table(spark))
    ids = sorted((r.doc_id for r in out.select("doc_id").collect()), key=str)
    assert set(ids) == {r[0] for r in awkward.rows()}
    if name != "packing":
        assert ids == sorted((r[0] for r in awkward.rows()), key=str)


@pytest.mark.parametrize("name", list(WORK))
def test_empty(spark, name):
    assert WORK[name](awkward.empty(spark)).count() == 0


def test_scan(spark):
    assert licences.scan(awkward.table(spark)).count() == licences.scan(awkward.empty(spark)).count() == 0


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "pack"], ids=lambda s: s[0])
def test_stages(spark, stage):
    docs = awkward.table(spark)
    out = stage[1](spark, docs, "")
    assert out.columns == docs.columns and out.count() > 0
    assert {tuple(r) for r in out.select("key", "found", "order", "row", "part", "n", "_name").collect()} == {("k", 5, 6, 7, 8, 9, "x")}
    assert stage[1](spark, awkward.empty(spark), "").count() == 0


def test_near_dedup_keeps_one(spark):
    """One row of each group, whatever the ids: all texts of the awkward table that no other is near to stay."""
    out = simhash.one_of_each(awkward.table(spark)).collect()
    kept = [(r.doc_id, r.text) for r in out]
    assert len(kept) == len(set(kept)) and (awkward.BIG, "tie tie tie tie") in kept and (awkward.BIG + 1, "tie tie tie tie") not in kept
    assert (7, "same id, other text") in kept and any(i == 7 and t.startswith("other") for i, t in kept)


def test_near_dedup_of_shared_and_null_ids(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "one two three four five"), (None, "alpha beta gamma delta"), (None, "lone words of no name"), (None, "lone words of no name"), (2, "one two three four five")]
    for part in (1, 4):
        out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(part)).collect()
        assert sorted(map(tuple, out), key=repr) == sorted([rows[0], rows[1], rows[3]], key=repr)


def test_mix_keeps_columns_of_any_name(spark):
    rows = [(i, "some words of a text", "a", "keepme", 7, 8, 9, "x") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _mix_name string, _mix_copies int, copies int, `part` int, `row` string")
    out = mixing.mixed(docs, [1])
    assert out.columns == docs.columns and {tuple(r)[3:] for r in out.collect()} == {("keepme", 7, 8, 9, "x")}


def test_work_folder_must_be_shared(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        batches.work_folder(Session(), "x")
