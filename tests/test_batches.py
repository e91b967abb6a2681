"""Files, jobs, presets, cache, chains, evaluation and pages on small fixtures."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from gridleaf.functions import text as T
from gridleaf.operators import chain, evaluate, files, grids, jobs, pages, store
from gridleaf.operators.scan import number_rows, running_total
from gridleaf.sources import inventory


def test_scans_split_groups(spark, monkeypatch):
    from gridleaf.operators import scan

    monkeypatch.setattr(scan, "CHUNK", 10)
    data = [("hot", i, i % 3) for i in range(500)] + [(None, i, 1) for i in range(20)]
    frame = spark.createDataFrame(data, "k string, seq long, v int")
    numbered = number_rows(frame.where("v > 0"), ["k"], [F.floor(F.col("seq") / 10)], ["seq"], "pos").collect()
    for key in ("hot", None):
        assert [r.pos for r in sorted((r for r in numbered if r.k == key), key=lambda r: r.seq)] == list(range(sum(d[0] == key and d[2] > 0 for d in data)))
    total = 0
    for r in sorted((r for r in running_total(frame, ["k"], "seq", "v", "t").collect() if r.k == "hot"), key=lambda r: r.seq):
        assert r.t == total
        total += r.v


def test_inventory_and_sinks(spark, folder):
    for path, body in {"a.pdf": "x", "sub/b.png": "y", "node_modules/c.txt": "z", "empty.txt": "", "sub/.hidden": "h"}.items():
        full = os.path.join(folder, "in", path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as handle:
            handle.write(body)
    root = f"file:{folder}/in"
    listed = files.file_inventory(inventory.list_folder(spark, f"{folder}/in"), root)
    assert [r.path.rsplit("/in/")[1] for r in listed.collect()] == ["a.pdf", "sub/b.png"]
    inventory.write_outputs(listed.select("path"), f"{folder}/out", "json")
    assert spark.read.json(f"{folder}/out").count() == 2


def test_names(spark):
    names = ["a.tar.gz", "noext", ".bashrc", "X.PDF", "dot."]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(files.extension(F.col("n")).alias("e")).collect()
    assert [r.e for r in got] == ["gz", "", "", "pdf", ""]
    hit = spark.range(1).select(files.sensitive_match(F.lit("My_Contract[1].pdf"), ["", "*.doc", "my_?ontract*", "*"])).first()[0]
    assert hit == "my_?ontract*"
    bracket = spark.range(1).select(files.sensitive_match(F.lit("a-b.txt"), ["a[!x]b.*"]), files.sensitive_match(F.lit("a-b.txt"), ["a[xy]b.*"])).first()
    assert list(bracket) == ["a[!x]b.*", None]


def test_resolve_names(spark):
    sources = ["/x/a.txt", "/y/a.txt", "/z/a.txt", "/x/b.txt", "/q/a.txt", "/x/a (3).txt"]
    frame = spark.createDataFrame([(p, i) for i, p in enumerate(sources)], "path string, seq long")
    there = spark.createDataFrame([("/o", "a", "txt"), ("/o", "a (2)", "txt"), ("/o", "a (5)", "txt")], "dir string, stem string, ext string")
    named = files.target_names(frame, F.lit("/o"))
    got = {r.path: r.output for r in files.resolve_names(named, there).collect()}
    assert len(set(got.values())) == len(sources)
    assert got["/x/a (3).txt"] == "/o/a (3).txt" and got["/x/b.txt"] == "/o/b.txt"
    assert [got[p] for p in ("/x/a.txt", "/y/a.txt", "/z/a.txt", "/q/a.txt")] == ["/o/a (4).txt", "/o/a (6).txt", "/o/a (7).txt", "/o/a (8).txt"]
    skipped = {r.path: r.status for r in files.resolve_names(named, there, "skip").collect()}
    assert skipped["/x/a.txt"] == "skipped" and skipped["/x/b.txt"] == "queued"


def test_trim_empty_over_stretches(spark, monkeypatch):
    """Blank rows at and over the borders of stretches, a wholly blank table, a null key, repeated cells, extra columns."""
    monkeypatch.setattr(grids, "CHUNK", 4)
    draw = random.Random(8)
    cells = [
        (case, r, c, draw.choice(["", " ", None, "x"]) if r % 7 < 4 and c != 2 and case != "blank" else "", r * 10 + c)
        for case in ("a", None, "blank") for r in range(30) for c in range(5)
    ]
    cells += [("a", 1, 1, "again", -1), ("a", 9, 4, "far", -2)]
    frame = spark.createDataFrame(cells, "image_id string, row int, col int, text string, __id int").repartition(3)
    want = []
    for case in ("a", None, "blank"):
        mine = [c for c in cells if c[0] == case]
        rows = sorted({c[1] for c in mine if (c[3] or "").strip()})
        cols = sorted({c[2] for c in mine if (c[3] or "").strip()})
        want += [(case, rows.index(c[1]), cols.index(c[2]), c[3], c[4]) for c in mine if c[1] in rows and c[2] in cols]
    got = grids.trim_empty(frame)
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert grids.trim_empty(frame.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [3, 65536])
def test_resolve_names_against_a_loop(spark, monkeypatch, chunk):
    """Families with gaps, runs over the borders of cells, own numbers, null folders, repeated rows."""
    monkeypatch.setattr(files, "CHUNK", chunk)
    draw = random.Random(5)
    stems = ["a", "b", "c (x)", "a (2)", "a (7)", "d (3)", "e"]
    named = [(draw.choice(["/o", None]), draw.choice(stems), "txt", seq) for seq in range(120)] + [("/o", "alone", "", 500)]
    taken = [(draw.choice(["/o", None]), f"{draw.choice('abdq')} ({draw.randrange(2, 40)})", "txt") for _ in range(90)]
    taken += [("/o", "a", "txt"), ("/o", "a", "txt")] + [("/o", f"e ({n})", "txt") for n in range(1, 30)] + [("/o", "e", "txt")]

    def used_by(rows, plain):
        for folder, stem, ext in rows:
            if plain:
                yield (folder, stem, ext, 1)
            hit = re.fullmatch(r"(.+) \((\d{1,9})\)", stem)
            if hit and int(hit[2]) >= 2:
                yield (folder, hit[1], ext, int(hit[2]))

    used = set(used_by(taken, True)) | set(used_by([r[:3] for r in named], False))
    want = {}
    for folder, stem, ext, seq in named:
        number = 1
        while (folder, stem, ext, number) in used:
            number += 1
        used.add((folder, stem, ext, number))
        want[seq] = number
    frame = spark.createDataFrame(named, "dir string, stem string, ext string, seq long").repartition(5)
    there = spark.createDataFrame(taken, "dir string, stem string, ext string")
    got = files.resolve_names(frame, there)
    assert got.columns == ["dir", "stem", "ext", "seq", "output", "status"]
    numbers = {}
    for row in got.collect():
        tail = f" ({want[row.seq]})" if want[row.seq] > 1 else ""
        numbers[row.seq] = row.output
        assert row.output == (None if row.dir is None else f"{row.dir}/{row.stem}{tail}" + (f".{row.ext}" if row.ext else ""))
    assert len(numbers) == len(named)
    assert files.resolve_names(frame.limit(0), there).count() == 0
    assert files.resolve_names(frame, there.limit(0)).count() == len(named)


def test_routes(spark):
    frame = spark.createDataFrame([("local", None, []), ("cloud", None, []), ("auto", "*x*", []), ("odd", None, ["none"])], "preference string, sensitive string, allowed array<string>")
    engines = [("l", True, True), ("c", False, True)]
    off = [(r.candidates, r.notes) for r in files.route_plan(frame, engines, False).collect()]
    assert off == [(["l"], []), (["l"], ["cloud disabled", "fell back to local"]), (["l"], ["sensitive name: *x*"]), ([], [])]
    on = [r.candidates for r in files.route_plan(frame, engines, True, fallback=False).collect()]
    assert on == [["l"], ["c"], ["l"], []]


def test_jobs(spark):
    tasks = spark.createDataFrame(
        [(1, "skipped", 0.0), (2, "failed", 0.0), (2, "running", 50.0), (3, "succeeded", 0.0), (3, "failed", 1.0)], "job_id int, status string, progress double"
    )
    got = {r.job_id: (r.status, r.error, r.progress) for r in jobs.job_status(jobs.job_rollup(tasks), F.col("job_id") > 99).collect()}
    assert got == {1: ("succeeded", None, 100.0), 2: ("failed", "all files failed", 75.0), 3: ("succeeded", "1 files failed", 100.0)}
    assert not any(r.passed for r in jobs.strict_success(tasks).collect())
    tried = spark.createDataFrame([(1, 0, "a", False, "e0"), (1, 1, "b", True, None), (2, 0, "a", False, "e1"), (2, 1, "b", False, "e2")], "file_id int, ord int, engine string, ok boolean, error string")
    out = {r.file_id: (r.engine, r.notes, r.error) for r in jobs.first_success(tried).collect()}
    assert out == {1: ("b", "a failed (e0)", None), 2: (None, "a failed (e1)", "e2")}


def test_isolated_rows(spark):
    def work(record):
        return str(10 // record["n"])

    got = {r.n: (r.result, r.status, r.error) for r in jobs.run_isolated(spark.createDataFrame([(2,), (0,)], "n int"), work).collect()}
    assert got[2] == ("5", "succeeded", None) and got[0][1] == "failed" and "ZeroDivisionError" in got[0][2]


def test_store(spark):
    changes = spark.createDataFrame(
        [("a", " x ", "1", 1, "i1"), ("a", "x", "2", 2, "i2"), ("a", " ", "3", 3, "i3"), ("a", "y" * 41, "4", 4, "i4")], "action string, name string, params string, updated int, new_id string"
    )
    assert [tuple(r) for r in store.save_presets(changes).collect()] == [("a", "x", "i1", "2", 1, 2)]
    cache = spark.createDataFrame([("k1", "v1", 1, 0, None), ("k2", "v2", 2, 5, 9)], "key string, value string, created long, hits long, last_hit long")
    asked = spark.createDataFrame([(1, "k1", 7), (2, "k1", 8), (3, "zz", 9)], "request_id int, key string, at long")
    assert {(r.key, r.hits, r.last_hit) for r in store.cache_touch(cache, asked).collect()} == {("k1", 2, 8), ("k2", 5, 9)}
    assert [r.key for r in store.cache_misses(asked, cache).collect()] == ["zz"]
    put = store.cache_put(cache, spark.createDataFrame([("k1", "new", 5), ("k3", "v3", 6), ("big", "x" * 4_000_001, 7)], "key string, value string, created long"))
    assert {(r.key, r.value, r.created, r.hits) for r in put.collect()} == {("k1", "new", 1, 0), ("k2", "v2", 2, 5), ("k3", "v3", 6, 0)}
    assert [r.key for r in store.cache_evict(cache, 1).collect()] == ["k2"]
    old = spark.createDataFrame([(1, "n1", "s1"), (2, "n2", "s2")], "id int, name string, status string")
    new = spark.createDataFrame([(2, "other", None), (3, "n3", "s3")], "id int, name string, status string")
    assert {tuple(r) for r in jobs.upsert(old, new, "id", ["status"]).collect()} == {(1, "n1", "s1"), (2, "n2", None), (3, "n3", "s3")}
    maps = spark.range(1).select(store.merge_params(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m"))
    assert maps.first()["m"] == {"a": "1", "b": "3"}


def test_chain_check_agrees_with_its_data_form(spark):
    chains = [[], ["pdf.rotate"] * 13, ["pdf.rotate", "pdf.info"], ["nope"], ["pipeline"], ["pdf.merge"], ["pdf.to_word", "pdf.rotate"], ["image.ocr"]]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(chains)], "i int, steps array<string>")
    got = {r.i: r.error for r in chain.validate_chain(frame, F.lit("pdf"), F.col("steps")).collect()}
    assert got == {i: chain.check_steps("pdf", c) for i, c in enumerate(chains)}
    assert got[2] is None and got[6] == "step 2 pdf.rotate: does not accept .docx"


def test_evaluation(spark):
    want = [(1, 0, 0, "1,250"), (1, 0, 1, "abc"), (1, 1, 0, "18.50"), (1, 1, 1, "5%")]
    got = [(1, 0, 0, "1250", "#,##0"), (1, 0, 1, "", ""), (1, 1, 0, "18.5", "0"), (1, 1, 1, "zzz", ""), (1, 2, 2, "more", "")]
    expected = spark.createDataFrame(want, "case_id int, row int, col int, text string")
    actual = spark.createDataFrame(got, "case_id int, row int, col int, value string, fmt string")
    r = evaluate.compare_grids(expected, actual).first()
    assert (r.matched, r.exact, r.total, r.missing, r.wrong, r.extra_rows, r.extra_cols) == (2, 1, 4, 1, 1, 1, 1)
    top = {(t.verdict, t.row, t.col) for t in evaluate.top_mismatches(expected, actual).collect()}
    assert top == {("missing", 0, 1), ("format", 1, 0), ("wrong", 1, 1)}


def test_merge(spark):
    docs = spark.createDataFrame([(1, 10, 0, 2, False), (1, 11, 1, 3, True), (1, 12, 2, None, False), (1, 13, 3, 1, False), (2, 14, 0, 4, False)], "merge_id int, doc_id int, ord int, page_count int, encrypted boolean")
    marks = {r.doc_id: (r.first_page, r.skipped) for r in pages.merge_bookmarks(docs).collect()}
    assert marks == {10: (1, None), 11: (None, "encrypted"), 12: (None, "unreadable"), 13: (3, None), 14: (1, None)}
    assert {r.merge_id: r.error for r in pages.merge_status(docs).collect()} == {1: None, 2: "needs two documents"}
    leaves = spark.createDataFrame([(10, 1), (10, 2), (11, 1), (13, 1), (14, 1)], "doc_id int, page_no int")
    assert {(r.doc_id, r.page_no, r.merged_page) for r in pages.merge_docs(leaves, docs).collect()} == {(10, 1, 1), (10, 2, 2), (13, 1, 3)}


def test_content_key_ignores_the_name(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x")], "name string, body string").select(T.content_key(F.col("body"), "v1").alias("k")).distinct()
    assert rows.count() == 1
