"""Scoring a rebuilt grid against the expected one, cell by cell.

Both grids meet on one exchange, by case and band of rows: runs of cells travel as one row, and a band's cells are put
together over whole Arrow batches. Verdicts and scores are native.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.cells import any_number, bare_text, display_matches, same_value
from ..functions.text import SPACE, normalize_text
from ..session import ship
from .images import numbers, starts_of, whole_groups

# --- fixed values ---------------------------------------------------------
TOP = 8
NO_SPACE = "[^" + SPACE[1:]
# --------------------------------------------------------------------------

SPOT = ["case_id", "row", "col"]
#: Rows of a band, cells and bytes of text of a run, runs and pairs that are worked on together.
BAND, CELLS, BYTES, RUNS, PAIRS = 256, 64, 4096, 8192, 262144


def _joined(texts: pa.Array, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts of each run put together, and the bytes of every text (null: -1)."""
    texts = texts.cast(pa.string())
    null = texts.is_null().to_numpy(zero_copy_only=False)
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    cuts = pa.py_buffer(ends[np.append(at, len(texts))].astype(np.int32))
    return pa.Array.from_buffers(pa.string(), len(at), [None, cuts, texts.buffers()[2] or pa.py_buffer(b"")]), np.where(null, -1, np.diff(ends)).astype(np.int32)


def _cut(texts: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The single texts again."""
    if not len(sizes):
        return pa.array([], pa.string())
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
    ends = pa.py_buffer((first + np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])).astype(np.int32))
    single = pa.Array.from_buffers(pa.string(), len(sizes), [None, ends, texts.buffers()[2] or pa.py_buffer(b"")])
    return pc.if_else(pa.array(sizes < 0), pa.scalar(None, pa.string()), single) if (sizes < 0).any() else single


def _col_type(cells: DataFrame) -> DataType:
    """The type of a single column number, which lists of texts may leave to their order."""
    if "col" not in cells.columns:
        return IntegerType()
    kind = cells.schema["col"].dataType
    return kind.elementType if isinstance(kind, ArrayType) else kind


def _flat(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Single cells of rows that hold theirs as lists; a row without lists has none."""
    lists = {n: c for n, c in zip(batch.schema.names, batch.columns) if n not in ("case_id", "row")}
    sizes = [pc.fill_null(c.value_lengths(), 0) for c in lists.values()]
    if not all(s.equals(sizes[0]) for s in sizes):
        raise ValueError("the lists of a row of cells differ in length")
    size = sizes[0].to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(batch.num_rows), size)
    single = {n: batch.column(n).take(pa.array(owner)) for n in ("case_id", "row")}
    single["col"] = pa.array((np.arange(len(owner)) - (np.cumsum(size) - size)[owner]).astype(np.int32))
    single |= {n: c.flatten() for n, c in lists.items()}
    return pa.RecordBatch.from_arrays(list(single.values()), names=list(single))


def _runs(cells: DataFrame, got: bool) -> DataFrame:
    """Cells that follow each other in one band of a case as one row; cells in no order make short runs, nothing more.

    Every column of single cells takes its time on the way to Python, so there are only those that the side has: ``fmt`` for ``got``.
    """
    lists = [StructField(f"{c}s", ArrayType(kind)) for c, kind in (("row", cells.schema["row"].dataType), ("col", _col_type(cells)))]
    texts = [StructField(f"{c}{end}", kind) for c in ("text", "fmt") for end, kind in (("", StringType()), ("_bytes", ArrayType(IntegerType())))]
    schema = StructType([cells.schema["case_id"], StructField("band", LongType()), StructField("got", BooleanType()), *lists, *texts])
    arrow = to_arrow_schema(schema)
    told, listed = ("text", "fmt") if got else ("text",), isinstance(cells.schema["text"].dataType, ArrayType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _flat(batch) if listed else batch
            if not batch.num_rows:
                continue
            band, place = numbers(batch, "row")[0] // BAND, np.arange(batch.num_rows)
            turns = np.union1d(starts_of(batch.column("case_id")), np.flatnonzero(np.diff(band, prepend=band[0] - 1)))
            whole = np.zeros(1, np.int64)
            size = sum(_joined(batch.column(c), whole)[1].clip(0).astype(np.int64) for c in told)
            before, since = np.cumsum(size) - size, np.repeat(turns, np.diff(np.append(turns, len(place))))
            for cut in ((place - since) // CELLS, (before - before[since]) // BYTES):
                turns = np.union1d(turns, np.flatnonzero(np.diff(cut, prepend=0)))
            ends = pa.array(np.append(turns, batch.num_rows).astype(np.int32))
            made = [batch.column("case_id").take(pa.array(turns)), pa.array(band[turns]), pa.array(np.full(len(turns), got))]
            made += [pa.ListArray.from_arrays(ends, batch.column(c)) for c in ("row", "col")]
            for c in told:
                texts, sizes = _joined(batch.column(c), turns)
                made += [texts, pa.ListArray.from_arrays(ends, pa.array(sizes))]
            made += [pa.nulls(len(turns), f.type) for f in list(arrow)[len(made) :]]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)

    return cells.mapInArrow(run, schema)


def _foreign(texts: pa.Array) -> pa.Array:
    """NFKC forms of the texts that are not ASCII, null for the others."""
    plain = pc.fill_null(pc.string_is_ascii(texts), True)
    if pc.all(plain).as_py() in (True, None):
        return pa.nulls(len(texts), pa.string())
    forms = [[None if p else unicodedata.normalize("NFKC", t) for t, p in zip(texts.slice(i, 64).to_pylist(), plain.slice(i, 64).to_pylist())] for i in range(0, len(texts), 64)]
    return pa.concat_arrays([pa.array(f, pa.string()) for f in forms])


def _keys(band: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """One number for each place of a band."""
    _, row = np.unique(row, return_inverse=True)
    _, col = np.unique(col, return_inverse=True)
    return (band * (row.max(initial=0) + 1) + row) * (col.max(initial=0) + 1) + col


def _meet(want: np.ndarray, got: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equal numbers on both sides, each with each, then those without a partner (-1); a number below 0 has none."""
    left, right = np.argsort(want, kind="stable"), np.argsort(got, kind="stable")
    sought, known = want[left], got[right]
    low = np.searchsorted(known, sought, "left")
    many = np.where(sought < 0, 0, np.searchsorted(known, sought, "right") - low)
    upto = np.cumsum(many)
    i = 0
    while i < len(left):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] - many[i] + PAIRS, "right")))
        n = many[i:j]
        yield np.repeat(left[i:j], n), right[np.repeat(low[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        i = j
    alone = left[many == 0]
    yield alone, np.full(len(alone), -1)
    alone = right[(known < 0) | (np.searchsorted(sought, known, "left") == np.searchsorted(sought, known, "right"))]
    yield np.full(len(alone), -1), alone


def _pairs(expected: DataFrame, actual: DataFrame, unicode_forms: bool, differ: bool = False) -> DataFrame:
    """A full outer join on ``case_id, row, col``: ``want, got, fmt``, the NFKC forms of what is not ASCII, and which sides there are.

    ``differ``: of these, only expected cells whose text is not the actual one.
    """
    want, got = (frame.select("case_id", "row", F.lit(None).cast(_col_type(frame)).alias("col")) for frame in (expected, actual))
    spot = want.join(got, SPOT, "full_outer").schema
    ship(expected.sparkSession)

    def placed(frame: DataFrame, **texts: str) -> DataFrame:
        lists = isinstance(frame.schema[texts["text"]].dataType, ArrayType)
        kinds = {"case_id": spot["case_id"].dataType, "row": spot["row"].dataType}
        cells = {**({"col": spot["col"].dataType} if "col" in frame.columns else {}), **dict.fromkeys(texts, StringType())}
        kinds |= {n: ArrayType(k) if lists else k for n, k in cells.items()}
        return frame.select(*[F.col(texts.get(n, n)).cast(k).alias(n) for n, k in kinds.items()])

    want, got = placed(expected, text="text"), placed(actual, text="value", fmt="fmt")
    both = _runs(want, False).unionByName(_runs(got, True)).repartition("case_id", "band").sortWithinPartitions("case_id", "band")
    texts = [StructField(c, StringType()) for c in ("want", "got", "fmt", "want_form", "got_form")]
    schema = StructType([*spot.fields, *texts, StructField("has_want", BooleanType()), StructField("has_got", BooleanType())])
    arrow = to_arrow_schema(schema)

    def sides(batch: pa.RecordBatch, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        band = np.repeat(np.arange(len(at)), np.diff(np.append(at, batch.num_rows)))
        right = batch.column("got").to_numpy(zero_copy_only=False)
        found = []
        for side in (~right, right):
            part = batch.filter(pa.array(side))
            count = part.column("rows").value_lengths().to_numpy(zero_copy_only=False)
            cells = pa.RecordBatch.from_arrays([part.column(c).flatten() for c in ("rows", "cols")], names=["row", "col"])
            cut = [_cut(part.column(c), part.column(f"{c}_bytes").flatten().to_numpy(zero_copy_only=False)) for c in ("text", "fmt")]
            form = _foreign(cut[0]) if unicode_forms else pa.nulls(len(cut[0]), pa.string())
            found.append((np.repeat(band[side], count), cells, *cut, form, pc.coalesce(form, cut[0], "") if differ else None))
        (wband, wcells, want, _, wform, wtext), (gband, gcells, got, fmt, gform, gtext) = found
        case = batch.column("case_id").take(pa.array(at))
        bands = np.concatenate([wband, gband])
        row, no_row = (np.concatenate(x) for x in zip(numbers(wcells, "row"), numbers(gcells, "row")))
        col, no_col = (np.concatenate(x) for x in zip(numbers(wcells, "col"), numbers(gcells, "col")))
        keys = np.where(no_row | no_col | case.is_null().to_numpy(zero_copy_only=False)[bands], -1, _keys(bands, row, col))
        places = [pa.concat_arrays([wcells.column(c), gcells.column(c)]) for c in ("row", "col")]
        for w, g in _meet(keys[: len(wband)], keys[len(wband) :]):
            if differ:
                w, g = w[w >= 0], g[w >= 0]
                other = pc.not_equal(wtext.take(pa.array(w)), pc.fill_null(gtext.take(pa.array(g, mask=g < 0)), "")).to_numpy(zero_copy_only=False)
                w, g = w[other], g[other]
            if not len(w):
                continue
            cell = np.where(w < 0, g + len(wband), w)
            of_want, of_got = pa.array(w, mask=w < 0), pa.array(g, mask=g < 0)
            made = [case.take(pa.array(bands[cell])), *[p.take(pa.array(cell)) for p in places]]
            made += [want.take(of_want), got.take(of_got), fmt.take(of_got), wform.take(of_want), gform.take(of_got), pa.array(w >= 0), pa.array(g >= 0)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at in whole_groups(batches, ["case_id", "band"], RUNS):
            yield from sides(batch, at)

    return both.mapInArrow(run, schema)


def paired_cells(expected: DataFrame, actual: DataFrame, unicode_forms: bool = True) -> DataFrame:
    """``case_id, row, col, want, got, fmt, has_want, has_got, verdict`` of every cell on either side.

    ``expected``: ``case_id, row, col, text``; ``actual`` has ``value`` and ``fmt`` instead of text. Cells listed more than
    once meet each with each; a cell without case, row or column meets none. On either side ``col`` and the texts may be
    lists: cells of one row that are at hand together, which spares the way into Arrow cell by cell. Lists without ``col``
    hold the columns from 0 on.
    """
    return _judged(_pairs(expected, actual, unicode_forms))


def _judged(both: DataFrame) -> DataFrame:
    """Pairs with their ``verdict``. Each step is a column of its own: worked out once, in generated code, and not where the texts are equal."""
    texts = both.withColumns({f"{c}_form": F.coalesce(f"{c}_form", c, F.lit("")) for c in ("want", "got")})
    want, got = F.col("want_form"), F.col("got_form")
    bare = texts.withColumns({c: F.when(want != got, bare_text(t)) for c, t in (("a", want), ("b", got))})
    read = bare.withColumn("x", any_number(F.col("a"))).withColumn("y", F.when(F.col("x").isNotNull(), any_number(F.col("b"))))
    verdict = F.when(
        (want == got) | same_value(*map(F.col, "abxy")),
        F.when(display_matches(want, F.col("fmt"), False), "exact").when(normalize_text(want, False) != normalize_text(got, False), "format").otherwise("value"),
    ).otherwise(F.when(((got >= "!") & (got < "\x7f")) | got.rlike(NO_SPACE), "wrong").otherwise("missing"))
    cells = [*SPOT, "want", "got", "fmt", "has_want", "has_got"]
    # Out of a generator, so that a filter on the verdict does not work it out once more.
    return read.select(*cells, verdict.alias("verdict")).select(*cells, F.explode(F.array("verdict")).alias("verdict"))


def compare_grids(expected: DataFrame, actual: DataFrame, unicode_forms: bool = True) -> DataFrame:
    """Scores per case. Cells on neither side are blank on both and match, so the grid is never filled in.

    The frame of a case is the greatest expected row and column. Only cells that were not expected wait for it: the others are
    one row per case before the exchange.
    """
    pairs = paired_cells(expected, actual, unicode_forms)
    wanted, verdict = F.col("has_want"), F.col("verdict")
    more = [F.when(~wanted, F.col(c)).alias(f"more_{c}") for c in ("row", "col")]
    last = {f"{side}_{axis}s": F.max(F.when(F.col(has), F.col(axis))) for has, side in (("has_want", "exp"), ("has_got", "act")) for axis in ("row", "col")}
    counts = {
        "listed": F.count(F.lit(1)), "ok_in": F.count_if(verdict.isin("exact", "format", "value")), "exact_in": F.count_if(verdict == "exact"),
        "missing": F.count_if(wanted & (verdict == "missing")), "wrong": F.count_if(verdict == "wrong"),
    }
    few = pairs.groupBy("case_id", wanted.alias("wanted"), *more).agg(*[c.alias(n) for n, c in {**last, **counts}.items()])
    case = W.partitionBy("case_id")
    framed = few.withColumns({c: F.coalesce(F.max(c).over(case) + 1, F.lit(0)) for c in last})
    # Actual cells inside the frame without an expected cell are compared with blank; those outside are extra rows and columns.
    inside = F.col("wanted") | ((F.col("more_row") < F.col("exp_rows")) & (F.col("more_col") < F.col("exp_cols")))
    scored = framed.groupBy("case_id").agg(
        *[F.max(c).alias(c) for c in last], *[F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(c) for c in counts]
    )
    rows, cols = F.col("exp_rows"), F.col("exp_cols")
    total = (rows * cols).cast("bigint")
    both_blank = total - F.col("listed")
    matched, exact = F.col("ok_in") + both_blank, F.col("exact_in") + both_blank
    return scored.select(
        "case_id", matched.alias("matched"), exact.alias("exact"), total.alias("total"),
        F.when(total > 0, F.round(matched / total, 6)).otherwise(0.0).alias("accuracy"),
        F.when(total > 0, F.round(exact / total, 6)).otherwise(0.0).alias("fidelity"),
        "missing", "wrong",
        F.greatest(F.lit(0), F.col("act_rows") - rows).alias("extra_rows"),
        F.greatest(F.lit(0), F.col("act_cols") - cols).alias("extra_cols"),
    )


def top_mismatches(expected: DataFrame, actual: DataFrame, k: int = TOP, unicode_forms: bool = True) -> DataFrame:
    """The first ``k`` missing, wrong and badly shown cells of a case, row by row.

    A top-k report: Spark keeps ``k`` rows per group before the shuffle already.
    """
    # Two equal texts are none of the three, so such pairs stay where they met.
    pairs = _judged(_pairs(expected, actual, unicode_forms, differ=True)).where(F.col("verdict").isin("missing", "wrong", "format"))
    nth = F.row_number().over(W.partitionBy("case_id", "verdict").orderBy("row", "col"))
    return pairs.withColumn("nth", nth).where(F.col("nth") <= k).select("case_id", "verdict", "nth", "row", "col", "want", "got")


def eval_summary(scores: DataFrame) -> DataFrame:
    """Mean and lowest accuracy and mean fidelity of the cases that were scored."""
    scored = scores.where(F.col("total") > 0)
    return scored.agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg("accuracy"), 6).alias("mean_accuracy"),
        F.min("accuracy").alias("min_accuracy"), F.round(F.avg("fidelity"), 6).alias("mean_fidelity"),
    )
