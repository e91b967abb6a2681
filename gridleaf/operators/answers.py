"""Model answers to table cells: JSON of whole Arrow batches, read once, with the pieces of an image put together.

Answers of one image meet in one task on one exchange, in tile order; a task holds one image's answers beside a batch.
What counts as JSON, as a table and as a seam is that of ``parse_json_lenient``, ``normalize_table`` and ``merge_fragments`` in
``grids``, which do the same on columns.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from ..functions.text import SPACE_CHARS
from ..session import ship
from .images import whole_groups

# --- fixed values ---------------------------------------------------------
SEAM_ROWS = 5
FENCE = "```"
# --------------------------------------------------------------------------

#: Images whose answers are Python objects at a time, and cells (more by those of the last image) that go out together.
IMAGES, CELLS = 256, 65536
ESCAPE = re.compile(r"\\(?:u[0-9a-f]{4}|.)")
NO_SPACE = {ord(c): None for c in SPACE_CHARS}

Piece = tuple[list[str], list[list[str]]]


def unfenced(text: str) -> str:
    """The text without white space around it and without a code fence."""
    text = text.strip(SPACE_CHARS)
    if text.startswith(FENCE):
        text = text[text.find("\n") + 1 :].removesuffix(FENCE).strip(SPACE_CHARS)
    return text


def _once(pairs: list[tuple[str, object]]) -> dict:
    named = dict(pairs)
    if len(named) < len(pairs):
        raise ValueError("a name repeats")
    return named


def _no_number(name: str) -> None:
    raise ValueError(name)


def scanner(repeats: bool):
    """Reader of strict JSON; decimals come as they are written, a name that repeats is an error unless ``repeats``."""
    return json.JSONDecoder(object_pairs_hook=dict if repeats else _once, parse_float=str, parse_constant=_no_number).scan_once


def _tables(text: str | None, scan) -> list[dict]:
    """The tables in one answer, which is read as one value, else as that between its outermost braces."""
    value = None if text is None else _value(unfenced(text), scan)
    tables = value.get("tables") if isinstance(value, dict) else None
    return [t for t in tables if isinstance(t, dict)] if isinstance(tables, list) else []


def _value(text: str, scan) -> object:
    try:
        return _whole(text, scan)
    except (ValueError, StopIteration, RecursionError):
        start, end = text.find("{"), text.rfind("}")
        if start < 0 or end < start:
            return None
    try:
        return _whole(text[start : end + 1], scan)
    except (ValueError, StopIteration, RecursionError):
        return None


def _whole(text: str, scan) -> object:
    """The one value that the text is; no white space is around it."""
    value, end = scan(text, 0)
    if end < len(text):
        raise ValueError("more than one value")
    return value


def _utf16(name: str) -> bytes:
    """Names of an object go by UTF-16 units, as in a variant."""
    return name.encode("utf-16-be", "surrogatepass")


def _sorted(value: object) -> object:
    if isinstance(value, dict):
        return {k: _sorted(value[k]) for k in sorted(value, key=_utf16)}
    return [_sorted(v) for v in value] if isinstance(value, list) else value


def _text(value: object) -> str:
    """A JSON value as cell text; null is the empty text."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value)
    told = json.dumps(_sorted(value), ensure_ascii=False, separators=(",", ":"))
    return ESCAPE.sub(lambda m: m[0][:2] + m[0][2:].upper(), told)


def _texts(values: list) -> list[str]:
    return [v if type(v) is str else _text(v) for v in values]


def pieces_of(text: str | None, scan) -> list[Piece]:
    """``(headers, rows)`` of the tables in one answer; object rows in header order, scalar rows as one cell."""
    out = []
    for table in _tables(text, scan):
        headers, rows = (v if isinstance(v, list) else [] for v in (table.get("headers"), table.get("rows")))
        if not headers and not rows:
            continue
        headers, cells = _texts(headers), []
        for row in rows:
            if type(row) is list:
                cells.append(_texts(row))
            elif type(row) is dict:
                cells.append([_text(row.get(n)) for n in headers or sorted(row, key=_utf16)])
            else:
                cells.append([_text(row)])
        out.append((headers, cells))
    return out


def has_table(text: str | None, scan) -> bool:
    """Whether ``pieces_of`` finds any."""
    return any(isinstance(v, list) and v for t in _tables(text, scan) for v in (t.get("headers"), t.get("rows")))


def _keys(row: list[str]) -> list[str]:
    return [(c if c.isascii() else unicodedata.normalize("NFKC", c)).translate(NO_SPACE) for c in row]


def merged(pieces: list[Piece]) -> Iterator[tuple[int, int, bool, list[str], list[list[str]]]]:
    """``table_no, first_row, opens, headers, rows`` of an image's pieces in their order (see ``merge_fragments``)."""
    if len(pieces) == 1:
        yield 0, 0, True, *pieces[0]
        return
    number, first_row, tail = -1, 0, []
    heads = [_keys(h) for h, _ in pieces]
    follows = [k > 0 and bool(h) and heads[k - 1] == h for k, h in enumerate(heads)] + [False]
    for k, (headers, rows) in enumerate(pieces):
        # Row keys tell of seams and blank rows: a table of one piece needs none.
        keys = [_keys(r) for r in rows] if follows[k] or follows[k + 1] else []
        cut = 0
        if follows[k]:
            for size in range(1, SEAM_ROWS + 1):
                if size <= min(len(tail), len(keys)) and tail[-size:] == keys[:size]:
                    cut = size
            rows = [r for r, key in zip(rows[cut:], keys[cut:]) if any(key)]
        else:
            number, first_row, tail = number + 1, 0, []
        tail = (tail + [key for key in keys[cut:] if any(key)])[-SEAM_ROWS:]
        yield number, first_row, not follows[k], headers, rows
        first_row += len(rows)


def _strings(values: list[str]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # half of a pair, written as an escape
        return pa.array([v.encode("utf-8", "replace").decode("utf-8") for v in values], pa.string())


def _in_order(tiles: list, texts: list[str | None]) -> list[str | None]:
    """Answers of an image, sorted by tile; those of one tile by text."""
    runs = groupby(zip(tiles, texts), key=lambda t: t[0])
    return [text for _, run in runs for text in sorted((t for _, t in run), key=lambda t: (t is not None, t or ""))]


def _repeats(answers: DataFrame) -> bool:
    return str(answers.sparkSession.conf.get("spark.sql.variant.allowDuplicateKeys", "false")).lower() == "true"


def images_with_tables(answers: DataFrame, key: str = "image_id") -> DataFrame:
    """``key`` of every answer (``key, answer``) that has a table."""
    ship(answers.sparkSession)
    repeats, schema = _repeats(answers), StructType([answers.schema[key]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(repeats)
        for batch in batches:
            told = [has_table(t, scan) for i in range(0, batch.num_rows, IMAGES) for t in batch.column("answer").slice(i, IMAGES).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key).filter(pa.array(told, pa.bool_()))], schema=arrow)

    return answers.select(key, "answer").mapInArrow(run, schema)


def model_cells(answers: DataFrame, headers: bool = True, key: str = "image_id") -> DataFrame:
    """``key, table_no, row, col, text, is_header`` from model answers (``key, tile_id, answer``).

    A titled table opens with its header row, which ``is_header`` marks if ``headers``; the other pieces move down by one.
    """
    ship(answers.sparkSession)
    repeats = _repeats(answers)
    numbers = [StructField(c, IntegerType()) for c in ("table_no", "row", "col")]
    schema = StructType([answers.schema[key], *numbers, StructField("text", StringType()), StructField("is_header", BooleanType())])
    arrow = to_arrow_schema(schema)

    def made(images: pa.Array, tables: list[tuple[int, int, int, int, bool]], sizes: list[int], texts: list[str]) -> pa.RecordBatch:
        image, number, first, count, top = (np.array(v) for v in zip(*tables))
        row = np.arange(len(sizes)) - np.repeat(np.cumsum(count) - count - first, count)
        size = np.array(sizes, np.int64)
        col = np.arange(len(texts)) - np.repeat(np.cumsum(size) - size, size)
        piece = np.repeat(np.repeat(np.arange(len(count)), count), size)
        row = np.repeat(row, size)
        columns = [images.take(pa.array(image[piece])), *[pa.array(v.astype(np.int32)) for v in (number[piece], row, col)], _strings(texts), pa.array(top[piece] & (row == 0))]
        return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(repeats)
        for batch, starts in whole_groups(batches, [key], 1):
            images, bounds = batch.column(key), np.append(starts, batch.num_rows).tolist()
            tables, sizes, texts = [], [], []
            for at in range(0, len(starts), IMAGES):
                some = bounds[at : at + IMAGES + 1]
                told, tiles = (batch.column(c).slice(some[0], some[-1] - some[0]).to_pylist() for c in ("answer", "tile_id"))
                for begin, end in zip(some, some[1:]):
                    part = slice(begin - some[0], end - some[0])
                    pieces = [p for text in (_in_order(tiles[part], told[part]) if end - begin > 1 else told[part]) for p in pieces_of(text, scan)]
                    for table, first_row, opens, head, rows in merged(pieces) if pieces else ():
                        titled = any(h.strip(SPACE_CHARS) for h in head)
                        if titled and opens:
                            rows = [head, *rows]
                        elif titled:
                            first_row += 1
                        tables.append((begin, table, first_row, len(rows), headers and titled and opens))
                        sizes.extend(map(len, rows))
                        texts.extend(chain.from_iterable(rows))
                    if len(texts) >= CELLS:
                        yield made(images, tables, sizes, texts)
                        tables, sizes, texts = [], [], []
            if texts:
                yield made(images, tables, sizes, texts)

    rows = answers.select(key, "tile_id", "answer").repartition(key).sortWithinPartitions(key, "tile_id")
    return rows.mapInArrow(run, schema)
