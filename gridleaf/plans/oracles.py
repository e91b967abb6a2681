"""Independent SQL (DuckDB dialect) for the registered queries, straight from the given tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

LINES = """lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
  l_extendedprice, l_quantity, l_discount, l_tax) AS rn FROM lineitem)"""
CELLS = """flat AS (
  SELECT l_orderkey AS image_id, rn AS r, c, CASE c WHEN 0 THEN 'P' || l_partkey WHEN 1 THEN l_returnflag
    WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) ELSE format('{:,.2f}', l_extendedprice) END AS text
  FROM lines, (VALUES (0), (1), (2), (3)) v(c)
  UNION ALL SELECT o.k, 0, h.c, h.t FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) o,
    (VALUES (0, 'Item'), (1, 'Flag'), (2, 'Qty'), (3, 'Amount')) h(c, t))"""
BOXES = """blocks AS (SELECT image_id, r, c, r * 10 + c AS block_id, text, c * 200 + 10 + j AS x0, r * 50 + 10 + j AS y0,
  c * 200 + 90 + j AS x1, r * 50 + 38 + j AS y1, 0.5 + ((r * 10 + c) % 50) / 100 AS confidence
  FROM (SELECT *, (image_id * 7 + r * 3 + c * 5) % 6 AS j FROM flat))"""
BLOCKS = f"WITH {LINES}, {CELLS}, {BOXES}"
IMAGES = "images AS (SELECT l_orderkey AS image_id, {w} AS width, ((count(*) + 1) * 50 + 20) * {s} AS height, 28 AS line FROM lineitem GROUP BY 1)"
IMG1, IMG4 = IMAGES.format(w=810, s=1), IMAGES.format(w=3240, s=4)
EXT = "['pdf','png','jpg','docx','xlsx','txt','zip','bin'][doc_id % 8 + 1]"
FILES = f"""files AS (SELECT *, '/in/' || source || '/' || lang || '/' || name AS path FROM (
  SELECT doc_id, source, lang, {EXT} AS ext, 'doc' || (doc_id % 50) AS stem, 'doc' || (doc_id % 50) || '.' || {EXT} AS name,
  CASE WHEN doc_id % 37 = 0 THEN 0 ELSE n_chars END AS length FROM documents))"""
PAGES = """pages_ AS (SELECT doc_id, p AS page_no, n AS page_count, substr(text, (p - 1) * 1000 + 1, 1000) AS full_text,
    (doc_id + p) % 5 = 0 AS scan, 90 * (doc_id % 4) AS rotation
  FROM (SELECT doc_id, text, CAST(ceil(length(text) / 1000) AS INT) AS n FROM documents), LATERAL (SELECT unnest(range(1, n + 1)) AS p)),
pg AS (SELECT doc_id, page_no, page_count, full_text, rotation, CASE WHEN scan THEN '' ELSE full_text END AS page_text,
  CASE WHEN scan OR page_no % 3 = 0 THEN 1 ELSE 0 END AS images, CASE WHEN scan THEN 0 ELSE length(full_text) END AS characters FROM pages_)"""
# Which page is selected by the five page lists.
PICK = """(CASE doc_id % 5 WHEN 0 THEN true WHEN 1 THEN page_no <= 2 WHEN 2 THEN page_no >= 2 WHEN 3 THEN page_no IN (1, 3) ELSE false END)"""
DOCS = """docs AS (SELECT doc_id, source AS merge_id, doc_id AS ord, CAST(ceil(length(text) / 1000) AS INT) AS page_count,
  doc_id % 41 = 0 AS encrypted FROM documents)"""
TASKS = """tasks AS (SELECT user_id AS job_id, event_id AS task_id, event_id AS seq, ts, 'file' || event_id AS file_name,
  CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'cancelled' END AS status,
  CAST(event_id % 100 AS DOUBLE) AS progress, CASE WHEN event_type = 'error' THEN 'broken input ' || event_id END AS error,
  event_id * 100 AS bytes_in, event_id * 100 * 7 // 10 AS bytes_out FROM events)"""
JOBS = """jobs AS (SELECT job_id, min(seq) AS created_at, count(*) AS n, CASE arg_max(status, seq) WHEN 'cancelled' THEN 'queued' WHEN 'skipped' THEN 'running'
  ELSE arg_max(status, seq) END AS status FROM tasks GROUP BY 1)"""
RAW = """raw AS (SELECT l_orderkey AS case_id, rn AS row, c AS col, l_extendedprice AS price, l_discount AS disc, l_quantity AS qty, l_partkey AS part,
    l_linenumber AS ln, l_returnflag AS flag, l_linestatus AS st,
    CASE c WHEN 0 THEN format('{:,.2f}', l_extendedprice) WHEN 1 THEN CAST(round(l_discount * 100) AS INT) || '%' WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR)
    WHEN 3 THEN '00' || l_linenumber WHEN 4 THEN CASE WHEN l_returnflag = 'R' THEN '(' || format('{:,}', l_partkey) || ')' ELSE format('{:,}', l_partkey) END
    ELSE l_linestatus END AS text FROM lines, (VALUES (0), (1), (2), (3), (4), (5)) v(c))"""
CELLW = f"WITH {LINES}, {RAW}"
CACHE = """cache AS (SELECT sha256(text) AS key, 'result of ' || min(doc_id) AS value, min(doc_id) AS created FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)"""


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


oracle("invoice_totals", """SELECT l_orderkey AS image_id, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY 1""")

# files
oracle("file_inventory", f"WITH {FILES} SELECT DISTINCT path FROM files WHERE length > 0")
oracle("classify_file", f"""WITH {FILES} SELECT doc_id, ext, CASE WHEN ext IN ('png','jpg') THEN 'image' WHEN ext = 'pdf' THEN 'pdf' WHEN ext = 'docx' THEN 'word'
  WHEN ext = 'xlsx' THEN 'excel' WHEN ext = 'txt' THEN 'text' WHEN ext = 'zip' THEN 'archive' ELSE 'unknown' END AS kind FROM files""")
oracle("accept_split", f"""WITH {FILES} SELECT doc_id, CASE WHEN ext IN ('pdf','png','jpg') THEN 'queued' ELSE 'skipped' END AS status,
  CASE WHEN ext NOT IN ('pdf','png','jpg') THEN 'does not accept .' || ext END AS reason FROM files""")
oracle("add_new_files", f"""WITH {FILES}, old AS (SELECT path, min(length) AS length FROM files WHERE length <= 2000 GROUP BY 1),
  both_ AS (SELECT path, length FROM old UNION ALL SELECT path, length FROM files WHERE path NOT IN (SELECT path FROM old))
  SELECT path, count(*) AS n, CAST(sum(length) AS BIGINT) AS length FROM both_ GROUP BY 1""")
oracle("content_key", "SELECT doc_id, 'v1:' || lang || ':' || sha256(text) AS key FROM documents")
oracle("relative_target_dir", f"""WITH {FILES} SELECT doc_id, CASE WHEN source = 'src1' THEN '/out/' || lang ELSE '/out' END AS narrow,
  '/out/' || source || '/' || lang AS wide FROM files""")
oracle("render_outputs", """SELECT '# ' || doc_id || chr(10) || chr(10) || text AS value FROM documents
  UNION ALL SELECT '{"doc_id":' || doc_id || ',"lang":"' || lang || '"}' FROM documents""")
oracle("sensitive_match", f"""WITH {FILES} SELECT doc_id, CASE WHEN regexp_full_match(name, 'doc1.\\..*') THEN 'DOC1?.*' WHEN ext = 'pdf' THEN '*.PDF'
  WHEN name[4] IN ('2','3') THEN 'doc[2-3]*' END AS pattern FROM files""")
oracle("route_plan", f"""WITH {FILES}, f AS (SELECT doc_id, ext = 'pdf' AS s, ['local','cloud','auto'][doc_id % 3 + 1] AS p, doc_id % 4 = 0 AS only_a FROM files)
  SELECT doc_id, CASE WHEN s OR p = 'local' OR only_a THEN 'local.a' ELSE 'cloud.a>local.a' END AS candidates,
  CASE WHEN s THEN 'sensitive name: *.pdf' WHEN p = 'local' THEN '' WHEN p = 'cloud' AND only_a THEN 'fell back to local' WHEN p = 'cloud' THEN ''
    WHEN only_a THEN 'auto: local only' ELSE 'auto: cloud first' END AS notes FROM f""")
oracle("resolve_names", f"""WITH {FILES}, fam AS (SELECT stem, ext, count(*) AS n, bool_or(length % 3 = 0) AS t1, bool_or(length % 5 = 0) AS t2 FROM files GROUP BY 1, 2),
  free AS (SELECT stem, ext, i, row_number() OVER (PARTITION BY stem, ext ORDER BY i) AS k FROM fam, LATERAL (SELECT unnest(range(1, n + 3)) AS i)
    WHERE NOT (i = 1 AND t1) AND NOT (i = 2 AND t2)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY stem, ext ORDER BY doc_id) AS k FROM files)
  SELECT doc_id, '/out/' || stem || CASE WHEN i > 1 THEN ' (' || i || ')' ELSE '' END || '.' || ext AS output FROM ranked JOIN free USING (stem, ext, k)""")
oracle("skip_names", f"""WITH {FILES}, fam AS (SELECT stem, bool_or(length % 3 = 0) AS t, min(doc_id) AS first FROM files GROUP BY 1)
  SELECT doc_id, '/out/' || stem || '.txt' AS output, CASE WHEN t OR doc_id <> first THEN 'skipped' ELSE 'queued' END AS status FROM files JOIN fam USING (stem)""")
oracle("aggregate_name", "SELECT source AS batch, 'merged_' || count(*) || '_2024-01-31' AS name FROM documents GROUP BY 1")

# layout
oracle("polygon_to_box", f"""{BLOCKS} SELECT image_id, block_id, text, CAST(round_even(x0 / 2, 0) AS INT) AS x0, CAST(round_even(y0 / 2, 0) AS INT) AS y0,
  CAST(round_even((x1 + 1) / 2, 0) AS INT) AS x1, CAST(round_even((y1 + 1) / 2, 0) AS INT) AS y1,
  CASE WHEN block_id % 7 = 0 THEN 1.0 ELSE confidence END AS confidence FROM blocks WHERE block_id % 13 <> 0""")
oracle("lines_to_blocks", """WITH l AS (SELECT doc_id, n_chars, unnest(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\s]'))) AS text,
    generate_subscripts(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\s]')), 1) - 1 AS i,
    len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\\s]'))) AS n FROM documents)
  SELECT doc_id AS image_id, i AS block_id, text, CAST(i * greatest(1, n_chars // n) AS INT) AS y0, CAST((i + 1) * greatest(1, n_chars // n) AS INT) AS y1 FROM l""")
oracle("estimate_line_height", f"""{BLOCKS}, h AS (SELECT image_id, list_sort(list(CASE WHEN block_id % 3 = 0 THEN 78 ELSE 28 + block_id % 4 END)) AS hs FROM blocks GROUP BY 1)
  SELECT image_id, CAST(CASE WHEN hs[len(hs) // 2 + 1] > 2 * hs[CAST(floor(len(hs) * 0.1) AS INT) + 1] THEN hs[CAST(floor(len(hs) * 0.1) AS INT) + 1]
    ELSE hs[len(hs) // 2 + 1] END AS DOUBLE) AS line_height FROM h""")
SCALE = "least(1.0, 1300.0 / greatest(width, height), sqrt(1690000.0 / (CAST(width AS DOUBLE) * height)))"
oracle("line_scaling", f"""WITH {IMG4} SELECT image_id, round({SCALE}, 6) AS scale, round(28 * {SCALE}, 6) AS readable, 3033 AS side,
  round(least(CAST(0.2 AS DOUBLE) * height, greatest(2.0, 0.004 * height, 0.012 * height)), 6) AS guess,
  round(least(greatest(2.0, CAST(0.2 AS DOUBLE) * height), greatest(2.0, 0.004 * height, 2800.0)), 6) AS capped FROM images""")
GRID = """g AS (SELECT *, least(greatest(2.0, 0.2 * height), greatest(2.0, 0.004 * height, {line})) AS lh FROM images),
  s AS (SELECT *, greatest(64, CAST(floor(1300 * lh / 12) AS INT)) AS side FROM g),
  t AS (SELECT *, CASE WHEN width <= 1300 AND height <= 1300 OR side >= greatest(width, height) THEN 1 ELSE CAST(ceil(width / side) AS INT) END AS cols,
    CASE WHEN width <= 1300 AND height <= 1300 OR side >= greatest(width, height) THEN 1 ELSE CAST(ceil(height / side) AS INT) END AS rows FROM s)"""
GRID28 = GRID.format(line="28.0")
oracle("small_text_warning", f"""WITH {IMG4}, {GRID28} SELECT image_id, concat_ws('; ', CASE WHEN cols * rows > 1 THEN 'small text: split in ' || cols * rows || ' tiles' END,
  CASE WHEN 28 * {SCALE} < 12 THEN 'text too small to read safely' END, CASE WHEN image_id % 3 = 0 THEN 'blank margins cropped' END) AS warnings FROM t""")
oracle("plan_tiles", f"""WITH {IMG4}, {GRID28} SELECT image_id, CAST(cols * rows AS BIGINT) AS tiles, CAST(width * height AS BIGINT) AS core_area, 0 AS left, 0 AS top,
  CAST(width AS INT) AS right, CAST(height AS INT) AS bottom FROM t""")
oracle("plan_tile_rows", f"""WITH {IMG4}, {GRID28}, tiles AS (SELECT *, unnest(range(0, CAST(cols * rows AS BIGINT))) AS tile_id FROM t),
  core AS (SELECT *, tile_id % cols AS c, tile_id // cols AS r, CAST(width AS DOUBLE) / cols AS cw, CAST(height AS DOUBLE) / rows AS ch FROM tiles),
  cut AS (SELECT *, CAST(round_even(c * cw, 0) AS INT) AS core_x0, CAST(round_even(r * ch, 0) AS INT) AS core_y0,
    CAST(CASE WHEN c = cols - 1 THEN width ELSE round_even((c + 1) * cw, 0) END AS INT) AS core_x1, CAST(CASE WHEN r = rows - 1 THEN height ELSE round_even((r + 1) * ch, 0) END AS INT) AS core_y1,
    CAST(floor(cw * OVERLAP) AS INT) AS px, CAST(floor(ch * OVERLAP) AS INT) AS py FROM core)
  SELECT image_id, CAST(tile_id AS INT) AS tile_id, greatest(0, core_x0 - px) AS x, greatest(0, core_y0 - py) AS y,
    CAST(least(width, core_x1 + px) - greatest(0, core_x0 - px) AS INT) AS width, CAST(least(height, core_y1 + py) - greatest(0, core_y0 - py) AS INT) AS height,
    core_x0, core_y0, core_x1, core_y1 FROM cut""".replace("OVERLAP", "0.12"))
oracle("tile_to_global", f"""{BLOCKS}, {IMG1} SELECT image_id, block_id, x0 + 5 AS x0, x1 + 5 AS x1,
  CAST(y0 + 7 + CASE WHEN block_id % 2 = 1 THEN height // 2 ELSE 0 END AS INT) AS y0, CAST(y1 + 7 + CASE WHEN block_id % 2 = 1 THEN height // 2 ELSE 0 END AS INT) AS y1
  FROM blocks JOIN images USING (image_id)""")
oracle("tile_owner", f"""{BLOCKS}, {IMG1}, o AS (SELECT image_id, block_id, (x0 + x1) / 2 + 300 AS cx, (y0 + y1) / 2 AS cy, height // 2 AS half, height FROM blocks JOIN images USING (image_id))
  SELECT image_id, block_id, CASE WHEN cx < 810 THEN CASE WHEN cy < half THEN 0 ELSE 1 END
    WHEN abs(cy - half / 2) <= abs(cy - (half + (height - half) / 2)) THEN 0 ELSE 1 END AS owner FROM o""")
oracle("dedupe_overlap", f"{BLOCKS} SELECT image_id, block_id * 2 AS block_id, text, x0, y0 FROM blocks")
oracle("reading_order", f"{BLOCKS} SELECT image_id, block_id, r AS line, r * 4 + c AS pos FROM blocks")
oracle("page_text", f"{BLOCKS} SELECT image_id, CAST(0 AS BIGINT) AS part, string_agg(text, chr(10) ORDER BY r, c) AS text FROM blocks GROUP BY 1")
MEAN = "CAST(sum(CAST(confidence AS DECIMAL(18,9))) AS DOUBLE) / count(*)"
oracle("average_confidence", f"{BLOCKS} SELECT image_id, round({MEAN}, 8) AS avg_confidence FROM blocks GROUP BY 1")
oracle("text_layer_geometry", f"""{BLOCKS} SELECT image_id, block_id, 'latin' AS font, round(28 * (72.0 / 150) * 0.8, 6) AS font_size, round(x0 * (72.0 / 150), 6) AS base_x,
  round(y1 * (72.0 / 150) - 28 * (72.0 / 150) * 0.18, 6) AS base_y FROM blocks""")
oracle("ocr_report", f"""{BLOCKS}, {IMG1}, f AS (SELECT image_id, count(*) AS line_count, round({MEAN}, 3) AS avg_confidence, string_agg(text, chr(10) ORDER BY r, c) AS full_text FROM blocks GROUP BY 1)
  SELECT image_id, CAST(width AS INT) AS width, CAST(height AS INT) AS height, line_count, avg_confidence, length(full_text) AS chars, full_text AS text, substr(full_text, 1, 60) AS preview, length(full_text) > 60 AS truncated
  FROM f JOIN images USING (image_id)""")

# grids
GAPPY = "gappy AS (SELECT * FROM blocks WHERE NOT ((r + c + image_id) % 11 = 0 AND c IN (1, 2)))"
COLNO = """used AS (SELECT image_id, c, row_number() OVER (PARTITION BY image_id ORDER BY c) - 1 AS col FROM (SELECT DISTINCT image_id, c FROM gappy))"""
oracle("group_rows", f"{BLOCKS} SELECT image_id, block_id, CAST(r AS INT) AS row FROM blocks")
oracle("detect_columns", f"{BLOCKS} SELECT image_id, c AS col, CAST(min(x0) AS INT) AS x0, CAST(max(x1) AS INT) AS x1 FROM blocks GROUP BY 1, 2")
oracle("assign_column", f"{BLOCKS}, {GAPPY}, {COLNO} SELECT image_id, block_id, CAST(col AS INT) AS col FROM gappy JOIN used USING (image_id, c)")
oracle("blocks_to_grid", f"{BLOCKS}, {GAPPY}, {COLNO} SELECT image_id, CAST(r AS INT) AS row, CAST(col AS INT) AS col, text FROM gappy JOIN used USING (image_id, c)")
oracle("dense_rows", f"""{BLOCKS}, {GAPPY}, {COLNO}, spots AS (SELECT u.image_id, d.r, u.c, u.col FROM used u JOIN (SELECT DISTINCT image_id, r FROM gappy) d USING (image_id))
  SELECT image_id, CAST(r AS INT) AS row, string_agg(coalesce(text, ''), '|' ORDER BY col) AS cells FROM spots LEFT JOIN gappy USING (image_id, r, c) GROUP BY 1, 2""")
oracle("trim_empty", f"""{CELLW}, k AS (SELECT * FROM raw WHERE row % 3 <> 0 AND col <> 1)
  SELECT case_id, CAST(dense_rank() OVER (PARTITION BY case_id ORDER BY row) - 1 AS INT) AS row, CAST(CASE WHEN col > 1 THEN col - 1 ELSE col END AS INT) AS col, text FROM k""")
oracle("guess_header_row", "SELECT DISTINCT l_orderkey AS image_id, 0 AS header, l_orderkey % 3 <> 0 AS met FROM lineitem")
oracle("merge_fragments", f"""WITH {LINES}, n AS (SELECT *, max(rn) OVER (PARTITION BY l_orderkey) AS last FROM lines),
  t AS (SELECT l_orderkey AS image_id, rn, 'P' || l_partkey || '-' || rn || '|' || format('{{:,.2f}}', l_extendedprice) AS cells, l_orderkey % 9 = 0 AND rn >= 7 AS late,
    l_orderkey % 9 = 0 AND rn = 6 AND last > 6 AS twice FROM n)
  SELECT image_id, CASE WHEN late THEN 1 ELSE 0 END AS table_no, CAST(CASE WHEN late THEN rn - 6 ELSE rn - 1 END AS INT) AS row, cells FROM t UNION ALL SELECT image_id, 1, 0, cells FROM t WHERE twice""")
oracle("parse_json_lenient", """SELECT DISTINCT l_orderkey AS image_id, CASE WHEN l_orderkey % 4 < 3 THEN 'Invoice' END AS title,
  CASE WHEN l_orderkey % 4 = 3 THEN 'not valid JSON' END AS error FROM lineitem""")
oracle("normalize_table", f"""WITH {LINES} SELECT l_orderkey, CAST(rn AS INT) AS rn, '' AS title, 'a|b' AS headers,
  l_partkey || '|' || l_returnflag || '/' || l_linestatus || '|/' || rn || '.50' AS rows FROM lines""")
oracle("column_width", """SELECT p_brand AS brand, col, CAST(least(48, greatest(8, max(length(t)) + 3)) AS INT) AS width
  FROM (SELECT p_brand, 0 AS col, p_name AS t FROM part UNION ALL SELECT p_brand, 1, p_type FROM part) GROUP BY 1, 2""")
oracle("sheet_name", """SELECT p_partkey, CASE WHEN p_size = 1 THEN 'Sheet1' ELSE substr('ab' || p_name || p_brand || ' ' || p_type, 1, 28) END AS name FROM part""")
oracle("image_to_table", f"""{BLOCKS} SELECT image_id, 0 AS table_no, CAST(r AS INT) AS row, 0 AS col, text, r = 0 AS is_header, 'model' AS source FROM blocks WHERE image_id % 4 < 3 AND c = 0
  UNION ALL SELECT image_id, 0, CAST(r AS INT), 1, text, r = 0, 'model' FROM blocks WHERE image_id % 4 < 3 AND c = 3
  UNION ALL SELECT image_id, 0, CAST(r AS INT), c, text, r = 0, 'grid' FROM blocks WHERE image_id % 4 = 3""")
oracle("tables_of_images", f"""{BLOCKS}, t AS (SELECT image_id, 0 AS table_no, CAST(r AS INT) AS row, CASE c WHEN 3 THEN 1 ELSE 0 END AS col, text, r = 0 AS is_header, 'model' AS source
    FROM blocks WHERE image_id % 4 < 3 AND c IN (0, 3)
  UNION ALL SELECT image_id, 0, CAST(r AS INT), c, text, r = 0, 'grid' FROM blocks WHERE image_id % 4 = 3)
  SELECT o_orderkey AS image_id, table_no, row, col, text, is_header, source, CASE WHEN source IS NULL THEN 'nothing was recognised' END AS error
  FROM orders LEFT JOIN t ON o_orderkey = image_id""")
oracle("table_summary", "SELECT l_orderkey AS image_id, CAST(1 AS BIGINT) AS tables, count(*) + 1 AS rows, true AS rebuilt FROM lineitem GROUP BY 1")

# cells and text
NUM = "CASE col WHEN 0 THEN price WHEN 1 THEN round(disc * 100) / 100 WHEN 2 THEN qty WHEN 4 THEN CASE WHEN flag = 'R' THEN -part ELSE part END END"
oracle("parse_cell", f"""{CELLW} SELECT case_id, CAST(row AS INT) AS row, col, CAST(round({NUM}, 6) AS DOUBLE) AS num, CASE WHEN col IN (3, 5) THEN text END AS text,
  CASE col WHEN 0 THEN CASE WHEN price >= 1000 THEN '#,##0.00' ELSE '0.00' END WHEN 1 THEN '0%' WHEN 2 THEN '0'
    WHEN 4 THEN CASE WHEN part >= 1000 THEN '#,##0' ELSE '0' END || CASE WHEN flag = 'R' THEN ';#,##0' ELSE '' END END AS fmt,
  CASE WHEN col = 2 THEN CAST(CAST(qty AS INT) AS VARCHAR) WHEN col = 4 THEN CAST(CASE WHEN flag = 'R' THEN -part ELSE part END AS VARCHAR) END AS whole FROM raw""")
oracle("coerce_simple", f"""{CELLW} SELECT case_id, CAST(row AS INT) AS row, col, CAST(CASE WHEN col = 0 THEN price WHEN col = 2 THEN qty WHEN col = 4 AND flag <> 'R' THEN part END AS DOUBLE) AS num,
  CASE WHEN NOT (col IN (0, 2) OR (col = 4 AND flag <> 'R')) THEN text END AS text FROM raw""")
oracle("parse_param", f"""{CELLW}, k AS (SELECT *, CASE WHEN col = 5 THEN NULL WHEN col = 2 OR (col = 4 AND flag <> 'R' AND part < 1000) THEN 'int'
    WHEN col = 0 AND price < 1000 THEN 'float' ELSE 'text' END AS kind FROM raw)
  SELECT case_id, CAST(row AS INT) AS row, col, CASE WHEN col <> 5 THEN 'c' || col END AS key, kind, CASE WHEN kind = 'int' THEN CAST(text AS BIGINT) END AS whole,
  CASE WHEN kind = 'text' THEN text END AS text, CASE WHEN col = 5 THEN 'no equals sign' END AS error FROM k""")
oracle("value_key", f"""{CELLW} SELECT case_id, CAST(row AS INT) AS row, col, CASE WHEN col = 0 THEN 'num:' || printf('%.9e', price) WHEN col = 2 THEN 'num:' || printf('%.9e', qty)
  WHEN col = 3 THEN 'num:' || printf('%.9e', CAST(ln AS DOUBLE)) WHEN col = 4 AND flag <> 'R' THEN 'num:' || printf('%.9e', CAST(part AS DOUBLE))
  ELSE 'txt:' || lower(replace(text, ',', '')) END AS key FROM raw""")
oracle("format_key", f"{CELLW} SELECT case_id, CAST(row AS INT) AS row, col, text || ' x' AS key FROM raw")
oracle("display_matches", f"{CELLW} SELECT case_id, CAST(row AS INT) AS row, col, NOT (col = 4 AND flag = 'R' AND part < 1000) AS shown FROM raw")
oracle("parse_page_range", f"""WITH {DOCS}, p AS (SELECT doc_id, unnest(range(1, page_count + 1)) AS page_no FROM docs), hit AS (SELECT doc_id, page_no FROM p WHERE {PICK})
  SELECT doc_id, page_no FROM docs LEFT JOIN hit USING (doc_id)""")
CJK, LATIN, DIGITS = (f"length(regexp_replace(text, '{c}', '', 'g'))" for c in ("[^\\x{4e00}-\\x{9fff}]", "[^A-Za-z]", "[^\\p{Nd}]"))
oracle("language_hint", f"""WITH n AS (SELECT doc_id, {CJK} AS c, {LATIN} AS a, {DIGITS} AS g FROM documents)
  SELECT doc_id, CASE WHEN c / greatest(1, c + a + g) > 0.25 THEN 'zh' WHEN a / greatest(1, c + a + g) > 0.6 THEN 'en' ELSE 'auto' END AS hint FROM n""")
oracle("needs_cjk", "SELECT doc_id, regexp_matches(text, '[\\x{2e80}-\\x{9fff}\\x{f900}-\\x{faff}\\x{ff00}-\\x{ffef}]') AS cjk FROM documents")
oracle("normalize_text", "SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM documents")
oracle("cell_key", "SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS key FROM documents")
oracle("structure_lines", """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS ls FROM documents),
  e AS (SELECT doc_id, unnest(ls) AS t, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS line_no FROM l)
  SELECT doc_id, line_no, CASE WHEN t[1] = '#' THEN 'heading' ELSE 'paragraph' END AS kind, CAST(least(6, length(t) - length(ltrim(t, '#'))) AS INT) AS level,
  regexp_replace(ltrim(t, '#'), '^\\s+', '') AS text FROM e""")
oracle("expand_template", f"""WITH {PAGES} SELECT doc_id, page_no, nth, CASE nth WHEN 0 THEN 'doc' || doc_id || ' ' || page_no || '/' || page_count || ' {{who}}' WHEN 1 THEN '{{' || page_no || '}}'
  WHEN 2 THEN '{{page}} {{' WHEN 3 THEN '{{}} {{page}}' ELSE '{{0}}{{page}}' END AS text FROM pg, (VALUES (0), (1), (2), (3), (4)) v(nth)""")
oracle("hex_color", """WITH h AS (SELECT p_partkey, p_size % 5 AS k, p_partkey * 65537 AS v, lpad(printf('%X', p_partkey * 65537), 6, '0') AS t FROM part),
  q AS (SELECT p_partkey, k, CASE WHEN k = 2 THEN NULL WHEN k = 0 THEN t[1] || t[1] || t[2] || t[2] || t[3] || t[3] ELSE t END AS t FROM h)
  SELECT p_partkey, coalesce(CAST('0x' || t[1:2] AS INT), 255) AS r, coalesce(CAST('0x' || t[3:4] AS INT), 255) AS g, coalesce(CAST('0x' || t[5:6] AS INT), 255) AS b,
  CASE WHEN k = 1 THEN 128 ELSE 255 END AS a FROM q""")
oracle("warning_summary", """WITH w AS (SELECT doc_id, list_distinct(list_filter([source, text, lang], lambda x: length(x) <> 3)) AS u, list_filter([source, text, lang], lambda x: length(x) <> 3) AS l FROM documents),
  s AS (SELECT doc_id, l[1] AS h, len(u) AS n FROM w)
  SELECT doc_id, CASE WHEN n = 0 THEN 'done' ELSE 'done · ⚠ ' || CASE WHEN length(h) > 46 THEN substr(h, 1, 46) || '…' ELSE h END || CASE WHEN n > 1 THEN ' (' || n || ' in all)' ELSE '' END END AS summary FROM s""")
oracle("typed_param", """SELECT event_id, user_id AS n, CAST(5 AS BIGINT) AS bad_n, value AS x, CAST(0.5 AS DOUBLE) AS none, event_type = 'click' AS flag, true AS no_flag,
  CASE WHEN event_type = 'click' THEN ' YES ' ELSE event_type END AS word FROM events""")

# pages
TRIMMED = "length(regexp_replace(page_text, '^\\s+|\\s+$', '', 'g'))"
oracle("page_route", f"""WITH {PAGES} SELECT doc_id, count(*) FILTER ({TRIMMED} >= 20) AS kept_pages, count(*) FILTER ({TRIMMED} < 20) AS ocr_pages FROM pg GROUP BY 1""")
oracle("likely_scanned", f"WITH {PAGES} SELECT doc_id, page_no, characters, images, characters < 20 AND images > 0 AS likely_scanned FROM pg")
oracle("doc_looks_scanned", f"WITH {PAGES} SELECT doc_id, sum(characters) < count(*) * 20 AND sum(images) >= count(*) AS scanned FROM pg GROUP BY 1")
oracle("doc_info", f"""WITH {PAGES} SELECT doc_id, count(*) AS page_count, CAST(sum(characters) AS BIGINT) AS total_characters, CAST(sum(images) AS BIGINT) AS total_images,
  count(*) FILTER (characters < 20 AND images > 0) AS scanned_pages FROM pg GROUP BY 1""")
STARTS = """ok AS (SELECT merge_id FROM docs GROUP BY 1 HAVING count(*) >= 2 AND sum(CASE WHEN encrypted THEN 0 ELSE page_count END) > 0),
  st AS (SELECT *, sum(CASE WHEN encrypted THEN 0 ELSE page_count END) OVER (PARTITION BY merge_id ORDER BY ord ROWS UNBOUNDED PRECEDING) - page_count + 1 AS first_page FROM docs)"""
oracle("merge_docs", f"""WITH {PAGES}, {DOCS}, {STARTS} SELECT merge_id, doc_id, page_no, CAST(first_page + page_no - 1 AS BIGINT) AS merged_page
  FROM st JOIN pg USING (doc_id) WHERE NOT encrypted AND merge_id IN (SELECT merge_id FROM ok)""")
oracle("merge_bookmarks", f"""WITH {DOCS}, {STARTS} SELECT merge_id, doc_id, ord, page_count, CASE WHEN NOT encrypted THEN CAST(first_page AS BIGINT) END AS first_page,
  CASE WHEN encrypted THEN 'encrypted' END AS skipped FROM st""")
oracle("merge_status", f"""WITH {DOCS}, a AS (SELECT merge_id, count(*) AS docs, CAST(sum(CASE WHEN encrypted THEN 0 ELSE page_count END) AS BIGINT) AS pages, count(*) FILTER (encrypted) AS skipped FROM docs GROUP BY 1)
  SELECT *, CASE WHEN docs < 2 THEN 'needs two documents' WHEN pages = 0 THEN 'no readable document' END AS error FROM a""")
oracle("split_every", f"""WITH {PAGES} SELECT doc_id, (page_no - 1) // 3 AS part, min(page_no) || '-' || max(page_no) AS label, count(*) AS pages FROM pg GROUP BY 1, 2""")
oracle("split_ranges", f"""WITH {PAGES}, cut AS (SELECT *, CASE WHEN page_count >= 2 THEN 1 ELSE 0 END AS more FROM pg)
  SELECT doc_id, page_no, 1 AS part, '1_2' AS label FROM cut WHERE page_no <= 2 UNION ALL SELECT doc_id, page_no, 2, '2_' FROM cut WHERE page_no >= 2
  UNION ALL SELECT doc_id, page_no, 3, '3' FROM cut WHERE page_no = 3""")
oracle("extract_pages", f"WITH {PAGES} SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS new_page FROM pg WHERE {PICK}")
oracle("selection_status", f"""WITH {DOCS}, {PAGES}, n AS (SELECT doc_id, count(*) FILTER ({PICK}) AS selected FROM pg GROUP BY 1)
  SELECT doc_id, page_count, coalesce(selected, 0) AS selected, CASE WHEN coalesce(selected, 0) = 0 THEN 'no page matches' END AS error FROM docs LEFT JOIN n USING (doc_id)""")
oracle("rotate_pages", f"WITH {PAGES} SELECT doc_id, page_no, CASE WHEN {PICK} THEN (rotation + 270) % 360 ELSE rotation END AS rotation FROM pg")
REBUILT = f"""WITH {PAGES}, r AS (SELECT doc_id, page_no, CASE WHEN regexp_matches(page_text, '\\S') THEN 'layer' WHEN doc_id % 7 <> 0 THEN 'ocr' ELSE 'failed' END AS origin,
    CASE WHEN regexp_matches(page_text, '\\S') THEN page_text WHEN doc_id % 7 <> 0 THEN full_text ELSE '' END AS raw FROM pg),
  b AS (SELECT doc_id, page_no, origin, list_filter(list_transform(string_split(raw, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS ls FROM r),
  rebuilt AS (SELECT doc_id, page_no, origin, array_to_string(ls, chr(10)) AS text, CAST(length(array_to_string(ls, '')) AS INT) AS chars FROM b)"""
oracle("page_text_rebuild", f"{REBUILT} SELECT * FROM rebuilt")
oracle("rebuild_status", f"""{REBUILT} SELECT doc_id, count(*) AS pages, count(*) FILTER (origin = 'ocr') AS recognised, count(*) FILTER (origin = 'failed') AS failed,
  CAST(sum(chars) AS BIGINT) AS chars, CASE WHEN sum(chars) = 0 THEN 'no text on any page' END AS error FROM rebuilt GROUP BY 1""")
oracle("doc_text", f"{REBUILT} SELECT doc_id, CAST(0 AS BIGINT) AS part, string_agg(text, chr(12) ORDER BY page_no) AS text FROM rebuilt GROUP BY 1")
oracle("rotated_extent", """WITH e AS (SELECT p_partkey, p_size * 10.0 AS w, p_retailprice AS h, abs(cos(radians(p_partkey % 360))) AS c, abs(sin(radians(p_partkey % 360))) AS s FROM part)
  SELECT p_partkey, round(w * c + h * s, 4) AS width, round(w * s + h * c, 4) AS height FROM e""")
HALF_W, HALF_H = "(120 * cos(radians(30)) + 30 * 0.5) / 2", "(120 * 0.5 + 30 * cos(radians(30))) / 2"
oracle("placement_centers", f"""WITH {PAGES}, a AS (SELECT * FROM (VALUES ('top-left','l','t'),('top-center','c','t'),('top-right','r','t'),('middle-left','l','m'),('center','c','m'),
    ('middle-right','r','m'),('bottom-left','l','b'),('bottom-center','c','b'),('bottom-right','r','b'),('custom','x','x'),('nowhere','r','b')) v(position, h, v))
  SELECT doc_id, page_no, position, round(CASE h WHEN 'l' THEN 23.8 + {HALF_W} WHEN 'r' THEN 595 - 23.8 - {HALF_W} WHEN 'c' THEN 297.5 ELSE 148.75 END, 4) AS cx,
  round(CASE v WHEN 't' THEN 23.8 + {HALF_H} WHEN 'b' THEN 842 - 23.8 - {HALF_H} WHEN 'm' THEN 421 ELSE 631.5 END, 4) AS cy FROM pg, a""")
oracle("tile_centers", f"""WITH {PAGES}, spots AS (SELECT (595 - 2 * 243.0) / 2 + x * 243.0 + CASE WHEN y % 2 = 1 THEN 121.5 ELSE 0 END AS cx, (842 - 10 * 81.0) / 2 + y * 81.0 AS cy
    FROM range(3) a(x), range(11) b(y)), seen AS (SELECT count(*) AS n, round(sum(cx), 3) AS sx, round(sum(cy), 3) AS sy FROM spots WHERE cx BETWEEN -90 AND 685)
  SELECT doc_id, page_no, n, CAST(sx AS DOUBLE) AS sum_x, CAST(sy AS DOUBLE) AS sum_y FROM pg, seen""")
oracle("stamp_plan", f"""WITH {PAGES}, t AS (SELECT doc_id, page_no, 'doc' || doc_id || ' ' || page_no || '/' || page_count AS text FROM pg WHERE {PICK})
  SELECT doc_id, page_no, text, CAST(round(595 * 0.07, 4) AS DOUBLE) AS font_size, round(595 - 595 * 0.05 - length(text) * 0.6 * (595 * 0.07) / 2, 4) AS cx,
  round(842 - 595 * 0.05 - 595 * 0.07 * 1.2 / 2, 4) AS cy, CAST(1.0 AS DOUBLE) AS opacity, 255 AS r, 0 AS g, 136 AS b FROM t""")

# jobs
oracle("task_filter", f"WITH {TASKS} SELECT job_id, task_id, status FROM tasks WHERE status IN ('succeeded', 'skipped')")
ROLL = f"""WITH {TASKS}, roll AS (SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('succeeded', 'skipped')) AS completed, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status = 'cancelled') AS cancelled, CAST(100.0 AS DOUBLE) AS progress FROM tasks GROUP BY 1)"""
oracle("job_rollup", f"{ROLL} SELECT * FROM roll")
oracle("job_status", f"""{ROLL} SELECT job_id, CASE WHEN cancelled * 4 > total THEN 'cancelled' WHEN failed > 0 AND completed = 0 THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN cancelled * 4 > total THEN NULL WHEN failed > 0 AND completed = 0 THEN 'all files failed' WHEN failed > 0 THEN failed || ' files failed' END AS error FROM roll""")
oracle("strict_success", f"WITH {TASKS} SELECT job_id, bool_and(status = 'succeeded') AS passed, count(*) FILTER (status <> 'succeeded') AS bad_tasks FROM tasks GROUP BY 1")
oracle("failure_reasons", f"""WITH {TASKS} SELECT job_id, task_id, file_name || '(' || status || ': ' || coalesce(error, 'no message') || ')' AS reason FROM tasks WHERE status <> 'succeeded'""")
oracle("run_isolated", f"""{CELLW} SELECT case_id, CAST(row AS INT) AS row, col, CAST(TRY_CAST(CASE WHEN col IN (2, 3, 4) THEN text END AS INT) + 1 AS VARCHAR) AS result,
  CASE WHEN TRY_CAST(CASE WHEN col IN (2, 3, 4) THEN text END AS INT) IS NULL THEN 'failed' ELSE 'succeeded' END AS status FROM raw""")
oracle("upsert_tasks", f"""WITH {TASKS}, o AS (SELECT * FROM tasks WHERE status <> 'skipped'), n AS (SELECT task_id FROM tasks WHERE status <> 'failed')
  SELECT t.task_id, CASE WHEN o.task_id IS NULL THEN -1 ELSE t.job_id END AS job_id, CASE WHEN o.task_id IS NULL THEN 'renamed' ELSE t.file_name END AS file_name,
  CASE WHEN n.task_id IS NOT NULL THEN 'succeeded' ELSE t.status END AS status, CASE WHEN n.task_id IS NULL THEN t.error END AS error
  FROM tasks t LEFT JOIN o ON o.task_id = t.task_id LEFT JOIN n ON n.task_id = t.task_id""")
oracle("list_jobs", f"WITH {TASKS}, {JOBS} SELECT job_id, created_at FROM jobs ORDER BY created_at DESC, job_id DESC LIMIT 500 OFFSET 3")
oracle("active_jobs", f"WITH {TASKS}, {JOBS} SELECT job_id, status FROM jobs WHERE status IN ('queued', 'running')")
oracle("job_tasks", f"WITH {TASKS}, {JOBS} SELECT job_id, task_id, t.status FROM tasks t WHERE job_id IN (SELECT job_id FROM jobs WHERE status IN ('queued', 'running'))")
oracle("clear_history", f"WITH {TASKS}, {JOBS} SELECT job_id, n AS tasks FROM jobs WHERE status NOT IN ('queued', 'running')")
oracle("size_change", f"""WITH {TASKS} SELECT job_id, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out,
  CASE WHEN sum(bytes_in) > 0 THEN round((1 - sum(bytes_out) / sum(bytes_in)) * 100, 4) ELSE 0.0 END AS saved_percent FROM tasks GROUP BY 1""")
oracle("first_success", """WITH a AS (SELECT event_id // 3 AS file_id, event_id % 3 AS ord, event_type <> 'error' AS ok, event_id FROM events),
  f AS (SELECT file_id, min(ord) FILTER (ok) AS hit, max(ord) AS top FROM a GROUP BY 1),
  n AS (SELECT file_id, string_agg('engine' || ord || ' failed (failed at ' || event_id || ')', '; ' ORDER BY ord) AS notes FROM a JOIN f USING (file_id) WHERE NOT ok AND ord < coalesce(hit, top) GROUP BY 1)
  SELECT f.file_id, CASE WHEN hit IS NOT NULL THEN 'engine' || hit END AS engine, coalesce(notes, '') AS notes, CASE WHEN hit IS NULL THEN 'failed at ' || (f.file_id * 3 + top) END AS error
  FROM f LEFT JOIN n ON n.file_id = f.file_id""")
oracle("preferred_engine", """SELECT domain, engine, fidelity FROM (SELECT p_brand AS domain, p_name AS engine, p_size AS fidelity, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k
  FROM part WHERE p_type <> 'SMALL') WHERE k = 1""")

# presets, cache, usage
SAVED = """saved AS (SELECT event_type AS action, 'p' || user_id AS name, 'id' || min(event_id) AS id, arg_max(props, event_id) AS params, min(event_id) AS created, max(event_id) AS updated
  FROM events GROUP BY 1, 2)"""
oracle("refused_presets", """SELECT 'id' || event_id AS new_id, CASE event_id % 7 WHEN 0 THEN 'empty name' ELSE 'name too long' END AS error FROM events
  WHERE event_id % 7 = 0 OR (event_id % 7 = 1 AND length('p' || user_id) * 20 > 40)""")
oracle("save_presets", f"WITH {SAVED} SELECT * FROM saved")
oracle("list_presets", f"WITH {SAVED} SELECT name, params FROM saved WHERE action = 'click'")
oracle("delete_presets", f"WITH {SAVED} SELECT action, name FROM saved WHERE created >= 1000")
oracle("merge_params", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'view' ELSE json_extract_string(props, '$.k') END AS k, CAST(user_id AS VARCHAR) AS "user",
  CASE WHEN event_type <> 'view' THEN event_type END AS kind FROM events""")
oracle("cache_lookup", f"WITH {CACHE} SELECT doc_id AS request_id, value IS NOT NULL AS hit, value FROM documents LEFT JOIN cache ON key = sha256(text)")
oracle("cache_misses", f"WITH {CACHE} SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT key FROM cache)")
TOUCHED = f"""{CACHE}, touched AS (SELECT key, value, created, count(*) AS hits, max(doc_id) AS last_hit FROM cache JOIN documents ON sha256(text) = key GROUP BY 1, 2, 3)"""
oracle("cache_touch", f"WITH {TOUCHED} SELECT key, hits, last_hit FROM touched")
oracle("cache_refused", """SELECT CAST(doc_id AS VARCHAR) AS key, doc_id AS created, CASE WHEN doc_id % 5 = 0 OR text IS NULL THEN 'no value' ELSE 'value too long' END AS reason
  FROM documents WHERE doc_id % 5 = 0 OR text IS NULL OR length(text) > 2000""")
oracle("cache_put", f"""WITH {CACHE}, r AS (SELECT sha256(text) AS key, arg_max(lang, doc_id) AS value, min(doc_id) AS first FROM documents GROUP BY 1)
  SELECT r.key, r.value, coalesce(cache.created, first) AS created, CAST(0 AS BIGINT) AS hits FROM r LEFT JOIN cache ON cache.key = r.key""")
oracle("cache_evict", f"WITH {TOUCHED} SELECT key, hits FROM touched ORDER BY last_hit DESC, key LIMIT 100")
oracle("cache_stats", f"WITH {TOUCHED} SELECT count(*) AS entries, CAST(sum(hits) AS BIGINT) AS hits FROM touched")
oracle("usage_rollup", """WITH c AS (SELECT event_type, count(*) AS calls, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 1000) AS BIGINT) AS completion_tokens FROM events GROUP BY 1)
  SELECT *, round(prompt_tokens / 1000000 * 0.3 + completion_tokens / 1000000 * 1.2, 6) AS cost FROM c""")
oracle("estimate_cost", f"""WITH {IMG4}, {GRID.format(line="0.012 * height")}, n AS (SELECT image_id, CAST(cols * rows AS BIGINT) AS tiles FROM t)
  SELECT image_id, tiles, tiles * 1774 AS input_tokens, tiles * 12000 AS output_tokens, round(tiles * 1774 / 1000000 * 0.3 + tiles * 12000 / 1000000 * 1.2, 6) AS cost FROM n""")

# chains: the five step lists spelled out
CHAIN = f"""{FILES}, k AS (SELECT doc_id, doc_id % 5 AS k, ext, ext IN ('png','jpg') AS img, ext IN ('docx','xlsx','txt') AS office FROM files),
  v AS (SELECT *, CASE WHEN k = 0 AND ext <> 'pdf' THEN 'step 1 pdf.rotate: does not accept .' || ext WHEN k = 1 AND NOT img THEN 'step 1 image.ocr: does not accept .' || ext
    WHEN k = 2 AND NOT office THEN 'step 1 doc.to_pdf: does not accept .' || ext WHEN k = 3 THEN 'step 1 pdf.merge: takes a whole batch'
    WHEN k = 4 AND NOT img THEN 'step 1 image.watermark: does not accept .' || ext WHEN k = 4 THEN 'step 2 pdf.to_word: does not accept .' || ext END AS error FROM k)"""
oracle("validate_chain", f"WITH {CHAIN} SELECT doc_id, error, CASE k WHEN 0 THEN 'json' WHEN 1 THEN 'pdf' WHEN 3 THEN 'pdf' WHEN 4 THEN 'docx' END AS final_ext FROM v")
oracle("describe_chain", f"""WITH {CHAIN} SELECT doc_id, CASE WHEN error IS NULL THEN CASE k WHEN 0 THEN 'pdf.rotate .pdf -> .pdf; pdf.info .pdf -> .json'
  WHEN 1 THEN 'image.ocr .' || ext || ' -> .txt; doc.to_pdf .txt -> .pdf' ELSE 'doc.to_pdf .' || ext || ' -> .pdf; pdf.to_images .pdf -> .png; image.watermark .png -> .png' END
  WHEN k = 4 AND img THEN 'image.watermark .' || ext || ' -> .' || ext ELSE '' END AS flow FROM v""")
oracle("run_chain", f"""WITH {PAGES}, n AS (SELECT *, bool_or({PICK}) OVER (PARTITION BY doc_id) AS any_hit, {PICK} AS hit FROM pg)
  SELECT doc_id, count(*) AS pages, CAST(sum(characters) AS BIGINT) AS characters, CASE WHEN any_hit THEN (max(rotation) + 90) % 360 ELSE max(rotation) END AS rotation,
  CASE WHEN NOT any_hit THEN 'no page matches' END AS error, CASE WHEN NOT any_hit THEN '1 pdf.extract_pages' END AS failed_step FROM n WHERE hit OR NOT any_hit GROUP BY doc_id, any_hit""")

# evaluation
SHOWN = "CASE WHEN col = 1 AND row % 10 <> 0 THEN false ELSE NOT (col = 4 AND flag = 'R') END"
PAIRS = f"""{CELLW}, cut AS (SELECT *, row % 17 = 0 AS lost, row % 10 = 0 AND row % 17 <> 0 AS bad FROM raw),
  got AS (SELECT *, CASE WHEN lost THEN NULL WHEN bad THEN text || 'x' ELSE CASE col WHEN 0 THEN CASE WHEN price = floor(price) THEN CAST(CAST(price AS BIGINT) AS VARCHAR) ELSE CAST(price AS VARCHAR) END
    WHEN 1 THEN CASE WHEN round(disc * 100) % 100 = 0 THEN CAST(CAST(disc AS BIGINT) AS VARCHAR) ELSE CAST(round(disc * 100) / 100 AS VARCHAR) END WHEN 2 THEN text WHEN 3 THEN text
    WHEN 4 THEN CASE WHEN flag = 'R' AND part > 0 THEN '-' || part ELSE CAST(part AS VARCHAR) END ELSE text END END AS value FROM cut),
  pairs AS (SELECT *, CASE WHEN lost THEN 'missing' WHEN bad OR col = 1 OR (col = 4 AND flag = 'R') THEN 'wrong' ELSE 'exact' END AS verdict FROM got)"""
SCORES = f"""{PAIRS}, scores AS (SELECT case_id, count(*) FILTER (verdict = 'exact') AS listed, count(*) FILTER (verdict = 'missing') AS missing,
    count(*) FILTER (verdict = 'wrong') AS wrong, (max(row) + 1) * 6 AS total, max(row) + 1 - (max(row) FILTER (NOT lost) + 1) AS short FROM pairs GROUP BY 1),
  res AS (SELECT case_id, listed + 6 AS matched, listed + 6 AS exact, total, round((listed + 6) / total, 6) AS accuracy, round((listed + 6) / total, 6) AS fidelity, missing, wrong,
    0 AS extra_rows, 0 AS extra_cols FROM scores)"""
oracle("compare_grids", f"{SCORES} SELECT * FROM res")
oracle("top_mismatches", f"""{PAIRS}, m AS (SELECT case_id, verdict, CAST(row_number() OVER (PARTITION BY case_id, verdict ORDER BY row, col) AS INT) AS nth, CAST(row AS INT) AS row, col, text AS want, value AS got
  FROM pairs WHERE verdict <> 'exact') SELECT * FROM m WHERE nth <= 8""")
oracle("eval_summary", f"""{SCORES} SELECT count(*) AS cases, round(avg(accuracy), 6) AS mean_accuracy, min(accuracy) AS min_accuracy, round(avg(fidelity), 6) AS mean_fidelity FROM res""")

# streams
oracle("latest_task_state", f"WITH {TASKS} SELECT job_id AS task_id, arg_max(seq, seq) AS seq, arg_max(status, seq) AS status, arg_max(progress, seq) AS progress FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) AS k FROM tasks) WHERE k = 1 GROUP BY 1")
oracle("fresh_files", """SELECT '/in/' || doc_id AS path, n_chars + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS length FROM documents WHERE doc_id % 3 = 0 OR doc_id % 10 = 1""")
oracle("batch_merges", f"""WITH {DOCS}, placed AS (SELECT *, sum(CASE WHEN encrypted THEN 0 ELSE page_count END) OVER (PARTITION BY doc_id // 100 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM docs)
  SELECT CAST(doc_id // 100 AS VARCHAR) AS merge_id, doc_id, CASE WHEN NOT encrypted THEN CAST(coalesce(before, 0) + 1 AS BIGINT) END AS first_page, CASE WHEN encrypted THEN 'encrypted' END AS skipped FROM placed""")
oracle("throttle", """WITH RECURSIVE e AS (SELECT event_type AS task_id, event_id * 10 AS t, event_id AS seq, user_id = 7 AS forced FROM events),
  nx AS MATERIALIZED (SELECT a.task_id, a.seq, (SELECT min(b.seq) FROM e b WHERE b.task_id = a.task_id AND b.seq > a.seq AND (b.t >= a.t + 80 OR b.forced)) AS nxt FROM e a),
  kept AS (SELECT task_id, min(seq) AS seq FROM e GROUP BY 1 UNION ALL SELECT k.task_id, nx.nxt FROM kept k JOIN nx ON nx.task_id = k.task_id AND nx.seq = k.seq WHERE nx.nxt IS NOT NULL)
  SELECT task_id, seq FROM kept""")
oracle("log_tail", f"WITH {TASKS} SELECT task_id, status FROM tasks ORDER BY seq DESC LIMIT 500")
