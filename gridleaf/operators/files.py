"""File-table operators: inventory, kinds, routing and output names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import CHUNK, null_safe_join, number_rows

# --- fixed values ---------------------------------------------------------
KINDS = {
    "image": ["jpg", "jpeg", "png", "gif", "webp", "bmp", "tif", "tiff", "heic", "heif", "avif", "ico", "svg", "jfif"],
    "pdf": ["pdf"],
    "word": ["doc", "docx", "docm", "rtf", "odt", "wps"],
    "excel": ["xls", "xlsx", "xlsm", "xlsb", "csv", "tsv", "ods", "et"],
    "ppt": ["ppt", "pptx", "pptm", "odp", "dps"],
    "text": ["txt", "md", "markdown", "json", "xml", "html", "htm", "log", "yaml", "yml"],
    "archive": ["zip", "rar", "7z", "tar", "gz"],
}
SKIPPED_FOLDERS = [
    "node_modules", ".git", ".venv", "__pycache__", "$RECYCLE.BIN", "System Volume Information", "Windows",
    "Program Files", "Program Files (x86)", "AppData", ".cache", "dist", "out",
]
IMPORT_LIMIT, IMPORT_DEPTH = 20_000, 12  # of one batch of the desktop import, for callers that want it
PREFERENCES = ("local", "cloud", "auto")
# --------------------------------------------------------------------------

ENGINE = "struct<id:string,offline:boolean,available:boolean>"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(name: Column) -> Column:
    """Lower-case extension without the dot; a leading dot starts a name, not an extension."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def file_inventory(files: DataFrame, root: str = "/", max_files: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Non-empty files, once per path, outside the skipped folders: all of them, unless the caller sets a limit.

    ``max_files`` keeps the first ones by path, ``max_depth`` those with so many folders at most.
    """
    below = F.substring(F.col("path"), len(root.rstrip("/")) + 2, F.length("path"))
    folders = F.slice(F.split(below, "/"), 1, F.greatest(F.size(F.split(below, "/")) - 1, F.lit(0)))
    skipped = F.arrays_overlap(folders, F.array(*[F.lit(s) for s in SKIPPED_FOLDERS]))
    shallow = F.lit(True) if max_depth is None else F.size(folders) <= max_depth
    listed = files.where((F.col("length") > 0) & ~skipped & shallow).dropDuplicates(["path"])
    return listed if max_files is None else listed.orderBy("path").limit(max_files)


def classify(ext: Column) -> Column:
    """Extension to one of seven kinds, else ``unknown``."""
    kind = F.lit("unknown")
    for name, exts in KINDS.items():
        kind = F.when(ext.isin(*exts), name).otherwise(kind)
    return kind


def accept_split(files: DataFrame, accepts: list[str]) -> DataFrame:
    """Adds ``status`` and ``reason``: unaccepted files stay, as skipped. An empty list accepts all."""
    ext = extension(file_name(F.col("path")))
    good = ext.isin(*accepts) if accepts else F.lit(True)
    return files.withColumns(
        {
            "status": F.when(good, "queued").otherwise("skipped"),
            "reason": F.when(~good, F.concat(F.lit("does not accept ."), ext)),
        }
    )


def add_new_files(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing files and those incoming ones whose path is new."""
    return existing.unionByName(incoming.join(existing.select("path"), "path", "left_anti").select(*existing.columns))


def relative_target_dir(path: Column, root: str, out: str, keep_tree: bool = True) -> Column:
    """Output folder of a file: its place below ``root``, or the output root when outside it."""
    folder = F.regexp_replace(path, "/[^/]*$", "")
    base = root.rstrip("/")
    inside = folder.startswith(base + "/") | (folder == base)
    tail = F.substring(folder, len(base) + 1, F.length(folder))
    return F.when(inside & F.lit(keep_tree), F.concat(F.lit(out.rstrip("/")), tail)).otherwise(out.rstrip("/"))


def glob_regex(pattern: str) -> str:
    """A file-name pattern (``*``, ``?``, ``[..]``, ``[!..]``) as a regular expression over the whole name."""
    out = []
    for part in re.findall(r"\[!?\]?[^\]]*\]|.", pattern, re.S):
        if part == "*":
            out.append(".*")
        elif part == "?":
            out.append(".")
        elif len(part) > 1:
            inner = part[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[^" + inner[1:] + "]" if inner.startswith("!") else "[" + inner + "]")
        else:
            out.append("\\" + part if part in r"\.^$+(){}|[]" else part)
    return "(?s)^" + "".join(out) + "$"


def sensitive_match(name: Column, patterns: list[str]) -> Column:
    """First pattern that the lower-cased name matches, in list order; null for none."""
    hit = F.lit(None).cast("string")
    for pattern in reversed([p for p in patterns if p.strip()]):
        hit = F.when(F.lower(name).rlike(glob_regex(pattern.strip().lower())), pattern).otherwise(hit)
    return hit


def engine_list(engines: list[tuple[str, bool, bool]]) -> Column:
    """``(id, offline, available)`` tuples, best first, as one array column."""
    items = [F.struct(F.lit(i).alias("id"), F.lit(o).alias("offline"), F.lit(a).alias("available")) for i, o, a in engines]
    return F.array(*items).cast(f"array<{ENGINE}>")


def route_plan(files: DataFrame, engines: list[tuple[str, bool, bool]], cloud_enabled: bool, fallback: bool = True) -> DataFrame:
    """Adds ``candidates`` (engine ids in order of trial) and ``notes``.

    Uses ``preference``, ``sensitive`` (pattern or null) and ``allowed`` (array, empty for all). The
    handful of engines is an array on the row: no join.
    """
    ready = F.filter(engine_list(engines), lambda e: e["available"])
    ids = lambda found: F.transform(found, lambda e: e["id"])
    none = F.array().cast("array<string>")
    pref = F.when(F.col("preference").isin(*PREFERENCES), F.col("preference")).otherwise("local")
    free = F.filter(ready, lambda e: (F.size("allowed") == 0) | F.array_contains("allowed", e["id"]))
    local = ids(F.filter(free, lambda e: e["offline"]))
    wants = pref != "local"
    cloud = F.when(wants & F.lit(cloud_enabled), ids(F.filter(free, lambda e: ~e["offline"]))).otherwise(none)
    n_local, n_cloud = F.size(local) > 0, F.size(cloud) > 0
    hit = F.col("sensitive").isNotNull()
    order = (
        F.when(hit, ids(F.filter(ready, lambda e: e["offline"])))
        .when(pref == "local", local)
        .when(pref == "cloud", F.concat(cloud, local) if fallback else cloud)
        .otherwise(F.concat(cloud, local))
    )
    notes = F.array_compact(
        F.array(
            F.when(hit, F.concat(F.lit("sensitive name: "), F.col("sensitive"))),
            F.when(~hit & wants & ~F.lit(cloud_enabled), "cloud disabled"),
            F.when(~hit & (pref == "cloud") & ~n_cloud & n_local & F.lit(fallback), "fell back to local"),
            F.when(~hit & (pref == "auto") & n_cloud, "auto: cloud first"),
            F.when(~hit & (pref == "auto") & ~n_cloud & n_local, "auto: local only"),
        )
    )
    return files.withColumns({"candidates": order, "notes": notes})


def aggregate_name(template: str, date: str, count: Column) -> Column:
    """Name of a batch result: ``{count}`` and ``{date}`` filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("{count}"), count.cast("string")), F.lit("{date}"), F.lit(date))


def target_names(files: DataFrame, target_dir: Column, suffix: str = "", ext: str | None = None) -> DataFrame:
    """Adds ``dir, stem, ext``: the name a result would like to have."""
    name = file_name(F.col("path"))
    own = extension(name)
    stem = F.when(F.length(own) > 0, F.substring(name, F.lit(1), F.length(name) - F.length(own) - 1)).otherwise(name)
    return files.withColumns(
        {"dir": target_dir, "stem": F.concat(stem, F.lit(suffix)), "ext": F.lit(ext.lower().lstrip(".")) if ext else own}
    )


def _numbered(names: DataFrame) -> DataFrame:
    """``dir, stem, ext, num``: the numbers a name family has used; the plain name is number 1."""
    got = names.select(
        "dir", "ext", F.regexp_extract("stem", r"^(?s)(.*) \((\d{1,9})\)$", 1).alias("base"),
        F.regexp_extract("stem", r"^(?s)(.*) \((\d{1,9})\)$", 2).try_cast("int").alias("n"), "stem",
    )
    plain = got.select("dir", "stem", "ext", F.lit(1).alias("num"))
    numbered = got.where((F.col("n") >= 2) & (F.length("base") > 0)).select("dir", F.col("base").alias("stem"), "ext", F.col("n").alias("num"))
    return plain.unionByName(numbered)


def resolve_names(named: DataFrame, existing: DataFrame, policy: str = "rename") -> DataFrame:
    """Adds ``output`` and ``status`` to rows with ``dir, stem, ext, seq``; ``existing`` holds ``dir, stem, ext``.

    ``rename`` gives the k-th file of a name the k-th free number (``name``, ``name (2)``, ...); a
    number that another file of the batch carries as its own name stays with that file. ``skip`` lets the
    first file of a free name through and marks the rest skipped, ``overwrite`` takes the plain name.
    Used numbers become runs, so a folder with a million numbered copies is a few intervals.
    """
    keys = ["dir", "stem", "ext"]
    dot = F.when(F.length("ext") > 0, F.concat(F.lit("."), F.col("ext"))).otherwise("")

    def full(number: Column) -> Column:
        tail = F.when(number > 1, F.concat(F.lit(" ("), number.cast("string"), F.lit(")"))).otherwise("")
        return F.concat("dir", F.lit("/"), "stem", tail, dot)

    one = F.lit(1).cast("bigint")
    if policy == "overwrite":
        return named.withColumns({"output": full(one), "status": F.lit("queued")})
    if policy == "skip":
        ranked = number_rows(named, keys, [F.floor(F.col("seq") / CHUNK)], ["seq"], "__k")
        there = existing.select(*keys).distinct().withColumn("__there", F.lit(True))
        joined = null_safe_join(ranked, there, keys, "left")
        taken = F.coalesce("__there", F.lit(False)) | (F.col("__k") > 0)
        return joined.withColumns({"output": full(one), "status": F.when(taken, "skipped").otherwise("queued")}).drop("__k", "__there")

    return _free_numbers(named, existing, keys).withColumns({"output": full(F.col("__number")), "status": F.lit("queued")}).drop("__number")


def _free_numbers(named: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``__number``: the k-th file of a family, by ``seq``, gets the k-th number that the family has not used.

    Used numbers are summed up in cells of ``CHUNK``; only these summaries meet by family. There each run of used
    numbers learns how many numbers are free before it and how many are used up to its end, so that ranking the files
    and looking up their numbers are two ordered merges in cells of bounded size: no array of runs lies on a row, and
    a family of any size is spread over the cluster. Files with equal ``seq`` come in any order; nulls come first.
    """
    family = F.struct(*keys).alias("__f")

    def cell(position: str) -> Column:
        return F.floor(F.col(position) / CHUNK)

    own = _numbered(named.select(*keys)).where(F.col("num") > 1)
    used = _numbered(existing.select(*keys)).unionByName(own).select(family, F.lit(1).alias("__side"), cell("num").alias("__cell"), "num")
    asked = named.select(family, F.lit(0).alias("__side"), cell("seq").alias("__cell"), F.lit(None).cast("int").alias("num"))
    cells = asked.unionByName(used).groupBy("__f", "__side", "__cell").agg(
        F.count(F.lit(1)).alias("__rows"), F.array_sort(F.collect_set("num")).alias("__nums")
    )
    pairs = F.transform("__nums", lambda x, i: F.struct(x.cast("bigint").alias("x"), i.cast("bigint").alias("i")))
    starts = F.filter(pairs, lambda s: F.coalesce(F.get("__nums", (s["i"] - 1).cast("int")) != s["x"] - 1, F.lit(True)))
    size = F.when(F.col("__side") == 0, F.col("__rows")).otherwise(F.size("__nums")).cast("bigint")
    cells = cells.select("__f", "__side", "__cell", size.alias("__size"), starts.alias("__starts")).repartition("__f")

    earlier = W.partitionBy("__f", "__side").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    wanted = F.sum(F.when(F.col("__side") == 0, F.col("__size"))).over(W.partitionBy("__f"))
    cells = cells.withColumns({"__before": F.coalesce(F.sum("__size").over(earlier), F.lit(0)), "__wanted": wanted})
    runs = cells.where(F.col("__wanted") > 0).select(
        "__f", "__side", "__cell", "__before", "__size", "__wanted", F.explode_outer("__starts").alias("__start")
    )
    runs = runs.withColumn("__index", F.col("__before") + F.col("__start.i"))
    runs = runs.withColumn("__free", F.col("__start.x") - 1 - F.col("__index"))
    along = W.partitionBy("__f").orderBy("__side", "__start.x")
    runs = runs.withColumns(
        {
            "__upto": F.coalesce(F.lead("__index").over(along), F.col("__before") + F.col("__size")),
            "__till": F.least(F.lead("__free").over(along), F.col("__wanted")),  # least passes over a null
        }
    )
    # A run holds for the files ranked from "__free" to before "__till"; every cell on the way gets it at its start.
    is_run = F.col("__side") == 1
    span = F.when(is_run, F.sequence(cell("__free"), F.floor((F.col("__till") - 1) / CHUNK))).otherwise(F.array("__cell"))
    marks = runs.where(~is_run | (F.col("__free") < F.col("__till"))).withColumn("__cell", F.explode(span))
    rows = named.select(family, F.lit(0).alias("__side"), cell("seq").alias("__cell"), F.col("seq").alias("__seq"), F.struct(*named.columns).alias("__row"))
    marks = marks.select(
        "__f", "__side", "__cell", F.when(~is_run, F.col("__before")).alias("__before"), F.when(is_run, F.col("__upto")).alias("__upto"),
        F.when(is_run, F.greatest("__free", F.col("__cell") * CHUNK)).alias("__at"),
    )
    merged = rows.unionByName(marks, allowMissingColumns=True)

    # A cell's summary comes first and carries the number of files in earlier cells.
    inside = W.partitionBy("__f", "__side", "__cell").orderBy(F.col("__row").isNotNull(), "__seq")
    rank = F.first("__before").over(inside) + F.row_number().over(inside) - 2
    merged = merged.withColumn("__at", F.when(is_run, F.col("__at")).otherwise(rank)).where(is_run | F.col("__row").isNotNull())
    reached = W.partitionBy("__f", "__cell").orderBy("__at", F.desc("__side")).rowsBetween(W.unboundedPreceding, 0)
    merged = merged.withColumn("__cell", cell("__at"))
    merged = merged.withColumn("__number", F.col("__at") + 1 + F.coalesce(F.max("__upto").over(reached), F.lit(0)))
    return merged.where(F.col("__row").isNotNull()).select("__row.*", "__number")
