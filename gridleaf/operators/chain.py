"""Chains of actions: type flow, description and lazy execution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
IMAGES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff", "heic", "heif", "avif")
OFFICE = (
    "csv", "doc", "docm", "docx", "dps", "et", "md", "odp", "ods", "odt", "ppt", "pptm", "pptx", "rtf", "tsv", "txt",
    "wps", "xls", "xlsb", "xlsm", "xlsx",
)
ACTIONS = {  # id: (accepted extensions, output extension or None for unchanged, takes a whole batch)
    "image.watermark": (IMAGES, None, False),
    "image.ocr": (IMAGES, "txt", False),
    "image.to_excel": (IMAGES, "xlsx", False),
    "doc.to_pdf": (OFFICE, "pdf", False),
    "pdf.to_word": (("pdf",), "docx", False),
    "pdf.watermark": (("pdf",), "pdf", False),
    "pdf.merge": (("pdf",), "pdf", True),
    "pdf.split": (("pdf",), "pdf", False),
    "pdf.rotate": (("pdf",), "pdf", False),
    "pdf.compress": (("pdf",), "pdf", False),
    "pdf.extract_pages": (("pdf",), "pdf", False),
    "pdf.to_images": (("pdf",), "png", False),
    "pdf.info": (("pdf",), "json", False),
    "pdf.searchable": (("pdf",), "pdf", False),
    "pipeline": ((), None, False),
}
MAX_STEPS = 12
# --------------------------------------------------------------------------


def _lookup(values: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def validate_chain(files: DataFrame, ext: Column, steps: Column) -> DataFrame:
    """Adds ``error, final_ext, flow``: the type flow of each file's chain, folded over its steps.

    The action table is a constant on the row. ``flow`` reads like ``pdf.rotate .pdf -> .pdf``.
    """
    accepts = _lookup({k: F.array(*[F.lit(e) for e in v[0]]).cast("array<string>") for k, v in ACTIONS.items()})
    becomes = _lookup({k: F.lit(v[1]).cast("string") for k, v in ACTIONS.items()})
    batch = [k for k, v in ACTIONS.items() if v[2]]
    state = "struct<ext:string,error:string,flow:array<string>,no:int>"
    start = F.struct(
        ext.alias("ext"), F.lit(None).cast("string").alias("error"), F.array().cast("array<string>").alias("flow"), F.lit(1).alias("no")
    ).cast(state)

    def step(acc: Column, action: Column) -> Column:
        taken = F.try_element_at(accepts, action)
        label = F.concat(F.lit("step "), acc["no"].cast("string"), F.lit(" "), action)
        fault = (
            F.when(acc["error"].isNotNull(), acc["error"])
            .when(taken.isNull(), F.concat(label, F.lit(": unknown action")))
            .when(action == "pipeline", F.concat(label, F.lit(": chains do not nest")))
            .when(action.isin(*batch), F.concat(label, F.lit(": takes a whole batch")))
            .when((F.size(taken) > 0) & ~F.array_contains(taken, acc["ext"]), F.concat(label, F.lit(": does not accept ."), acc["ext"]))
        )
        out = F.coalesce(F.try_element_at(becomes, action), acc["ext"])
        line = F.concat(action, F.lit(" ."), acc["ext"], F.lit(" -> ."), out)
        return F.struct(
            F.when(fault.isNull(), out).otherwise(acc["ext"]).alias("ext"), fault.alias("error"),
            F.when(fault.isNull(), F.concat(acc["flow"], F.array(line))).otherwise(acc["flow"]).alias("flow"),
            (acc["no"] + 1).alias("no"),
        ).cast(state)

    done = F.aggregate(steps, start, step)
    size = F.coalesce(F.size(steps), F.lit(0))
    shape = F.when(size <= 0, "a chain needs a step").when(size > MAX_STEPS, "too many steps")
    last = F.try_element_at(becomes, F.try_element_at(steps, F.lit(-1)))
    return files.withColumn("__c", done).withColumns(
        {
            "error": F.coalesce(shape, F.col("__c.error")),
            "final_ext": last,
            "flow": F.array_join(F.col("__c.flow"), "; "),
        }
    ).drop("__c")


def check_steps(ext: str, steps: list[str]) -> str | None:
    """The same check for one chain before a plan is built; the error or None."""
    if not steps:
        return "a chain needs a step"
    if len(steps) > MAX_STEPS:
        return "too many steps"
    for no, action in enumerate(steps, 1):
        label = f"step {no} {action}"
        if action not in ACTIONS:
            return f"{label}: unknown action"
        accepts, out, whole_batch = ACTIONS[action]
        if action == "pipeline":
            return f"{label}: chains do not nest"
        if whole_batch:
            return f"{label}: takes a whole batch"
        if accepts and ext not in accepts:
            return f"{label}: does not accept .{ext}"
        ext = out or ext
    return None


Step = tuple[str, Callable[[DataFrame], DataFrame]]


def run_chain(rows: DataFrame, steps: list[Step], ext: str) -> DataFrame:
    """Feed each step's rows to the next, as one lazy plan without files in between.

    A step may set ``error`` on a row; later steps leave such rows alone and ``failed_step`` names the step.
    """
    problem = check_steps(ext, [name for name, _ in steps])
    if problem:
        raise ValueError(problem)
    for name in ("error", "failed_step"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    for no, (name, work) in enumerate(steps, 1):
        rows = rows.transform(work)
        if "error" in rows.columns:
            fresh = F.col("error").isNotNull() & F.col("failed_step").isNull()
            rows = rows.withColumn("failed_step", F.when(fresh, f"{no} {name}").otherwise(F.col("failed_step")))
    return rows
