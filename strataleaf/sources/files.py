"""Files: formats, routing, validation, names and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.config import StructureConfig

# Suffixes of supported files.
FORMATS = {
    ".pdf": "pdf",
    ".docx": "docx",
    ".doc": "docx",
    ".html": "html",
    ".htm": "html",
    ".md": "markdown",
    ".markdown": "markdown",
    ".epub": "epub",
    ".pptx": "pptx",
    ".ppt": "pptx",
    ".png": "image",
    ".jpg": "image",
    ".jpeg": "image",
    ".tiff": "image",
    ".tif": "image",
}
MAX_MB = 500
MEGABYTE = 1024 * 1024


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def source_format(path: Column) -> Column:
    """Format by suffix; null for unsupported ones."""
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.element_at(table, suffix(path))


def usable_outlines(documents: DataFrame, toc: DataFrame, least: int = 2) -> DataFrame:
    """documents with has_outline: two or more outline entries, whatever they hold."""
    counts = toc.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return documents.join(counts, "doc_id", "left").withColumn("has_outline", F.coalesce(F.col("_n") >= least, F.lit(False))).drop("_n")


def sanitise_outline(toc: DataFrame) -> DataFrame:
    """Outline entries with a page and a title."""
    return toc.where("page_start >= 1").where(F.trim(F.coalesce("title", F.lit(""))) != "")


def route(path: Column, has_outline: Column, config: StructureConfig = StructureConfig()) -> Column:  # noqa: B008
    """Which plan reads a file: a parser, the page model, or an error text."""
    fmt = source_format(path)
    model = F.lit(config.page_model_available)
    return (
        F.when(fmt.isNull(), F.concat(F.lit("error: unsupported file format "), suffix(path)))
        .when((fmt == "image") & model, "page model")
        .when(fmt == "image", "error: images need the page model")
        .when((fmt == "pdf") & ~has_outline & model, "page model")
        .otherwise(F.concat(fmt, F.lit(" parser")))
    )


def fast_or_slow(fmt: Column, has_outline: Column, heading_count: Column, least: int = 2) -> Column:
    fast = ((fmt == "pdf") & has_outline) | (fmt.isin("docx", "html", "markdown") & (heading_count >= least)) | fmt.isin("epub", "pptx")
    return F.when(fast, "fast").otherwise("slow")


def dispatch(files: DataFrame, plans: dict) -> DataFrame:
    """Each format's files through its own plan (DataFrame -> DataFrame), united by name."""
    out = None
    for fmt, plan in plans.items():
        part = plan(files.where(source_format(F.col("path")) == fmt))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", x)


def size_text(size: Column) -> Column:
    """Size in B, KB, MB or GB with one decimal."""
    out = F.when(size == 0, "0 B")
    for k, unit in enumerate(("B", "KB", "MB")):
        out = out.when(size < 1024 ** (k + 1), F.concat(one_decimal(size / F.lit(float(1024**k))), F.lit(f" {unit}")))
    return out.otherwise(F.concat(one_decimal(size / F.lit(float(1024**3))), F.lit(" GB")))


def validation_error(path: Column, size: Column) -> Column:
    """Null for a file that can be taken, else why not."""
    name = F.when(suffix(path) == "", "<missing extension>").otherwise(suffix(path))
    mb = size / F.lit(float(MEGABYTE))
    return F.when(source_format(path).isNull(), F.concat(F.lit("Unsupported format: "), name, F.lit(f". Accepted: {', '.join(FORMATS)}"))).when(mb > MAX_MB, F.concat(F.lit("File too large: "), one_decimal(mb), F.lit(f"MB. Max: {MAX_MB}MB")))


def base_name(path: Column) -> Column:
    """Name for downloads: the last suffix off."""
    return F.regexp_replace(path, r"\.[^.]*$", "")


def stem(path: Column) -> Column:
    """File name without folders and its last suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def viewer(fmt: Column) -> Column:
    return F.when(fmt == "pdf", "pdf viewer").when(fmt == "html", "frame").otherwise("link")


def is_inside(path: Column) -> Column:
    """A relative asset path that stays inside its folder once ``.`` and ``..`` are resolved."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(a, p):
        depth = a["depth"] + F.when(p == "..", -1).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(a["least"], depth).alias("least"))

    end = F.aggregate(parts, start, step)
    return ~F.startswith(path, F.lit("/")) & (end["least"] >= 0) & (end["depth"] > 0)


def asset_url(job_id: Column, path: Column) -> Column:
    return F.when(job_id.isNotNull() & F.startswith(path, F.lit("assets/")), F.concat(F.lit("/asset/"), job_id, F.lit("/"), path)).otherwise(path)


def write_outputs(results: DataFrame, folder: str, kind: str = "both") -> None:
    """Writes (doc_id, json, markdown) as text, a folder for each document and format."""
    if kind not in ("json", "markdown", "both"):
        raise ValueError("kind is json, markdown or both")
    for name in ("json", "markdown"):
        if kind in (name, "both"):
            results.select("doc_id", F.col(name).alias("value")).write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\n").text(f"{folder}/{name}")
