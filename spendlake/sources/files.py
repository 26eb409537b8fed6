"""Raw files: reading, encoding, type detection and upload checks.

A file is one row (path, length, content), at most what one row can hold (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.quality import sanitize_filename
from spendlake.functions.rules import any_of, case_of

MAX_PARSE_BYTES = 50 * 1024 * 1024

# Byte order marks, in trial order; no mark means UTF-8.
BYTE_ORDER_MARKS = [("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE")]

# First bytes of a file and the parser they select.
MAGIC = [("25504446", "pdf"), ("504B", "excel"), ("D0CF11E0", "excel")]
EXTENSIONS = {"pdf": "pdf", "csv": "csv", "txt": "csv", "xlsx": "excel", "xls": "excel", "xlsm": "excel"}
DELIMITERS = [",", ";", "\t", "|"]

# Content types by first bytes, and extensions allowed per upload class.
SIGNATURES = [
    ("25504446", "application/pdf"),
    ("FFD8FF", "image/jpeg"),
    ("89504E470D0A1A0A", "image/png"),
    ("474946383761", "image/gif"),
    ("474946383961", "image/gif"),
    ("504B0304", "application/zip"),
]
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
ALLOWED = {
    "document": {
        "application/pdf": [".pdf"],
        "image/jpeg": [".jpg", ".jpeg"],
        "image/png": [".png"],
        "text/csv": [".csv"],
        XLSX: [".xlsx"],
    },
    "image": {"image/jpeg": [".jpg", ".jpeg"], "image/png": [".png"], "image/gif": [".gif"]},
}
SIZE_LIMITS = {"document": 10 * 1024 * 1024, "image": 5 * 1024 * 1024}
DANGEROUS = ["<script", "javascript:", "vbscript:", "data:text/html", "expression(", "<?php", "<%"]


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """All files below a folder as (path, length, content)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", "content")


def starts_with(content: Column, hex_bytes: str) -> Column:
    return F.startswith(content, F.unhex(F.lit(hex_bytes)))


def encoding_of(content: Column) -> Column:
    return case_of([(starts_with(content, mark), F.lit(name)) for mark, name in BYTE_ORDER_MARKS], "UTF-8")


def has_valid_utf8(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def decode_text(content: Column) -> Column:
    """Text of the file without its byte order mark.

    Bytes that are not UTF-8 are read as ISO-8859-1, which accepts all of them.
    """
    size = F.octet_length(content)
    branches = [
        (starts_with(content, mark), F.decode(F.substring(content, len(mark) // 2 + 1, 2**31 - 1), name))
        for mark, name in BYTE_ORDER_MARKS[1:]
    ]
    utf8_bom = starts_with(content, "EFBBBF")
    body = F.when(utf8_bom, F.substring(content, 4, 2**31 - 1)).otherwise(content)
    plain = F.when(has_valid_utf8(body), body.cast("string")).otherwise(F.decode(body, "ISO-8859-1"))
    return F.when(size == 0, F.lit("")).otherwise(case_of(branches, plain))


def to_lines(files: DataFrame) -> DataFrame:
    """(file, line_no from 0, line) of all files, whatever their size; ``validate_files`` reports large ones."""
    text = decode_text(F.col("content"))
    return files.select(
        F.col("path").alias("file"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    ).withColumn("line", F.regexp_replace("line", "\r$", ""))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def head_text(content: Column, n: int) -> Column:
    """First bytes as text; bytes that are not UTF-8 are dropped."""
    return F.regexp_replace(F.make_valid_utf8(F.substring(content, 1, n).cast("string")), "�", "")


def looks_like_csv(content: Column) -> Column:
    """One delimiter occurs equally often, twice or more, on the first five non-blank lines."""
    lines = F.filter(F.slice(F.split(head_text(content, 2000), "\n"), 1, 5), lambda s: F.trim(s) != "")

    def steady(d: str) -> Column:
        counts = F.transform(lines, lambda s: F.length(s) - F.length(F.replace(s, F.lit(d), F.lit(""))))
        return (F.size(lines) > 0) & (F.array_min(counts) == F.array_max(counts)) & (F.array_min(counts) >= 2)

    return any_of(steady(d) for d in DELIMITERS)


def file_type(path: Column, content: Column) -> Column:
    """pdf, excel or csv: by first bytes, extension, then content; null if none."""
    branches = [(starts_with(content, magic), F.lit(kind)) for magic, kind in MAGIC]
    ext = extension(path)
    branches += [(ext == e, F.lit(kind)) for e, kind in EXTENSIONS.items()]
    branches.append((looks_like_csv(content), F.lit("csv")))
    return case_of(branches)


def validate_files(files: DataFrame) -> DataFrame:
    """Type of every file and why it cannot be parsed, if so."""
    kind = file_type(F.col("path"), F.col("content"))
    ext = extension(F.col("path"))
    corrupt = ((F.col("file_type") == "pdf") & ~(starts_with(F.col("content"), "25504446") & (ext == "pdf"))) | (
        (F.col("file_type") == "excel") & ~ext.isin("xlsx", "xls", "xlsm")
    ) | ((F.col("file_type") == "csv") & ~ext.isin("csv", "txt"))
    issue = (
        F.when(F.col("length") == 0, "File is empty")
        .when(F.col("length") > MAX_PARSE_BYTES, "File exceeds maximum size (50MB)")
        .when(F.col("file_type").isNull(), "Unsupported file format")
        .when(corrupt, "File appears to be corrupted or malformed")
    )
    fits = (F.col("length") > 0) & (F.col("length") <= MAX_PARSE_BYTES)
    return files.withColumn("file_type", F.when(fits, kind)).select(
        "path", "length", "file_type", F.array_compact(F.array(issue)).alias("issues"), issue.isNull().alias("is_valid")
    )


def content_type(content: Column) -> Column:
    head = F.substring(content, 1, 1000)
    zipped = starts_with(content, "504B0304")

    def holds(text: str) -> Column:
        return F.contains(head, F.encode(F.lit(text), "UTF-8"))

    branches = [(zipped & holds("xl/"), F.lit(XLSX)), (zipped & holds("word/"), F.lit(DOCX))]
    branches += [(starts_with(content, s), F.lit(t)) for s, t in SIGNATURES]
    text = has_valid_utf8(head)
    branches += [(text & holds(","), F.lit("text/csv")), (text, F.lit("text/plain"))]
    return case_of(branches, "application/octet-stream")


def is_malicious(content: Column, mime: Column) -> Column:
    """Script or template text in the first bytes, or anywhere in an image."""
    low = F.lower(head_text(content, 10000))
    in_image = mime.startswith("image/") & (
        F.contains(content, F.encode(F.lit("<script"), "UTF-8")) | F.contains(content, F.encode(F.lit("javascript:"), "UTF-8"))
    )
    return any_of(low.contains(p) for p in DANGEROUS) | in_image


def validate_uploads(files: DataFrame, upload_class: str = "document", max_size: int | None = None) -> DataFrame:
    """Upload rules per file: size, extension, content type, mismatch, dangerous content."""
    limit = max_size or SIZE_LIMITS.get(upload_class, 10 * 1024 * 1024)
    allowed = ALLOWED.get(upload_class, {})
    extensions = [e for exts in allowed.values() for e in exts]
    name = sanitize_filename(F.regexp_extract("path", r"([^/]*)$", 1))
    checked = files.withColumn("filename", name).withColumn("content_type", content_type(F.col("content")))
    dotted = F.concat(F.lit("."), extension(F.col("filename")))
    mime = F.col("content_type")
    expected = case_of([(mime == m, dotted.isin(exts)) for m, exts in allowed.items()], F.lit(True))
    rules = [
        (F.col("length") > limit, f"File exceeds maximum size of {limit / (1024 * 1024):.1f} MB"),
        (~dotted.isin(extensions), f"File type not allowed. Allowed: {', '.join(extensions)}"),
        (~mime.isin(list(allowed)), F.concat(F.lit("File content type not allowed: "), mime)),
        (~expected, "File extension does not match content type"),
        (is_malicious(F.col("content"), mime), "File contains potentially malicious content"),
    ]
    found = F.array_compact(F.array(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in rules]))
    errors = F.when(F.col("length") == 0, F.array(F.lit("File content is empty"))).otherwise(found)
    return checked.select("path", "filename", "content_type", errors.alias("errors"), (F.size(errors) == 0).alias("is_valid"))
