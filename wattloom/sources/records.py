"""Record-tagged CSV: C comment, I column names, D data; and archives holding it."""
from __future__ import annotations

import io
import shutil
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A field of a record: quoted, with doubled quotes inside, or plain.
FIELD = r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'


def tagged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, place) of every text line below path; place orders the lines of a file.  Splits of large files read in parallel."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), place.alias("place"))


def fields_of(line: Column) -> Column:
    """All fields of a record, however many; an empty field is null."""
    plain = lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)     # noqa: E731
    return F.transform(F.regexp_extract_all(line, F.lit(FIELD), F.lit(1)), lambda x: F.nullif(plain(x), F.lit("")))


def parse_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header rows (file, table, version, names) and data rows (..., fields).

    The first letter is tested before the line is split, so other records are never parsed.  Where a
    file has several headers of a table version, the last stands."""
    d = lines.filter(F.col("line").rlike("^[ID],")).withColumn("_r", fields_of(F.col("line")))
    d = d.select("file", "place", F.get("_r", F.lit(0)).alias("tag"), F.concat_ws("_", F.get("_r", F.lit(1)), F.get("_r", F.lit(2))).alias("table"),
                 F.get("_r", F.lit(3)).alias("version"), F.slice("_r", F.lit(5), F.greatest(F.size("_r") - 4, F.lit(0))).alias("fields"))
    heads = d.filter("tag = 'I'").groupBy("file", "table", "version").agg(F.max_by(F.filter("fields", lambda x: x.isNotNull()), "place").alias("names"))
    return heads, d.filter("tag = 'D'").drop("tag", "place")


def issue_times(lines: DataFrame, report: str) -> DataFrame:
    """(file, issued_at): the date and time in the sixth and seventh field of a file's first line, where its third names the report."""
    first = lines.filter(F.col("line").startswith("C,")).groupBy("file").agg(F.min_by("line", "place").alias("_l")).withColumn("_f", fields_of(F.col("_l")))
    return first.filter(F.get("_f", F.lit(2)) == report).select("file", F.concat_ws(" ", F.get("_f", F.lit(5)), F.get("_f", F.lit(6))).alias("issued_at"))


def tagged_scan(lines: DataFrame, table: str, columns: list[str], issued: str | None = None) -> DataFrame:
    """Chosen columns of one table as text.  Data rows find their column positions through
    the header of the same (file, table, version); short rows and absent columns give null.  With issued, the
    name of a report, ISSUED_AT is added from the first line of its files."""
    heads, rows = parse_records(lines)
    heads = heads.filter(F.col("table") == table)
    pos = heads.select("file", "version", *[F.array_position("names", c).cast("int").alias(f"_p{i}") for i, c in enumerate(columns)])
    d = rows.filter(F.col("table") == table).join(pos, ["file", "version"])
    d = d.select("file", "version", *[F.when(F.col(f"_p{i}") > 0, F.get("fields", F.col(f"_p{i}") - 1)).alias(c) for i, c in enumerate(columns)])
    return d if issued is None else d.join(issue_times(lines, issued).withColumnRenamed("issued_at", "ISSUED_AT"), "file", "left")


def all_tables(lines: DataFrame) -> DataFrame:
    """Every record of every table as a name-to-value map, ready to be written partitioned by table."""
    heads, rows = parse_records(lines)
    d = rows.join(heads, ["file", "table", "version"])
    return d.select("file", "table", "version", F.map_from_arrays("names", F.transform("names", lambda _, i: F.get("fields", i))).alias("record"))


def filtered_scan(df: DataFrame, columns: list[str], ids: DataFrame | None = None, times: DataFrame | None = None) -> DataFrame:
    """Keep columns and the rows whose id or time is listed, as semi-joins that reduce the scan early."""
    out = df
    for want in (ids, times):
        if want is not None:
            out = out.join(want.distinct(), want.columns, "left_semi")
    return out.select(*columns)


def _members(name: str, source, piece: int) -> Iterator[tuple[str, int, str]]:
    """(member, part, text) of an archive and the archives in it, read as a stream."""
    with zipfile.ZipFile(source) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            member = f"{name}/{info.filename}"
            if info.filename.lower().endswith(".zip"):
                with tempfile.SpooledTemporaryFile(max_size=1 << 26) as inner, z.open(info) as f:      # the task's own scratch, gone with the member
                    shutil.copyfileobj(f, inner)
                    inner.seek(0)
                    yield from _members(member, inner, piece)
                continue
            with io.TextIOWrapper(z.open(info), encoding="utf-8", newline="") as f:
                part = 0
                while text := f.read(piece):
                    if not text.endswith("\n"):
                        text += f.readline()                 # a piece ends with a line
                    yield member, part, text
                    part += 1
                if part == 0:
                    yield member, 0, ""


def expand_archives(files: DataFrame, piece: int = 1 << 24) -> DataFrame:
    """(path, content) of ZIP files, as read by the binaryFile source, to (path, member, part, text).

    Members may be of any size and archives nested to any depth: a member is read as a stream and given
    out in parts of about ``piece`` characters that end with a line.  Archives are independent, so this is a map over the files."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, blob in zip(b["path"], b["content"]):
                for member, part, text in _members("", io.BytesIO(blob), piece):
                    yield pd.DataFrame({"path": [path], "member": [member.lstrip("/")], "part": [part], "text": [text]})
    return files.select("path", "content").mapInPandas(run, "path string, member string, part int, text string")
