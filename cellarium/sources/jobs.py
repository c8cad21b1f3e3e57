"""Job lists pasted as text: one job a line, split at the first of tab, comma, ;, | and white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _csv(line: Column) -> Column:
    """The fields of a CSV line: quotes hold commas, two of them are one."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(\s*"(?:[^"]|"")*"[^,]*|[^,]*)'), F.lit(1))
    return F.transform(fields, lambda x: F.replace(F.regexp_replace(x, r'^\s*"((?:[^"]|"")*)"', "$1"), F.lit('""'), F.lit('"')))


def parse_job_text(lines: DataFrame, header: str = "auto") -> DataFrame:
    """lines(job_text_id, line_no, line) to (job_text_id, line_no, job_number, part_number).

    Empty fields are dropped; with one field the part is empty. The first line of a text that is not blank is a header
    if its first field mentions a job, order or wo (``header``: auto, true or false).
    """
    t = F.trim("line")
    sep = (
        F.when(t.contains("\t"), F.split(t, "\t")).when(t.contains(","), _csv(t))
        .when(t.contains(";"), F.split(t, ";")).when(t.contains("|"), F.split(t, r"\|")).otherwise(F.split(t, r"\s+"))
    )
    fields = F.filter(F.transform(sep, lambda x: F.trim(x)), lambda x: x != "")
    rows = lines.withColumn("f", fields).filter("size(f) > 0")
    if header != "false":
        first = rows.groupBy("job_text_id").agg(F.min("line_no").alias("first_no"))
        rows = rows.join(first, "job_text_id")
    head = F.lower(F.col("f")[0]).rlike("job|order|wo")
    drop = F.lit(False) if header == "false" else (F.col("line_no") == F.col("first_no")) & (head if header == "auto" else F.lit(True))
    return rows.filter(~drop).select(
        "job_text_id", "line_no", F.col("f")[0].alias("job_number"), F.coalesce(F.get("f", F.lit(1)), F.lit("")).alias("part_number")
    )


def parse_job_sheets(facts: DataFrame) -> DataFrame:
    """(doc_id, original_index, job_number, part_number): the job list on each workbook's first sheet.

    The last header among five rows names the job and the part column (without one: the first two,
    from the first row). Rows without both are dropped; a part without a job is named by its place.
    """
    first = facts.filter("kind = 'cell' and sheet_idx = 0 and trim(v_str) <> ''").withColumn("norm", F.lower(F.trim("v_str")))
    is_job, is_part = F.col("norm").rlike("job|order|wo"), F.col("norm").rlike("part|item|pn")
    top = (F.col("row") <= 5) & (F.col("col") <= 14)
    last = lambda hit: F.max(F.when(top & hit, F.struct("row", "col")))
    head = first.groupBy("doc_id").agg(last(is_job).alias("j"), last(is_part & ~is_job).alias("p")).select(
        "doc_id", F.coalesce("j.col", F.lit(1)).alias("job_col"), F.coalesce("p.col", F.lit(2)).alias("part_col"),
        F.coalesce(F.greatest("j.row", "p.row"), F.lit(0)).alias("head_row"),
    )
    value = lambda c: F.max(F.when(F.col("col") == F.col(c), F.trim("v_str")))
    named = lambda c: F.when(F.lower(c).isin("none", "-", "nan"), "").otherwise(F.coalesce(c, F.lit("")))
    rows = first.join(head, "doc_id").filter("row > head_row").groupBy("doc_id", "row").agg(value("job_col").alias("job"), value("part_col").alias("part"))
    rows = rows.select("doc_id", "row", named("job").alias("job"), named("part").alias("part_number")).filter("job <> '' or part_number <> ''")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("row")) - 1
    rows = rows.withColumn("original_index", at)
    number = F.when(F.col("job") == "", F.concat(F.lit("JOB-"), (F.col("original_index") + 1).cast("string"))).otherwise(F.col("job"))
    return rows.select("doc_id", "original_index", number.alias("job_number"), "part_number")


def read_job_csv(spark: SparkSession, path: str) -> DataFrame:
    """Job lists in CSV files, one text for each file."""
    lines = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("job_text_id"), F.posexplode(F.split(F.expr("decode(content, 'utf-8')"), r"\r?\n")).alias("line_no", "line")
    )
    return parse_job_text(lines)
