"""CSV sources: the positional 17-column ride upload and the drop-folder filter."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farebox import schemas as sch
from farebox.session import broadcast_if_small, cut_lineage

# Case-insensitive ``.csv`` extension (S3).
CSV_GLOB = "*.[cC][sS][vV]"


def _reader(spark: SparkSession):
    return (spark.read.schema(sch.CSV_SCHEMA_WITH_CORRUPT)
            .option("header", True).option("enforceSchema", True)
            .option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", sch.CORRUPT_COLUMN)
            .option("pathGlobFilter", CSV_GLOB))


def short_row_guard(last_field: Column, corrupt: Column) -> Column:
    """Fails the job on a row with fewer than 17 fields (the reference's CSV
    reader rejects it); rows with extra fields pass, the extras ignored."""
    return F.when(corrupt.isNotNull() & last_field.isNull(),
                  F.raise_error(F.concat(F.lit("CSV row has too few fields: "), corrupt)))


def clean_csv_rows(df: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """The 17 text columns of raw CSV rows: empty field -> '', and a row with
    too few fields fails the job. Shared by the batch and streaming scans."""
    last = sch.CSV_COLUMNS[-1]
    # The guard is NULL unless it raises; folded into the last field so it is
    # evaluated on every row that is read.
    guard = short_row_guard(F.col(last), F.col(sch.CORRUPT_COLUMN)).cast("string")
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in sch.CSV_COLUMNS[:-1]]
    cols.append(F.coalesce(guard, F.col(last), F.lit("")).alias(last))
    return df.select(*cols, *(extra or []))


def csv_scan(spark: SparkSession, path: str, with_file: bool = False,
             line_breaks: bool | None = None) -> DataFrame:
    """S1 + S3: 17 text columns by position (header names ignored), RFC 4180
    quoting with doubled quotes, blank lines skipped, empty field -> ''.

    Only non-empty ``.csv`` files (any case) are read, of any size: a silent
    skip would lose rows. ``with_file`` keeps the file path and block start, which
    fix the load order together with the row's position.

    Fields may hold line breaks inside quotes, also across the edge of two
    splits; files stay splittable either way. ``line_breaks`` says whether some
    do; by default one pass over the text looks for it. Without them each line
    is a row (the CSV reader as it is); with them records are put together
    first (``csv_records``), and ``with_file`` also gives the row's place in its
    block.
    """
    lines = text_lines(spark, path)
    if line_breaks is None:
        line_breaks = not lines.where(F.col("odd") == 1).isEmpty()
    if line_breaks:
        fields = F.from_csv("record", sch.CSV_SCHEMA_WITH_CORRUPT.toDDL(), {
            "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": sch.CORRUPT_COLUMN})
        df = csv_records(lines).select("_file", "_block", "_row", fields.alias("r")).select("_file", "_block", "_row", "r.*")
        return clean_csv_rows(df, [F.col(c) for c in ("_file", "_block", "_row")] if with_file else [])
    df = _reader(spark).csv(path)
    df = df.where(F.col("_metadata.file_size") > 0)
    extra = []
    if with_file:
        extra = [F.col("_metadata.file_path").alias("_file"),
                 F.col("_metadata.file_block_start").alias("_block")]
    return clean_csv_rows(df, extra)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the CSV files of ``path``: _file, _block (start of the
    split), _mono and _n (their order in it), line, sep (the break after it) and
    odd (1 if it holds an odd number of quotes). A line ends at a line feed or at
    a carriage return of its own; one before a line feed stays with the line."""
    parts = F.split("value", "\r(?!\\z)")
    lines = (spark.read.option("lineSep", "\n").option("pathGlobFilter", CSV_GLOB).text(path)
             .where(F.col("_metadata.file_size") > 0)
             .select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_mono"), F.size(parts).alias("_size"), F.posexplode(parts).alias("_n", "line")))
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    return lines.select("_file", "_block", "_mono", "_n", "line",
                        F.when(F.col("_n") == F.col("_size") - 1, F.lit("\n")).otherwise(F.lit("\r")).alias("sep"),
                        (quotes % 2).alias("odd"))


def csv_records(lines: DataFrame) -> DataFrame:
    """Whole records from lines, without headers and blank ones: _file, _block
    and _row (where the record starts: split and line in it) and record.

    A line starts a record if the quotes before it in its file are even. That
    takes each split's own parity, a prefix over a file's splits (one row each)
    and a running count within a split, so no file is read whole by one task.
    Only lines of records with breaks are gathered, by record; all other lines
    are records themselves. A file whose quotes are odd in all has a quoted
    field without an end: the scan fails, as it would gather the rest of the file.
    """
    split = ["_file", "_block"]
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*split).orderBy("_mono", "_n")
    parity = (lines.groupBy(*split).agg(F.sum("odd").alias("quotes"))
              .select(*split, (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("inside"), "quotes"))
    running = F.coalesce(F.sum("odd").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = (lines.select(*split, "line", "sep", "odd", F.row_number().over(here).alias("_row"), running.alias("_before"))
              .join(parity, split).withColumn("starts", (F.col("_before") + F.col("inside")) % 2 == 0))
    last = Window.partitionBy(*split).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut_lineage(placed.select(*split, "_row", "line", "sep", "odd", "starts", "quotes",
                                       F.max(F.when(F.col("starts"), F.col("_row"))).over(last).alias("_start")))
    open_ends = (placed.select(*split, "quotes").distinct().groupBy("_file").agg((F.sum("quotes") % 2).alias("odd"))
                 .where("odd = 1").orderBy("_file").limit(1).collect())
    if open_ends:
        raise ValueError(f"CSV file ends inside a quoted field: {open_ends[0]['_file']}")
    # lines before a split's first record belong to the last record of an earlier split
    tails = placed.groupBy(*split).agg(F.max("_start").alias("_tail"))
    owner = tails.select(*split, F.last(F.when(F.col("_tail").isNotNull(), F.struct("_block", "_tail")), True).over(before).alias("_owner"))
    alone = F.col("starts") & (F.col("odd") == 0)
    several = placed.where(~alone).join(broadcast_if_small(owner), split, "left")
    own = F.col("_start").isNotNull()
    gathered = (several.select("_file", F.when(own, F.col("_block")).otherwise(F.col("_owner._block")).alias("_of"),
                               F.when(own, F.col("_start")).otherwise(F.col("_owner._tail")).alias("_at"), "_block", "_row", "line", "sep")
                .groupBy("_file", "_of", "_at").agg(F.sort_array(F.collect_list(F.struct("_block", "_row", "line", "sep"))).alias("parts")))
    text = F.array_join(F.transform("parts", lambda x: F.concat(x["line"], x["sep"])), "")
    records = (placed.where(alone).select(*split, "_row", F.col("line").alias("record"))
               .union(gathered.select("_file", "_of", "_at", F.left(text, F.length(text) - 1))))
    records = (records.withColumn("record", F.regexp_replace("record", "\r\\z", ""))
               .where(F.col("record").rlike("[^\\x00-\\x20]")))
    heads = records.groupBy("_file").agg(F.min(F.struct("_block", "_row")).alias("_head"))
    heads = heads.select("_file", "_head._block", "_head._row")
    return records.join(broadcast_if_small(heads), ["_file", "_block", "_row"], "left_anti")


def csv_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """T1 source: the drop folder as a stream, one file per micro-batch by
    default, with the file path kept (it names the batch)."""
    df = (spark.readStream.schema(sch.CSV_SCHEMA_WITH_CORRUPT)
          .option("header", True).option("enforceSchema", True)
          .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", sch.CORRUPT_COLUMN)
          .option("pathGlobFilter", CSV_GLOB)
          .option("maxFilesPerTrigger", files_per_trigger).csv(path))
    return clean_csv_rows(df, [F.col("_metadata.file_path").alias("_file"),
                               F.col("_metadata.file_block_start").alias("_block")])


def literal_path(file_path: str) -> str:
    """A ``_metadata.file_path`` (a URI) as a path to read, its glob
    characters taken literally."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(file_path))


def eda_csv_scan(spark: SparkSession, path: str, na_texts: list[str] | None = None) -> DataFrame:
    """Header CSV (``.csv`` files only) with inferred types; the reader's
    NA texts become NULL. Type inference reads the whole input once more: on large
    inputs give a schema and use S1."""
    from farebox.operators.profile import PANDAS_NA_TEXTS
    df = (spark.read.option("header", True).option("inferSchema", True)
          .option("pathGlobFilter", CSV_GLOB)
          # Only full date-times may become timestamps: a bare clock time
          # would otherwise be read as today's date at that time.
          .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
          .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
          .option("quote", '"').option("escape", '"').csv(path))
    na = na_texts if na_texts is not None else PANDAS_NA_TEXTS
    string_cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.select(*[F.when(F.col(c).isin(na), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c in string_cols else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write text rows as RFC 4180 CSV with a header, blanks kept: a drop
    folder for the CSV sources (one file per partition value)."""
    w = df
    if partition_by:
        w = w.repartition(partition_by)
    (w.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .partitionBy(*([partition_by] if partition_by else [])).csv(path))
