"""Sources and sinks: captured outputs, byte chunks, the ledger, archives."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lines import normalize_eol, short_command

LEDGER = "time timestamp, command string, filters array<string>, raw_bytes bigint, out_bytes bigint, exit_code int, raw_log string"


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines (run_id, line_no, text) and runs (run_id, name, command, argv) of ``path/<run>/{input.txt,cmd}``.

    A file of any size is read in byte ranges that end at line ends, many tasks to a file. A line's number is
    its place in its range plus the lines of the file's earlier ranges, which a table of one row for each range
    tells; no line is shuffled unless that table is too large to be sent. A file without a line has no rows.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    # Rows of a range follow each other in a task, so their ids are consecutive.
    rows = spark.read.option("lineSep", "\n").text(f"{path}/*/input.txt").select(
        F.xxhash64(name).alias("run_id"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"), normalize_eol(F.col("value")).alias("text"),
    )
    ranges = rows.groupBy("run_id", "_at").agg(F.min("_row").alias("_first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("run_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("run_id", "_at", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    lines = rows.join(ranges, ["run_id", "_at"]).select("run_id", (F.col("_row") + F.col("_shift")).alias("line_no"), "text")
    command = F.trim(F.regexp_replace("value", r"\s+", " "))
    runs = spark.read.text(f"{path}/*/cmd", wholetext=True).select(F.xxhash64(name).alias("run_id"), name.alias("name"), command.alias("command"), F.split(command, " ").alias("argv"))
    return lines, runs


def reassemble_lines(chunks: DataFrame) -> DataFrame:
    """Whole lines (run_id, line_no, text) from byte chunks (run_id, seq, data) cut anywhere.

    Pieces are joined as bytes before they are decoded; only pieces of one line meet.
    """
    # Bytes as Latin-1 characters: splitting and joining then work on bytes.
    pieces = F.split(F.decode("data", "ISO-8859-1"), "\n")
    df = chunks.select("run_id", "seq", pieces.alias("p"))
    earlier = F.sum(F.size("p") - 1).over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("base", F.coalesce(earlier, F.lit(0)))
    df = df.select("run_id", "seq", "base", F.posexplode("p").alias("i", "piece")).withColumn("line_no", F.col("base") + F.col("i") + 1)
    df = df.where(F.col("piece") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "i", "piece"))), lambda x: x["piece"]), "")
    full = df.groupBy("run_id", "line_no").agg(joined.alias("t"))
    # Empty lines have no piece: every line number up to the last newline, or the last piece, exists.
    ends = chunks.groupBy("run_id").agg(F.sum(F.size(F.split(F.decode("data", "ISO-8859-1"), "\n")) - 1).alias("n"))
    last = full.groupBy("run_id").agg(F.max("line_no").alias("m"))
    ends = ends.join(last, "run_id", "left").withColumn("n", F.greatest("n", F.coalesce("m", F.lit(0)))).where("n > 0")
    every = ends.select("run_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("line_no"))
    text = F.decode(F.encode(F.coalesce("t", F.lit("")), "ISO-8859-1"), "UTF-8")
    return every.join(full, ["run_id", "line_no"], "left").select("run_id", "line_no", text.alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where that is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = shared_dir.own = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="millrace-")
    return found.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the plan, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_ledger(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped, and entries before ``since``, or without a time then."""
    try:
        rows = spark.read.text(path).where("trim(value) <> ''")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)  # no ledger yet
    parsed = F.from_json("value", LEDGER + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    df = rows.select(parsed.alias("x")).where("x._corrupt_record IS NULL").select("x.*").drop("_corrupt_record")
    return df.where(F.col("time") >= F.lit(since)) if since is not None else df


def append_ledger(stats: DataFrame, runs: DataFrame, path: str, now: datetime, fmt: str = "parquet", archive: str | None = None, batch: str | None = None) -> None:
    """Appends one row per run, stamped and with a short command, by date; archive: where S7 wrote the raw lines.

    batch: a name of this batch (a job's, or a stream's batch number). The same batch, written again by a retry,
    takes the place of what it wrote before, whatever it got done then; other batches are left alone. Without
    a name a retry adds its rows once more.
    """
    lost = F.col("filtered") & (F.size("filters") > 0)
    raw_log = F.when(lost, F.concat(F.lit(f"{archive}#run_id="), F.col("run_id").cast("string"))) if archive else F.lit(None).cast("string")
    when = F.coalesce("started_at", F.lit(now)) if "started_at" in runs.columns else F.lit(now)
    code = F.col("exit_code") if "exit_code" in runs.columns else F.lit(0)
    side = runs.select("run_id", when.cast("timestamp").alias("time"), short_command(F.col("command")).alias("command"), code.cast("int").alias("exit_code"))
    out = stats.join(side, "run_id").select("time", "command", "filters", F.col("raw_bytes"), F.col("bytes_out").alias("out_bytes"), "exit_code", raw_log.alias("raw_log"))
    if batch is None:
        out.withColumn("date", F.to_date("time")).write.mode("append").partitionBy("date").format(fmt).save(path)
        return
    # The batch is the outer folder, so a rewrite also removes days that the first attempt wrote and this one lacks.
    out.withColumn("date", F.to_date("time")).write.mode("overwrite").partitionBy("date").format(fmt).save(f"{path}/batch={batch}")


def write_compacted(kept: DataFrame, path: str) -> None:
    """Ordered rows, each run in one file."""
    kept.repartition("run_id").sortWithinPartitions("run_id", "out_no").write.mode("overwrite").parquet(path)


def write_raw_archive(lines: DataFrame, stats: DataFrame, path: str, day: date | None = None) -> None:
    """The raw lines of the runs that lost something, and of no others; with a day, as that day's folder of the archive."""
    lost = stats.where("filtered AND size(filters) > 0").select("run_id")
    lines.join(lost, "run_id", "left_semi").write.mode("overwrite").parquet(f"{path}/day={day.isoformat()}" if day else path)


def old_files(spark: SparkSession, path: str, days: int, now: datetime, pattern: str = "*.log") -> DataFrame:
    """Files under ``path`` (path, length) that were last changed more than ``days`` before ``now``; none for days <= 0.

    Spark lists the folders in tasks where they are many; contents are not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    old = F.lit(days > 0) & (F.col("modificationTime") < F.lit(now) - F.make_interval(days=F.lit(days)))
    return files.select("path", "length", "modificationTime").where(old).select("path", "length")


def prune_archive(spark: SparkSession, path: str, days: int, now: datetime, pattern: str = "*.log") -> DataFrame:
    """Deletes the files of ``old_files`` and reports each: path, length, deleted, error.

    The list is written first, then tasks delete their share of it. A task that runs twice finds some files
    gone, which counts as deleted, so the report is that of one run. A file that cannot be deleted is reported
    with its error and stops nothing. The report lies in the shared folder; ``agg`` it for files and bytes.
    """
    listed = stored(old_files(spark, path, days, now, pattern).repartition(F.xxhash64("path")))

    def delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            gone, errors = [], []
            for file in pdf["path"]:
                error = None
                try:
                    system, inner = fs.FileSystem.from_uri(quote(unquote(file), safe="/:@"))
                    if system.get_file_info(inner).type != fs.FileType.NotFound:
                        system.delete_file(inner)
                except OSError as e:
                    error = str(e)
                gone.append(error is None)
                errors.append(error)
            yield pdf.assign(deleted=gone, error=errors)

    return stored(listed.mapInPandas(delete, "path string, length long, deleted boolean, error string"))


def prune_days(spark: SparkSession, path: str, days: int, today: date) -> list[str]:
    """Drops the day folders of an archive (see ``write_raw_archive``) that are older than ``days``; their names.

    One call for each day, however many files it holds; done again it finds nothing.
    """
    if days <= 0:
        return []
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in system.listStatus(root) if s.isDirectory()) if system.exists(root) else []
    limit = f"day={(today - timedelta(days=days)).isoformat()}"
    old = [n for n in names if n.startswith("day=") and n < limit]
    for n in old:
        system.delete(jvm.org.apache.hadoop.fs.Path(root, n), True)
    return old
