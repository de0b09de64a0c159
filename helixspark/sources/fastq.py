"""FASTQ discovery and reading.

Reads are ``sample, file, mate, read_no, header, seq, qual, plus``, one row per record.  Files are found through Spark's
readers and read by :mod:`fastq_scan`, in byte ranges and in bounded memory; gzip is decompressed by suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.sources.fastq_scan import SPLIT_BYTES, Scan, scan

# File name endings and mate markers, in order of preference.
EXTENSIONS = (".fastq.gz", ".fq.gz", ".fastq", ".fq")
MATES = (("_R1", "_R2"), ("_1", "_2"), (".R1", ".R2"), (".1", ".2"), ("_F", "_R"), ("_forward", "_reverse"))
READS = "file string, read_no long, header string, seq string, plus string, qual string"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, name, bytes`` of the FASTQ files below a folder, each once."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{fastq,fq,fastq.gz,fq.gz}").load(folder)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.(fastq|fq)(\.gz)?$", "")
    return found.select("path", stem.alias("name"), F.col("length").alias("bytes")).distinct()


def find_samples(files: DataFrame) -> DataFrame:
    """``sample, layout, paths array`` sorted by sample: both mates are ``paired``, one file is ``single``.

    A name that ends in a mate marker belongs to the sample before the marker; where names collide the last path wins.
    """
    sample, mate = F.col("name"), F.lit("1")
    for one, two in reversed(MATES):
        for marker, no in ((one, "1"), (two, "2")):
            hit = F.col("name").endswith(marker)
            sample = F.when(hit, F.substring("name", 1, F.length("name") - len(marker))).otherwise(sample)
            mate = F.when(hit, no).otherwise(mate)
    each = files.select("path", "bytes", sample.alias("sample"), mate.alias("mate"))
    grouped = each.groupBy("sample").agg(F.max(F.when(F.col("mate") == "1", F.col("path"))).alias("r1"), F.max(F.when(F.col("mate") == "2", F.col("path"))).alias("r2"), F.sum("bytes").alias("bytes"))
    layout = F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), "paired").otherwise("single")
    return grouped.select("sample", layout.alias("layout"), F.array_compact(F.array("r1", "r2")).alias("paths"), "bytes").orderBy("sample")


def find_pairs_by_substring(files: DataFrame, keep_orphans: bool = True) -> DataFrame:
    """``sample, r1, r2``, as preprocessing pairs files: a mate marker anywhere in the name; the sample is the name
    without it.  Orphan second mates take the first place, or are left out."""
    sample, mate = F.col("name"), F.lit("1")
    for one, two in reversed(MATES[:4]):
        for marker, no in ((one, "1"), (two, "2")):
            hit = F.contains("name", F.lit(marker))
            sample = F.when(hit, F.replace("name", F.lit(marker), F.lit(""))).otherwise(sample)
            mate = F.when(hit, no).otherwise(mate)
    each = files.select("path", sample.alias("sample"), mate.alias("mate"))
    both = each.groupBy("sample").agg(F.max(F.when(F.col("mate") == "1", F.col("path"))).alias("r1"), F.max(F.when(F.col("mate") == "2", F.col("path"))).alias("r2"))
    if keep_orphans:
        return both.select("sample", F.coalesce("r1", "r2").alias("r1"), F.when(F.col("r1").isNotNull(), F.col("r2")).alias("r2"))
    return both.where("r1 is not null")


def summarize(samples: DataFrame) -> DataFrame:
    """One row: numbers of samples, paired, single, files, and bytes."""
    kind = lambda s: F.coalesce(F.sum((F.col("layout") == s).cast("long")), F.lit(0))
    return samples.agg(F.count("*").alias("total_samples"), kind("paired").alias("paired_samples"), kind("single").alias("single_samples"), F.coalesce(F.sum(F.size("paths")), F.lit(0)).alias("total_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))


def has_fastq(spark: SparkSession, folder: str) -> bool:
    """Whether the folder exists and holds FASTQ files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(path)) and bool(fs.getFileStatus(path).isDirectory()) and not list_files(spark, folder).limit(1).isEmpty()


def read_records(spark: SparkSession, paths: list[str], max_reads: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All whole records of the files, valid or not; ``OSError`` if a file cannot be read to its end."""
    done = scan(spark.createDataFrame([(p,) for p in paths], "path string"), max_reads, split_bytes)
    broken = done.failures.first()
    if broken is not None:
        raise OSError(f"{broken['file']}: {broken['error']}")
    return done.records


VALID = "startswith(header, '@') and startswith(plus, '+') and length(seq) = length(qual)"


def valid_records(records: DataFrame) -> DataFrame:
    return records.where(VALID)


def bad_records(records: DataFrame) -> DataFrame:
    """Records left out, with the reason; and valid ones with letters other than A, C, G, T, N as ``warning``."""
    reason = (
        F.when(~F.startswith("header", F.lit("@")), "header").when(~F.startswith("plus", F.lit("+")), "separator")
        .when(F.length("seq") != F.length("qual"), "length").when(~F.col("seq").rlike("^[ACGTN]*$"), "warning: letters")
    )
    return records.withColumn("reason", reason).where("reason is not null")


def scan_samples(samples: DataFrame, max_reads: int | None = None, split_bytes: int = SPLIT_BYTES) -> Scan:
    """Valid reads of discovered samples: ``sample, file, mate, read_no, header, seq, qual``.

    A sample of which a file cannot be read is left out as a whole and listed in ``failures`` (``sample, mate, file,
    error``); the others are not disturbed.
    """
    files = samples.select("sample", F.posexplode("paths").alias("at", "path")).select("path", "sample", (F.col("at") + 1).cast("string").alias("mate"))
    done = scan(files, max_reads, split_bytes)
    lost = done.failures.select("sample").distinct()
    reads = valid_records(done.records).join(lost, "sample", "left_anti")
    return Scan(reads.select("sample", "file", "mate", "read_no", "header", "seq", "qual"), done.failures.select("sample", "mate", "file", "error"))


def read_samples(samples: DataFrame, max_reads: int | None = None) -> DataFrame:
    """The reads of :func:`scan_samples`; mates follow each other."""
    return scan_samples(samples, max_reads).records


def manifest(pairs: DataFrame) -> DataFrame:
    """``sample, r1, r2`` with ``NA`` for a missing mate."""
    return pairs.select("sample", "r1", F.coalesce("r2", F.lit("NA")).alias("r2"))
