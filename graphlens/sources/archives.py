"""Archives that are checked before anything of them is used, and tables that are kept as long as their source is unchanged.
"""

from __future__ import annotations

import io
import re
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_folder, written


def read_archive(spark: SparkSession, path: str, sha256: str | dict[str, str]) -> DataFrame:
    """archive, name, content: the members of zip archives, unpacked by tasks, one archive at a time.

    ``path`` may name several files; ``sha256`` is the digest that they must have, or one for each file name. An archive with
    another digest, or one that is not listed, raises ValueError before any member is written; FileNotFoundError if there is none.
    """
    import pyarrow as pa

    name = F.element_at(F.split("path", "/"), -1)
    try:
        files = spark.read.format("binaryFile").load(path)
        found = files.select(name.alias("archive"), F.sha2("content", 256).alias("sha256")).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = []
    if not found:
        raise FileNotFoundError(path)
    for r in found:
        wanted = sha256 if isinstance(sha256, str) else sha256.get(r["archive"])
        if wanted is None or r["sha256"] != wanted.lower():
            raise ValueError(f"{r['archive']} has the SHA-256 {r['sha256']}, not {wanted}")

    def run(batches):
        for b in batches:
            for archive, content in zip(b.column("archive").to_pylist(), b.column("content")):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for member in z.infolist():
                        if not member.is_dir():
                            yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([member.filename]), pa.array([z.read(member)], pa.binary())], names=["archive", "name", "content"])

    return written(files.select(name.alias("archive"), "content").mapInArrow(run, "archive string, name string, content binary"), "archive")


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of the names, lengths and times of the files at a path, which are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    # sums of hashes, so that no list of files is gathered
    parts = files.select(F.xxhash64(F.lit(0), *files.columns).alias("a"), F.xxhash64(F.lit(1), *files.columns).alias("b")).agg(F.count("*"), *[F.sum(F.col(c).cast("decimal(38,0)")) for c in "ab"]).first()
    return "-".join(str(x or 0) for x in parts).replace("--", "-n")


def remembered(spark: SparkSession, path: str, name: str, read) -> DataFrame:
    """What ``read(spark, path)`` gives, kept as Parquet in the shared folder under ``name`` and the state of the source: as long as
    the source is unchanged a second call scans that table, in any session that has the folder.
    """
    folder = f"{shared_folder(spark)}/kept-{re.sub(r'[^A-Za-z0-9_]', '_', name)}-{state_of(spark, path)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        read(spark, path).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
