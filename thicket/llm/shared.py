"""Work folders, materialised tables and joins shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more rows than this share of a table are joined apart; there are fewer of them than its inverse.
HOT = 1e-4
#: Rows of a few numbers that are broadcast without asking: some MB.
SMALL = 100_000


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is absent, a temporary folder is made once and set, but only if everything runs on this machine (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="thicket-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: it is computed once, its lineage is cut,
    and the loss of an executor doesn't lose it."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashes(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` rows of the least hashes of ``keys``, all if there are fewer. ``rows`` is a written table. What passes a threshold that the count
    sets is ordered, hardly more than ``most`` rows in all, so no task gets as many from each partition; of rows whose keys are equal any may be meant."""
    n = rows.count()
    if n <= most:
        return rows
    unit = (F.xxhash64(*keys, F.lit(17)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).alias("_unit")
    # ten standard deviations more than wanted; only where equal rows hash together fewer may pass, and then all are ordered
    near = rows.select("*", unit).where(F.col("_unit") < (most + 10 * most**0.5 + 100) / n)
    if near.count() < most:
        near = rows.select("*", unit)
    return near.orderBy("_unit", *keys).limit(most).drop("_unit")


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, name: str) -> DataFrame:
    """text and label of ``most`` labelled texts at most, of ``docs`` (doc_id, text) and ``labels`` (doc_id, unique and not null; label): those of the least
    hashes of the text, so that ids say which label a text has and nothing else. Rows of equal doc_id and text count once."""
    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64(text).alias("hash"))
    found = materialise(rows.select("doc_id", "hash").distinct().join(labels, "doc_id"), f"{name}-labels")
    chosen = materialise(least_hashes(found, ["hash", "label"], most), f"{name}-chosen")
    own = rows.join(F.broadcast(chosen), ["doc_id", "hash"])  # `most` rows at most
    return materialise(own.groupBy("doc_id", "hash").agg(F.first("text").alias("text"), F.first("label").alias("label")).select("text", "label"), f"{name}-sample")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores after it as long as a column has that name, in whatever case."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", count: str = "n") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``count`` (dropped) how many rows of ``left`` hold that key. Both are
    written tables. Keys with more than a share of ``HOT`` of all rows number under 1 / HOT, so these are broadcast, and no task
    gets such a key's rows; all others are joined by shuffle. ``how``: inner or left."""
    most = max(1, int(left.count() * HOT))
    hot, cold = right.where(F.col(count) > most).drop(count), right.where(F.col(count) <= most).drop(count)
    if hot.limit(1).count() == 0:
        return left.join(right.drop(count), keys, how)
    near = left.join(F.broadcast(hot), keys)
    far = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return near.unionByName(far)


def few(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df``, of ``rows`` rows at most, in as many tasks as these are worth (``each`` a task; twice the cores at least): a small table isn't
    dealt over every shuffle partition. Not for joins with hot keys, whose parts would come together again."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def if_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The written table ``df``, to be broadcast in joins if it has ``most`` rows at most; else Spark chooses, as for any table that grows."""
    return F.broadcast(df) if df.count() <= most else df


# --- files ----------------------------------------------------------------------------------------------------------------


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it, for tasks."""
    plain = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    return (pyarrow.fs.LocalFileSystem(), plain) if "://" not in plain else pyarrow.fs.FileSystem.from_uri(plain)


def publish(fs: pyarrow.fs.FileSystem, written: str, final: str) -> None:
    """Renames a whole file; one of that name from an attempt before is replaced, as it holds the same."""
    try:
        fs.move(written, final)
    except OSError:
        if fs.get_file_info(final).type == pyarrow.fs.FileType.NotFound:
            raise
        fs.delete_file(final)
        fs.move(written, final)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder below the shared one that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
