"""Session helpers shared by every operator: sessions, lineage cuts, statistics that fit on the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the fixed-size key filter of :func:`key_filter` (128 KB, whatever the data).
FILTER_BITS = 1 << 20


def session(app: str = "scriptorium", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which the cluster sizes to its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there.

    The copy lies outside the executors, so losing one loses nothing.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``. Only a session on one machine (master local)
    that names none gets a temporary one, removed when Python ends; any other raises, since its executors could not
    read it."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("name a folder all executors share in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="scriptorium-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, for wide rows: a compressed table in the shared checkpoint folder, read back."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def key_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS):
    """A fixed-size membership filter over ``keys[key]``; false positives only, never a false negative.

    Returns a function that turns a Column into a boolean Column. What reaches the driver is a bitmap of at most
    ``bits / 62`` numbers, the same for any data. Use it in front of a shuffle join to drop most rows that cannot
    match; the join itself stays exact.
    """
    per = 62
    slots = -(-bits // per)
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(slots * per))
    rows = (
        keys.select(h.alias("h"))
        .groupBy(F.floor(F.col("h") / per).alias("slot"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h % {per} as int))")).alias("word"))
        .collect()
    )
    words = ["0"] * slots
    for r in rows:
        words[r["slot"]] = str(r["word"])
    table = F.split(F.lit(",".join(words)), ",").cast("array<bigint>")

    def within(c: Column) -> Column:
        g = F.pmod(F.xxhash64(c), F.lit(slots * per))
        word = F.get(table, F.floor(g / per).cast("int"))
        return F.getbit(word, (g % per).cast("int")) == 1

    return within
