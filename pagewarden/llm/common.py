"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after making sure that its session gives Python BATCH_ROWS rows at once at most, as texts may be long."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew only if the scan has few splits: up to a fourth as many as the cluster has cores, or fewer than cores and eight.

    What is moved is those few splits; a larger input isn't.
    """
    cores = small_batches(df).sparkSession.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    return df.repartition(cores) if n * 4 <= cores or n < min(cores, 8) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors can reach.

    Only a session in local mode (a test) may leave it unset: it gets a fresh
    temporary folder. On a cluster that is an error, as no local folder is shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-pagewarden-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables of one run in the shared folder, written and read back: cuts the lineage, survives lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        import uuid

        path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table))[0])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        kept = {id(t) for t in tables}
        self.drop(*[t for key, (_, t) in list(self.paths.items()) if key not in kept])


def stored(df: DataFrame, name: str) -> DataFrame:
    """One such table, which stays."""
    return Scratch(df.sparkSession)(df, name)


def pieces(batch_rows: int, sizes, limit: int):
    """Ranges [a, b) of rows whose sizes add up to about limit at most; one larger row is a range of its own."""
    a, held = 0, 0
    for i in range(batch_rows):
        if i > a and held + sizes[i] > limit:
            yield a, i
            a, held = i, 0
        held += sizes[i]
    if batch_rows > a:
        yield a, batch_rows
