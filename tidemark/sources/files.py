"""Sources and sinks: tolerant scans, multi-part unions, JSON and CSV with declared schemas, profiles, reports."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a temporary one only on a local master (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: no folder that all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scan_pruned(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def scan_tolerant(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[c for c in columns if c in df.columns])


def scan_parts(spark: SparkSession, paths: list[str], strict: bool = True) -> DataFrame:
    """The union of all parts; a missing one is an error unless not ``strict``, and it always is one if none is there."""
    found = []
    for p in paths:
        try:
            found.append(spark.read.parquet(p))
        except AnalysisException as e:  # only a missing path is forgiven
            if strict or e.getCondition() != "PATH_NOT_FOUND":
                raise
    if not found:
        raise FileNotFoundError(f"none of {paths} is there")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType, numbers: list[str]) -> DataFrame:
    """JSON lines with a declared schema; bad lines keep their text in _corrupt (count them there); null numbers are 0."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    df = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return df.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in numbers})


def scan_json_docs(spark: SparkSession, path: str, schema: T.StructType, items: str) -> DataFrame:
    """One document per file, its nested array exploded; the file's name is kept."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select("*", F.col("_metadata.file_name").alias("file_name"), F.explode(items).alias("item")).drop(items)


def scan_csv_mixed(spark: SparkSession, paths: list[str], encoding: str = "UTF-8") -> DataFrame:
    """CSV files of different widths as strings, file name kept. Lines with too few or too many fields keep what they have, and
    their text in _corrupt (count them there)."""
    out = None
    for p in paths:
        reader = spark.read.option("header", True).option("encoding", encoding)
        names = reader.csv(p).columns
        kind = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_corrupt"]])
        df = reader.schema(kind).option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", True).csv(p)
        df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns]).withColumn("file_name", F.element_at(F.split(F.input_file_name(), "/"), -1))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def file_label(name: str, labels: dict[str, str]):
    """A label from a file name's prefix."""
    out = None
    for prefix, label in labels.items():
        hit = F.col(name).startswith(prefix)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def land_table(df: DataFrame, url: str, table: str, types: str = "", **options: str) -> None:
    """``df`` as a relational table; ``types`` declares columns whose default type a database can't compare or index."""
    writer = df.write.format("jdbc").options(url=url, dbtable=table, **options)
    (writer.option("createTableColumnTypes", types) if types else writer).mode("overwrite").save()


def scan_table(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A relational table. With a numeric ``column`` and its ``bounds`` it is read in ``parts`` ranges by as many tasks (the bounds
    deal the rows, they drop none); filters on its columns go to the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def local_database(spark: SparkSession, folder: str) -> str | None:
    """The address of an embedded database in ``folder``, for a master whose executors are the driver's own process; else null."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return None
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return f"jdbc:derby:{folder.removeprefix('file://').removeprefix('file:')};create=true"


def profile(df: DataFrame) -> DataFrame:
    """Rows of each file, of all (null), the number of columns, and their names and types."""
    kinds = ", ".join(f"{name} {kind}" for name, kind in df.dtypes)
    n = df.select(F.col("_metadata.file_name").alias("part")).rollup("part").agg(F.count("*").alias("n"))
    return n.select("part", "n", F.lit(len(df.columns)).alias("n_columns"), F.lit(kinds).alias("columns"))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_report(overall: DataFrame, cells: DataFrame, by: str, most: int = 100_000) -> DataFrame:
    """A nested report: one overall row with its cells as an array. A report is for readers: over ``most`` cells are refused, as they
    would all be one row."""
    if cells.limit(most + 1).count() > most:
        raise ValueError(f"a report of more than {most} cells")
    nested = cells.agg(F.sort_array(F.collect_list(F.struct(by, *[c for c in cells.columns if c != by]))).alias("cells"))
    return overall.crossJoin(nested).select(F.to_json(F.struct("*")).alias("report"))  # one row each


def append_jsonl(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Appends a stream as JSON lines; with ``available_now`` it ends when all that has landed is read."""
    writer = stream.writeStream.outputMode("append").format("json").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def ticker_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Landed ticker files as a stream; the price is last, else close, else the mid."""
    s = spark.readStream.schema(schema).parquet(path)
    return s.withColumn("price", F.coalesce("last", "close", (F.col("bid") + F.col("ask")) / 2))
