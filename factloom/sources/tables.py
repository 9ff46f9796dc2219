"""Scans and sinks."""

from __future__ import annotations

import io
import itertools
import json
import math
import os
import urllib.request
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import valid_alias

CANDIDATE_ALIASES = {"unique_id": "facility_id", "id": "facility_id", "capability": "capability_id"}
PART_START, PART_CAP = 7 << 20, 9 << 20
GEONAMES_COLUMNS = "geonameid name asciiname alternatenames latitude longitude feature_class feature_code country cc2 admin1 admin2 admin3 admin4 population elevation dem timezone modified".split()


def require_columns(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what} lacks columns {missing}")
    return df


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet file or a folder of parts, with only the columns asked for."""
    df = spark.read.parquet(path)
    return require_columns(df, columns, path).select(*columns) if columns else df


def scan_table(spark: SparkSession, table: str, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A catalog table, or one behind JDBC (options url, driver, partitionColumn and so on)."""
    return spark.read.format("jdbc").options(dbtable=table, **jdbc).load() if jdbc else spark.table(table)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """CSV or parquet by suffix, column aliases renamed, ids as string."""
    df = spark.read.csv(path, header=True) if path.lower().rstrip("/").endswith(".csv") else spark.read.parquet(path)
    df = df.withColumnsRenamed({a: b for a, b in CANDIDATE_ALIASES.items() if a in df.columns and b not in df.columns})
    return require_columns(df, ["facility_id", "capability_id"], path).withColumns({c: F.col(c).cast("string") for c in ("facility_id", "capability_id")})


def _zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines (value) of the text file in a zip on any store that Spark reads; a readme is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    name = next(n for n in z.namelist() if n.endswith(".txt") and "readme" not in n.lower())
                    with io.TextIOWrapper(z.open(name), encoding="utf-8", errors="replace", newline="\n") as lines:
                        while some := list(itertools.islice(lines, 10_000)):
                            yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in some], pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string").repartition(spark.sparkContext.defaultParallelism)


def read_geonames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Places (populated places and areas) and their aliases from a GeoNames dump: tab-separated text, or a zip of one."""
    from factloom.functions.text import normalize

    source = _zipped_lines(spark, path) if path.endswith(".zip") else spark.read.text(path)
    lines = source.select(F.split("value", "\t").alias("f")).where(F.size("f") >= len(GEONAMES_COLUMNS))
    named = lines.select(*[F.col("f")[i].alias(n) for i, n in enumerate(GEONAMES_COLUMNS)]).where(F.col("feature_class").isin("P", "A"))
    places = named.select(F.col("geonameid").try_cast("long").alias("geoname_id"), "name", F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"), "feature_class", "feature_code", "admin1", "admin2", "asciiname", "alternatenames").where("geoname_id is not null and latitude is not null and longitude is not null")
    spelled = F.concat(F.array("name", "asciiname"), F.split(F.coalesce("alternatenames", F.lit("")), ","))
    aliases = places.select("geoname_id", F.explode(spelled).alias("alias")).select("geoname_id", normalize("alias").alias("alias")).where(valid_alias(F.col("alias"))).distinct()
    return places.drop("asciiname", "alternatenames"), aliases


def read_latest(spark: SparkSession, path: str, key: str = "cache_key", at: str = "cached_at_epoch", schema: str | None = None) -> DataFrame:
    """JSON lines; of each key the last record: by time (null first), then by file name and place in the file, as lines are appended."""
    df = (spark.read.schema(schema) if schema else spark.read).json(path)
    fields = [c for c in df.columns if c != key]
    order = F.struct(F.coalesce(F.col(at).cast("double"), F.lit(float("-inf"))).alias("at"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    latest = df.withColumn("factloom_order", order).where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*fields), "factloom_order").alias("r"))
    return latest.select(key, "r.*")


def fetch_once(url: str, path: str, opener: Callable[[str], bytes] | None = None) -> str:
    """The path of a file that is downloaded only if nothing is there yet. opener: url to bytes (urllib by default, 45 seconds)."""
    if not (os.path.exists(path) and os.path.getsize(path)):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        content = opener(url) if opener else urllib.request.urlopen(url, timeout=45).read()
        with open(path, "wb") as f:
            f.write(content)
    return path


def read_env(path: str) -> dict[str, str]:
    """Sets the variables of a .env file that aren't set yet, and gives those; a missing file gives none. Blank lines, comments and lines without = are passed over."""
    added: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for name, sign, value in (line.strip().partition("=") for line in f if not line.lstrip().startswith("#")):
                if sign and name.strip() not in os.environ:
                    added[name.strip()] = os.environ[name.strip()] = value.strip().strip("\"'")
    return added


def read_document(path: str) -> dict:
    """A YAML or JSON document of settings (taxonomy, vocabulary)."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def write_capped(df: DataFrame, path: str, order: str, estimate: int, cap: int = PART_CAP) -> int:
    """Writes contiguous ranges of `order` as parquet parts of at most `cap` bytes, with one part more until all fit; gives the number of parts."""
    spark = df.sparkSession
    fs, fs_path = _filesystem(spark, path)
    parts = max(2, math.ceil(estimate / PART_START))
    while True:
        df.repartitionByRange(parts, order).write.mode("overwrite").parquet(path)
        sizes = [f.getLen() for f in fs.listStatus(fs_path) if f.getPath().getName().endswith(".parquet")]
        if max(sizes, default=0) <= cap:
            return parts
        parts += max(1, math.ceil(parts * (max(sizes) / cap - 1)))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON text."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_metrics(df: DataFrame, path: str) -> None:
    """One row of figures as a JSON document, on any store."""
    fs, p = _filesystem(df.sparkSession, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(json.loads(df.toJSON().first()), indent=2, sort_keys=True).encode()))
    out.close()


def create_table(spark: SparkSession, path: str, schema: str) -> bool:
    """Makes an empty table at the path if there is none; whether it did."""
    fs, p = _filesystem(spark, path)
    if fs.exists(p):
        return False
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return True


def build_bundle(spark: SparkSession, files: list[str], tables: dict[str, tuple[str, str]], source: str, target: str) -> int:
    """Copies files (by their path below source) and tables (name: path, ordering column) to a new target; gives its bytes.

    A missing file ends the build before anything is copied. Tables of over PART_CAP bytes become parts (write_capped), the others are copied.
    """
    fs, root = _filesystem(spark, target)
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    sources = {f: path(f"{source}/{f}") for f in files} | {f"data/{n}": path(p) for n, (p, _) in tables.items()}
    for name, p in sources.items():
        if not p.getFileSystem(conf).exists(p):
            raise FileNotFoundError(f"the bundle lacks {name}: {p.toString()}")
    fs.delete(root, True)
    fs.mkdirs(root)
    for name, p in sources.items():
        own = p.getFileSystem(conf)
        size = own.getContentSummary(p).getLength()
        if name.startswith("data/") and name[5:] in tables and size > PART_CAP:
            write_capped(spark.read.parquet(p.toString()), f"{target}/{name}", tables[name[5:]][1], size)
        else:
            to = path(f"{target}/{name}")
            fs.mkdirs(to.getParent())
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(own, p, fs, to, False, True, conf)
    return fs.getContentSummary(root).getLength()


def insert_absent(new: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows of which no row with the same keys (null equals null) is stored; gives their number. One writer at a time."""
    spark = new.sparkSession
    first = Window.partitionBy(*keys).orderBy(*new.columns)
    new = new.withColumn("factloom_rank", F.row_number().over(first)).where("factloom_rank = 1").drop("factloom_rank")
    fs, fs_path = _filesystem(spark, path)
    if fs.exists(fs_path):
        old = spark.read.schema(new.schema).parquet(path).select(*[F.col(k).alias(f"old_{k}") for k in keys])
        same = None
        for k in keys:
            one = F.col(k).eqNullSafe(F.col(f"old_{k}"))
            same = one if same is None else same & one
        new = new.join(old, same, "left_anti")
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n
