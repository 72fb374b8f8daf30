"""Sources and sinks: the host's tables, JSON channel databases, station lists, caches, CSV and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.functions import labels
from rivulet.operators.columns import first_rows

CHANNELS = ["id", "name", "channel_number", "channel_group_id", "epg_data_id"]
STREAMS = ["id", "name", "m3u_account", "url", "channel_group", "tvg_id"]
DATABASE = T.StructType(
    [
        T.StructField("country_code", T.StringType()), T.StructField("country_name", T.StringType()), T.StructField("version", T.StringType()),
        T.StructField("channels", T.ArrayType(T.StructType([T.StructField("channel_name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("type", T.StringType()), T.StructField("callsign", T.StringType()), T.StructField("zones", T.ArrayType(T.StringType()))]))),
    ]
)
STATION = "callsign string, network_affiliation string, community_served_city string, community_served_state string"
PROBE = "stream_id long, throughput_mbps double, throughput_measured_at timestamp, edge_ip string, nominal_bitrate_mbps double, probe_duration_s int"


def table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A host table as Parquet; only the columns that exist are read."""
    df = spark.read.parquet(f"{root}/{name}")
    return df if columns is None else df.select(*(c for c in columns if c in df.columns))


def channels(spark: SparkSession, root: str) -> DataFrame:
    """Channels with their group's name; ``attached_channel_id`` is null where the host has none."""
    df = table(spark, root, "channels", [*CHANNELS, "attached_channel_id"])
    df = df if "attached_channel_id" in df.columns else df.withColumn("attached_channel_id", F.lit(None).cast("long"))
    groups = table(spark, root, "channel_groups").select(F.col("id").alias("channel_group_id"), F.col("name").alias("channel_group_name"))
    return df.join(groups, "channel_group_id", "left")


def streams(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "streams", [*STREAMS, "stats", "width", "height"])
    groups = table(spark, root, "channel_groups").select(F.col("id").alias("channel_group"), F.col("name").alias("channel_group_name"))
    return df.join(groups, "channel_group", "left")


def in_profiles(df: DataFrame, membership: DataFrame, profile_ids: list[int]) -> DataFrame:
    """Channels that are enabled in one of the profiles."""
    own = membership.where(F.col("enabled") & F.col("channel_profile_id").isin(profile_ids)).select(F.col("channel_id").alias("id")).distinct()
    return df.join(own, "id", "left_semi")


def stream_groups(df: DataFrame, column: str = "channel_group_name") -> DataFrame:
    """The distinct group names that aren't empty."""
    return df.select(F.col(column).alias("name")).where("name <> ''").distinct()


def channel_databases(spark: SparkSession, paths: list[str], countries: list[str] | None = None) -> DataFrame:
    """Entries of ``<CC>_channels.json`` files with the country of the file name, and whether they are broadcast."""
    df = spark.read.schema(DATABASE).option("multiLine", True).json(paths).withColumn("file", F.input_file_name())
    df = df.withColumn("country_code", F.regexp_extract("file", r"([^/]+)_channels\.json$", 1))
    if countries is not None:
        df = df.where(F.col("country_code").isin(countries))
    df = df.select("country_code", "country_name", F.posexplode("channels").alias("ord", "c")).select("country_code", "country_name", "ord", "c.*")
    return df.where("channel_name <> ''").withColumn("broadcast", F.lower(F.coalesce("type", F.lit(""))).contains("broadcast") | F.col("callsign").isNotNull())


def database_catalogue(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(id, label, is_default, file) of channel databases: the country of the file's name, what the file calls itself, and whether it is read unless told
    otherwise, as those of the US and a lone one are. Files that aren't JSON are left out."""
    head = T.StructType([f for f in DATABASE.fields if f.name != "channels"])
    df = spark.read.schema(head).option("multiLine", True).option("mode", "DROPMALFORMED").json(paths).withColumn("path", F.input_file_name())
    df = df.select("*", F.regexp_extract("path", r"([^/]+)$", 1).alias("file")).withColumn("id", F.upper(F.substring_index("file", "_", 1)))
    named = F.coalesce("country_name", "file")
    label = F.when(F.col("country_code").isNull(), F.col("file")).when(F.coalesce("version", F.lit("")) != "", F.concat(named, F.lit(" (v"), F.col("version"), F.lit(")"))).otherwise(named)
    # One row for each file, so one task counts them all.
    alone = F.count("*").over(Window.partitionBy(F.lit(0))) == 1
    return df.select("id", label.alias("label"), ((F.col("id") == "US") | alone).alias("is_default"), "file")


def stations(spark: SparkSession, path: str) -> DataFrame:
    """The first record of each full and each base callsign: (key, tier, ...), tier 1 full and 2 base."""
    df = spark.read.schema(STATION).option("multiLine", True).json(path).withColumn("ord", F.monotonically_increasing_id())
    keys = F.array(F.struct(F.upper("callsign").alias("key"), F.lit(1).alias("tier")), F.struct(labels.base_callsign(F.upper("callsign")).alias("key"), F.lit(2).alias("tier")))
    df = df.where("callsign <> ''").withColumn("k", F.explode(keys)).select("*", "k.key", "k.tier").drop("k")
    return first_rows(df, ["key", "tier"], ["ord"]).drop("ord")


def alias_rows(spark: SparkSession, *maps: dict[str, list[str]]) -> DataFrame:
    """(canonical, variant, pos) of several maps; a variant keeps its first place."""
    rows: dict[str, dict[str, None]] = {}
    for m in maps:
        for canonical, variants in m.items():
            rows.setdefault(canonical, {}).update(dict.fromkeys(variants))
    return spark.createDataFrame([(c, x, k) for c, own in rows.items() for k, x in enumerate(own)], "canonical string, variant string, pos int")


def throughput_cache(spark: SparkSession, path: str) -> DataFrame:
    """The probe cache; empty where there is none."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:  # no such path, or no Parquet in it; what else goes wrong is an error
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], PROBE)
    return df.select(*(F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], PROBE).schema))


def user_agents(streams_: DataFrame, accounts: DataFrame, default: str) -> DataFrame:
    own = accounts.select(F.col("id").alias("m3u_account"), "user_agent")
    return streams_.join(own, "m3u_account", "left").withColumn("user_agent", F.coalesce(F.nullif("user_agent", F.lit("")), F.lit(default)))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells can't start a spreadsheet formula."""
    safe = [labels.csv_guard(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema]
    df.select(*safe).write.mode("overwrite").option("header", True).csv(path)


def write_assignments(df: DataFrame, path: str) -> None:
    """Overwrites the assignment table; written beside it first, since ``df`` may be read from it. The old table goes only when
    the new one is whole; a run that ends in between leaves it as ``path`` or ``path.old``."""
    spark = df.sparkSession
    df.repartition("channel_id").sortWithinPartitions("channel_id", "ord").write.mode("overwrite").parquet(f"{path}.new")
    at = spark._jvm.org.apache.hadoop.fs.Path
    new, here, old = at(f"{path}.new"), at(path), at(f"{path}.old")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(here):
        fs.delete(old, True)
        if not fs.rename(here, old):
            raise OSError(f"can't move {path}")
    if not fs.rename(new, here):
        raise OSError(f"can't move {path}.new")
    fs.delete(old, True)
    spark.catalog.refreshByPath(path)


def write_changed(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Puts the new streams of the channels in ``df`` (channel_id, stream_id, ord) into a table that ``write_changed`` keeps in ``buckets`` of
    channels. Buckets without such a channel keep their files."""
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64("channel_id"), F.lit(buckets)).cast("int")
    new = df.select("channel_id", "stream_id", "ord").withColumn("bucket", bucket)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        held = spark.read.schema("channel_id long, stream_id long, ord int, bucket int").parquet(path)
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        stays = held.where(F.col("bucket").isin(touched)).join(new.select("channel_id").distinct(), "channel_id", "left_anti")
        new = new.select("channel_id", "stream_id", F.col("ord").cast("int"), "bucket").unionByName(stays)
    out = new.repartition("bucket").sortWithinPartitions("bucket", "channel_id", "ord")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    spark.catalog.refreshByPath(path)


def kept_reports(files: DataFrame, newest: int = 8, min_age_s: int = 2400):
    """Of (path, mtime, now) rows those that retention keeps: the newest ones and those too young to go."""
    newest_ = files.orderBy(F.desc("mtime"), "path").limit(newest).select("path").withColumn("newest", F.lit(True))
    kept = F.col("newest").isNotNull() | (F.col("now") - F.col("mtime") < min_age_s)
    return files.join(newest_, "path", "left").where(kept).select(*files.columns)
