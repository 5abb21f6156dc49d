"""Landing, flattening and merging of station data."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import local_clock
from ..operators.intervals import overlap_join
from ..operators.joins import SIDE, spread_join
from . import schemas

# Regions as (min lon, min lat, max lon, max lat), and the provider.
REGIONS = {
    "chennai": (80.080170, 12.779249, 80.332855, 13.232850),
    "delhi": (76.8381, 28.4126, 77.3477, 28.8814),
    "gurugram": (76.9895, 28.3194, 77.1731, 28.5135),
    "india": (68.0, 6.0, 97.5, 37.5),
}
PROVIDER_ID, PROVIDER_NAME = 168, "CPCB"
#: Rows that a task gathers for a file of a partition.
FILE_ROWS = 50_000


def read_registry(spark: SparkSession, path: str, keep: str | None = None) -> DataFrame:
    """The station registry (quoted fields may hold commas); with ``keep`` only rows of exactly that status."""
    df = spark.read.schema(schemas.REGISTRY).csv(path, header=True, quote='"', escape='"', multiLine=True)
    df = df.withColumn("nn_station", F.col("nn_station").cast("bigint"))
    return df if keep is None else df.filter(F.col("status") == keep)


def flatten_locations(pages: DataFrame, provider_id: int = PROVIDER_ID, provider_name: str = PROVIDER_NAME) -> DataFrame:
    """One row per location of the provider (both id and name must agree), from pages with ``results``."""
    r = pages.select(F.explode("results").alias("r")).filter((F.col("r.provider.id") == provider_id) & (F.col("r.provider.name") == provider_name))
    names = F.filter(F.transform("r.sensors", lambda s: s["parameter"]["name"]), lambda n: n.isNotNull() & (n != ""))
    return r.select(
        F.col("r.id").alias("location_id"), F.col("r.name").alias("name"), F.col("r.locality").alias("locality"),
        F.col("r.coordinates.latitude").alias("latitude"), F.col("r.coordinates.longitude").alias("longitude"),
        F.col("r.country.code").alias("country_iso"), F.col("r.timezone").alias("timezone"), F.col("r.isMobile").alias("is_mobile"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(names)), ","), F.lit("")).alias("parameters"),
        F.when(F.col("r.sensors").isNull(), 0).otherwise(F.size("r.sensors")).alias("sensor_count"),
        F.col("r.datetimeFirst.local").alias("datetime_first"), F.col("r.datetimeLast.local").alias("datetime_last"))


def join_location_pages(locations: DataFrame) -> DataFrame:
    """Locations whose sensors came on several pages, as one row each: parameters of all, sensors added up. Other columns must agree."""
    same = [c for c in locations.columns if c not in ("parameters", "sensor_count")]
    names = F.filter(F.array_distinct(F.flatten(F.collect_set(F.split("parameters", ",")))), lambda n: n != "")
    return locations.groupBy(*same).agg(F.array_join(F.array_sort(names), ",").alias("parameters"), F.sum("sensor_count").cast("int").alias("sensor_count")).select(locations.columns)


def in_bbox(df: DataFrame, lat: str, lon: str, box: str | tuple[float, float, float, float]) -> DataFrame:
    """Points within a region's box, edges included."""
    w, s, e, n = REGIONS[box] if isinstance(box, str) else box
    return df.filter(F.col(lon).between(w, e) & F.col(lat).between(s, n))


def reports_parameter(df: DataFrame, parameters: str, name: str, exact: bool = False) -> DataFrame:
    """I4: rows whose parameter string holds ``name``, case aside: anywhere in it, or with ``exact`` as a listed name."""
    c = F.lower(parameters)
    hit = F.array_contains(F.split(c, ","), name.lower()) if exact else c.contains(name.lower())
    return df.filter(F.coalesce(hit, F.lit(False)))


def latest_sensor_ids(latest: DataFrame, sensor: str = "sensorsId") -> DataFrame:
    """Distinct sensor ids, null and zero aside."""
    return latest.select(F.explode("results").alias("r")).select(F.col(f"r.{sensor}").alias("sensor_id")).filter("sensor_id is not null and sensor_id <> 0").distinct()


def flatten_measurements(pages: DataFrame, layout: str = "narrow", also: tuple[str, ...] = ()) -> DataFrame:
    """One row per measurement from pages (location_id, sensor_id, results, columns ``also`` that are kept); missing structs give NULLs."""
    r = pages.select("location_id", "sensor_id", *also, F.explode("results").alias("r"))
    return r.select("location_id", "sensor_id", *also, *[F.col(f"r.{path}").alias(name) for name, path in schemas.LAYOUTS[layout].items()])


def sensors_overlapping(sensors: DataFrame, start: str, end: str, parameter: str = "pm25") -> DataFrame:
    """Sensors of the parameter whose dates (first ten characters) overlap [start, end], both ends included; ``first_date`` orders them."""
    d = sensors.withColumns({"first_date": F.substring("datetime_first", 1, 10), "last_date": F.substring("datetime_last", 1, 10)})
    return d.filter((F.lower("parameter_name") == parameter) & (F.col("last_date") >= start) & (F.col("first_date") <= end))


def sensors_in_windows(sensors: DataFrame, windows: DataFrame, start: str = "window_start", end: str = "window_end", parameter: str = "pm25") -> DataFrame:
    """I7 for many windows at once: every sensor of the parameter with each window (dates) that its dates overlap, both ends included.
    Sensors whose dates cannot be read meet none."""
    s = sensors.filter(F.lower("parameter_name") == parameter)
    s = s.withColumns({"first_date": F.substring("datetime_first", 1, 10).try_cast("date"), "last_date": F.substring("datetime_last", 1, 10).try_cast("date")})
    return overlap_join(s, windows, ("first_date", "last_date"), (start, end))


def guard_window(df: DataFrame, local: str, start: str, end: str, mode: str = "dates", parameter: str | None = None, parameter_col: str = "parameter_name") -> DataFrame:
    """I8: rows of the window by the local clock. dates: start <= date <= end. half_open: start 00:00 <= clock < end 00:00; bad times are dropped."""
    if mode not in ("dates", "half_open"):
        raise ValueError("mode must be 'dates' or 'half_open'")
    ts = local_clock(local)
    if mode == "dates":
        ok = F.to_date(ts).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    else:
        ok = (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))
    if parameter is not None:
        ok = ok & (F.lower(parameter_col) == parameter)
    return df.filter(ok)


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def stitch_sensors(df: DataFrame, location: str = "location_id", utc: str = "datetime_from_utc", first_date: str = "first_date", sensor: str = "sensor_id") -> DataFrame:
    """One row per location and hour, from the sensor with the earliest first date."""
    return keep_first(df, [location, utc], [F.asc_nulls_last(first_date), sensor])


def merge_batches(old: DataFrame, new: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Rows of both pulls, one per key; the old pull wins, ties within a pull go by ``tie``."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, keys, ["_batch", *tie]).drop("_batch")


def merge_summary(merged: DataFrame, key: str, local: str, before: DataFrame | None = None) -> DataFrame:
    """Rows, first and last local time by key; with ``before`` also the rows before merging."""
    out = merged.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(local).alias("first_local"), F.max(local).alias("last_local"))
    return out if before is None else out.join(before.groupBy(key).agg(F.count("*").alias("rows_before")), key, "left")


def fetch_outcome(stations: DataFrame, sensors: DataFrame, rows: DataFrame, key: str = "location_id") -> DataFrame:
    """Done (rows in the window), empty (a sensor but no rows) or failed (no sensor) for every station."""
    s = sensors.groupBy(key).agg(F.count("*").alias("n_sensors"))
    r = rows.groupBy(key).agg(F.count("*").alias("n_rows"))
    out = stations.select(key).distinct().join(s, key, "left").join(r, key, "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("n_sensors", "n_rows")}
    return out.withColumns(n).withColumn("outcome", F.when(F.col("n_sensors") == 0, "failed").when(F.col("n_rows") == 0, "empty").otherwise("done"))


def with_chunks(df: DataFrame, by: list[str], rows: int, chunk: str = "_chunk") -> DataFrame:
    """Column ``chunk`` that deals every group by row hash to pieces of about ``rows`` rows, as its count asks for."""
    n = df.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).count()
    # only groups past ``rows``, so at most one row per ``rows`` rows of df is broadcast
    large = n.filter(F.col("count") > rows).withColumn("_pieces", F.ceil(F.col("count") / rows)).drop("count")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)])
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    piece = F.coalesce(F.pmod(F.xxhash64(*hashed), F.col("_pieces")), F.lit(0)).cast("int")
    return df.join(F.broadcast(large), same, "left").withColumn(chunk, piece).select(*df.columns, chunk)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite", rows: int = FILE_ROWS, dynamic: bool = False) -> None:
    """Parquet by partition columns; rows of a partition are gathered in chunks of about ``rows``, so each directory gets
    few files and no task a whole partition. Prefer a month to a station: thousands of stations mean as many tiny files. With ``dynamic``
    overwriting replaces only the partitions that ``df`` has rows for."""
    df = with_chunks(df, by, rows).repartition(*by, "_chunk").drop("_chunk")
    df.write.mode(mode).option("maxRecordsPerFile", 2 * rows).option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy(*by).parquet(path)


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    """All partitions as one table."""
    return spark.read.parquet(path)


def read_station_csvs(spark: SparkSession, path: str, schema, pattern: str = r"pm25_loc_(\d+)\.csv") -> DataFrame:
    """A folder with a CSV per station; the id comes from the file name."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.withColumn("location_id", F.regexp_extract(F.input_file_name(), pattern, 1).cast("bigint"))


def sample_raster_at_points(points: DataFrame, pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each point and image the pixel that holds the point; rows without ``value`` go. Points and pixels share the
    cell columns ``keys`` (see geo.snap_to_grid). A cell's rows, points times images, are dealt to as many tasks as they ask for."""
    return _sampled(points, pixels.filter(F.col(value).isNotNull()), keys)


#: Points that travel together, as an array, and pixels in a tile: a row of the merge, as many pixels times as many points, is in memory at once.
GROUP, PIXELS = 256, 1_024


def _sampled(points: DataFrame, pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``points.join(pixels, keys)``. Groups of a cell's points meet its pixels and are taken apart last, so rows come out group by group and pixel by
    pixel: in files a pixel's columns are runs and those of points repeat every GROUP rows, which both take next to no room."""
    of_point = [c for c in points.columns if c not in keys]
    hashed = [f.name for f in points.schema.fields if f.name in of_point and "map<" not in f.dataType.simpleString()]  # maps have no hash
    if not hashed:
        return spread_join(points, pixels, keys)
    known = points.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    large = known.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > SIDE)
    piece = F.pmod(F.xxhash64(*hashed), F.coalesce(F.ceil(F.col("_n") / SIDE), F.lit(1))).alias("_piece")
    lists = known.join(F.broadcast(large), keys, "left").groupBy(*keys, piece).agg(F.collect_list(F.struct(*of_point)).alias("_of"))
    starts = F.sequence(F.lit(1), F.size("_of"), F.lit(GROUP))
    groups = lists.select(*keys, "_of", "_piece", F.explode(starts).alias("_from")).select(*keys, "_piece", "_from", F.slice("_of", F.col("_from"), GROUP).alias("_of"))
    met = spread_join(groups, pixels, keys, PIXELS, SIDE * SIDE // PIXELS // GROUP)
    return met.select(*keys, F.inline("_of"), *[c for c in pixels.columns if c not in keys])


def cell_series(mapping: DataFrame, grid: DataFrame, cell: list[str], cell_id: str = "cell_id") -> DataFrame:
    """The grid's series of every distinct cell of the mapping, once, with its id."""
    return grid.join(mapping.select(*cell, cell_id).distinct(), cell)


#: Columns of a permissive read beside those of the schema.
CORRUPT, FILE = "_corrupt_record", "_file"


def read_permissive(spark: SparkSession, path: str, schema: str, format: str = "json", **options) -> DataFrame:
    """Landed files as they are: the columns of ``schema``, the text of a record that does not fit it (else NULL), and the file it is from."""
    options = ({"header": True, "quote": '"', "escape": '"', "enforceSchema": True} if format == "csv" else {}) | options
    df = spark.read.schema(f"{schema}, {CORRUPT} string").options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options).format(format).load(path)
    return df.select("*", F.col("_metadata.file_name").alias(FILE))


def good_rows(df: DataFrame) -> DataFrame:
    """Records that fit the schema, of a permissive read."""
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, FILE)


def quarantined_rows(df: DataFrame) -> DataFrame:
    """(record, file, n_read): records that do not fit, the file of each and how many of its fields could be read all the same."""
    n_read = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in df.columns if c not in (CORRUPT, FILE)])
    return df.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("record"), F.col(FILE).alias("file"), n_read.alias("n_read"))


def land(spark: SparkSession, path: str, schema: str, out: str, format: str = "json", **options) -> tuple[DataFrame, DataFrame]:
    """Writes a landing to the Parquet table ``out`` in one pass, its broken records in a partition of their own, and returns
    (good rows, quarantine). Every record is in one of them."""
    df = read_permissive(spark, path, schema, format, **options)
    df.withColumn("quarantined", F.col(CORRUPT).isNotNull()).write.mode("overwrite").partitionBy("quarantined").parquet(out)
    return landed(spark, out, schema)


def landed(spark: SparkSession, out: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine) of a table of :func:`land`; each reads its own partition."""
    df = spark.read.schema(f"{schema}, {CORRUPT} string, {FILE} string, quarantined boolean").parquet(out)
    return good_rows(df.filter(~F.col("quarantined")).drop("quarantined")), quarantined_rows(df.filter("quarantined").drop("quarantined"))


def write_tiles(pixels: DataFrame, path: str, keys: list[str], degrees: float, order: list[str], rows: int = FILE_ROWS) -> None:
    """Pixels (with their cell's centre in columns ``keys``, latitude first) by tiles of ``degrees``, each a directory, in files of about ``rows`` rows that are
    sorted by ``order``, so that a file's statistics tell which images it has."""
    df = pixels.filter(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull()).withColumns(_tile(keys, degrees))
    df = with_chunks(df, list(TILE), rows).repartition(*TILE, "_chunk").sortWithinPartitions(*TILE, *order).drop("_chunk")
    df.write.mode("overwrite").option("maxRecordsPerFile", 2 * rows).partitionBy(*TILE).parquet(path)


TILE = ("tile_lat", "tile_lon")


def _tile(keys: list[str], degrees: float) -> dict[str, Column]:
    return {t: F.floor(F.col(c) / degrees).cast("int") for t, c in zip(TILE, keys, strict=True)}


def sample_tiles(points: DataFrame, spark: SparkSession, path: str, keys: list[str], value: str, degrees: float) -> DataFrame:
    """I14 over tiles of :func:`write_tiles`: the same rows as :func:`sample_raster_at_points`. Spark reads only the directories of tiles that hold
    points (dynamic partition pruning, as long as it broadcasts the points), so points of a city do not scan a continent."""
    at = points.filter(F.col(keys[0]).between(-90, 90) & F.col(keys[1]).between(-360, 360)).withColumns(_tile(keys, degrees))
    # the cells of the points prune the directories, then points and pixels meet in tiles of many tasks
    cells = at.select(*TILE, *keys).distinct()
    pixels = spark.read.parquet(path).filter(F.col(value).isNotNull()).join(cells, [*TILE, *keys], "left_semi")
    return _sampled(at, pixels, [*TILE, *keys]).drop(*TILE)
