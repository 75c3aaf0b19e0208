"""Readers and writers: GeoJSON layers, coordinate CSVs, JSON lines, dataset specs and catalogues, streams."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats by file extension where they differ from it.
FORMATS = {"jsonl": "json", "txt": "text"}


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """One row a feature: its properties (DDL of their columns) and its geometry as text."""
    schema = f"features array<struct<properties:struct<{', '.join(p.strip().replace(' ', ':', 1) for p in properties.split(','))}>,geometry:struct<type:string,coordinates:string>>>"
    feature = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return feature.select("f.properties.*", F.to_json("f.geometry").alias("geometry"))


def read_lonlat_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, lon, lat) from columns RecordNumber, Title, Longitude, Latitude; rows out of range are dropped."""
    rows = spark.read.csv(path, header=True)
    lon, lat = F.col("Longitude").try_cast("double"), F.col("Latitude").try_cast("double")
    row_id = F.coalesce(F.col("RecordNumber").try_cast("long"), F.monotonically_increasing_id()) if "RecordNumber" in rows.columns else F.monotonically_increasing_id()
    return rows.select(row_id.alias("id"), F.col("Title").alias("name"), lon.alias("lon"), lat.alias("lat")).where("lon between -180 and 180 and lat between -90 and 90")


def read_tuple_csv(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """(name, lon, lat) from a ``coords`` text like ``[(lon, lat)]``; rows that cannot be read are dropped."""
    number = r"(-?[0-9.]+)"
    part = lambda k: F.regexp_extract("coords", rf"\(\s*{number}\s*,\s*{number}\s*\)", k).try_cast("double")
    return spark.read.csv(path, header=True).select(F.col(name).alias("name"), part(1).alias("lon"), part(2).alias("lat")).dropna(subset=["lon", "lat"])


def read_image_points(spark: SparkSession, path: str, city: str) -> DataFrame:
    """Images of one city with a URL and coordinates; bad lines are skipped."""
    schema = "mapillary_id string, id long, city string, url string, geometry struct<coordinates:array<double>>, _bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = rows.where(F.col("_bad").isNull() & (F.col("city") == city) & F.col("url").isNotNull() & (F.size("geometry.coordinates") >= 2))
    at = F.col("geometry.coordinates")
    return good.select(F.col("mapillary_id").try_cast("long").alias("id"), F.col("id").alias("node_id"), F.lit("mapillary").alias("type"), "url", at[0].alias("lon"), at[1].alias("lat"))


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder by its extension; empty CSV fields stay empty text."""
    ext = path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.format(FORMATS.get(ext, ext))
    return (reader.option("header", True).option("nullValue", "\u0000").option("emptyValue", "") if ext == "csv" else reader).load(path)


def known_path(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds something at a path."""
    return _read_or_none(spark, path, spark.read.format("binaryFile").load) is not None


def parse_spec(spec: str, exists: Callable[[str], bool] = lambda path: False) -> tuple[str | None, str, list[str], int | None]:
    """(hub, path, subsets, rows) of ``[hub::]path[:sub1/sub2][#n]``.

    What ``exists`` says is there is never split, and ``#`` splits only before digits at the end; so a path may hold both
    marks. A scheme (``s3a://``) belongs to the path.
    """
    hub, rest, subsets, n = None, spec, "", None
    if not exists(rest):
        hub, _, rest = rest.rpartition("::")
    counted = None if exists(rest) else re.fullmatch(r"(.*)#(\d+)", rest, re.S)
    if counted:
        rest, n = counted[1], int(counted[2])
    if not exists(rest):
        rest, subsets = re.fullmatch(r"((?:\w+:/+)?[^:]*)(?::(.*))?", rest, re.S).groups()
    return (hub or "").lower() or None, rest.strip(), [s.strip() for s in subsets.split("/")] if subsets else [], n


def select_subsets(asked: list[str], known: list[str], weak: tuple[str, ...] = ()) -> list[str]:
    """None asked: the only subset, or ``default``, else an error; ``all``: every subset that is not weak; unknown names pass."""
    if asked == ["all"]:
        return [s for s in known if s not in weak]
    if asked:
        return asked
    if len(known) == 1:
        return known
    if "default" in known:
        return ["default"]
    raise ValueError(f"name one of the subsets: {', '.join(known)}")


def coerce_list(lines: DataFrame, field: str) -> DataFrame:
    """The text column ``value`` of JSON lines with ``field`` as a list: missing is empty, a scalar a list of one; malformed lines are dropped."""
    raw = F.get_json_object("value", f"$.{field}")
    items = F.from_json(raw, "array<string>")
    listed = F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("["), items).otherwise(F.array(raw))
    return lines.where(F.from_json("value", "map<string,string>").isNotNull()).select("value", listed.alias(field))


def union_city_tables(tables: list[DataFrame], ids: tuple[str, ...] = ("id",)) -> DataFrame:
    """Tables with different columns in one, ids as whole numbers; rows whose ids are none are dropped."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    present = [c for c in ids if c in out.columns]
    return out.withColumns({c: F.col(c).try_cast("long") for c in present}).dropna(subset=present)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Each task writes its part; nothing is gathered."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_graph_tables(edges: DataFrame, path: str, place: str) -> None:
    edges.withColumn("place", F.lit(place)).write.mode("overwrite").partitionBy("place", "type").parquet(path)


def safe_rename(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Case-insensitive renaming; where two columns map to one name neither is renamed; a name mapped to itself is protected."""
    lower = {k.lower(): v for k, v in columns.items()}
    plan = {c: lower[c.lower()] for c in df.columns if c.lower() in lower}
    targets = list(plan.values())
    return df.withColumnsRenamed({c: t for c, t in plan.items() if targets.count(t) == 1 and c != t})


def city_of(path: str) -> str | None:
    found = re.search(r"(newyork|singapore)", path.lower())
    return found[1] if found else None


def _read_or_none(spark: SparkSession, path: str, read) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return read(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_city_layers(spark: SparkSession, folder: str, properties: str, layers: tuple[str, ...] = ("area_pois", "point_pois", "roads")) -> dict[str, DataFrame | None]:
    """The layers of a city: each from its Parquet table, else its GeoJSON file, else None."""
    out = {}
    for layer in layers:
        found = _read_or_none(spark, f"{folder}/{layer}.parquet", spark.read.parquet)
        out[layer] = found if found is not None else _read_or_none(spark, f"{folder}/{layer}.geojson", lambda p: read_geojson(spark, p, properties))
    return out


def read_side_attributes(lines: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) from JSON lines (``order``, ``value``): the last value that is not null of each key wins; other lines are passed over."""
    raw = lines.select(order, F.get_json_object("value", f"$.{key}").alias(key), F.get_json_object("value", f"$.{value}").try_cast("double").alias("_v"))
    return raw.where(F.col(key).isNotNull() & F.col("_v").isNotNull()).groupBy(key).agg(F.max_by("_v", order).alias(value))


def dataset_catalogue(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """(name, path, subsets, split, columns, tags, function) of registered datasets; a name given twice is an error."""
    names = [e["name"] for e in entries]
    if len(names) != len(set(names)):
        raise ValueError("a dataset is registered twice")
    rows = [(e["name"], e["path"], e.get("subsets", []), e.get("split", "train"), e.get("columns", {}), e.get("tags", []), e.get("function")) for e in entries]
    return spark.createDataFrame(rows, "name string, path string, subsets array<string>, split string, columns map<string,string>, tags array<string>, function string")


def load_registered(spark: SparkSession, catalogue: DataFrame, name: str, functions: dict | None = None) -> DataFrame:
    """A dataset of the catalogue, its columns renamed, run through its own function of rows where it names one."""
    row = catalogue.where(F.col("name") == name).first()
    if row is None:
        raise KeyError(name)
    df = safe_rename(read_dataset(spark, row["path"]), row["columns"])
    return functions[row["function"]](df) if row["function"] else df


def write_subgraphs(nodes: DataFrame, edges: DataFrame, folder: str, buckets: int = 64) -> None:
    """Node and edge tables of subgraphs, partitioned by a hash bucket of ``graph``, so a graph is read from one bucket."""
    for name, df in (("subgraph_nodes", nodes), ("subgraph_edges", edges)):
        df.withColumn("bucket", F.pmod(F.xxhash64("graph"), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")


def materialise(train: DataFrame, val: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both parts of a dataset on disk, and read again; what is there already is read only."""
    spark, out = train.sparkSession, []
    for name, df in (("train", train), ("val", val)):
        path = f"{folder}/{name}"
        df.write.mode("ignore").parquet(path)
        out.append(spark.read.parquet(path))
    return out[0], out[1]
