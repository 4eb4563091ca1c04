"""Tabular sources."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELLED_VIDEOS = (
    "video_id STRING, title STRING, description STRING, channel STRING, published_at STRING, label INT"
)
INTENTS = "text STRING, intent STRING, slot STRING"
CODE_RECORDS = (
    "repo STRING, path STRING, func_name STRING, original_string STRING, language STRING, code STRING"
)
PARAMETERS = (
    "target_mean DOUBLE, target_std DOUBLE, transform STRING, language_to_id MAP<STRING,INT>, "
    "max_token_len INT, backbone STRING, lang_embed_dim INT, "
    "per_language_calibration MAP<STRING,STRUCT<a:DOUBLE,b:DOUBLE>>, calibration_note STRING"
)
MAX_TOKEN_LEN = 512


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str, multi_line: bool = True) -> DataFrame:
    """Header line, quoted text, empty cell = null.

    Text with line ends inside quotes needs ``multi_line``, and then a file is read by one task, whatever its
    size. Without it a large file is split, and a line end always ends a row.
    """
    return (
        spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """One object per line, plain or gzip; blank lines skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_sharded(
    spark: SparkSession, root: str, languages: Iterable[str], split: str, schema: str = CODE_RECORDS,
    suffixes: Sequence[str] = ("jsonl", "gz"),
) -> DataFrame:
    """All shards of a split below ``root/<language>/``.

    The language is the folder's, whatever the record says. ``shard`` and
    ``line`` give the file and line order.
    """
    folder = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/")
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    relative = F.substr(folder, F.lit(len(base) + 2))
    frame = (
        spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True)
        .json(root)
        .filter(F.col("_metadata.file_name").contains(split))
        .filter(F.col("_metadata.file_name").rlike(rf"\.({'|'.join(suffixes)})$"))
        # a condition on the path alone, below the row numbers, so that other files are not read
        .filter(F.element_at(F.split(relative, "/"), 1).isin(list(languages)))
    )
    return frame.withColumns({
        "language": F.element_at(F.split(relative, "/"), 1),
        "shard": F.col("_metadata.file_path"),
        "block": F.col("_metadata.file_block_start"),
        "line": F.monotonically_increasing_id(),
    })


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_feature_cache(spark: SparkSession, path: str) -> DataFrame:
    """Vectors with their language id and target, aligned by row."""
    schema = "embedding ARRAY<FLOAT>, language_id BIGINT, cyclomatic_complexity FLOAT"
    return spark.read.schema(schema).parquet(path)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Parameter document; without calibration an empty map, default token limit 512."""
    raw = spark.read.schema(PARAMETERS).option("multiLine", True).json(path)
    empty = F.create_map().cast("map<string,struct<a:double,b:double>>")
    return raw.withColumns({
        "per_language_calibration": F.coalesce("per_language_calibration", empty),
        "max_token_len": F.coalesce("max_token_len", F.lit(MAX_TOKEN_LEN)),
    })


def calibration_table(params: DataFrame) -> DataFrame:
    return params.select(F.explode("per_language_calibration").alias("language", "c")).select(
        "language", "c.a", "c.b"
    )


def inline_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# --- landed video payloads -----------------------------------------------------

VIDEO_PAYLOAD = (
    "items ARRAY<STRUCT<snippet: STRUCT<resourceId: STRUCT<videoId: STRING>, title: STRING, "
    "description: STRING, channelTitle: STRING, publishedAt: STRING>>>, playlist_id STRING, page INT"
)
CHANNEL_PAYLOAD = (
    "search STRUCT<items: ARRAY<STRUCT<snippet: STRUCT<channelId: STRING>>>>, "
    "channels STRUCT<items: ARRAY<STRUCT<snippet: STRUCT<title: STRING>, "
    "contentDetails: STRUCT<relatedPlaylists: STRUCT<uploads: STRING>>>>>, label INT"
)


def flatten_video_payload(pages: DataFrame) -> DataFrame:
    """One row per listed video, in feed order within a playlist."""
    items = pages.select("playlist_id", "page", F.posexplode("items").alias("position", "item"))
    s = "item.snippet"
    return items.select(
        "playlist_id", "page", "position",
        F.col(f"{s}.resourceId.videoId").alias("video_id"), F.col(f"{s}.title").alias("title"),
        F.col(f"{s}.description").alias("description"), F.col(f"{s}.channelTitle").alias("channel"),
        F.col(f"{s}.publishedAt").alias("published_at"),
    )


def flatten_channel_payload(found: DataFrame) -> DataFrame:
    """First search hit with its own title and uploads playlist; misses are dropped."""
    hit, detail = F.get("search.items", F.lit(0)), F.get("channels.items", F.lit(0))
    rows = found.select(
        detail["snippet"]["title"].alias("channel"), hit["snippet"]["channelId"].alias("channel_id"),
        detail["contentDetails"]["relatedPlaylists"]["uploads"].alias("uploads_playlist"), "label",
    )
    return rows.filter(F.col("channel_id").isNotNull() & F.col("uploads_playlist").isNotNull())
