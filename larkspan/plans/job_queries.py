"""Queries that write and read back, or run a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, regression, search, splits
from ..operators.lookup import lookup_join
from ..session import scratch_path, staged
from ..sources import files, sinks, tables
from ..streaming import ordering, requests
from . import workflows
from .profile_queries import sql_strip
from .registry import query, spread, table
from .text_queries import SQL_DOCUMENT_CHUNKS, SQL_HASHED, SQL_TEXT_CHUNKS, document_files

# --- sources and sinks -------------------------------------------------------------


@query("csv_roundtrip", """
SELECT doc_id, text, lang, source, n_chars FROM documents""")
def csv_roundtrip(spark, d):
    path = sinks.write_csv(table(spark, d, "documents"), scratch_path(spark, "csv"))
    return tables.read_csv(spark, path, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")


@query("jsonl_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_roundtrip(spark, d):
    path = scratch_path(spark, "jsonl")
    table(spark, d, "conversations").write.option("compression", "gzip").json(path)
    return tables.read_jsonl(spark, path, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")


@query("sharded_read", """
WITH p AS (SELECT lang, text, row_number() OVER (ORDER BY md5('42|' || doc_id::VARCHAR)) AS rn, count(*) OVER () AS n
           FROM documents)
SELECT lang AS language, CASE WHEN rn <= floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split, count(*) AS n,
       sum(length(text))::BIGINT AS chars
FROM p GROUP BY 1, 2""")
def sharded_read(spark, d):
    """Shards in a folder per language and split; the language is the folder's."""
    root = scratch_path(spark, "shards")
    docs = splits.validation_split(table(spark, d, "documents"), ["doc_id"])
    rows = docs.select("split", "lang", F.col("text").alias("code"), F.lit("?").alias("language"))
    rows.write.partitionBy("split", "lang").json(root)
    folders = [f"lang={r['lang']}" for r in docs.select("lang").distinct().collect()]
    found = None
    for split in ("train", "val"):
        part = tables.read_sharded(
            spark, f"{root}/split={split}", folders, "part-", "code STRING, language STRING", ("json",)
        ).withColumn("split", F.lit(split))
        found = part if found is None else found.unionByName(part)
    named = found.withColumn("language", F.regexp_replace("language", "^lang=", ""))
    return named.groupBy("language", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("code")).alias("chars")
    )


@query("write_split", """
SELECT split, count(*) AS n FROM (
  SELECT CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT row_number() OVER (ORDER BY md5('42|' || o_orderkey::VARCHAR)) AS rn, count(*) OVER () AS n FROM orders))
GROUP BY split""")
def write_split(spark, d):
    path = scratch_path(spark, "split")
    sinks.write_split(splits.positional_split(table(spark, d, "orders"), ["o_orderkey"]), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("feature_cache", """
SELECT label % 6 AS language_id, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 6) AS total
FROM embeddings GROUP BY 1""")
def feature_cache(spark, d):
    path = scratch_path(spark, "features")
    rows = table(spark, d, "embeddings").select(
        "embedding", (F.col("label") % 6).alias("language_id"),
        F.col("vec_id").cast("float").alias("cyclomatic_complexity"),
    )
    cached = tables.read_feature_cache(spark, sinks.write_feature_cache(rows, path)).withColumn("language_id", F.col("language_id").cast("int"))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return cached.groupBy("language_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(total), 6).alias("total")
    )


@query("scan_and_decode", """
SELECT lang, count(*) AS docs, (sum(length(text)) + count(*))::BIGINT AS chars FROM documents
WHERE lang <> 'de' GROUP BY lang""")
def scan_and_decode(spark, d):
    """Documents written as text files per language, one folder of which the scan ignores."""
    root = scratch_path(spark, "tree")
    docs = table(spark, d, "documents")
    one_line = F.translate("text", "\r\n", "  ")
    docs.select(one_line.alias("value"), "lang").write.partitionBy("lang").text(root)
    found = files.read_documents(files.scan_files(
        spark, root, ignored_folders=["lang=de"], ignored_files=["_SUCCESS"], ignored_extensions=[".crc"]
    ))
    lang = F.regexp_extract("filepath", "lang=([a-z]+)", 1)
    per_file = found.select(
        lang.alias("lang"), F.size(F.split("content", "\n")).alias("parts"), F.length("content").alias("chars")
    )
    return per_file.groupBy("lang").agg(
        F.sum(F.col("parts") - 1).alias("docs"), F.sum("chars").alias("chars")
    )


def _video_pages(spark, d):
    """Parts as landed feed pages: one page per brand and size."""
    snippet = F.struct(
        F.struct(F.col("p_partkey").cast("string").alias("videoId")).alias("resourceId"),
        F.col("p_name").alias("title"), F.col("p_type").alias("description"),
        F.concat(F.lit("Channel "), "p_brand").alias("channelTitle"), F.lit("2024-01-01T00:00:00Z").alias("publishedAt"),
    )
    pages = table(spark, d, "part").groupBy(
        F.col("p_brand").alias("playlist_id"), (F.col("p_partkey") / 50).cast("int").alias("page")
    ).agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), snippet.alias("snippet")))).alias("rows"))
    landed = F.to_json(F.struct(
        F.transform("rows", lambda r: F.struct(r["snippet"].alias("snippet"))).alias("items"), "playlist_id", "page"
    ))
    return pages.select(landed.alias("value"))


@query("video_payloads", """
SELECT p_partkey::VARCHAR AS video_id, p_name AS title, p_type AS description, 'Channel ' || p_brand AS channel,
       '2024-01-01T00:00:00Z' AS published_at, p_brand AS playlist_id,
       (row_number() OVER (PARTITION BY p_brand, p_partkey // 50 ORDER BY p_partkey) - 1)::INT AS position,
       substr(p_brand, 7)::INT % 2 AS label
FROM part""")
def video_payloads(spark, d):
    """Feed pages landed as JSON, flattened, with the label of their playlist."""
    path = scratch_path(spark, "pages")
    _video_pages(spark, d).write.text(path)
    videos = tables.flatten_video_payload(tables.read_jsonl(spark, path, tables.VIDEO_PAYLOAD)).drop("page")
    playlists = table(spark, d, "part").select(F.col("p_brand").alias("playlist_id")).distinct()
    labelled = playlists.withColumn("label", F.substring("playlist_id", 7, 10).cast("int") % 2)
    return lookup_join(videos, labelled, ["playlist_id"], "inner")


@query("channel_payloads", """
SELECT 'Real ' || s_name AS channel, 'UC' || s_suppkey AS channel_id, 'UU' || s_suppkey AS uploads_playlist,
       (s_nationkey % 2)::INT AS label
FROM supplier WHERE s_acctbal >= 0""")
def channel_payloads(spark, d):
    """Channel lookups landed as JSON; a supplier in debt stands for a miss."""
    hit = F.struct(F.struct(F.concat(F.lit("UC"), F.col("s_suppkey").cast("string")).alias("channelId")).alias("snippet"))
    none = F.array().cast("array<struct<snippet:struct<channelId:string>>>")
    detail = F.struct(
        F.struct(F.concat(F.lit("Real "), "s_name").alias("title")).alias("snippet"),
        F.struct(F.struct(F.concat(F.lit("UU"), F.col("s_suppkey").cast("string")).alias("uploads")).alias("relatedPlaylists")).alias("contentDetails"),
    )
    landed = F.to_json(F.struct(
        F.struct(F.when(F.col("s_acctbal") >= 0, F.array(hit)).otherwise(none).alias("items")).alias("search"),
        F.struct(F.array(detail).alias("items")).alias("channels"), (F.col("s_nationkey") % 2).alias("label"),
    ))
    path = scratch_path(spark, "channels")
    table(spark, d, "supplier").select(landed.alias("value")).write.text(path)
    return tables.flatten_channel_payload(tables.read_jsonl(spark, path, tables.CHANNEL_PAYLOAD))


@query("params_roundtrip", """
SELECT l_returnflag AS language, round(regr_slope(l_extendedprice, l_quantity), 6) AS a,
       round(regr_intercept(l_extendedprice, l_quantity), 3) AS b FROM lineitem GROUP BY l_returnflag""")
def params_roundtrip(spark, d):
    """Scaler and calibration written as a parameter document and read again."""
    items = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("language"), F.col("l_extendedprice").alias("target"),
        F.col("l_quantity").alias("prediction"),
    )
    fitted = regression.fit_calibration(items, "language")
    params = regression.merge_params(
        regression.fit_scaler(items, "target"), fitted, "language", "corrected = a * raw + b before inversion"
    )
    path = sinks.write_params(params, scratch_path(spark, "params"))
    table_ab = tables.calibration_table(tables.read_params(spark, path))
    return table_ab.select("language", F.round("a", 6).alias("a"), F.round("b", 3).alias("b"))


# --- corpus index ------------------------------------------------------------------


@query("build_index", f"""
WITH c AS ({SQL_DOCUMENT_CHUNKS})
SELECT count(DISTINCT d.doc_id) AS files, count(DISTINCT c.doc_id) AS files_indexed, count(DISTINCT d.doc_id) - count(DISTINCT c.doc_id) AS files_failed,
       count(DISTINCT CASE WHEN d.doc_id % 4 < 2 AND {sql_strip("coalesce(text, '')")} = '' THEN d.doc_id END) AS files_empty,
       0::BIGINT AS files_unreadable, 0::BIGINT AS files_unparsed, count(c.doc_id) AS chunks
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""")
def build_index(spark, d):
    """Files to chunks with vectors, stored as one table, with the statistics of that pass."""
    return workflows.index_documents(spread(document_files(spark, d)), scratch_path(spark, "index"), sep="\n")


def _written_tree(spark, d):
    """Documents as real files in a folder per source, some Latin-1, some with CR LF, some with hidden or ignored names."""
    root = scratch_path(spark, "tree")
    name = (
        F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("_"), "filename")).when(F.col("doc_id") % 9 == 5, F.concat(F.lit("."), "filename"))
        .when(F.col("doc_id") % 9 == 6, F.concat("filename", F.lit(".PNG"))).otherwise(F.col("filename"))
    )
    folder = F.when(F.col("doc_id") % 9 == 7, "node_modules").when(F.col("doc_id") % 9 == 8, F.concat(F.lit("_"), "source")).otherwise(F.col("source"))
    content = F.when(F.col("doc_id") % 5 == 1, F.replace("content", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("content"))
    rows = document_files(spark, d).withColumn("doc_id", F.regexp_extract("filename", r"(\d+)", 1).cast("long"))
    rows = rows.withColumn("source", F.split("filepath", "/")[2]).select(
        F.concat_ws("/", folder, name).alias("path"), content.alias("content"), (F.col("doc_id") % 5 == 2).alias("latin"))

    def write(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        for batch in batches:
            for path, text, latin in zip(*[c.to_pylist() for c in batch.columns]):
                raw = text.encode("latin-1") if latin and all(ord(c) < 256 for c in text) else text.encode()
                system, place = pafs.FileSystem.from_uri(f"{root}/{path}" if "://" in root else f"file://{root}/{path}")
                system.create_dir(place.rsplit("/", 1)[0])
                with system.open_output_stream(place) as out:
                    out.write(raw)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    spread(rows).mapInArrow(write, "n BIGINT").agg(F.sum("n")).collect()
    return root


# Documents whose files the scan takes, and their place in the tree.
_TREE = """
SELECT doc_id, doc_id % 4 AS kind, text,
       CASE WHEN doc_id % 9 = 8 THEN '_' ELSE '' END || source || '/' || CASE doc_id % 9 WHEN 4 THEN '_' WHEN 5 THEN '.' ELSE '' END AS place
FROM documents WHERE doc_id % 9 NOT IN (6, 7)"""


@query("build_index_tree", f"""
WITH f AS ({_TREE})
SELECT place || 'doc' || doc_id || extension AS file, extension, chunk_id::INT AS chunk_id, content
FROM ({SQL_DOCUMENT_CHUNKS}) JOIN f USING (doc_id)""")
def build_index_tree(spark, d):
    """The index of a written file tree."""
    root, out = _written_tree(spark, d), scratch_path(spark, "index")
    workflows.build_index(spark, root, out, sep="\n")
    inner = F.substring_index(F.col("filepath"), "/", -2)
    return spark.read.parquet(out).select(inner.alias("file"), "extension", "chunk_id", "content")


@query("build_index_tree_stats", f"""
WITH f AS ({_TREE}), c AS (SELECT doc_id FROM ({SQL_DOCUMENT_CHUNKS}) JOIN f USING (doc_id))
SELECT (SELECT count(*) FROM f) AS files, count(DISTINCT doc_id) AS files_indexed, (SELECT count(*) FROM f) - count(DISTINCT doc_id) AS files_failed,
       (SELECT count(*) FROM f WHERE kind < 2 AND {sql_strip("coalesce(text, '')")} = '') AS files_empty,
       0::BIGINT AS files_unreadable, 0::BIGINT AS files_unparsed, count(*) AS chunks FROM c""")
def build_index_tree_stats(spark, d):
    """The statistics of the pass that writes the index of a file tree."""
    return workflows.build_index(spark, _written_tree(spark, d), scratch_path(spark, "index"), sep="\n")


@query("file_columns", f"""
SELECT place || 'doc' || doc_id || k.extension AS file, CASE doc_id % 9 WHEN 4 THEN '_' WHEN 5 THEN '.' ELSE '' END || 'doc' || doc_id || k.extension AS filename,
       k.extension FROM ({_TREE}) JOIN (VALUES (0, '.txt'), (1, '.md'), (2, '.json'), (3, '.py')) k(kind, extension) USING (kind)""")
def file_columns(spark, d):
    """Name and extension of every listed file of a written tree."""
    listed = files.list_files(spark, _written_tree(spark, d))
    return listed.select(F.substring_index(F.col("filepath"), "/", -2).alias("file"), files.file_name("filepath").alias("filename"),
                         files.extension(files.file_name("filepath")).alias("extension"))


# --- streams -----------------------------------------------------------------------

# Turns as request lines: some are no JSON, some no object, some out of range.
REQUEST_LINE = (
    "CASE turn % 6 WHEN 0 THEN '{bad' WHEN 1 THEN '[1]' WHEN 2 THEN '{\"command\": \"ping\"}' "
    "WHEN 3 THEN '{\"query\": \"' || role || '\", \"top_k\": \"' || conv_id || '\"}' "
    "WHEN 4 THEN '{\"query\": \"' || role || '\", \"top_k\": \"x\"}' "
    "ELSE '{\"query\": \"  \", \"top_k\": 3}' END"
)


def _request_stream(spark, d):
    source = f"{d.rstrip('/')}/conversations.parquet"
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).parquet(f"{source}*")
    return rows.select("conv_id", "turn", F.expr(REQUEST_LINE).alias("value"))


@query("stream_requests", """
SELECT conv_id, turn, CASE turn % 6 WHEN 3 THEN conv_id::INT WHEN 4 THEN NULL WHEN 5 THEN 3 ELSE 10 END AS top_k,
       CASE turn % 6 WHEN 0 THEN 'Invalid JSON' WHEN 1 THEN 'Request must be a JSON object.'
            WHEN 3 THEN CASE WHEN conv_id <= 0 THEN 'top_k must be a positive integer, got ' || conv_id END
            WHEN 4 THEN '''top_k'' must be an integer, got ''x''.'
            WHEN 5 THEN 'Request must include a non-empty ''query'' string.' END AS error,
       CASE turn % 6 WHEN 2 THEN '{"ok":true,"pong":true}' END AS reply
FROM conversations""")
def stream_requests(spark, d):
    """Request lines read as a stream, parsed and checked, then read back."""
    out = scratch_path(spark, "requests")
    parsed = requests.parse_search_requests(_request_stream(spark, d))
    run = (
        parsed.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(spark, "requests-state")).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.parquet(out).select("conv_id", "turn", "top_k", "error", "reply")


_TURNS = "(SELECT conv_id || ':' || turn AS request_id, text FROM conversations)"


@query("stream_search", f"""
WITH RECURSIVE {SQL_TEXT_CHUNKS},
{SQL_HASHED.format(name='dv', ids='doc_id, chunk_id', text='content', source='chunks')},
{SQL_HASHED.format(name='qv', ids='request_id', text='text', source=_TURNS)},
s AS (SELECT request_id, doc_id, chunk_id, round(sum(qv.x * dv.x), 12) AS score
      FROM qv JOIN dv ON qv.dim = dv.dim GROUP BY request_id, doc_id, chunk_id)
SELECT request_id, rank, 'doc' || doc_id AS filepath, chunk_id, round(score, 9) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, 'doc' || doc_id, chunk_id)::INT AS rank
      FROM s) WHERE rank <= 10 AND score >= 0.2""")
def stream_search(spark, d):
    """All turns as a stream of searches over the chunks of all documents; answers unrolled to rows."""
    path = scratch_path(spark, "stream-index")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    documents = spread(table(spark, d, "documents").select(
        name.alias("filename"), name.alias("filepath"), F.col("text").alias("content")
    ))
    sinks.write_index(search.embed(chunking.chunk_text(documents, sep="\n")), path)
    source = f"{d.rstrip('/')}/conversations.parquet"
    turns = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*")
    lines = turns.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.to_json(F.struct(F.col("text").alias("query"))).alias("value"),
    )
    out = scratch_path(spark, "answers")
    run = requests.serve_search(
        lines, lambda: spark.read.parquet(path), "request_id", out, scratch_path(spark, "answers-state"), once=True
    )
    run.awaitTermination()
    shape = "results ARRAY<STRUCT<rank:INT,score:DOUBLE,filepath:STRING,chunk_id:INT>>"
    answers = spark.read.parquet(out).select("request_id", F.from_json("response", shape)["results"].alias("results"))
    return answers.select("request_id", F.inline("results"))


@query("stream_in_order", """
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS out, response FROM (
  SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'Invalid JSON' WHEN 1 THEN 'Request must be a JSON object.' WHEN 2 THEN '{"ok":true,"pong":true}'
         WHEN 3 THEN CASE WHEN conv_id <= 0 THEN 'top_k must be a positive integer, got ' || conv_id ELSE 'search ' || conv_id END
         WHEN 4 THEN '''top_k'' must be an integer, got ''x''.' ELSE 'Request must include a non-empty ''query'' string.' END AS response
  FROM conversations)""")
def stream_in_order(spark, d):
    """Requests of many conversations that arrive mixed over several micro-batches, answered in the order of the turns."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.expr(REQUEST_LINE).alias("value"))
    arrivals = ordering.dealt_files(lines, 6)
    stream = spark.readStream.schema("conv_id LONG, turn LONG, value STRING").option("maxFilesPerTrigger", 2).parquet(arrivals)
    parsed = requests.parse_search_requests(stream)
    searched = F.concat(F.lit("search "), F.col("top_k").cast("string"))
    answers = parsed.select("conv_id", "turn", F.coalesce("reply", "error", searched).alias("response"))
    out = scratch_path(spark, "in-order")
    ordering.serve_in_order(answers, "conv_id", "turn", out, scratch_path(spark, "in-order-state"), once=True).awaitTermination()
    return spark.read.parquet(out)
