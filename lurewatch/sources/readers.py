"""Files and wire payloads to rows.

Payload parsers take a DataFrame with a JSON text column, so the same code
reads files, tables and streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch import lexicon as L
from lurewatch import schemas
from lurewatch.functions.keys import flexible_timestamp
from lurewatch.functions.text import strip_space


#: Leading bytes that tell a file's type.
HEAD_BYTES = 16


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark lists it."""
    plain = spark._jvm.org.apache.hadoop.fs.Path(path)
    return plain.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(plain).toString()


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path as Spark writes it (special characters as they are) and the path within."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return pafs.FileSystem.from_uri(quote(path, safe=":/@"))


def labelled_examples(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``{purpose, labels, examples: [...]}`` documents to one row per example."""
    doc = spark.read.schema(schemas.LABELLED_DOCUMENT).option("multiLine", multi_line).json(path)
    return doc.select("purpose", F.inline("examples"))


def paraphrase_pairs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Two rows per pair: the known and the unseen wording."""
    doc = spark.read.schema(schemas.PAIR_DOCUMENT).option("multiLine", multi_line).json(path)
    pair = doc.select(F.inline("pairs"))
    return pair.select(
        F.col("id").alias("pair_id"),
        F.expr("stack(2, 'known', known.text, known.is_scam, 'unseen', unseen.text, unseen.is_scam) AS (half, text, is_scam)"),
    )


def session_file(spark: SparkSession, path: str) -> DataFrame:
    """Legacy evidence file; a missing, blank or broken one gives no rows."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return sessions_from_json(spark.createDataFrame([], "payload STRING"))
    return sessions_from_json(spark.read.text(path, wholetext=True).select(F.col("value").alias("payload")))


def sessions_from_json(df: DataFrame, column: str = "payload") -> DataFrame:
    """One row per session of a ``{sessions: {id: session}}`` payload."""
    parsed = F.from_json(F.col(column), schemas.SESSION_FILE)
    rows = df.select(F.explode_outer(parsed["sessions"]).alias("session_id", "s")).filter("session_id IS NOT NULL")
    return rows.select(
        "session_id", F.coalesce("s.scamDetected", F.lit(False)).alias("scam_detected"), F.col("s.scamType").alias("scam_type"),
        F.col("s.conversationHistory").alias("history"), F.col("s.extractedIntelligence").alias("intel"),
        flexible_timestamp(F.col("s.startTime")).alias("started_at"),
    )


def feed_entries(df: DataFrame, column: str = "payload") -> DataFrame:
    """External URL feed; entries without a URL are dropped, gaps filled."""
    rows = df.select(F.inline_outer(F.from_json(F.col(column), schemas.FEED)["urls"]))
    return rows.filter(F.coalesce("url", F.lit("")) != "").select(
        "url", F.coalesce("host", F.lit("")).alias("host"), _or("threat", "unknown"), F.coalesce("date_added", F.lit("")).alias("date_added")
    )


def _or(name: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default)).alias(name)


def _media(kind, uri: Column, mime: Column, size: Column) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.struct(kind.alias("kind"), uri.alias("uri"), mime.alias("mime_type"), size.cast("bigint").alias("size_bytes"))


def _content_type(text: Column, media: Column) -> Column:
    has_text = strip_space(F.coalesce(text, F.lit(""))) != ""
    return F.when(F.size(media) == 0, "text").when(has_text, "mixed").otherwise(F.try_element_at(media, F.lit(1))["kind"])


def _requests(df: DataFrame, platform: str, text: Column, keep: Column, *extra: Column) -> DataFrame:
    blank = strip_space(F.coalesce(text, F.lit(""))) == ""
    return df.filter(keep & ~(blank & (F.size("media") == 0))).select(
        F.lit(platform).alias("platform"), "user_id", _content_type(text, F.col("media")).alias("content_type"),
        F.nullif(text, F.lit("")).alias("text"), "media", *extra,
    )


def bot_updates(df: DataFrame, column: str = "payload") -> DataFrame:
    """Bot updates: text or caption, the largest photo, document, voice or audio."""
    u = F.from_json(F.col(column), schemas.BOT_UPDATE)
    df = df.select(u["update_id"].alias("update_id"), F.coalesce(u["message"], u["channel_post"]).alias("m"))
    m = F.col("m")
    photo, doc, voice = F.try_element_at(m["photo"], F.lit(-1)), m["document"], F.coalesce(m["voice"], m["audio"])
    uri = lambda f: F.concat(F.lit("telegram:"), f["file_id"])
    mime = F.nullif(doc["mime_type"], F.lit(""))
    media = F.array_compact(F.array(
        F.when(photo.isNotNull(), _media("image", uri(photo), F.lit(None).cast("string"), photo["file_size"])),
        F.when(doc["file_id"] != "", _media(F.when(F.contains(mime, F.lit("pdf")), "pdf").otherwise("image"), uri(doc), mime, doc["file_size"])),
        F.when(voice["file_id"] != "", _media("audio", uri(voice), voice["mime_type"], voice["file_size"])),
    ))
    df = df.select(
        m["from"]["id"].cast("string").alias("user_id"), media.alias("media"), m["chat"]["id"].cast("string").alias("chat_id"),
        F.coalesce(m["message_id"], F.col("update_id")).cast("string").alias("message_id"),
        F.coalesce(F.nullif(m["text"], F.lit("")), m["caption"], F.lit("")).alias("__text"),
    )
    return _requests(df, "telegram", F.col("__text"), F.col("chat_id").isNotNull(), F.col("chat_id"), F.col("message_id"))


def hook_messages(df: DataFrame, column: str = "payload") -> DataFrame:
    """Nested ``entry -> changes -> messages`` payloads, one request per message."""
    p = F.from_json(F.col(column), schemas.HOOK)
    values = F.flatten(F.transform(p["entry"], lambda e: F.transform(e["changes"], lambda c: c["value"])))
    df = df.select(F.explode_outer(values).alias("v")).select("v.metadata.phone_number_id", F.explode_outer("v.messages").alias("m"))
    m = F.col("m")
    kind_of = F.create_map(*[F.lit(x) for kv in L.MEDIA_KINDS.items() for x in kv])
    block = F.coalesce(*[F.when(m["type"] == t, m[t]) for t in L.MEDIA_KINDS])
    mime = F.nullif(block["mime_type"], F.lit(""))
    as_image = (m["type"] == "document") & F.coalesce(mime.startswith("image/"), F.lit(False))
    kind = F.when(as_image, "image").otherwise(F.try_element_at(kind_of, m["type"]))
    media = F.array_compact(F.array(
        F.when(block["id"] != "", _media(kind, F.concat(F.lit("whatsapp:"), block["id"]), mime, F.lit(None)))
    ))
    df = df.select(
        m["from"].alias("user_id"), m["from"].alias("chat_id"), m["id"].alias("message_id"), "phone_number_id", media.alias("media"),
        F.coalesce(F.nullif(m["text"]["body"], F.lit("")), F.when(F.size(media) > 0, block["caption"]), F.lit("")).alias("__text"),
    )
    keep = (F.coalesce("user_id", F.lit("")) != "") & (F.coalesce("message_id", F.lit("")) != "")
    return _requests(df, "whatsapp", F.col("__text"), keep, F.col("chat_id"), F.col("message_id"))


def api_calls(df: DataFrame, column: str = "payload", fallback: Column | None = None) -> DataFrame:
    """Session API calls; the first non-blank of eight image fields becomes media."""
    p = F.from_json(F.col(column), schemas.API_CALL)
    df = df.select(p.alias("p")).filter("p.sessionId IS NOT NULL")
    m, meta = F.col("p.message"), F.col("p.metadata")
    fields = ["image", "imageUrl", "image_url", "media_url"]
    image = F.coalesce(*[F.nullif(strip_space(m[f]), F.lit("")) for f in fields], *[F.nullif(strip_space(F.try_element_at(meta, F.lit(f))), F.lit("")) for f in fields])
    mime = F.when(F.contains(F.left(image, F.lit(30)), F.lit("png")), "image/png").otherwise("image/jpeg")
    media = F.array_compact(F.array(F.when(image.isNotNull(), _media("image", image, mime, F.lit(None)))))
    df = df.select(
        F.lit(None).cast("string").alias("user_id"), media.alias("media"), F.col("p.sessionId").alias("session_id"), m["sender"].alias("sender"),
        F.coalesce(m["text"], F.lit("")).alias("__text"), flexible_timestamp(m["timestamp"], fallback).alias("ts"),
    )
    return _requests(df, "api", F.col("__text"), F.lit(True), F.col("session_id"), F.col("sender"), F.col("ts"))


def sniff(content: Column) -> Column:
    """struct(mime, kind) from leading bytes; nulls when unknown."""
    def verdict(mime: str, kind: str) -> Column:
        return F.struct(F.lit(mime).alias("mime"), F.lit(kind).alias("kind"))

    head = F.hex(F.substring(content, 1, 16))
    out = F.lit(None).cast("struct<mime:string,kind:string>")
    for code, mime, kind in reversed(L.RIFF_TYPES):
        out = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == code), verdict(mime, kind)).otherwise(out)
    for code, mime, kind in reversed(L.MAGIC_NUMBERS):
        out = F.when(head.startswith(code), verdict(mime, kind)).otherwise(out)
    return out


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = []
        for name in batch.column("path").to_pylist():
            system, place = file_system(name)
            with system.open_input_file(place) as file:
                heads.append(file.read(HEAD_BYTES))
        yield batch.append_column("head", pa.array(heads, pa.binary()))


def attachments(spark: SparkSession, path: str, max_bytes: int = L.LIMITS["media_bytes"], pattern: str = "*") -> DataFrame:
    """Files below ``path`` with length and sniffed type; the size limit is checked before any byte is read.

    Of each file within the limit the first ``HEAD_BYTES`` bytes are read and no others, once. Unknown types
    are ``unsupported_media``; empty files are not listed, as Spark reads none; a file that is gone by the time its bytes are read fails the job.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    meta = files.select("path", "length", "modificationTime")
    read = meta.filter(F.col("length") <= max_bytes).mapInArrow(_heads, meta.schema.add("head", "binary"))
    known = read.withColumn("s", sniff(F.col("head"))).select(
        "path", "length", "s.mime", "s.kind", F.when(F.col("s").isNull(), "unsupported_media").alias("rejection"))
    over = meta.filter(F.col("length") > max_bytes).select(
        "path", "length", *[F.lit(None).cast("string").alias(c) for c in ("mime", "kind")], F.lit("too_large").alias("rejection"))
    return known.unionByName(over)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def jdbc_table(spark: SparkSession, url: str, name: str, partition_column: str, bounds: tuple[int, int], parts: int, **properties: str) -> DataFrame:
    """A database table read in parallel ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=properties)
