"""Content-addressed WARC archive.

The archive has two tables in the shared folder. ``headers`` holds, for every record, the exact
bytes that precede its payload (WARC header, and HTTP header of a response); ``payloads`` holds
each distinct payload once under its SHA-256. A record is rebuilt by joining the two. On
reading, every payload's digest is computed again and must equal its key.

Of records with equal payloads (of at least ``least`` bytes) the one with the largest page id
is the response; the others are revisits that name it and carry no payload.

Defined results: a null html is an empty payload; a null url leaves out the target URI; a
null page_id ranks below all others; rows that repeat both page_id and payload of a response are
responses too and share its payload; an empty table gives an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_skewed, keep, new_path

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    headers: str
    payloads: str


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: the 40 hex digits in groups of 5, each of which is 4 base32 digits."""
    h = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(h, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _header(date: str) -> Column:
    """The bytes before the payload, as text."""
    response = F.col("record_type") == "response"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes"), F.lit(CRLF * 2))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(response, line("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(
            F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", urn("refers_to")))
        ),
        line("Content-Length", F.when(response, (F.octet_length(http) + F.col("payload_bytes")).cast("string")).otherwise("0")),
        F.lit(CRLF),
        F.when(response, http).otherwise(""),
    )


def write_archive(pages: DataFrame, least: int = 0, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archive:
    """Writes the two tables and returns their places."""
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    light = keep(base.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")), "warc-light")
    winners = keep(light.where(F.col("payload_bytes") >= least).groupBy("sha256").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.count("page_id").alias("n_ids")), "warc-winners")
    typed = join_skewed(light, winners, ["sha256"], "n", F.col("page_id"))
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    typed = typed.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    out = Archive(new_path(spark, "warc-headers"), new_path(spark, "warc-payloads"))
    typed.select("page_id", _header(date).cast("binary").alias("header"), "sha256").write.parquet(out.headers)
    _payloads(base, winners, light, least).write.parquet(out.payloads)
    return out


def _payloads(base: DataFrame, winners: DataFrame, light: DataFrame, least: int) -> DataFrame:
    """(sha256, payload), each distinct payload once.

    The rows that lose are told by their page_id: broadcast where they are few, else joined by
    a shuffle. Only if page ids repeat, or payloads below ``least`` do, are the rest made distinct.
    """
    keyed = base.select(F.coalesce("page_id", F.lit(-(2**63))).alias("id"), F.sha2("payload", 256).alias("sha256"), "payload")
    first = winners.select(F.coalesce("first_id", F.lit(-(2**63))).alias("id"), "sha256")
    repeated = winners.where("n > 1").select(F.coalesce("first_id", F.lit(-(2**63))).alias("keep_id"), "sha256")
    n_repeated = winners.where("n > 1").count()
    if n_repeated <= BROADCAST_ROWS:
        # payloads that occur once are stored as they are read, without a shuffle
        rows = keyed.join(F.broadcast(repeated), "sha256", "left").where(F.col("keep_id").isNull() | (F.col("keep_id") == F.col("id"))).select("sha256", "payload")
    else:
        below = keyed.where(F.octet_length("payload") < least)
        rows = keyed.where(F.octet_length("payload") >= least).join(first, ["id", "sha256"], "left_semi").select("sha256", "payload").unionAll(below.select("sha256", "payload"))
    ids = light.agg(F.count(F.lit(1)).alias("n"), F.count("page_id").alias("ids"), F.min("payload_bytes").alias("least")).first()
    again = ids["n"] and (ids["n"] != ids["ids"] or ids["least"] < least or light.groupBy("page_id").count().where("count > 1").limit(1).count())
    return rows.dropDuplicates(["sha256"]) if again else rows


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """(sha256, payload), verified: a payload whose digest is not its key is an error."""
    stored = spark.read.parquet(archive.payloads)
    return stored.where(F.when(F.sha2("payload", 256) == F.col("sha256"), True).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("boolean")))


def read_headers(spark: SparkSession, archive: Archive) -> DataFrame:
    """Fields of every record header, parsed from its bytes."""
    text = F.col("header").cast("string")
    field = lambda name: F.regexp_extract(text, f"(?md)^{name}: ([^\\r\\n]*)\\r$", 1)
    urn = lambda name: F.regexp_extract(text, f"(?md)^{name}: <urn:page:([^>\\r\\n]*)>\\r$", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    return spark.read.parquet(archive.headers).select(
        number(urn("WARC-Record-ID")).alias("page_id"), field("WARC-Type").alias("record_type"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        number(urn("WARC-Refers-To")).alias("refers_to"), field("WARC-Target-URI").alias("url"), "header", "sha256",
    )


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, record): the original records, rebuilt; a record ends in two line ends."""
    headers = read_headers(spark, archive)
    full = headers.where("record_type = 'response'").join(read_payloads(spark, archive), "sha256")
    end = F.lit(CRLF * 2).cast("binary")
    return full.select("page_id", F.concat("header", "payload", end).alias("record")).unionAll(headers.where("record_type <> 'response'").select("page_id", F.concat("header", end).alias("record")))


def export_warc(spark: SparkSession, archive: Archive, path: str, compression: str = "none") -> None:
    """Writes the records as .warc text files by Spark's own writer: the line separator is the end of a record."""
    text = F.expr("cast(substring(record, 1, length(record) - 4) as string)")
    read_records(spark, archive).select(text.alias("value")).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def parse_records(records: DataFrame) -> DataFrame:
    """Fields of whole records (page_id, record), read from their bytes alone: (page_id, record_type, refers_to, payload_digest, payload).

    The lengths that a record tells must be those that it has, and a response's digest must be its payload's; a revisit has no payload.
    """
    text = F.col("record").cast("string")
    header = F.substring_index(text, CRLF * 2, 1)
    http = F.substring_index(F.substring_index(text, CRLF * 2, 2), CRLF * 2, -1)
    field = lambda of, name: F.regexp_extract(of, f"(?m)^{name}: ([^\\r\\n]*)$", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    urn = lambda name: number(F.regexp_extract(header, f"(?m)^{name}: <urn:page:([^>\\r\\n]*)>$", 1))
    read = records.select(
        urn("WARC-Record-ID").alias("page_id"), field(header, "WARC-Type").alias("record_type"), urn("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(field(header, "WARC-Payload-Digest"), "^sha1:", "").alias("told"), number(field(header, "Content-Length")).alias("length"),
        F.octet_length(header).alias("head"), F.when(field(header, "WARC-Type") == "response", number(field(http, "Content-Length"))).alias("size"), F.octet_length(http).alias("http"), "record",
    )
    response = F.col("record_type") == "response"
    fits = F.octet_length("record") == F.col("head") + 8 + F.col("length")
    whole = F.when(response, fits & (F.col("length") == F.col("http") + 4 + F.col("size"))).otherwise(fits & (F.col("length") == 0))
    payload = F.when(response, F.substring("record", F.col("head") + F.col("http") + 9, F.col("size").cast("int")))
    read = read.withColumn("payload", F.when(whole, payload).otherwise(F.raise_error(F.lit("a record does not have the length that it tells")).cast("binary")))
    same = F.when(~response | (base32_sha1(F.col("payload")) == F.col("told")), F.col("told")).otherwise(F.raise_error(F.lit("a record's digest does not match its payload")))
    return read.select("page_id", "record_type", "refers_to", same.alias("payload_digest"), "payload")


def summary(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), worked out from the rebuilt records; a revisit's length is that of the response it names."""
    read = parse_records(read_records(spark, archive)).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    read = keep(read, "warc-read")
    revisits = read.where("record_type <> 'response'").drop("payload_bytes")
    counts = revisits.groupBy("refers_to", "payload_digest").agg(F.count(F.lit(1)).alias("n"))
    responses = read.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    named = keep(responses.join(counts, ["refers_to", "payload_digest"]), "warc-named")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = join_skewed(revisits, named, ["refers_to", "payload_digest"], "n", F.col("page_id"))
    return read.where("record_type = 'response'").select(*columns).unionByName(found.select(*columns))
