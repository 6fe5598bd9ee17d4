"""Merkle fixity audit of WARC records.

Pages become WARC response records. Records are dealt to archives by digest; inside an
archive they are ordered and get byte offsets. The digests of the records are the leaves
of a tree for each archive and replica, and a node over ``FANOUT`` consecutive children
covers an ordered range of offsets. An audit compares the replicas' roots and descends, by
joins, only below nodes that differ, until it holds the differing records. Leaves lie in
folders by ``SHARDS`` of archives: the descent reads the folders of archives whose roots
differ, and none where all roots agree.

Groups are bounded by the fan-out at every level, and only digests are shuffled.

Defined results: null urls and texts count as empty; a replica's record that is null is
missing, and one whose own record is null is extra (its digest is null, its length 0; where
both are null they agree); very long records are hashed whole; repeated rows are separate records (equal ones are interchangeable); an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import written

FANOUT = 16
#: Records that an archive holds on average.
ARCHIVE_RECORDS = 4_096
#: Folders that leaves lie in, and the most numbers that the descent brings to the driver.
SHARDS = 4_096
#: Fixed value: the date of the records, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"


def response_record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC/1.0 response record."""
    body = F.coalesce(html, F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), body)
    name = F.md5(F.concat_ws("|", page_id.cast("string"), url))
    uuid = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    fields = [F.lit("WARC/1.0"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")), F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))), F.lit(f"WARC-Date: {DATE}"), F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), F.octet_length(http).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *fields), F.lit("\r\n\r\n"), http, F.lit("\r\n\r\n"))


def manifest(records: DataFrame, key: str, record: str, replica: str, archive_records: int = ARCHIVE_RECORDS) -> DataFrame:
    """(key, archive, position, offset, length, digest, replica_digest, shard) of every record."""
    digest = F.sha2(F.col(record).cast("binary"), 256)
    leaves = written(records.select(F.col(key).alias("key"), F.coalesce(F.octet_length(record).cast("long"), F.lit(0).cast("long")).alias("length"), digest.alias("digest"), F.sha2(F.col(replica).cast("binary"), 256).alias("replica_digest")), "leaves")
    archives = max(1, math.ceil(leaves.count() / archive_records))
    named = F.coalesce("digest", "replica_digest", F.lit("0"))
    number = F.conv(F.substring(named, 1, 8), 16, 10).cast("long") % archives
    order = Window.partitionBy("shard", "archive").orderBy(F.col("key").asc_nulls_first(), "digest", F.col("replica_digest").asc_nulls_first())
    dealt = leaves.withColumn("archive", number).withColumn("shard", F.col("archive") % SHARDS).repartition("shard")
    placed = dealt.withColumn("position", (F.row_number().over(order) - 1).cast("long"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).select("key", "archive", "position", "offset", "length", "digest", "replica_digest", "shard")


def trees(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels (archive, place, start, end, digest, replica_digest) from the leaves to the roots;
    the leaves keep their shard."""
    missing = F.lit("-")
    level = leaves.select("archive", F.col("position").alias("place"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), F.coalesce("digest", missing).alias("digest"), F.coalesce("replica_digest", missing).alias("replica_digest"), "shard")
    top = leaves.agg(F.max("position")).first()[0] or 0
    levels = [level]
    while top > 0:
        child = F.struct("place", "digest", "replica_digest")
        grouped = levels[-1].groupBy("archive", (F.floor(F.col("place") / fanout)).alias("place")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(child)).alias("children"))
        joined = lambda name: F.sha2(F.array_join(F.transform("children", lambda c: c[name]), ""), 256)
        levels.append(grouped.select("archive", "place", "start", "end", joined("digest").alias("digest"), joined("replica_digest").alias("replica_digest")))
        top //= fanout
    return [levels[0], *(written(x, f"level{i}") for i, x in enumerate(levels[1:], 1))]


def differing(levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(archive, place) of the leaves that differ, found from the roots downwards."""
    unlike = F.col("digest") != F.col("replica_digest")
    found = levels[-1].filter(unlike).select("archive", "place")
    if len(levels) == 1:
        return found
    shards = [r[0] for r in found.select(F.col("archive") % SHARDS).distinct().collect()]  # SHARDS numbers at most
    if not shards:
        return found
    for level in [*reversed(levels[1:-1]), levels[0].filter(F.col("shard").isin(shards))]:
        below = found.select(F.col("archive").alias("__a"), F.col("place").alias("__p"))
        within = (F.col("archive") == F.col("__a")) & (F.floor(F.col("place") / fanout) == F.col("__p"))
        found = level.join(below, within, "left_semi").filter(unlike).select("archive", "place")
    return found


def audit(records: DataFrame, *, key: str, record: str, replica: str, archive_records: int = ARCHIVE_RECORDS, fanout: int = FANOUT) -> DataFrame:
    """The manifest with each record's status (ok, corrupt, missing, extra) and its archive's roots."""
    leaves = written(manifest(records, key, record, replica, archive_records), "manifest", by="shard")
    levels = trees(leaves, fanout)
    bad = differing(levels, fanout).select(F.col("archive").alias("__a"), F.col("place").alias("__p"), F.lit(True).alias("bad"))
    roots = levels[-1].select(F.col("archive").alias("__r"), F.col("digest").alias("root"), F.col("replica_digest").alias("replica_root"))
    out = leaves.join(bad, (F.col("archive") == F.col("__a")) & (F.col("position") == F.col("__p")), "left")
    status = F.when(F.col("bad").isNull(), "ok").when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
    return out.join(roots, F.col("archive") == F.col("__r")).select("key", "archive", "position", "offset", "length", "digest", status.alias("status"), "root", "replica_root")


def faulty(record: Column, key: Column) -> Column:
    """A replica with faults for trials: by a hash of the key, a record in 499 has a byte
    changed and one in 997 is lost."""
    pick = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    return F.when(pick % 997 == 5, F.lit(None).cast("string")).when(pick % 499 == 3, F.concat(F.lit("w"), F.substring(record, 2, 2**31 - 1))).otherwise(record)
