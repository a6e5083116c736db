"""WARC fixity audit with Merkle trees.

Records lie in archives in a fixed order with byte offsets. A tree over an
archive has record digests as leaves; a node of level k covers ``fanout``**k
neighbouring records and hashes its children's digests in order with the byte
range that it covers. Two replicas are compared at their roots; only below
nodes that differ are children compared, level by level, until the differing
records, or records that only one replica has, are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import staged


def warc_record(record_id: Column, uri: Column, payload: Column) -> Column:
    """The bytes of a WARC/1.1 resource record; null parts count as empty."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archived(pages: DataFrame, payload: Column | None = None, per_archive: int = 4096) -> DataFrame:
    """(archive, seq, page_id, offset, length, digest) of every page as a record.

    An archive holds the records of ``per_archive`` neighbouring page ids, in
    order of id, then digest for ids that repeat; a null id lies in archive -1
    (so null ids must be few). Offsets run on within the archive. Only record
    digests and lengths are shuffled, never payloads.
    """
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html") if payload is None else payload)
    slim = pages.select(F.coalesce(F.floor(F.col("page_id") / per_archive), F.lit(-1)).cast("long").alias("archive"), "page_id", F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"))
    order = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    slim = slim.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return slim.select("archive", "seq", "page_id", offset.cast("long").alias("offset"), "length", "digest")


def merkle_levels(records: DataFrame, fanout: int = 16, top: int = 3) -> list[DataFrame]:
    """Trees of all archives: levels 0 (records) to ``top``, each (archive, node, start, end, digest).

    A node gathers ``fanout`` children at most. ``fanout``**``top`` must cover
    the longest archive for level ``top`` to be its root; a longer one has
    several top nodes, all of which are compared. Levels are written once each.
    """
    level = records.select("archive", F.col("seq").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), "digest")
    levels = [level]
    for _ in range(top):
        up = level.groupBy("archive", F.floor(F.col("node") / fanout).alias("node")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("node", "digest"))).alias("_below"))
        text = F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), F.array_join(F.transform("_below", lambda x: x["digest"]), ","))
        level = staged(up.select("archive", "node", "start", "end", F.sha2(text, 256).alias("digest")), "level")
        levels.append(level)
    return levels


def differing(a: list[DataFrame], b: list[DataFrame], fanout: int = 16) -> DataFrame:
    """(archive, node) of the records at which two trees differ, found from the roots down.

    At each level only children of nodes that differ are read on.
    """
    bad = None
    for one, two in zip(reversed(a), reversed(b), strict=True):
        one = one.select("archive", "node", F.struct("start", "end", "digest").alias("_one"))
        two = two.select("archive", "node", F.struct("start", "end", "digest").alias("_two"))
        if bad is not None:
            parent = F.floor(F.col("node") / fanout)
            one, two = (x.withColumn("_up", parent).join(bad.select("archive", F.col("node").alias("_up")), ["archive", "_up"], "left_semi").drop("_up") for x in (one, two))
        bad = one.join(two, ["archive", "node"], "full_outer").where("not (_one <=> _two)").select("archive", "node")
    return bad


def audit(replica_a: DataFrame, replica_b: DataFrame, fanout: int = 16, top: int = 3) -> DataFrame:
    """Every record of either replica with its byte range, digests and ``intact``.

    Takes two results of ``archived``. Columns: archive, seq, page_id, offset,
    length, digest (of the first replica, null where it lacks the record),
    replica_digest, archive_intact (roots agree), intact (the descent reached
    no difference here). A record is what lies at its place of the archive: one
    that a replica lacks moves all later records of that archive to other places
    and ranges, and they count as differing. Empty replicas give no rows.
    """
    a, b = staged(replica_a, "replica_a"), staged(replica_b, "replica_b")
    la, lb = merkle_levels(a, fanout, top), merkle_levels(b, fanout, top)
    bad = differing(la, lb, fanout).select("archive", F.col("node").alias("seq"), F.lit(False).alias("_bad"))
    bad = staged(bad, "differing")
    b = b.select("archive", "seq", F.col("page_id").alias("_page"), F.col("offset").alias("_offset"), F.col("length").alias("_length"), F.col("digest").alias("replica_digest"))
    rows = a.join(b, ["archive", "seq"], "full_outer").join(bad, ["archive", "seq"], "left")
    broken = bad.select("archive").distinct().withColumn("_broken", F.lit(True))
    rows = rows.join(broken, "archive", "left")
    return rows.select("archive", "seq", F.coalesce("page_id", "_page").alias("page_id"), F.coalesce("offset", "_offset").alias("offset"), F.coalesce("length", "_length").alias("length"), "digest", "replica_digest", F.col("_broken").isNull().alias("archive_intact"), F.col("_bad").isNull().alias("intact"))
