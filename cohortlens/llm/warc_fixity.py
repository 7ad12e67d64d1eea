"""Merkle fixity audit of WARC replicas.

``records`` lays web pages out as WARC/1.1 response records in numbered
segments (files), each record with its byte offset. ``tree`` hashes the records
(SHA-256 of their bytes) and builds ordered offset ranges above them: a node of
level 0 covers RANGE_BYTES bytes of a segment and hashes its records' offsets,
lengths and digests in offset order; a node of level k hashes the FANOUT nodes
below it in order; the nodes of the last level, one for each segment, are
hashed in the same way over ranges of segment numbers up to one root.

``audit`` compares replicas from the top: a level's nodes are joined only where
their parents differ, so equal branches are never opened, and what is left at
the end are the records of differing ranges: corrupt (same place, other bytes),
missing or additional in the second replica.

A node's place follows from the offset alone, so a segment of any size is
hashed range by range in parallel. Trees are materialised once per replica.

Nulls and edges: a null html is an empty payload, a null url an empty target
URI; null page_ids lie in the segment -1; repeated page_ids are ordered by
their digest; records of equal offset within a segment (only damaged layouts have them)
are ordered by digest; an empty replica has no nodes, and all records of the
other are missing or additional; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PAGES_PER_SEGMENT = 1024
RANGE_BYTES = 1 << 16
FANOUT = 16
LEVELS = 3  # of offset ranges: a segment's node hashes ranges of RANGE_BYTES * FANOUT ** (LEVELS - 1) bytes
SEGMENT_LEVELS = 3  # of segment ranges: the root hashes ranges of FANOUT ** (SEGMENT_LEVELS - 1) segments


def record_bytes(url: Column, html: Column) -> Column:
    """A WARC response record: header, blank line, payload, two line ends."""
    payload = F.encode(F.coalesce(html.cast("string"), F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url.cast("string"), F.lit("")),
                    F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), payload, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def records(pages: DataFrame, content: Column | None = None, per_segment: int = PAGES_PER_SEGMENT, keep_content: bool = False) -> DataFrame:
    """segment, offset, length, digest, page_id of every page as a record (and its bytes, if ``keep_content``).

    Segments hold ``per_segment`` consecutive page_ids. ``content`` stands in
    for the record's own bytes where a replica has others of the same length.
    Records are hashed before they are laid out, so their bytes are not shuffled.
    """
    own = record_bytes(F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), own.alias("own"), (own if content is None else content).alias("content"))
    rows = rows.select("page_id", F.octet_length("own").cast("long").alias("length"), F.sha2("own", 256).alias("own_digest"), F.sha2("content", 256).alias("digest"),
                       F.coalesce(F.floor(F.col("page_id") / per_segment), F.lit(-1)).cast("long").alias("segment"), *(["content"] if keep_content else []))
    order = Window.partitionBy("segment").orderBy("page_id", "own_digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("offset", F.sum("length").over(order) - F.col("length")).drop("own_digest")


def _ordered_hash(place: str, *parts: Column) -> Column:
    """Digest of the children's parts in the order of their place; a node has a bounded number of children."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), F.concat_ws(":", *parts).alias("said")))), lambda c: c["said"]), "\n"), 256)


def tree(records_: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the root down to the records (segment, offset, length, digest, page_id).

    Level frames: (segment, node, hash); above the segments the
    segment column holds a range of segments and node is 0.
    """
    digests = materialize(records_.select("segment", "offset", "length", "digest", "page_id"), "warc-leaves")
    levels = [digests]
    node = F.floor(F.col("offset") / range_bytes)
    below = (digests.groupBy("segment", node.alias("node"))
             .agg(_ordered_hash("offset", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("digest")).alias("hash")))
    for k in range(LEVELS):
        below = materialize(below, f"warc-ranges-{k}")
        levels.append(below)
        up = F.floor(F.col("node") / fanout) if k < LEVELS - 1 else F.lit(0).cast("long")
        below = below.groupBy("segment", up.alias("node")).agg(_ordered_hash("node", F.col("node").cast("string"), F.col("hash")).alias("hash"))
    below = below.select(F.lit(0).cast("long").alias("segment"), F.col("segment").alias("node"), "hash")
    for k in range(SEGMENT_LEVELS):
        below = materialize(below, f"warc-segments-{k}")
        levels.append(below)
        up = F.floor(F.col("node") / fanout) if k < SEGMENT_LEVELS - 1 else F.lit(0).cast("long")
        below = below.groupBy("segment", up.alias("node")).agg(_ordered_hash("node", F.col("node").cast("string"), F.col("hash")).alias("hash"))
    levels.append(materialize(below, "warc-root"))
    return levels[::-1]


def _differing(first: DataFrame, second: DataFrame) -> DataFrame:
    """Nodes whose hashes differ, or that one replica lacks."""
    both = first.withColumnRenamed("hash", "first").join(second.withColumnRenamed("hash", "second"), ["segment", "node"], "full")
    return both.filter("first is null or second is null or first <> second").select("segment", "node")


def roots(*trees: list[DataFrame]) -> list[str | None]:
    """The root hash of each replica."""
    return [row["hash"] if (row := t[0].first()) else None for t in trees]


def audit(first: list[DataFrame], second: list[DataFrame], range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records that differ between two trees: segment, offset, status, lengths and digests on both sides."""
    bad = _differing(first[0], second[0])
    top = 1 + SEGMENT_LEVELS
    for k in range(1, top + LEVELS):
        if k <= SEGMENT_LEVELS:  # children of a node over segment ranges; the lowest of these levels has a node for each segment
            segment, parent = F.lit(0).cast("long"), F.lit(0).cast("long") if k == 1 else F.floor(F.col("node") / fanout)
        elif k == top:  # the only node of the highest range level stands under its segment's node
            segment, parent = F.lit(0).cast("long"), F.col("segment")
        else:
            segment, parent = F.col("segment"), F.floor(F.col("node") / fanout)
        up = bad.select(F.col("segment").alias("_s"), F.col("node").alias("_n"))
        opened = [x.join(up, (segment == F.col("_s")) & (parent == F.col("_n")), "left_semi") for x in (first[k], second[k])]
        bad = materialize(_differing(*opened), f"warc-differing-{k}")
    up = bad.select(F.col("segment").alias("_s"), F.col("node").alias("_n"))
    opened = [x.join(up, (F.col("segment") == F.col("_s")) & (F.floor(F.col("offset") / range_bytes) == F.col("_n")), "left_semi")
              for x in (first[-1], second[-1])]
    a, b = (x.withColumn("copy", F.row_number().over(Window.partitionBy("segment", "offset").orderBy("digest")))
            .select("segment", "offset", "copy", F.col("page_id").alias(f"{side}_page"), F.col("length").alias(f"{side}_length"), F.col("digest").alias(f"{side}_digest")) for x, side in zip(opened, ("first", "second")))
    status = F.when(F.col("second_digest").isNull(), "missing").when(F.col("first_digest").isNull(), "additional").otherwise("corrupt")
    return (a.join(b, ["segment", "offset", "copy"], "full").withColumn("status", status)
            .filter("status <> 'corrupt' or first_digest <> second_digest or first_length <> second_length")
            .select("segment", "offset", F.coalesce("first_page", "second_page").alias("page_id"), "status", "first_length", "second_length", "first_digest", "second_digest"))
