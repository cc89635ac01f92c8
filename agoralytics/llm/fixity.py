"""Fixity audit of archive replicas by Merkle trees over record digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoralytics.plans.staging import staged

FAN_OUT = 16
FILE_BYTES = 1 << 26  # records that an archive file should hold
_NODE = ("file", "node")
_ARCHIVE = -1  # stands for the file in nodes that join files


def warc_record(page_id: Column, url: Column, body: Column) -> Column:
    """A page as the bytes of a WARC resource record; what is null counts as empty."""
    content = F.coalesce(body.cast("string"), F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url.cast("string"), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), content, F.lit("\r\n\r\n").cast("binary"))


def manifest(records: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """``records(page_id, length, ...)`` with the archive ``file``, ``position`` there and ``offset``.

    Records are dealt to files by their place in the input, as many files as the total length
    asks for, so neither a repeated record nor a repeated id makes a file larger than others;
    in a file they are ordered by id. ``records`` must be a written table: its row order counts.
    """
    total = records.agg(F.sum("length").alias("n")).first().n or 0
    files = max(1, -(-total // file_bytes))
    row = F.monotonically_increasing_id()
    placed = records.withColumn("row", row).withColumn("file", F.pmod(F.xxhash64("row"), F.lit(files)))
    order = Window.partitionBy("file").orderBy("page_id", "row")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.select(
        "*", (F.row_number().over(order) - 1).cast("bigint").alias("position"), before.alias("offset")
    ).drop("row")


def _parents(nodes: DataFrame, fan_out: int) -> DataFrame:
    """One node per ``fan_out`` neighbours: a digest of its byte range and its children's digests, in order."""
    children = F.array_sort(F.collect_list(F.struct("node", "digest")))
    listed = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ",")
    return nodes.groupBy("file", F.floor(F.col("node") / fan_out).alias("parent")).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), listed.alias("children")
    ).select(
        "file",
        F.col("parent").alias("node"),
        "start",
        "end",
        F.sha2(F.concat_ws("|", F.col("start").cast("string"), F.col("end").cast("string"), "children"), 256).alias("digest"),
    )


def _height(width: int, fan_out: int) -> int:
    height = 0
    while width > 1:
        width, height = -(-width // fan_out), height + 1
    return height


def merkle_tree(leaves: DataFrame, in_file: int, over_files: int, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels ``(file, node, start, end, digest)`` from the records up to the archive's root.

    ``in_file`` levels join neighbouring records of a file; then each file is a node, and
    ``over_files`` levels join files. Every level is written, each a ``fan_out``-th of the one below.
    """
    levels = [
        staged(
            leaves.select("file", F.col("position").alias("node"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), "digest"),
            "merkle",
        )
    ]
    for _ in range(in_file):
        levels.append(staged(_parents(levels[-1], fan_out), "merkle"))
    files = levels[-1].select(F.lit(_ARCHIVE).cast("bigint").alias("file"), F.col("file").alias("node"), "start", "end", "digest")
    levels.append(files)
    for _ in range(over_files):
        levels.append(staged(_parents(levels[-1], fan_out), "merkle"))
    return levels


def audit(ours: DataFrame, theirs: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """Records on which two replicas differ: ``file, position, offset, length, status, digest, replica_digest``.

    Both arguments hold one row per record, ``file, position, offset, length, digest``. The
    roots are compared first; below a node only the children of nodes that differ are read, so
    equal branches cost nothing past their top. ``status`` is ``damaged``, ``missing`` (in the
    replica) or ``extra`` (only there; place and length are then the replica's). Equal replicas
    and empty tables give no rows; a null digest is a record that cannot be read, and differs
    from any digest. Records must be unique in ``file, position``.
    """
    sizes = ours.select("file", "position").union(theirs.select("file", "position")).agg(F.max("file"), F.max("position")).first()
    in_file = _height((sizes[1] or 0) + 1, fan_out)
    over_files = _height((sizes[0] or 0) + 1, fan_out)
    trees = [merkle_tree(t.withColumn("digest", F.coalesce("digest", F.lit("unreadable"))), in_file, over_files, fan_out) for t in (ours, theirs)]
    differing = None
    for level in range(in_file + over_files + 1, -1, -1):
        a, b = (tree[level] for tree in trees)
        if differing is not None:
            parent = differing.select(F.col("file").alias("f"), F.col("node").alias("n")).distinct()
            if level == in_file:  # the parent of a file's root is the file
                inside = lambda t, p=parent: t.join(p, (F.col("node") == 0) & (F.col("file") == p.n), "left_semi")
            elif level == in_file + 1 + over_files:
                inside = lambda t: t
            else:
                inside = lambda t, p=parent: t.join(
                    p, (F.col("file") == p.f) & (F.floor(F.col("node") / fan_out) == p.n), "left_semi"
                )
            a, b = inside(a), inside(b)
        theirs_ = b.select("file", "node", F.col("start").alias("start_b"), F.col("end").alias("end_b"), F.col("digest").alias("digest_b"))
        compared = a.join(theirs_, list(_NODE), "full_outer")
        differing = staged(compared.where(~F.col("digest").eqNullSafe(F.col("digest_b"))), "differing")
    start, end = F.coalesce("start", "start_b"), F.coalesce("end", "end_b")
    return differing.select(
        "file",
        F.col("node").alias("position"),
        start.alias("offset"),
        (end - start).alias("length"),
        F.when(F.col("digest").isNull(), "extra").when(F.col("digest_b").isNull(), "missing").otherwise("damaged").alias("status"),
        "digest",
        F.col("digest_b").alias("replica_digest"),
    )
