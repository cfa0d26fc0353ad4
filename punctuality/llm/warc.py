"""WARC archives: written by Spark's text sink, read back in parallel splits with
boundary-chain verification.

Writing: pages of equal payloads (of at least MIN_REVISIT bytes) become revisits of the
one with the largest id. Which do is found from digests alone and brought to the pages
where they are read. A record is text, so the sink's own files are plain WARC/1.1
archives, with the sink's commit protocol behind them.

Reading: tasks cut their splits at every magic line, which makes candidates, also inside
payloads. Each candidate gives the offset of its successor from its own Content-Length.
Pointers jump within a split (doubling, by offset), then between splits (doubling, by
joins of the few candidates that follow another split's exit), from the start of the
file; only the candidates so reached are records. Payloads that hold a magic line
are put together again from the pieces they were cut into.

Defined results: a null payload is empty, and of 0 bytes; a null id is written as an
empty one and read back as null, and its page is always a response; of repeated rows of
the largest id each is a response; a very
long payload is one record, written and digested whole (up to the 2 GB of a row); an
empty table makes an empty folder, which reads as no rows; other columns are kept out,
whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from punctuality.llm.shared import discard, join_skewed, tasks, written

MAGIC = "WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MIN_REVISIT = 1000
ID = "urn:page:"
#: Rows of one archive file, at most.
FILE_ROWS = 200_000
#: Repeats that are broadcast at once, at most (some 100 MB).
BROADCAST_ROWS = 1_000_000
DATE = "2024-01-01T00:00:00Z"


def _rows(pages: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(file, id, url, body) of pages; file: a hash of the path that a row is read from.
    Pages that aren't read from files as they stand are written first."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    try:
        return pages.select(F.xxhash64("_metadata.file_path").alias("file"), F.col(id_col).alias("id"), text(url_col).alias("url"), text(text_col).alias("body"))
    except AnalysisException:
        held = written(pages.select(F.col(id_col).alias("id"), text(url_col).alias("url"), text(text_col).alias("body")), "warc-pages")
        return _rows(held, "id", "url", "body")


def repeats(rows: DataFrame, least: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The pages (file, id, digest, first) whose payload a page of a larger id has, in
    order of files; and ranges of files (from, to, how many such pages) for one broadcast
    each. Of pages only digests are moved."""
    digests = written(rows.select("file", "id", F.unhex(F.sha1(F.col("body").cast("binary"))).alias("digest"), F.octet_length("body").cast("long").alias("bytes")), "warc-digests")
    large = digests.where((F.col("bytes") >= least) & F.col("id").isNotNull())
    keyed = large.select("file", "id", "digest", F.concat(F.hex("digest"), F.lit(":"), F.col("bytes").cast("string")).alias("key"))
    first = keyed.groupBy("key").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = join_skewed(keyed, first, "key", "inner").where(F.col("id") != F.col("first")).select("file", "id", "digest", "first").distinct()
    again = written(again.repartitionByRange(tasks(rows.sparkSession), "file", "id").sortWithinPartitions("file", "id"), "warc-repeats")
    each = digests.select("file", F.lit(0).alias("n")).distinct().unionByName(again.select("file", F.lit(1).alias("n"))).groupBy("file").agg(F.sum("n").alias("n"))
    ranges: list[tuple[int, int, int]] = []
    for file, n in sorted(each.collect()):  # a row a file
        if ranges and ranges[-1][2] + n <= BROADCAST_ROWS:
            ranges[-1] = (ranges[-1][0], file, ranges[-1][2] + n)
        else:
            ranges.append((file, file, n))
    discard(rows.sparkSession, digests)
    return again, ranges


def records(rows: DataFrame, again: DataFrame, date: str = DATE) -> DataFrame:
    """(record): one WARC record a row (id, url, body), as text that ends in CR LF CR, so
    that the text sink's line feed closes it. again: see repeats."""
    rows = rows.withColumn("bytes", F.octet_length("body").cast("long")).withColumn("sha1", F.sha1(F.col("body").cast("binary")))
    joined = rows.join(again.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "first"), F.expr("id = _id and unhex(sha1) = _digest"), "left")
    revisit = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("body"))
    one_line = F.regexp_replace("url", r"[\r\n]", "")  # a header is one line
    profile = line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = F.concat(
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", one_line),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", uri(F.col("first"))), profile)).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(body) + len(HTTP)).cast("string")),
    )
    return joined.select(F.concat(F.lit(MAGIC), head, F.lit("\r\n" + HTTP), body, F.lit("\r\n\r")).alias("record"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = MIN_REVISIT, date: str = DATE) -> None:
    """Archives of the pages, as files in the folder path. Range by range of input files,
    their repeats are broadcast; a file of more repeats than a broadcast holds is read once
    for each, and of it the pages whose ids fall to that. No payload is shuffled, however
    many repeats there are."""
    rows = _rows(pages, id_col, url_col, text_col)
    again, ranges = repeats(rows, least)
    for a, b, n in ranges or [(0, 0, 0)]:
        many = -(-2 * n // max(1, BROADCAST_ROWS)) if n > BROADCAST_ROWS else 1  # half as many on average: a hash doesn't deal evenly
        for k in range(many):
            mine = F.col("file").between(a, b) & (F.pmod(F.xxhash64("id"), F.lit(many)) == k)
            found = records(rows.where(mine), F.broadcast(again.where(mine)), date)
            found.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).option("lineSep", "\n").text(path)
    discard(pages.sparkSession, again)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, value): what stands between magic lines. Files are read in
    splits; row rises with the place in the split; file is a hash of the path."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value"))


def _header(head: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1))


def candidates(rows: DataFrame) -> DataFrame:
    """What the tasks say of each piece: its length, the header fields, how long the
    record is that it starts, and the digest of the payload if that lies in the piece
    alone. The record's own text stays behind."""
    raw = rows.withColumn("size", F.octet_length("value").cast("long")).withColumn("head", F.substring_index("value", "\r\n\r\n", 1))
    raw = raw.withColumn("cut", F.octet_length("head").cast("long"))  # in bytes; a piece without a blank line has no header
    raw = raw.withColumn("length", F.expr(r"try_cast(regexp_extract(head, '(?im)^Content-Length:[ \t]*([0-9]+)[ \t]*$', 1) as bigint)"))
    raw = raw.withColumn("valid", (F.col("cut") < F.col("size")) & F.col("length").isNotNull())
    return raw.withColumn("record", F.when(F.col("valid"), len(MAGIC) + F.col("cut") + 4 + F.col("length") + 4))


def _described(raw: DataFrame) -> DataFrame:
    """The columns of the pages from a record's bytes (value, cut, length)."""
    body = F.expr("substring(cast(value as binary), cast(cut + 5 as int), cast(least(length, 2147483647) as int))")
    raw = raw.withColumn("body", body).withColumn("http", F.octet_length(F.substring_index(F.col("body").cast("string"), "\r\n\r\n", 1)))
    payload = F.expr("substring(body, http + 5, 2147483647)")
    return raw.select(
        "file", "row", "block", "size", "record", "valid", _header(F.col("head"), "WARC-Type").alias("kind"), _header(F.col("head"), "WARC-Record-ID").alias("id"),
        _header(F.col("head"), "WARC-Refers-To").alias("to"), F.expr(r"try_cast(regexp_extract(head, '(?im)^WARC-Payload-Length:[ \t]*([0-9]+)', 1) as bigint)").alias("told_bytes"),
        F.regexp_replace(_header(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "").alias("sha1"), F.octet_length(payload).cast("long").alias("_bytes"), F.sha1(payload).alias("_sha1"),
    ).withColumn("right", (F.col("kind") == "revisit") | ((F.col("sha1") == F.col("_sha1")) & (F.col("told_bytes") == F.col("_bytes")))).drop("_bytes", "_sha1")


def _jump(nxt: np.ndarray) -> np.ndarray:
    """Where each chain ends: nxt[i] is i's successor in the split, or i itself."""
    while True:
        further = nxt[nxt]
        if (further == nxt).all():
            return nxt
        nxt = further


def reachable(offsets: DataFrame) -> DataFrame:
    """The rows (file, row) of offsets (file, block, row, at, to) on the chain that starts at
    offset 0 of each file. to: the successor's offset, null for none."""
    offsets = written(offsets, "warc-offsets")

    def local(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        part = part.sort_values("at")
        at, to = part["at"].to_numpy(), part["to"].fillna(-1).to_numpy(np.int64)
        where = np.minimum(np.searchsorted(at, to), len(at) - 1)
        inside = (at[where] == to) & (to > at)
        return part, np.where(inside, where, np.arange(len(at))), to

    def exits(part: pd.DataFrame) -> pd.DataFrame:
        part, nxt, to = local(part)
        end = _jump(nxt)
        return pd.DataFrame({"file": part["file"].to_numpy(), "block": part["block"].to_numpy(), "at": part["at"].to_numpy(), "exit": to[end]})

    out = written(offsets.groupBy("file", "block").applyInPandas(exits, "file long, block long, at long, exit long"), "warc-exits")
    # only a file's first record and those that another split's chain leads to matter now
    doors = out.select("file", F.col("exit").alias("at")).where("at > 0").distinct().join(out, ["file", "at"]).select("file", "block", "at", "exit")
    doors = written(doors.unionByName(out.where("at = 0").select("file", "block", "at", "exit")).distinct(), "warc-doors")
    splits = offsets.groupBy("file").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] or 0
    reached, jump = doors.where("at = 0").select("file", "at"), doors.select("file", "at", F.col("exit").alias("to"))
    steps = 1
    while steps < splits:  # after k rounds, all within 2**k splits of the start
        over = jump.withColumnRenamed("to", "mid")
        reached = written(reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "warc-reached")
        jump = written(over.join(jump.select("file", F.col("at").alias("mid"), "to"), ["file", "mid"]).select("file", "at", "to"), "warc-jumps")
        steps *= 2
    entries = doors.join(reached, ["file", "at"], "left_semi").select("file", "block", F.col("at").alias("entry"))

    def marked(part: pd.DataFrame) -> pd.DataFrame:
        part, nxt, _ = local(part)
        on = part["at"].isin(part["entry"].dropna()).to_numpy() if len(part) else np.zeros(0, bool)
        while True:  # the set doubles its reach with the pointers
            more = on.copy()
            more[nxt[on]] = True
            nxt2 = nxt[nxt]
            if (more == on).all() and (nxt2 == nxt).all():
                break
            on, nxt = more, nxt2
        return part.loc[on, ["file", "row"]]

    held = offsets.join(entries.select("file", "block", "entry", F.col("entry").alias("at")), ["file", "block", "at"], "left")
    return held.groupBy("file", "block").applyInPandas(marked, "file long, row long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: id, kind (response or revisit), bytes and sha1 (of the full
    payload), refers_to. A response whose payload doesn't have the digest that its
    header tells raises an error."""
    rows = pieces(spark, path)
    seen = written(_described(candidates(rows)), "warc-candidates")
    # a file's first piece is what stands before its first magic line: nothing
    width = F.col("size") + len(MAGIC)
    ends = seen.groupBy("file", "block").agg(F.sum(width).alias("total"))
    base = ends.select("file", "block", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = seen.join(base, ["file", "block"]).withColumn("end", F.col("base") + F.sum(width).over(Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)))
    # the magic line that ends the piece before is this piece's own: it starts one magic line earlier
    placed = written(placed.withColumn("at", F.col("end") - F.col("size") - 2 * len(MAGIC)).where("at >= 0"), "warc-placed")
    on = written(reachable(placed.select("file", "block", "row", "at", F.when(F.col("valid"), F.col("at") + F.col("record")).alias("to"))), "warc-records")
    real = placed.join(on, ["file", "row"], "left_semi")
    whole = real.where(F.col("record") == F.col("size") + len(MAGIC))
    broken = written(real.where(F.col("record") != F.col("size") + len(MAGIC)).select("file", "row", "at", "record"), "warc-broken")
    out = whole.select("id", "kind", "to", "told_bytes", "sha1", "right")
    if not broken.isEmpty():
        out = out.unionByName(_mended(rows, placed, broken).select(*out.columns))
    page = F.nullif(F.regexp_extract("id", rf"^<{ID}(.*)>$", 1), F.lit(""))
    damaged = F.raise_error(F.concat(F.lit("damaged record "), F.col("id")))
    return out.select(
        page.alias("id"), F.when(F.col("right"), F.col("kind")).otherwise(damaged).alias("kind"), F.col("told_bytes").alias("bytes"), "sha1",
        F.nullif(F.regexp_extract("to", rf"^<{ID}(.*)>$", 1), F.lit("")).alias("refers_to"),
    )


def _mended(rows: DataFrame, placed: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload was cut at magic lines inside it: their pieces, found by
    their places in the file, are joined again. Only those pieces are read anew."""
    near = Window.partitionBy("file").orderBy("at", F.col("head_at").isNull())
    heads = broken.select("file", F.col("row").alias("head_row"), F.col("at").alias("head_at"), F.col("record").alias("head_size"), "at")
    marks = placed.select("file", "row", "at").unionByName(heads, allowMissingColumns=True)
    last = lambda c: F.last(c, ignorenulls=True).over(near)
    inside = marks.select("file", "row", "at", last("head_row").alias("head_row"), last("head_at").alias("head_at"), last("head_size").alias("head_size")).where("row is not null and head_at is not null and at < head_at + head_size")
    inside = written(inside, "warc-inside")
    parts = rows.join(inside.select("file", "row", "head_row", "at"), ["file", "row"])
    whole = parts.groupBy("file", "head_row").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("p"))
    glued = whole.select("file", F.lit(0).cast("long").alias("block"), F.col("head_row").alias("row"), F.expr(f"array_join(p.value, '{MAGIC}')").alias("value"))
    return _described(candidates(glued))


def report(spark: SparkSession, pages: DataFrame, path: str, id_col: str = "page_id", **options) -> DataFrame:
    """Write the pages to archives in path, read those back: one row a page."""
    write(pages, path, id_col=id_col, **options)
    kind = dict(pages.dtypes)[id_col]
    found = read(spark, path)
    return found.select(F.col("id").cast(kind).alias(id_col), F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
