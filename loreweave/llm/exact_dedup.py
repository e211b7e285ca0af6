"""Exact deduplication by a tree merge of sorted digest runs.

Every document falls into one of `runs` runs by a hash of its row, and by the first two bytes of its digest into a part. Level 0
sorts each run by digest and keeps one entry per digest. Then come binomial rounds: `fan_in` neighbouring runs are sent to one
partition (the shuffle is dealt by part and run, not by digest), sorted together and merged into one, until a single run is
left; as parts are merged apart from each other, no partition ever holds more than some parts of one run. Every merge keeps,
for each verified key (SHA-256, a second 64-bit hash and the length of the normalised text), the entry that stays and the number
of rows it stands for. The verdicts then go back down: each run gets those of its own digests, so that a document meets its
verdict under (digest, run) and a text that holds a third of all rows is spread over all runs.

Only DataFrame functions run. Defined results: null text counts as empty; empty texts form one group; very long texts are read
whole; rows repeated with the same id are separate rows of one group, of which exactly one stays; of equally long texts the
smallest id stays; a null id loses against any other of the same length; an empty table gives no rows; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import SPACES, hashed_rows, materialize, text_of, without_dropped

KEY = ("digest", "check", "norm_chars")


def normalised(text: Column) -> Column:
    """The text without the characters [\\x20\\x09-\\x0D]."""
    return F.translate(text, SPACES, "")


def digest_rows(docs: DataFrame, id_col: str, text_col: str, row_col: str | None, runs: int) -> DataFrame:
    """A row per document: row, id, run, KEY, chars. Written out, so row numbers hold."""
    text = text_of(text_col)
    norm = normalised(text)
    rows = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).alias("id"),
        F.length(text).alias("chars"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.xxhash64(norm).alias("check"),
        F.length(norm).alias("norm_chars"),
    )
    return materialize(rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)).cast("int")), "digests")


def merged(entries: DataFrame) -> DataFrame:
    """Of the entries with equal key in a run, the one that stays, and the rows all of them stand for. The runs come out sorted:
    an aggregate that keeps a whole entry sorts by its keys."""
    return entries.groupBy("part", "run", *KEY).agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))


def merge_round(level: DataFrame, fan_in: int) -> DataFrame:
    """One round: neighbouring runs of a part meet in one partition and become one."""
    return merged(level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition("part", "run"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, runs: int = 256, fan_in: int = 4) -> DataFrame:
    """Columns: row (row_col, or a number of its own), id_col, keep_id, group_size, kept, text_sha256. One row per input row."""
    rows = digest_rows(docs, id_col, text_col, row_col, runs)
    rank = F.struct((-F.col("chars")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("id"), F.col("row").alias("row"))
    part = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    leaves = merged(rows.select(part.alias("part"), "run", *KEY, rank.alias("best"), F.lit(1).cast("long").alias("rows")))
    level, left = leaves, runs
    while left > 1:
        level, left = merge_round(level, fan_in), -(-left // fan_in)
    root = level.where("rows > 1").select(*KEY, F.col("best.id").alias("keep"), F.col("best.row").alias("keep_row"), "rows")
    verdicts = leaves.select(*KEY, "run").join(root, list(KEY))
    single = F.col("rows").isNull()
    return rows.join(verdicts, [*KEY, "run"], "left").select(
        "row",
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops. Rows are named by a hash of all columns, so docs is not copied."""
    rows, row = hashed_rows(docs)
    return without_dropped(rows, row, exact_dedup(rows, id_col, text_col, row))
