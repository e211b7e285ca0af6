"""Quality rules: a decision list learned from labelled statistics, as ordered Spark conditional expressions.

Sequential covering: on two thirds of the labelled rows a rule grows, threshold by threshold, by the largest information gain
for rejected rows; on the other third its last conditions are pruned while that raises its precision there. Rows it covers
are taken out and the next rule grows, until one does not reach `precision` on the pruning rows that are left, covers fewer
than `least` rows, or the list has `most` rules; a rule has at most `depth` conditions. The list becomes one
F.when(...).when(...).otherwise(keep). The driver learns on at most `max_rows` labelled ids, a few numbers each; statistics of
all documents come from DataFrame functions only.

Defined results: a null text has no words; very long texts are read whole; without words every share is 0; without labelled rows,
or with one label only, the list is empty and keeps all; of equally good conditions the first by name and limit counts; of labels
that repeat an id the least counts, of documents that repeat a labelled id the least numbers; rows repeated are separate rows;
null ids are kept (and never labelled); an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import SPACES, WORD, bounded_sample, materialize, text_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!\"'()+,-./:;=?@[\\]^_`{}~0123456789"


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def ordered_windows(hashes: Column) -> Column:
    """The hashes of all 3-word windows with their places, in order of the hash."""
    return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_places(ordered: str) -> Column:
    """The places of windows that occur twice or more, in order: in ordered, a neighbour has the same hash."""
    s = F.col(ordered)
    same = lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
    return F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(same(e, k), F.lit(False))), lambda e: e["i"]))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_marks. Written out."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.select(
        "id",
        F.when(text.rlike(WORD), F.split(F.btrim(text, F.lit(SPACES)), r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        _count(text, CAPITALS).alias("n_capitals"),
        _count(text, MARKS).alias("n_marks"),
    )
    windows = F.when(F.size("words") >= 3, F.transform(F.slice("words", 1, F.size("words") - 2), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "id", "word_chars", "n_symbols", "n_capitals", "n_marks",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    kept = ["id", "word_chars", "n_symbols", "n_capitals", "n_marks", "n_words", "n_lines", "n_dup_lines"]
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select(*kept, F.when(repeats, ordered_windows(F.col("windows"))).alias("ordered"))
    rows = rows.select(*kept, F.when(F.col("ordered").isNotNull(), repeated_places("ordered")).alias("places"))
    gaps = F.aggregate(F.zip_with(F.slice("places", 1, F.size("places") - 1), F.slice("places", 2, F.size("places") - 1), lambda a, b: F.least(b - a, F.lit(3))), F.lit(3), lambda a, b: a + b)
    return materialize(rows.select(*kept, F.when(F.size("places") > 0, gaps).otherwise(0).cast("long").alias("n_repeat_words")), "statistics")


def shares() -> dict[str, Column]:
    """The numbers that rules may test."""
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": part("word_chars", "n_words"),
        "symbols_per_word": part("n_symbols", "n_words"),
        "capital_share": part("n_capitals", "word_chars"),
        "mark_share": part("n_marks", "word_chars"),
        "dup_line_share": part("n_dup_lines", "n_lines"),
        "repeat_share": part("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def holds(self, row: dict) -> bool:
        return row[self.name] > self.limit if self.above else row[self.name] <= self.limit

    def column(self) -> Column:
        value = shares()[self.name]
        return value > self.limit if self.above else value <= self.limit

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.limit:.6g}"


def _covers(rule: list[Condition], row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _grow(bad: list[dict], good: list[dict], steps: int, depth: int) -> list[Condition]:
    rule: list[Condition] = []
    while good and bad and len(rule) < depth:
        base, best = math.log2(len(bad) / (len(bad) + len(good))), None
        for name in bad[0]:
            values = sorted(r[name] for r in bad + good)
            limits = sorted({(values[k] + values[k - 1]) / 2 for j in range(1, steps) if (k := j * len(values) // steps) and values[k] != values[k - 1]} | {(a + b) / 2 for a, b in zip(sorted({r[name] for r in bad})[:steps], sorted({r[name] for r in bad})[1:steps], strict=False)})
            b, g = sorted(r[name] for r in bad), sorted(r[name] for r in good)
            i = j = 0
            for limit in limits:
                while i < len(b) and b[i] <= limit:
                    i += 1
                while j < len(g) and g[j] <= limit:
                    j += 1
                for above, p, n in ((False, i, j), (True, len(b) - i, len(g) - j)):
                    if p and (gain := p * (math.log2(p / (p + n)) - base)) > (best[0] if best else 1e-9):
                        best = (gain, Condition(name, above, limit))
        if best is None:
            break
        rule.append(best[1])
        bad, good = ([r for r in x if best[1].holds(r)] for x in (bad, good))
    return rule


def learn(rows: list[tuple[str, int, dict]], precision: float = 0.9, least: int = 3, most: int = 24, steps: int = 32, depth: int = 4) -> list[list[Condition]]:
    """rows: id, label (0: reject), numbers. The rules, in order; a row that any covers is rejected."""
    prune = [zlib.crc32(f"prune:{i}".encode()) % 3 == 0 for i, _, _ in rows]
    sides = {(p, y): [x for q, (_, z, x) in zip(prune, rows, strict=True) if q == p and z == y] for p in (False, True) for y in (0, 1)}
    out: list[list[Condition]] = []
    while len(out) < most and len(sides[False, 0]) >= least:
        rule = _grow(sides[False, 0], sides[False, 1], steps, depth)
        if not rule:
            break

        def worth(r: list[Condition]) -> tuple[float, int]:
            p, n = (sum(_covers(r, x) for x in sides[True, y]) for y in (0, 1))
            return ((p + 1) / (p + n + 2), p)

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        p, n = (sum(_covers(rule, x) for x in sides[True, y]) for y in (0, 1))
        if p < 1 or p / (p + n) < precision or p + sum(_covers(rule, x) for x in sides[False, 0]) < least:
            break
        out.append(rule)
        sides = {k: [x for x in v if not _covers(rule, x)] for k, v in sides.items()}
    return out


def decision_list(rules: list[list[Condition]]) -> Column:
    """True for what the list keeps."""
    out = None
    for rule in rules:
        hold = F.lit(True)
        for c in rule:
            hold = hold & c.column()
        out = F.when(hold, F.lit(False)) if out is None else out.when(hold, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 20_000) -> list[list[Condition]]:
    """Learns on at most max_rows labelled rows, chosen by a hash of the id."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    columns = shares()
    rows = stats.join(F.broadcast(bounded_sample(marked.groupBy("id").agg(F.min("label").alias("label")), "id", max_rows)), "id")  # at most max_rows rows
    rows = rows.groupBy("id", "label").agg(F.min(F.struct(*(c.alias(n) for n, c in columns.items()))).alias("x")).select("id", "label", "x.*").collect()
    return learn(sorted(((str(r["id"]), r["label"], {n: float(r[n]) for n in columns}) for r in rows), key=repr))


def judged(stats: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """stats with base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & decision_list(rules))
