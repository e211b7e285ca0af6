"""Secret scans over a trigram inverted index.

From each rule's regular expression follows a Boolean trigram query: every literal stretch (small classes and alternatives
spelled out) is one condition, met if all trigrams of one of its strings occur. The index holds, for the trigrams that any
rule asks for, the documents in which they occur (lower case); postings are intersected by counting, and what meets every
condition of a rule is verified with its expression on the whole text. A rule without a mandatory trigram scans all texts.
Documents are named by a 64-bit hash of id and text in the index; equal hashes only add candidates to verify.

Only DataFrame functions run on the executors. Spans are in code points, end exclusive, leftmost and not overlapping per
rule, and their places are summed up by blocks, so a long text full of matches costs little more than its length. Defined results:
a null text is empty, an empty one has no spans; spans that start together are ordered by rule; rows repeated give equal rows; null ids are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import literal_table, materialize, text_of


@dataclass(frozen=True)
class Rule:
    """group, least: matches whose group is shorter than least characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
EXTRA = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[rs]k_live_[0-9A-Za-z]{20,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!$&*+=-]+@"),
)

#: Strings that a literal stretch may stand for before it is cut.
MOST = 64


def conditions(pattern: str) -> list[list[frozenset[str]]]:
    """The mandatory conditions of a pattern: for each, alternative sets of lower-case trigrams of which one must occur whole."""
    out: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        grams = [frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings]
        if grams and all(grams):
            out.append(sorted(set(grams), key=sorted))

    def options(op, arg) -> set[str] | None:
        """All strings an element may match, if they are few."""
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN:
            found: set[str] = set()
            for o, a in arg:
                if o is C.LITERAL:
                    found.add(chr(a).lower())
                elif o is C.RANGE and a[1] - a[0] < 8:
                    found |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return None
            return found if len(found) <= 8 else None
        if op is C.SUBPATTERN:
            return sequence(arg[3])
        if op is C.BRANCH:
            parts = [sequence(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is C.MAX_REPEAT and arg[1] <= 2:
            inner = sequence(arg[2])
            return None if inner is None else set().union(*({"".join(p) for p in itertools.product(inner, repeat=n)} for n in range(arg[0], arg[1] + 1)))
        return None

    def sequence(items) -> set[str] | None:
        now = {""}
        for op, arg in items:
            own = options(op, arg)
            if own is None or len(now) * len(own) > MOST:
                return None
            now = {a + b for a in now for b in own}
        return now

    def walk(items) -> None:
        now = {""}
        for op, arg in items:
            own = options(op, arg)
            if own is not None and len(now) * len(own) <= MOST:
                now = {a + b for a in now for b in own}
                continue
            close(now)
            now = {""}
            if own is not None:
                now = own
            elif op is C.SUBPATTERN:
                walk(arg[3])
            elif op is C.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
        close(now)

    walk(_parser.parse(pattern))
    return out


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{ord(c):02x}" for c in text)


def gram_pattern(grams: set[str]) -> str:
    """A pattern that finds every one of the trigrams at every place, in either case: a look-ahead by first characters."""
    heads = [f"{_escaped(h)}(?:{'|'.join(_escaped(g[1:]) for g in sorted(own))})" for h, own in itertools.groupby(sorted(grams), key=lambda g: g[0])]
    return f"(?i)(?=({'|'.join(heads)}))"


def build_index(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The postings, written out: gram, key, for the trigrams the rules ask for. docs: key, text."""
    grams = {g for r in rules for c in conditions(r.pattern) for a in c for g in a}
    if not grams:
        return docs.select(F.lit("").alias("gram"), "key").limit(0)
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(gram_pattern(grams)), F.lit(1)), F.lower))
    return materialize(docs.select(F.explode(found).alias("gram"), "key"), "postings")


def candidates(spark: SparkSession, postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key, mask: bit k is set if a document meets every condition of rule k. Written out."""
    rows = [{"rule": k, "condition": c, "alternative": a, "gram": g, "need": len(grams)} for k, r in enumerate(rules) for c, alternatives in enumerate(conditions(r.pattern)) for a, grams in enumerate(alternatives) for g in sorted(grams)]
    counts = [{"rule": k, "conditions": len(conditions(r.pattern))} for k, r in enumerate(rules)]
    asked = F.broadcast(literal_table(spark, rows, "rule:int,condition:int,alternative:int,gram:string,need:bigint"))  # as many rows as the rules' trigrams
    needed = F.broadcast(literal_table(spark, counts, "rule:int,conditions:bigint"))
    met = postings.join(asked, "gram").groupBy("key", "rule", "condition", "alternative", "need").agg(F.count("*").alias("n")).where("n >= need")
    met = met.select("key", "rule", "condition").distinct().groupBy("key", "rule").agg(F.count("*").alias("n"))
    hits = met.join(needed, "rule").where("n = conditions")
    return materialize(hits.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("mask")), "candidates")


def sizes(text: Column, rule: Rule) -> Column:
    """Lengths (gap, own, held) of the pieces between matches, of the matches, and of their groups; own is null after the last match."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    zipped = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("own"), F.transform(held, F.length).alias("held"))
    return zipped.cast("array<struct<gap:int,own:int,held:int>>")


def total(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(x["own"], F.lit(0)))


def blocked(lengths: str) -> Column:
    """lengths in blocks of about the root of their number: no position is summed up over all that lie before it."""
    step = F.ceil(F.sqrt(F.size(lengths))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, step), lambda at: F.slice(lengths, at + 1, step))


def block_starts(blocks: str) -> Column:
    """Where each block starts in the text."""
    own = F.transform(blocks, total)
    return F.transform(own, lambda _, k: F.aggregate(F.slice(own, F.lit(1), k), F.lit(0), lambda a, n: a + n))


def spans(blocks: str, starts: str, rule: Rule, rank: int) -> Column:
    """The rule's matches as an array of (start, rank, end)."""

    def place(block: Column, start: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            begin = start + total(F.slice(block, F.lit(1), k)) + x["gap"]
            return F.struct(begin.alias("start"), F.lit(rank).alias("rank"), (begin + x["own"]).alias("end"), x["held"].alias("held"))

        return F.transform(block, one)

    every = F.flatten(F.zip_with(blocks, starts, place))
    fit = F.filter(every, lambda s: s["end"].isNotNull() & (s["held"] >= rule.least))
    return F.transform(fit, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, text_col and spans, an array of (start, rank, end) by start, then rank: the rule's place in rules."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key"))
    found = candidates(docs.sparkSession, build_index(rows.select("key", "text"), rules), rules)
    joined = rows.join(found, "key", "left")
    kept = [F.col(id_col), F.col("text")]
    mays = []
    for k, rule in enumerate(rules):
        if conditions(rule.pattern):
            mays.append(F.col("mask").bitwiseAND(F.lit(1 << k)) != 0)
        else:
            mays.append(F.col("text").rlike(f"{rule.pattern[:-1]}{{{rule.least},}}" if rule.pattern.endswith("]+") else rule.pattern))
    step = joined.select(*kept, *(F.when(may, sizes(F.col("text"), rule)).alias(f"sizes{k}") for k, (may, rule) in enumerate(zip(mays, rules, strict=True))))
    step = step.select(*kept, *(blocked(f"sizes{k}").alias(f"blocks{k}") for k in range(len(rules))))
    step = step.select(*kept, *(F.col(f"blocks{k}") for k in range(len(rules))), *(block_starts(f"blocks{k}").alias(f"starts{k}") for k in range(len(rules))))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    parts = [F.coalesce(spans(f"blocks{k}", f"starts{k}", rule, k), none) for k, rule in enumerate(rules)]
    return step.select(F.col(id_col), F.col("text").alias(text_col), F.array_sort(F.concat(*parts)).alias("spans"))


def written(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
