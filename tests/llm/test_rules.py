"""Statistics against a plain version; the learned list."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from loreweave.llm import rules


def plain(t):
    t = t or ""
    words = [w.decode() for w in t.encode().split()]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


CASES = [None, "", " \n\t", "one", "a b", "a b c", "a b c a b c", "a a a a", "x\n\n x\nx\nx \ny", "## $5 a&b | <é>", "a b c d a b c x b c d", ("w1 w2 w3 " * 3000), " ".join(f"u{k}" for k in range(8000)), "l\nl\nl\n", "a b c\x0ba b c\x1ca"]


def test_statistics(spark, documents):
    rows = [(k, t) for k, t in enumerate(CASES)] + [(3, "one"), (None, "a b c")]
    got = rules.statistics(documents(rows)).collect()
    assert sorted(((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == sorted(((i, *plain(t)) for i, t in rows), key=repr)


def test_learned_list(spark, documents):
    good = [(k, " ".join(f"word{k}x{j}" for j in range(60 + k))) for k in range(60)]
    bad = [(100 + k, " ".join(f"w{k}x{j}###" for j in range(60 + k))) for k in range(60)]
    docs = documents(good + bad + [(300, None), (301, "short text")])
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(300, 0)], "doc_id long, quality int")
    stats = rules.statistics(docs)
    learned = rules.fit(stats, labels)
    assert learned and any(c.name == "symbols_per_word" for r in learned for c in r)
    kept = {r.id: r.kept for r in rules.judged(stats, learned).collect()}
    assert all(kept[i] for i, _ in good) and not any(kept[i] for i, _ in bad) and not kept[300] and not kept[301]
    assert "CASE WHEN" in str(rules.decision_list(learned))


def test_nothing_to_learn(spark, documents):
    stats = rules.statistics(documents([(1, " ".join(f"w{k}" for k in range(60)))]))
    for rows in ([], [(1, 1)], [(1, None), (1, 7)]):
        assert rules.fit(stats, spark.createDataFrame(rows, "doc_id long, quality int")) == []
    assert [r.kept for r in rules.judged(stats, []).collect()] == [True]
    assert rules.statistics(documents([])).collect() == []


def test_precision_guards_the_list():
    rows = [(str(k), k % 2, {"a": float(k % 7)}) for k in range(400)]
    assert rules.learn(rows) == []
    assert isinstance(rules.decision_list([]), type(F.lit(True)))
