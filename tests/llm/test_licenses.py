"""Licence scans: held-out accuracy, statements inside prose, prose alone."""

from __future__ import annotations

from loreweave.llm import licenses


MODEL = licenses.default_model()


def predicted(text):
    p = MODEL.probabilities(licenses.tokens(text))
    return MODEL.families[p.argmax()] if p.max() >= 0.5 else licenses.UNKNOWN


def test_held_out_accuracy():
    table = licenses.training_table()
    assert len({s for _, s, _ in table}) > 0.97 * len(table)
    assert not {s for _, s, h in table if h} & {s for _, s, h in table if not h}
    assert licenses.train(table)[1] > 0.95


#: Statements whose names or frames the tables do not hold.
NEW = {
    "apache-2.0": ("Available under the Apache-2.0 license", "We offer this under Apache License, Version 2"),
    "mit": ("Code: MIT License", "It is provided under the MIT license terms"),
    "gpl-3.0": ("Published under the GNU GPL, version 3", "It falls under GPLv3"),
    "agpl-3.0": ("Offered under the GNU Affero General Public License v3",),
    "lgpl": ("Library under the GNU Lesser General Public License v3.0",),
    "bsd": ("Use is governed by the 3-clause BSD license",),
    "mpl-2.0": ("Files are under the Mozilla Public License 2.0",),
    "epl-2.0": ("Made available under the Eclipse Public License 2.0",),
    "cc-by-nc": ("Creative Attribution-NonCommercial 4.0 International", "Images: CC BY-NC 4.0"),
    "cc-by-sa": ("Text under Creative Commons Attribution-ShareAlike 4.0",),
    "cc-by": ("Photos: Creative Commons Attribution 4.0 International",),
    "public-domain": ("Dedicated to the public domain under CC0 1.0",),
    "unknown": (
        "Licensed under the Banana License.", "Released under the rules of the house.", "The license of the bar was revoked in May.", "They met in public and went home.", "The general read the notice.",
        "Er ging mit ihr in die Stadt.", "A new version of the song was released.", "The file is free.", "License: the Kite Agreement",
    ),
}


def test_statements_that_no_table_holds():
    known = {s for _, s, _ in licenses.training_table()}
    rows = [(f, s) for f, own in NEW.items() for s in own]
    assert not known & {s for _, s in rows}
    assert sum(predicted(s) == f for f, s in rows) >= 0.9 * len(rows), [(s, predicted(s)) for f, s in rows if predicted(s) != f]


def test_no_paragraph_without_a_trigger_has_a_family():
    """The worst paragraph that holds no trigger: every gram that favours a family."""
    import numpy as np

    words, u = set(licenses.triggers(MODEL)), MODEL.families.index(licenses.UNKNOWN)
    for k in range(len(MODEL.families)):
        if k != u:
            worst = sum(max(0, w[k] - w[u]) for g, w in MODEL.weights.items() if not words & set(g.split()))
            assert MODEL.bias[k] - MODEL.bias[u] + worst < 0
    assert np.isclose(MODEL.probabilities([]).sum(), 1) and MODEL.probabilities([]).argmax() == u


def plain(text):
    """(place, family, probability) by the definitions, word by word."""
    lines, parts = text.lower().split("\n"), []
    for k, line in enumerate(lines):
        before = lines[k - 1].strip(" \t\x0b\x0c\r") if k else ""
        if k and before and before[-1] not in ".!?:;" and line.strip(" \t\x0b\x0c\r"):
            parts[-1] += " " + line
        else:
            parts.append(line)
    out = []
    for place, part in enumerate(parts):
        words, best = licenses.tokens(part), None
        for at in range(0, max(0, len(words) - 61) + 1, 60):
            p = MODEL.probabilities(words[at : at + 120])
            if p.max() >= 0.5 and MODEL.families[p.argmax()] != licenses.UNKNOWN:
                sure = max(len(set(t) & set(words[at : at + 120])) / len(t) for f, t in licenses.templates() if f == MODEL.families[p.argmax()]) >= 0.8
                best = max(best or (), (sure, round(float(p.max()), 9), -at, MODEL.families[p.argmax()]))
        if best:
            out.append((place, best[3], best[1], best[0]))
    return out


def test_against_a_plain_scorer(spark, documents):
    import random

    rng = random.Random(3)
    statements = [s for _, s, _ in licenses.training_table()] + [s for own in NEW.values() for s in own]
    texts = ["\n".join(rng.choice([s, s.upper(), " ".join(s.split()[:4]), "words and words", "", "  ", s.replace(" ", "\n", 2)]) for s in rng.sample(statements, rng.randrange(1, 9))) for _ in range(150)]
    texts += ["filler " * 200 + "Licensed under CC BY-NC 4.0 " + "more words " * 150, None, "", "x" * 100_000]
    got = {r.doc_id: [(x.place, x.family, round(x.probability, 9), x.confirmed) for x in r.licences] for r in licenses.scan(documents(list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        want = plain(t or "")
        assert [(a, b, d) for a, b, _, d in got[k]] == [(a, b, d) for a, b, _, d in want], t
        assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(got[k], want, strict=True))


def test_wrapped_statements(spark, documents):
    texts = {
        1: "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal\nin the Software without restriction\n\nOther words.",
        2: "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\nany later version.",
        3: "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    }
    got = {r.doc_id: [(x.place, x.family) for x in r.licences if x.confirmed] for r in licenses.scan(documents([*texts.items()])).collect()}
    assert got == {1: [(0, "mit")], 2: [(0, "gpl-3.0")], 3: [(0, "bsd")]}


def test_scan(spark, documents):
    texts = {
        1: "Ein Text.\nLicensed under the Apache License, Version 2.0.\nMehr.",
        2: "Released under the MIT License.",
        3: "words mit words\nDas ist mit Absicht so.",
        4: "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.",
        5: "He lost his driving license in the domain of copies.",
        6: None, 7: "", 8: "\n\n", 9: ("filler word " * 20_000) + "\nLicensed under CC BY-NC 4.0.", 10: "Licensed under the Zorp License.",
    }
    got = {r.doc_id: [(x.place, x.family) for x in r.licences if x.confirmed] for r in licenses.scan(documents([*texts.items()])).collect()}
    assert got == {1: [(1, "apache-2.0")], 2: [(0, "mit")], 3: [], 4: [(0, "gpl-3.0"), (1, "proprietary")], 5: [], 6: [], 7: [], 8: [], 9: [(0, "cc-by-nc")], 10: []}


def test_rows(spark, documents):
    assert licenses.scan(documents([])).collect() == []
    out = licenses.scan(documents([(1, "All rights reserved."), (1, "All rights reserved."), (None, "All rights reserved.")])).collect()
    assert len(out) == 3 and all(len(r.licences) == 1 for r in out)
