"""Operators 1, 3 and 4, and the pipeline."""

import random

import pytest

import corpus_pipeline
from siftlog.llm import licenses, quality, toxicity


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, n_chars bigint")


def test_licences(spark):
    texts = [
        "Released under the MIT License.\nmore", "This work is licensed under the GNU General Public License, version 3.", "x All rights reserved.",
        "Redistribution and use in source and binary forms, with or without modification.\nRedistributions of source code must retain the above copyright notice.\nRedistributions in binary form must reproduce the above copyright notice.\nNeither the name of X may be used to endorse or promote products.",
        "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", "I have a licence to drive.", None, "", "license " * 5000,
    ]
    got = {r["doc_id"]: (r["licenses"], r["n_sentences"]) for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert got == {0: ("MIT", 1), 1: ("GPL-3.0-only", 1), 2: ("All-Rights-Reserved", 1), 3: ("BSD-3-Clause", 4), 4: ("Apache-2.0, CC-BY-NC-4.0", 2)}
    assert licenses.scan_licenses(docs(spark, texts).limit(0)).count() == 0


def prose(r, n=60):
    words = ["the", "river", "runs", "slowly", "past", "old", "stone", "houses", "where", "people", "sat", "talking", "about", "weather", "bread", "and", "summer"] + [f"{a}{b}" for a in ("lan", "mor", "tes", "vel", "kin", "sor", "dar", "pel", "win", "gar") for b in ("der", "ton", "ling", "ow", "ish", "et", "ard", "en", "ville", "a")]
    return " ".join(" ".join(r.choices(words, k=8)).capitalize() + "." for _ in range(n // 8))


def junk(r, kind):
    base = prose(r, 80).split()
    return [" ".join(w.upper() + "!!" for w in base), " ".join(w + r.choice(["###", "$$$"]) for w in base), " ".join([base[0]] * 60), " | ".join(base)][kind]


def test_quality_separates(spark):
    r = random.Random(1)
    texts = [prose(r, r.randint(16, 200)) for _ in range(200)] + [junk(r, i % 4) for i in range(60)] + [None, "", "One two.", "a" * 30_000]
    got = {x["doc_id"]: x for x in quality.classify(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["predicted"] == 1 for i in range(200))
    assert all(got[i]["predicted"] == 0 for i in range(200, 260))
    assert got[260]["predicted"] == got[261]["predicted"] == 1
    assert quality.classify(docs(spark, texts).limit(0)).count() == 0


def test_em_recovers_accuracies():
    """Patterns drawn from a known model: posteriors order as the true ones do."""
    r = random.Random(2)
    counts = {}
    for _ in range(20_000):
        bad = r.random() < 0.2
        p = "".join(("b" if r.random() < (0.4 if bad else 0.01) else "-") for _ in range(4)) + "".join(("g" if r.random() < (0.05 if bad else 0.9) else "-") for _ in range(2))
        counts.setdefault(p, [0, 0])[bad] += 1
    post = quality.fit_labellers({p: sum(c) for p, c in counts.items()})
    for p, (good, bad) in counts.items():
        if good + bad > 200:
            assert abs(post[p] - bad / (good + bad)) < 0.1
    assert quality.fit_labellers({}) == {}


@pytest.mark.parametrize("text,hit", [("you id1ot", 1), ("IDIOT!", 1), ("іdiоt", 1), ("ｉｄｉｏｔ", 1), ("ídiót", 1), ("i​diot", 1), ("l0ser", 1), ("p@thetic", 1), ("trash can", 0), ("the trash", 1), ("idiotic", 0), ("version 1.0 of 5", 0), ("", 0)])
def test_folding(text, hit):
    lexicon = toxicity.Lexicon({toxicity.fold(w): 1.0 for w in toxicity.SEEDS})
    assert lexicon.matches(toxicity.fold(text))[1] == hit


def toxic_corpus(spark):
    r = random.Random(3)
    texts, labels = [], []
    for i in range(600):
        words, bad = prose(r, r.randint(16, 80)).split(), i % 5 == 0
        if bad:
            for _ in range(r.randint(2, 4)):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "scum", "zorgblat" + r.choice(["en", "ig", "t"])]))
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    return docs(spark, texts + [None, ""]), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_learns(spark):
    d, labels = toxic_corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, labels).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert 100 < len(held) < 200
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.97
    assert got[600]["predicted"] == got[601]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_never_sees_held_out_labels(spark):
    from pyspark.sql import functions as F

    d, labels = toxic_corpus(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(d, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels(spark):
    d = docs(spark, ["you idiot scum", "good day"])
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(d, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()}
    assert got == {0: 1, 1: 0}


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "passages", "packing"]


def test_pipeline(spark, tmp_path):
    r = random.Random(5)
    fresh = lambda n: " ".join(f"word{r.randint(0, 10**6)}" for _ in range(n)) + "."
    clean = [prose(r, 40) + " " + fresh(40) for _ in range(120)]
    passage = fresh(60)
    texts = clean + [clean[0], clean[1] + " more", fresh(30) + " " + passage, fresh(40) + " " + passage, "you idiot scum trash loser", junk(r, 0), junk(r, 1), None, ""]
    d = docs(spark, texts).selectExpr("doc_id", "text", "'en' as lang", "source", "n_chars")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), d.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns
        seen[name] = {x["doc_id"]: x["text"] for x in kept.collect()}
    assert 124 not in seen["toxicity"] and len(seen["toxicity"]) == len(texts) - 1
    assert {125, 126}.isdisjoint(seen["quality"]) and set(range(120)) <= set(seen["quality"])
    assert {120, 121}.isdisjoint(seen["near_copies"]) and {0, 1, 122, 123} <= set(seen["near_copies"])
    assert seen["passages"][122] == texts[122] and len(seen["passages"][123].split()) == 40
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in rows} == set(seen["passages"])


def header(kind, version, what):
    return f"""This {what} is free software: you can redistribute it and/or modify
it under the terms of the GNU {kind}General Public License as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License
along with this {what}.  If not, see <https://www.gnu.org/licenses/>."""


def test_wrapped_licence_headers(spark):
    commented = "\n".join(" * " + x for x in header("", "3", "program").split("\n"))
    texts = [
        header("", "3", "program"), "/*\n" + commented + "\n */\nint main", header("Lesser ", "2.1", "library"), header("Affero ", "3", "program").replace("\n", "\r\n"), header("", "2", "program"),
        "Available under CC-BY-SA 4.0.", "-- Released under\n-- the MIT License", "Notes\nCopyright 2020 X\nAll rights reserved\nReleased under the\nMIT License", "All rights\n\nreserved",
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert got == {0: "GPL-3.0-or-later", 1: "GPL-3.0-or-later", 2: "LGPL-2.1-or-later", 3: "AGPL-3.0-or-later", 4: "GPL-2.0-or-later", 5: "CC-BY-SA-4.0", 6: "MIT", 7: "All-Rights-Reserved, MIT"}


def test_stages_keep_clean_rows_of_null_and_repeated_ids(spark, tmp_path):
    r = random.Random(8)
    clean = [prose(r, 60) for _ in range(60)]
    bad = ["you idiot scum trash loser", junk(r, 0), junk(r, 1), junk(r, 2)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else 100 + i, t) for i, t in enumerate(clean)]
    rows += [(i, t) for t in bad for i in (None, 7)] + [(7, clean[1])]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        d = stage(spark, d, str(tmp_path))
    assert sorted(map(str, ((x["doc_id"], x["text"]) for x in d.collect()))) == sorted(map(str, rows[:60]))


def test_published_notices(spark):
    """Notices of licences beyond the commonest, expressions, and denials."""
    cases = {
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice appear in all copies.": "ISC",
        "Permission is granted to anyone to use this software for any purpose,\n  including commercial applications, and to alter it.": "Zlib",
        " * Distributed under the Boost Software License, Version 1.0. (See accompanying file)": "BSL-1.0",
        "This program is made available under the terms of the Eclipse Public License v2.0 which accompanies it.": "EPL-2.0",
        "Available under the Creative Commons Attribution 3.0 License.": "CC-BY-3.0",
        "Text under CC BY-SA 3.0.": "CC-BY-SA-3.0",
        "// SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0, MIT",
        "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later",
        "# SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1-only",
        "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND MIT-0 */": "GPL-2.0-only WITH linux-syscall-note, MIT-0",
        "SPDX-License-Identifier: MIT": "MIT",
        "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0-only",
        "This file is not licensed under the Apache License, Version 2.0.": None,
        "The code is no longer distributed under the MIT License.": None,
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.": "OFL-1.1",
    }
    texts = list(cases)
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    first = docs(spark, texts).collect()[0]["doc_id"]
    assert {t: got.get(i) for i, t in enumerate(texts, first)} == cases
