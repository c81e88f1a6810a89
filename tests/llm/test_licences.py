import math
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from folioforge.llm import licences


@pytest.fixture(scope="module")
def model(spark):
    return licences.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_every_licence_line_of_the_corpus_is_found_and_nothing_else(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = F.when(F.col("text").contains("CC BY-NC 4.0"), "cc-by-nc").when(F.col("text").contains("GNU General Public"), "gpl").when(F.col("text").contains("Apache License"), "apache-2.0").when(F.col("text").contains("MIT License"), "mit").otherwise("unknown")
    got = licences.scan(docs, model).join(docs.select(F.col("doc_id").alias("id"), truth.alias("truth")), "id")
    assert got.filter("truth <> family").count() == 0 and got.filter("family <> 'unknown'").count() > 20


def test_templates_altered_texts_and_other_legal_prose(spark, model):
    rows = [(f, t, f) for f, ts in licences.TEMPLATES.items() for t in ts]
    rows += [("altered", "Permission is hereby granted, free of charge, to any person who obtains a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of it.", "mit")]
    rows += [("other", t, "unknown") for t in licences.OTHER_LEGAL] + [("prose", "The driver's license was renewed under the new terms of the council.", "unknown")]
    df = spark.createDataFrame([(i, "Some words before.\n" + t + "\nAnd after.", w) for i, (_, t, w) in enumerate(rows)], "doc_id long, text string, want string")
    got = licences.scan(df, model).join(df.select(F.col("doc_id").alias("id"), "want"), "id").collect()
    assert [(r.id, r.family) for r in got if r.family != r.want] == []
    assert all(0 <= r.score <= 1 for r in got)


def test_families_of_one_wording_are_told_apart(spark, model):
    rows = [
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "lgpl"),
        ("This file is part of tool. It is licensed under the GNU Lesser General Public License, version 3.", "lgpl"),
        ("You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "agpl"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl"),
        ("Text is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
        ("Photo: licensed under CC BY-ND 4.0.", "cc-by-nd"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License", "cc-by-nc-nd"),
        ("This project is not licensed under the terms of the MIT license.", "unknown"),
        ("It is no longer released under the MIT License.", "unknown"),
        ("This isn't licensed under CC BY 4.0.", "unknown"),
        ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mpl"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    assert {r.id: r.family for r in licences.scan(df, model).collect()} == dict(enumerate(f for _, f in rows))


def altered(words, kind, seed):
    """Copies in ways of their own: one of words left out, exchanged, doubled, or followed by others."""
    out = []
    for i, w in enumerate(words):
        hit = xxhash.xxh64_intdigest(f"{seed}:{i}") % 12 == 0
        out += {"left out": [] if hit else [w], "exchanged": ["other"] if hit else [w], "doubled": [w, w] if hit else [w], "followed": [w]}[kind]
    return " ".join(out + (["as", "the", "file", "at", "the", "top", "of", "the", "tree", "says"] if kind == "followed" else []))


def test_altered_templates_are_mostly_found_and_never_mistaken(spark, model):
    rows = [(altered(t.split(), kind, seed), f) for f, ts in licences.TEMPLATES.items() for t in ts for kind in ("left out", "exchanged", "doubled", "followed") for seed in range(3)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.id: r.family for r in licences.scan(df, model).collect()}
    right = sum(got[i] == f for i, (_, f) in enumerate(rows)) / len(rows)
    wrong = sum(got[i] not in (f, "unknown") for i, (_, f) in enumerate(rows)) / len(rows)
    print("altered templates: right", right, "mistaken", wrong)
    assert right > 0.75 and wrong < 0.04


def spark_hash(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def plain_scan(text, model):
    """(n_paragraphs, families, family, score) of a text in plain code."""
    split = lambda t: [w for w in re.sub(r"[^\w¶]|_", " ", t.translate({c: c + 32 for c in range(65, 91)})).split(" ") if w]
    lines = (text or "").split("\n") if text is not None else []
    runs = [r for r in re.split(r"\n[^\w¶]*\n", text or "") if sum(bool(split(x)) for x in r.split("\n")) > 1]
    weights, templates, found = dict(model.weights), dict(model.templates), []
    for p in lines + [r.replace("\n", " ") for r in runs]:
        w = split(p)
        grams = {spark_hash(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}
        own = [weights[g] for g in grams if g in weights]
        if not own:
            continue
        z = [c + sum(x[k] for x in own) for k, c in enumerate(model.intercepts)]
        e = [math.exp((x - max(z)) / model.temperature) for x in z]
        probs = [x / sum(e) for x in e][:-1]
        best = probs.index(max(probs))
        share = [sum(k in templates.get(g, ()) for g in grams) / n for k, n in enumerate(model.sizes)]
        m = [max([x for x, o in zip(share, model.owners) if o == f]) for f in range(len(licences.FAMILIES))]
        good = probs[best] >= model.threshold and m[best] >= licences.CONFIRM and m[best] >= max(m) and not grams & set(model.denials)
        found.append((licences.FAMILIES[best] if good else None, probs[best]))
    top = sorted((-p, f) for f, p in found if f)
    return len(found), sorted({f for f, _ in found if f}), top[0][1] if top else "unknown", -top[0][0] if top else 0.0


def test_scan_by_plain_code(spark, model, small):
    texts = [d["text"] for d in small] + [t + "\n" + u for ts in licences.TEMPLATES.values() for t, u in zip(ts, licences.OTHER_LEGAL)] + ["# not\n# licensed\n# under CC BY 4.0.", "Licensed under\n\nCC BY 4.0", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r for r in licences.scan(df, model).collect()}
    for i, text in enumerate(texts):
        n, families, family, score = plain_scan(text, model)
        assert (got[i].n_paragraphs, got[i].families, got[i].family) == (n, families, family), text
        assert abs(got[i].score - score) < 1e-9


def test_awkward_rows(docs, empty, model):
    got = licences.scan(docs, model).collect()
    assert len(got) == docs.count() and {r.family for r in got} == {"unknown"}
    assert licences.scan(empty, model).count() == 0
    assert licences.train(empty).weights is not None


def test_wrapped_licence_texts_are_found(spark, model):
    import textwrap

    long = [(f, t) for f, ts in licences.TEMPLATES.items() for t in ts if len(t) > 120]
    rows = [(prefix.join(["", *textwrap.wrap(t, width)]).strip("\n"), f) for f, t in long for width, prefix in ((76, "\n"), (40, "\n # "), (76, "\n * "))]
    rows = [(f"/* tool {i}\n *\n{t}\n\nint main;", f) for i, (t, f) in enumerate(rows)] + [("Licensed\nunder\nCC\nBY\n4.0.\n", "cc-by"), ("one plain line\nand one more\n\n", "unknown")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    assert {r.id: r.family for r in licences.scan(df, model).collect()} == dict(enumerate(f for _, f in rows))


def test_single_lines_are_not_counted_twice(spark):
    df = spark.createDataFrame([("a b\n\n # c d\n--\ne f\ng h\n",)], "text string")
    assert [x.strip() for x in df.select(licences.paragraphs(F.col("text")).alias("x")).first().x if x.strip()] == ["a b", "# c d", "--", "e f", "g h", "e f g h"]


def test_a_frequent_notice_within_longer_lines_is_not_lost(spark):
    end = "(c) 2020 Example Corp. Licensed under CC BY 4.0. For other terms write to the legal office of the company at its seat in the old town."
    docs = spark.createDataFrame([(i, f"text {i} of the source has words of its own number {i}\n{end}") for i in range(300)], "doc_id long, text string")
    alone = spark.createDataFrame([(1, "Licensed under CC BY 4.0."), (2, f"some text\n{end}"), (3, "For other terms write to the legal office.")], "doc_id long, text string")
    assert {r.id: r.family for r in licences.scan(alone, licences.train(docs)).collect()} == {1: "cc-by", 2: "cc-by", 3: "unknown"}


def test_what_confirms_a_template_has_a_feature():
    grams, triples = {1: {0}, 2: {0}, 3: {0}, 4: {1}}, {3: (1, 2)}
    assert licences._features(grams, [3, 1], {1, 2, 4}, triples, {1, 2, 4}) == ([1, 2, 4], [1, 2, 3, 4])
    assert licences._features(grams, [3, 1], {1, 2, 4}, triples, {1}) == ([2, 4], [2, 3, 4])
