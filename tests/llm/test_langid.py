import math
from collections import Counter, defaultdict

import numpy as np

from folioforge.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 250 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def plain_model(rows, sizes):
    """The method in plain code: a function of a text that gives language and score."""
    languages = sorted(sizes)
    counts = [defaultdict(Counter) for _ in range(6)]
    for text, lang in rows:
        for w in langid._LETTERS.findall(text.lower()):
            counts[0][w][lang] += 1
            for order in langid.ORDERS:
                for g in langid.grams(w, order):
                    counts[order][g][lang] += 1
    totals = [{x: sum(c[x] for c in own.values()) + langid.SMOOTH * (len(own) + 1) for x in languages} for own in counts]
    log = lambda order, g: np.array([math.log((counts[order][g][x] + langid.SMOOTH) / totals[order][x]) for x in languages])

    def evidence(word):
        if word in counts[0]:
            return log(0, word)
        for order in langid.ORDERS:
            if found := [log(order, g) for g in langid.grams(word, order) if g in counts[order]]:
                return np.mean(found, axis=0)
        return None

    def score(text):
        if not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        found = [e for t in text.split() for w in langid._LETTERS.findall(t.lower()) if (e := evidence(w)) is not None]
        total = np.sum(found, axis=0) if found else np.zeros(len(languages))
        total = (total - total.max()) / math.sqrt(len(text.split())) + [math.log(sizes[x] / sum(sizes.values())) for x in languages]
        odds = np.exp(total - total.max())
        return languages[int(np.argmax(odds))], float(odds.max() / odds.sum())

    return score


def test_scores_by_plain_code(spark, small):
    rows = [(d["text"], d["lang"]) for d in small if d["doc_id"] % 3 == 0 and d["text"] and d["lang"]]
    odd = ["The THE the", "12 34 !", "", None, "qqq", "Ünbekanntes wörtchen ßx", "a", "x", "naïve-café l'été", "日本語 word", "İstanbul ǅ", " ".join(f"neu{i}wort" for i in range(300))]
    texts = [d["text"] for d in small] + odd
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(df)
    want = plain_model(rows, Counter(lang for _, lang in rows))
    for scorer in (langid.Scorer(model), langid.Scorer(model)):
        for bound in (scorer.bound, 1024):
            scorer.bound = bound
            for text, (lang, p) in zip(texts, scorer.score(texts), strict=True):
                expected = want(text)
                assert lang == expected[0] and abs(p - expected[1]) < 1e-4, text


def test_keys_of_different_grams_differ():
    words = ["a", "b", "ab", "ba", "abab", "word", "wordy", "ß", "aa", "aaa"]
    keys = langid.Keys(words)
    assert len(set(keys.words().tolist())) == len(words)
    for order in langid.ORDERS:
        key, owner = keys.grams(order, np.arange(len(words)))
        pairs = {(g, k) for g, k in zip([g for w in words for g in langid.grams(w, order)], key.tolist(), strict=True)}
        assert len({g for g, _ in pairs}) == len({k for _, k in pairs}) == len(pairs)
        assert owner.tolist() == [i for i, w in enumerate(words) for _ in langid.grams(w, order)]


def test_ties_go_to_the_first_language_and_nothing_known_to_the_most_frequent(spark):
    rows = [(i, "der das", "de") for i in range(3)] + [(i, "the this", "en") for i in range(3, 6)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langid.Scorer(model).score(["qqq"]) == [("de", 0.5)]
    rows.append((9, "the", "en"))
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langid.Scorer(model).score(["qqq"])[0][0] == "en"


def test_sample_is_bounded_and_does_not_depend_on_order(spark):
    docs = spark.range(5000).selectExpr("id", "'some text' AS text", "'en' AS lang")
    a = {r.id for r in langid.training_sample(docs, 700).collect()}
    assert len(a) == 700 and a == {r.id for r in langid.training_sample(docs.repartition(5), 700).collect()}


def test_sample_is_never_empty_where_the_first_bin_exceeds_the_bound(spark):
    docs = spark.range(200_000).selectExpr("id", "'some text' AS text", "'en' AS lang")
    assert langid.training_sample(docs, 20).count() == 20 and langid.training_sample(docs, 1).count() == 1
    copies = spark.range(3000).selectExpr("1L AS id", "'one text' AS text", "'en' AS lang")
    assert langid.training_sample(copies, 20).count() == 1, "copies of one row, more than the bound, are learned once"


def test_rare_language_keeps_its_documents_beside_a_huge_one(spark):
    docs = spark.range(50_000).selectExpr("id", "CASE WHEN id % 5000 = 0 THEN concat('ritka szavak', id) ELSE concat('common words', id) END AS text", "CASE WHEN id % 5000 = 0 THEN 'hu' ELSE 'en' END AS lang")
    got = Counter(r.lang for r in langid.training_sample(docs, 100).collect())
    assert got == {"hu": 10, "en": 90}
    model = langid.train(docs.withColumnRenamed("id", "doc_id"), max_docs=100)
    assert langid.Scorer(model).score(["ritka szavak ritka szavak"])[0][0] == "hu"
    assert langid.quotas({"a": 5, "b": 100, "c": 100}, 50) == {"a": 5, "b": 22, "c": 23}
    assert langid.quotas({"a": 5, "b": 6, "c": 7}, 2) == {"b": 1, "c": 1}, "more languages than documents: the most frequent"


def test_large_models_come_from_fewer_documents(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('wort', translate(id, '0123456789', 'abcdefghij')) AS text", "'de' AS lang")
    full, half = langid.train(docs), langid.train(docs, max_rows=400)
    assert len(half.keys) <= 400 < len(full.keys) and len(half.keys) > 50


def test_awkward_rows(docs, empty):
    model = langid.train(docs)
    got = langid.predict(docs, model)
    assert got.columns == [*docs.columns, "language"]
    by = {(r.doc_id, r.text): r.language for r in got.collect()}
    assert by[3, None].lang_pred == "und" and by[4, ""].lang_pred == "und"
    none = langid.train(empty)
    assert {r.language.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
    assert langid.accepted_documents(docs).columns == docs.columns and langid.accepted_documents(empty).count() == 0
    own = docs.selectExpr("*", "'mine' AS language", "1 AS hash", "2 AS bin")
    kept = langid.accepted_documents(own, min_score=0.0)
    assert kept.columns == own.columns and {r.language for r in kept.collect()} == {"mine"}
