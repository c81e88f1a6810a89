from collections import Counter, defaultdict

from folioforge.llm import quality


def test_base_counts_by_plain_code(spark, small):
    got = {r.doc_id: r for r in quality.query(spark, "/root/testdata/sf0.001").collect()}
    for d in small:
        text = d["text"] or ""
        w = text.encode().split()
        windows = defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].append(i)
        covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        r = got[d["doc_id"]]
        assert (r.n_words, r.word_chars) == (len(w), sum(len(x.decode()) for x in w))
        assert r.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(covered)
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_frequent_lines_are_removed_and_depleted_documents_rejected(spark):
    common, own = "this line stands in very many documents of the host", "every document has {} words of its own that nobody else has and that make up most of it number {}"
    rows = [(i, f"{common}\n{own.format(i, i)}", "h") for i in range(40)]
    rows += [(100 + i, "\n".join([common.upper()] * 3 + [f"tail {i}"]), "h") for i in range(3)] + [(200, f"{common}\n{common}  \nand some more words here to reach twenty words", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.id: r for r in quality.line_rules(df).collect()}
    n = len(common.split())
    assert all(got[i].n_removed_words == n and got[i].kept for i in range(40))
    assert all(not got[100 + i].kept for i in range(3)), "a depleted document"
    assert got[200].n_removed_words == 0, "limits are by host"
    left = {r.doc_id: r.text for r in quality.cleaned_documents(df).collect()}
    assert left[5] == own.format(5, 5) and 100 not in left


def test_copies_of_a_text_count_once(spark):
    text = "\n".join(f"copied{i} line{i} number{i} has{i} some words" for i in range(5))
    df = spark.createDataFrame([(i, text, "h") for i in range(60)], "doc_id long, text string, source string")
    assert all(r.kept for r in quality.line_rules(df).collect())


def test_copies_do_not_dilute_the_limit(spark):
    footer, own = "a footer of the site that many of its pages have", "page {0} has quite many words of its own which make up nearly all of it page {0} of {0} pages in all"
    rows = [(i, f"{own.format(i)}\n{footer}", "h") for i in range(15)] + [(100 + i, own.format("copied"), "h") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    removed = {r.id: r.n_removed_words for r in quality.line_rules(df).collect()}
    assert all(removed[i] == len(footer.split()) for i in range(15)) and removed[100] == 0


def test_limit_stops_at_a_number_of_texts(spark):
    rows = [(i, f"line of {i % 2}\nown {i}", "h") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    count = lambda **limits: sum(r.n_removed_words > 0 for r in quality.line_rules(df, **limits).collect())
    assert (count(max_share=0.6), count(max_share=0.6, max_docs=29), count(max_share=0.6, max_docs=30)) == (0, 60, 0)


def test_frequent_lines_beyond_the_broadcast_bound_are_joined(spark):
    rows = [(i, "\n".join(f"line {k} of many" for k in range(8) if i % (k + 1) == 0) + f"\nown {i}", None if i % 5 else "h") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, quality.line_rules(df).collect()))
    assert all(sorted(map(str, quality.line_rules(df, broadcast_lines=n).collect())) == want for n in (0, 1, 3))


def test_user_columns_keep_their_names(spark, docs):
    own = docs.selectExpr("*", "'y' AS found", "'z' AS removed")
    got = quality.cleaned_documents(own)
    assert got.columns == own.columns and {(r["__hash"], r.found, r.removed) for r in got.collect()} == {("c", "y", "z")}


def test_awkward_rows(docs, empty):
    got = quality.line_rules(docs).collect()
    assert len(got) == docs.count()
    by_id = {r.id: r for r in got}
    assert by_id[3].n_words == 0 and by_id[3].base_failed and not by_id[4].kept and by_id[6].n_words == 100_000
    assert Counter(r.id for r in got)[7] == 2
    assert quality.cleaned_documents(docs).columns == docs.columns
    assert quality.line_rules(empty).count() == 0 and quality.cleaned_documents(empty).count() == 0
