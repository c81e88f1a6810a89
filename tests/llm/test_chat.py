from folioforge.llm import chat


def test_rotation_by_plain_code(spark):
    import pyarrow.parquet as pq

    turns = pq.read_table("/root/testdata/sf0.001/conversations.parquet").to_pylist()
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")).collect()}
    by = {}
    for t in sorted(turns, key=lambda t: (t["conv_id"], t["turn"], t["role"], t["text"])):
        by.setdefault(t["conv_id"], []).append(t)
    want = {}
    for conv, ts in by.items():
        for who in {t["role"] for t in ts}:
            text, spans = "", []
            for t in ts:
                text += "<|assistant|>\n" if t["role"] == who else f"<|user name={t['role']}|>\n"
                body = t["text"] + chat.END
                if t["role"] == who:
                    spans.append((len(text), len(text) + len(body)))
                text += body
            want[conv, who, 0] = (text, spans)
    assert {k: (r.text, [tuple(s) for s in r.spans]) for k, r in got.items()} == want


def test_awkward_turns(spark):
    rows = [(1, 0, "a", "hi <|end|> there"), (1, 1, None, None), (1, 1, None, None), (1, None, "b", "first"), (None, 0, "a", "x"), (2, 0, "a", ""), (3, 5000, "a", "late"), (3, 1, "b", "😀é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS blocks", "3 AS perspective")
    got = chat.rotate(df).collect()
    one = {(r.perspective, r.part): r for r in got if r.conv_id == 1}
    assert set(one) == {(p, 0) for p in ("a", "b", "unknown")} and one["b", 0].text.startswith("<|assistant|>\nfirst")
    mine = one["a", 0]
    assert "<\\|end|> there" in mine.text and [mine.text[s.start : s.end] for s in mine.spans] == ["hi <\\|end|> there<|end|>\n"]
    assert one["unknown", 0].n_turns == 4 and len(one["unknown", 0].spans) == 2
    three = {(r.perspective, r.part): r for r in got if r.conv_id == 3}
    assert set(k for _, k in three) == {0}
    assert three["b", 0].text[three["b", 0].spans[0].start : three["b", 0].spans[0].end].startswith("😀é") or len("😀") == 1
    assert chat.rotate(df.filter("false")).count() == 0


def test_turns_of_one_number_or_none_are_dealt_in_parts(spark):
    df = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS conv_id", "CASE WHEN id % 3 = 1 THEN 0 END AS turn", "concat('r', id % 2) AS role", "CASE WHEN id % 3 < 2 THEN 'same' ELSE concat('text ', id) END AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.rotate(df, part_turns=100).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 3 * 2 * 10 and all(r.n_turns == 100 for r in got)
    for conv in (None, 1, 2):
        mine = sorted((r for r in got if r.conv_id == conv and r.perspective == "r0"), key=lambda r: r.part)
        whole = "".join(r.text for r in mine)
        assert whole.count(chat.END) == 1000 and whole.count("<|assistant|>") == 500 == sum(len(r.spans) for r in mine)
        assert whole.rindex("<|assistant|>") < whole.index("<|user name=r1|>"), "in the order of roles over all parts"
