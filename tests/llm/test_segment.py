import numpy as np
import public_tokenizers
import pytest

from folioforge.llm import segment

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return segment.Segmenter(FILE)


def every_path(own, text):
    """All segmentations of a text as (score, ids), best first."""
    text, out = " " + text, []

    def go(i, score, ids):
        if i == len(text):
            out.append((score, tuple(ids)))
            return
        single = False
        for end in range(i + 1, len(text) + 1):
            if found := own.scores.get(text[i:end]):
                single |= end == i + 1
                go(end, score + found[0], [*ids, *found[1]])
        if not single:
            raw = [own.bytes[b] for b in text[i].encode()]
            go(i + 1, score + own.byte_score * len(raw), ids + raw)

    go(0, 0, [])
    return sorted(out, reverse=True)


@pytest.mark.parametrize("text", ["the cat", "a, b.", "x\ny", "日本 é", "(ab) c-d", "  two", "12 ab!"])
@pytest.mark.parametrize("n", [1, 2, 7])
def test_n_best_by_full_enumeration(own, text, n):
    want, got = every_path(own, text), own.n_best(text, n)
    assert [s for s, _ in got] == [s for s, _ in want[:n]]
    paths = set(want)
    found = [(s, tuple(np.frombuffer(raw, own.dtype).tolist())) for s, raw in got]
    assert len(set(found)) == len(found) and set(found) <= paths
    assert all(own.decode(raw) == text for _, raw in got)


def test_round_trips_of_whole_texts(own, small):
    for d in small:
        for _, raw in own.n_best(d["text"], 4):
            assert own.decode(raw) == (d["text"] or "")


def test_long_parts_are_searched_as_well(own):
    text = "abc" * 5000
    got = own.n_best(text, 3)
    assert len(got) == 3 and got[0][0] >= got[1][0] >= got[2][0] and all(own.decode(r) == text for _, r in got)


def test_awkward_rows(docs, empty):
    got = segment.segment(docs, vocabulary=FILE, n=3)
    assert got.columns == [*docs.columns, "segmentations"]
    rows = got.collect()
    assert all([list(x.ids) for x in r.segmentations] == [[]] for r in rows if not r.text)
    assert [len(r.segmentations) for r in rows if r.text == ""] == [1]
    shown = segment.digests(docs, vocabulary=FILE).collect()
    assert all(r.round_trip for r in shown) and len({(r.id, r.rank) for r in shown if r.id == 6}) == 4
    assert segment.segment(empty, vocabulary=FILE).count() == 0 and segment.encoded_documents(empty, vocabulary=FILE).count() == 0
    assert segment.encoded_documents(docs, vocabulary=FILE, keep=("source",)).count() == docs.count()


def test_parts_met_together_equal_parts_searched_alone(own, small):
    texts = [d["text"] for d in small][:60] + [None, "", "!!!!!!", "日本 é\n\n", "a" * 200, "\U0001f600 x  y", "\ud800"]
    parts = sorted({p for t in texts if t for p in own.parts.findall(" " + t) if len(p) <= 64})
    ids, scores, margins = own.forward(parts)
    for part, raw, score, margin in zip(parts, ids, scores, margins, strict=True):
        two = own.paths(part, 2)
        assert score == two[0][0] and margin == (two[0][0] - two[1][0] if len(two) > 1 else segment._NEVER)
        assert raw is None or tuple(np.frombuffer(raw, own.dtype).tolist()) == two[0][1]
    fresh = segment.Segmenter(FILE)
    assert list(fresh.n_best_of(texts, 4)) == [own.n_best(t, 4) for t in texts]


def test_new_parts_are_not_searched_one_by_one(small, monkeypatch):
    fresh, alone = segment.Segmenter(FILE), []
    learn = fresh._learn
    monkeypatch.setattr(fresh, "_learn", lambda part: alone.append(part) or learn(part))
    list(fresh.n_best_of([d["text"] for d in small], 4))
    assert len(fresh.known) > 1000 and len(alone) < len(fresh.known) // 10
