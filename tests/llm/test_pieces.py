import numpy as np
import public_tokenizers
import pytest

from barloom.llm.pieces import Lattice, decode_pieces, encode_pieces, times

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return Lattice(MODEL)


def sequential(lattice, text):
    """Plain left-to-right search over the whole text: score and ids."""
    s = "▁" + text.replace(" ", "▁") if text else ""
    best, back = lattice.forward(s, 0, len(s))
    return best[-1], lattice.traced(back, len(s), 0)


def score(lattice, ids):
    by_id = dict(lattice.pieces.values())
    return sum(by_id[i] for i in ids)


TEXTS = ["", " ", "a", "Hello  world\n foo\tbar", "the end. " * 40, "x" * 333, "naïve café — 12,5 €\n\n  two", "antidisestablishmentarianism" * 9,
         "\n\n", "one\ntwo " * 30, "漢字かな交じり文" * 12, "\U0001f600 ok"]


@pytest.mark.parametrize("chunk", [5, 16, 41, 10_000])
def test_same_as_one_long_search(spark, own, chunk):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "doc_id long, text string")
    rows = decode_pieces(encode_pieces(docs, MODEL, chunk=chunk, fanin=3), MODEL).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        want, ids = sequential(own, r.text or "")
        assert r.decoded == (r.text or "")
        if set(own.bytes_.values()).isdisjoint(r.ids):
            assert score(own, r.ids) == want
        else:
            assert [i for i in r.ids if i in own.bytes_.values()] == [i for i in ids if i in own.bytes_.values()]
        if chunk == 10_000:
            assert r.ids == ids


def every_way(lattice, s):
    """Scores of all segmentations of a short string."""
    if not s:
        return [0.0]
    ways = [score_ + rest for n in range(1, len(s) + 1) if s[:n] in lattice.pieces for score_ in [lattice.pieces[s[:n]][1]] for rest in every_way(lattice, s[n:])]
    if s[0] not in lattice.pieces:
        ways += [lattice.unknown + rest for rest in every_way(lattice, s[1:])]
    return ways


def test_best_of_all_segmentations(own):
    for text in ("hello", "the cat", "x\ny", "banana", "12,5"):
        assert sequential(own, text)[0] == max(every_way(own, "▁" + text.replace(" ", "▁")))


def test_products_are_associative():
    a, b, c = np.random.default_rng(1).integers(-50, 0, (3, 6, 6)).astype(float)
    assert (times(times(a, b), c) == times(a, times(b, c))).all()


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, ids string, _raw int, row int")
    assert encode_pieces(none, MODEL).count() == 0
    one = spark.createDataFrame([(1, "a b", "x", 5, 7)] * 2, none.schema)
    got = encode_pieces(one, MODEL, chunk=2).collect()
    assert [(r._raw, r.row, len(r.ids)) for r in got] == [(5, 7, 2)] * 2


def test_long_runs_without_spaces(own):
    for text in ("7" * 5000, "0123456789" * 500, "漢字仮名交文章" * 715, "7x" * 2500, "x" * 5000):
        fresh_ = Lattice(MODEL)
        s = "▁" + text
        best, back = own.forward(s, 0, len(s))
        assert np.frombuffer(fresh_.encode(s), "<i4").tolist() == own.traced(back, len(s), 0)
        assert all(len(w) <= 256 for w in fresh_.ids)
