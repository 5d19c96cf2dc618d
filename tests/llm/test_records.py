import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm.records import framed, read_records, unframed, with_start, write_records

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark, docs, corpus, tmp_path):
    own = Tokenizer.from_file(PATH)
    index = write_records(docs, str(tmp_path / "r"), PATH, end_id=1, docs_per_shard=9)
    rows = with_start(read_records(index, str(tmp_path / "r"), PATH)).collect()
    texts = sorted(((r[0], r[1] or "") for r in corpus), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in texts] and len({r.shard for r in rows}) > 3
    start = 0
    for r, (_, t) in zip(got, texts, strict=True):
        ids = own.encode(t, add_special_tokens=False).ids + [1]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)


def test_reads_a_part_in_any_order(docs, tmp_path):
    index = write_records(docs, str(tmp_path / "r"), PATH, docs_per_shard=9)
    part = index.filter("doc_id % 7 = 3").orderBy("length")
    assert sorted(r.doc_id for r in read_records(part, str(tmp_path / "r"), PATH).collect()) == sorted(r.doc_id for r in part.collect())


def test_words_with_marks_and_case(spark, tmp_path):
    texts = ["Don't stop, it's 3.14, O'Neil'S.", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "É.  ÉA, 'll, ...,  x́y KK", "́a b́, ß. İ,"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own, folder = Tokenizer.from_file(PATH), str(tmp_path / "r")
    for r in read_records(write_records(docs, folder, PATH), folder, PATH).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_damage_is_seen():
    record = framed(b"some payload")
    assert unframed(record) == b"some payload"
    for at in (0, 9, 14, len(record) - 1):
        with pytest.raises(ValueError):
            unframed(record[:at] + bytes([record[at] ^ 1]) + record[at + 1:])


def test_empty(none, tmp_path):
    index = write_records(none, str(tmp_path / "r"), PATH)
    assert with_start(read_records(index, str(tmp_path / "r"), PATH)).count() == 0
