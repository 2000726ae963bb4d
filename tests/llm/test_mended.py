"""Answers that were wrong once."""

import time

from poolsieve.llm import langid, quality, warc

from .test_llm_operators import record

GOOD = "The quiet garden behind the old school was open to every visitor, and people came to read there. They stayed until evening. "


def test_texts_without_words_are_bad(spark):
    blank = ["", None, "   ", "\t\n", "\x0b\x0c\r"]
    rows = [(i, f"{GOOD * (1 + i % 4)} {i}") for i in range(60)] + [(100 + i, "#### $$$ @@ " * 9) for i in range(20)] + [(200 + i, t) for i, t in enumerate(blank)]
    got = {r["id"]: r for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(not got[200 + i]["keep"] and got[200 + i]["posterior"] < 0.1 for i in range(len(blank)))
    assert len({(got[200 + i]["posterior"], got[200 + i]["score"]) for i in range(len(blank))}) == 1
    assert all(got[i]["keep"] for i in range(60))


def test_prediction_keeps_columns_of_any_name(spark):
    rows = [(i, t, lang, "a", "b", "c") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("12", "fr")] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text string, _text_ string, _letter string")
    got = langid.predict(docs, langid.train(docs))
    assert got.columns == [*docs.columns, "lang_pred", "score", "ambiguous"]
    assert all(tuple(r)[3:6] == ("a", "b", "c") and (r["lang_pred"] == r["lang"] if r["text"] and r["text"] != "12" else r["lang_pred"] == "und") for r in got.collect())


def test_sample_of_languages_is_a_bound(spark):
    docs = spark.createDataFrame([(i, f"wort{i % 7} " * 5, f"l{i % 7 if i < 70 else i}") for i in range(90)], "doc_id long, text string, lang string")
    assert langid.train(docs, sample=7).languages == [f"l{i}" for i in range(7)]


def pages_of(data):
    return [(r["page_id"], r["status"]) for r in warc.read_rows("f", data) if r["status"] != "gap"]


def test_a_record_inside_a_damaged_one_is_not_one_of_the_archive():
    outer = bytearray(record(2, b"before " + record(99) + b" after"))
    outer[outer.index(b"before")] ^= 1
    data = record(1) + bytes(outer) + record(3)
    assert pages_of(data) == [(1, "record"), (3, "record")]
    assert [x[:2] for x in warc.salvage(data) if isinstance(x, tuple)] == [(len(record(1)), len(outer))]
    # its end is gone as well, or its length: what is found inside is doubtful, what follows is not
    cut = bytes(outer[:-8])
    assert pages_of(record(1) + cut + record(3) + record(4)) == [(1, "record"), (99, "doubtful"), (3, "doubtful"), (4, "record")]
    unknown = bytes(outer).replace(b"Content-Length", b"Content Length", 1).replace(b"Content Length:", b"Content Length ", 1)
    assert pages_of(record(1) + unknown + record(3)) == [(1, "record"), (99, "doubtful"), (3, "record")]


def test_salvage_takes_time_in_proportion_to_the_bytes():
    for false in (b"WARC/1.1\r\n", b"WARC/1.1\r\nA: b\r\n" * 5 + b"\r\n"):
        data = record(1) + false * (2_000_000 // len(false)) + b"\r\n\r\n" + record(2)
        begin = time.perf_counter()
        assert pages_of(data) == [(1, "record"), (2, "record")]
        assert time.perf_counter() - begin < 20
