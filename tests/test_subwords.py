"""Sub-word tokens against a plain walk over each word."""

import random

import pytest

from poolsieve.operators import subwords

VOCAB = [("[PAD]", 0), ("[UNK]", 1), ("a", 5), ("ab", 6), ("##b", 7), ("##ba", 8), ("##a", 9), ("é", 10), (".", 11), ("c", 12), ("##c", 13), ("##c", 4)]


def plain(word):
    known, at, out = dict(VOCAB[:-1]), 0, []
    if len(word) > 100:
        return [1]
    while at < len(word):
        for end in range(len(word), at, -1):
            if (token := ("##" if at else "") + word[at:end]) in known:
                out.append(known[token])
                at = end
                break
        else:
            return [1]
    return out


@pytest.fixture
def vocab(spark):
    return spark.createDataFrame(VOCAB, "token string, token_id int")


def test_longest_pieces(spark, vocab):
    rng = random.Random(3)
    words = {"".join(rng.choices("abcdé", weights=[5, 5, 2, 1, 1], k=rng.randint(1, 9))) for _ in range(200)} | {"a" * 100, "a" * 101}
    df = spark.createDataFrame([(w,) for w in [*words, "", None, "ab", "ab"]], "word string")
    got = {r["word"]: r["ids"] for r in subwords.word_pieces(df, vocab).collect()}
    assert got == {w: plain(w) for w in words | {"ab"}} and [1] in got.values()
    assert {tuple(r["ids"]) for r in subwords.word_pieces(df, vocab.limit(0)).collect()} == {(1,)}
    assert subwords.word_pieces(df.limit(0), vocab).count() == 0


def test_texts_of_a_task(spark, vocab):
    rows = [(1, "AB a.", "x", 2.0, "gone"), (2, None, None, 1.0, "gone"), (3, "", "y", 1.0, "gone"), (4, "abab " * 9, "z", 1.0, "gone")]
    df = spark.createDataFrame(rows, "id long, text string, class string, weight double, side string")
    got = {r["id"]: r for r in subwords.task_inputs(df, "cls", "id", "text", "class", vocab, max_length=6).collect()}
    assert got[1].asDict() == {"id": 1, "input_ids": [2, 6, 5, 11, 3], "attention_mask": [1] * 5, "labels": "x", "weight": 2.0}
    assert got[2]["input_ids"] == got[3]["input_ids"] == [2, 3] and got[2]["labels"] is None
    assert got[4]["input_ids"] == [2, 6, 9, 7, 6, 3]
    two = subwords.task_inputs(df, "abs-sum", "id", "text", "class", vocab, max_length=None).orderBy("id").collect()
    assert [r["labels"] for r in two] == [[2, 1, 3], [2, 3], [2, 1, 3], [2, 1, 3]] and len(two[3]["input_ids"]) == 29
    bare = subwords.task_inputs(df, "cls", "id", "text", "class", vocab, subwords.Special(1, None, None), 3).orderBy("id").collect()
    assert [r["input_ids"] for r in bare] == [[6, 5, 11], [], [], [6, 9, 7]]


def test_tags_follow_their_words(spark, vocab):
    df = spark.createDataFrame([(1, ["abab", "", "a", None, "d"], [1, 9, 2, 9, 0]), (2, [], [])], "id long, words array<string>, tags array<int>")
    got = subwords.task_inputs(df, "ner", "id", "words", "tags", vocab, first_places=True).orderBy("id").collect()
    assert got[0]["input_ids"] == [2, 6, 9, 7, 5, 1, 3] and got[0]["labels"] == [-100, 1, 2, 2, 2, 0, -100] and got[0]["idx_first"] == [1, 4, 5]
    assert got[1]["input_ids"] == [2, 3] and got[1]["labels"] == [-100, -100] and got[1]["idx_first"] == []


def test_images_and_unknown_tasks(spark, vocab):
    df = spark.createDataFrame([(i, "p") for i in range(5)], "id long, pixels string")
    assert subwords.task_inputs(df, "cv_cls", "id", "pixels", "label", train=True, size=12).count() == 12
    assert subwords.task_inputs(df, "cv_cls", "id", "pixels", "label").columns == df.columns
    with pytest.raises(ValueError, match="unknown task"):
        subwords.task_inputs(df, "qa", "id", "pixels", "label", vocab)
    with pytest.raises(Exception, match="no id"):
        subwords.task_inputs(spark.createDataFrame([(None, "a", 1)], "id long, text string, label int"), "cls", "id", "text", "label", vocab).collect()
