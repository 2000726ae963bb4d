"""Sub-word tokens: each word is cut into the longest pieces a vocabulary has, and the inputs of each task are made of their ids.

A vocabulary is a table (token, token_id); pieces that go on in a word begin with ``##``. Only different words are cut: their substrings meet the vocabulary in
an equi-join, so it may have any size, and the longest matches are then walked in one expression over each word. Texts take up their words' ids by a join on the word, whose
sides adaptive execution may split on a word that most texts have. Everything stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.proba import let
from ..functions.text import align_labels, first_subtokens
from .rows import fixed_length

# fixed values: the mark of a piece within a word, and what a text's tokens are: runs of letters and digits, or single other characters
INSIDE = "##"
TOKENS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
#: Longer words are unknown, as is usual for such tokenizers; it bounds a word's substrings.
LONGEST_WORD = 100
# fixed values: names of tasks
TASKS = ("cls", "cnn_cls", "ner", "abs-sum", "nmt", "cv_cls")


@dataclass(frozen=True)
class Special:
    """Ids of an unknown word, and of what begins and ends a text (None: nothing)."""

    unknown: int = 1
    first: int | None = 2
    last: int | None = 3

    @property
    def around(self) -> int:
        return (self.first is not None) + (self.last is not None)


def text_words(text: Column) -> Column:
    """Lower-case words and single other characters of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKENS), 0)


def word_pieces(words: DataFrame, vocab: DataFrame, unknown: int = 1) -> DataFrame:
    """Rows (word, ids), one a different ``word`` that is neither null nor empty: ids of the longest pieces from left to right; ``unknown`` alone if a place has none, or
    the word is longer than LONGEST_WORD. Of tokens that are there twice, the largest id counts."""
    known = vocab.where("token is not null and token_id is not null").groupBy("token").agg(F.max("token_id").cast("int").alias("token_id"))
    most = vocab.agg(F.max(F.length(F.regexp_replace("token", f"^{INSIDE}", "")))).first()[0] or 0
    each = words.select("word").where("word <> ''").distinct()
    n = F.length("word")
    runs = F.when(n <= LONGEST_WORD, F.sequence(F.lit(0), n - 1))
    starts = each.select("word", F.explode(runs).alias("s")) if most else each.select("word", F.lit(0).alias("s")).limit(0)
    spans = starts.select("word", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(1, most)), n - F.col("s")))).alias("l"))
    token = F.concat(F.when(F.col("s") > 0, INSIDE).otherwise(""), F.col("word").substr(F.col("s") + 1, F.col("l")))
    met = spans.withColumn("token", token).join(known, "token")
    # at each place the longest match; places of a word are at most LONGEST_WORD
    best = met.groupBy("word", "s").agg(F.max(F.struct("l", "token_id")).alias("m"))
    places = best.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("s", "m"))).alias("m"))

    def onwards(state: Column, _: Column) -> Column:
        found = F.try_element_at(F.col("m"), state["at"])
        stays = (state["at"] < 0) | (state["at"] >= n)
        gone = F.struct(F.lit(-1).alias("at"), state["ids"].alias("ids"))
        step = F.struct((state["at"] + found["l"]).alias("at"), F.concat(state["ids"], F.array(found["token_id"])).alias("ids"))
        return F.when(stays, state).when(found.isNull(), gone).otherwise(step)

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ids"))
    walked = places.select("word", F.aggregate(F.sequence(F.lit(1), n), begin, onwards).alias("w"))
    walked = walked.select("word", F.when(F.col("w.at") == n, F.col("w.ids")).alias("ids"))
    return each.join(walked, "word", "left").select("word", F.coalesce("ids", F.array(F.lit(unknown))).alias("ids"))


def encoded_words(df: DataFrame, id_col: str, sides: dict[str, Column], vocab: DataFrame, special: Special = Special(), max_length: int | None = 512, carried: tuple[Column, ...] = ()) -> DataFrame:
    """Rows (id, ``carried`` columns of the row, and for each of ``sides``, arrays of words, a struct of ``ids`` and ``word_ids``): the pieces of its words between the first and the last id, cut to ``max_length`` with these; places
    that are no word's have a null word id. Words that are null or empty have no pieces. Ids tell rows apart; a null one is an error. All sides are cut in one go."""
    room = None if max_length is None else max(0, max_length - special.around)
    # a word that is not empty has a piece at least, so that no word after these can be in
    within = lambda w: w if room is None else let(w, lambda v: F.slice(v, 1, room + F.size(F.filter(v, lambda x: x.isNull() | (x == "")))))
    given = [F.struct(F.lit(k).alias("side"), within(w).alias("words")) for k, w in sides.items()]
    rows = df.select(F.col(id_col).alias("_id"), F.explode(F.array(*given)).alias("g"))
    flat = rows.select("_id", "g.side", F.posexplode("g.words").alias("pos", "word")).where("word <> ''")
    placed = flat.join(word_pieces(flat, vocab, special.unknown), "word")
    found = placed.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("side", "pos", "ids"))).alias("f"))
    empty = F.array().cast("array<int>")
    ends = lambda there, value: F.array(F.lit(value).cast("int")) if there is not None else empty

    def one(side: str) -> Column:
        mine = F.coalesce(F.filter("f", lambda x: x["side"] == side), F.array().cast("array<struct<side:string,pos:int,ids:array<int>>>"))
        cut = lambda a: a if room is None else F.slice(a, 1, room)
        ids = cut(F.flatten(F.transform(mine, lambda x: x["ids"])))
        at = cut(F.flatten(F.transform(mine, lambda x: F.array_repeat(x["pos"], F.size(x["ids"])))))
        return F.struct(
            F.concat(ends(special.first, special.first), ids, ends(special.last, special.last)).alias("ids"),
            F.concat(ends(special.first, None), at, ends(special.last, None)).alias("word_ids"),
        ).alias(side)

    rest = df.select(F.col(id_col).alias("_id"), F.struct(F.lit(0).alias("_"), *carried).alias("_rest")).join(found, "_id", "left")
    sure = F.coalesce(F.col("_id"), F.raise_error(F.lit("a row has no id")).cast(df.schema[id_col].dataType)).alias(id_col)
    return rest.select(sure, "_rest.*", *[one(k) for k in sides]).drop("_")


def task_inputs(
    df: DataFrame, task: str, id_col: str, text: str, label: str, vocab: DataFrame | None = None, special: Special = Special(), max_length: int | None = 512,
    subtokens: str = "inside", first_places: bool = False, train: bool = False, size: int | None = None, seed: int = 42
) -> DataFrame:
    """What a model of ``task`` reads: id, ``input_ids``, ``attention_mask``, ``labels``, and ``weight`` where there is one; all other columns go.

    ``cls``, ``cnn_cls``: a text, its label as it is. ``ner``: ``text`` holds an array of words and ``label`` one of numbers, spread over their pieces (``subtokens``,
    see ``align_labels``); with ``first_places`` also ``idx_first``, where words begin. ``abs-sum``, ``nmt``: ``label`` holds a text too, and its ids are the labels. ``cv_cls``: rows as they
    are; in training drawn anew, with repetition, to ``size`` rows (as many as there are). A null text is empty."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task}; known are {TASKS}")
    if task == "cv_cls":
        return fixed_length(df, df.count() if size is None else size, id_col, seed).drop("copy") if train else df
    words = F.col(text) if task == "ner" else text_words(F.col(text))
    sides = {"source": words} | ({"target": text_words(F.col(label))} if task in ("abs-sum", "nmt") else {})
    weight = ["weight"] if "weight" in df.columns else []
    carried = (*[F.col(c) for c in weight], *([] if "target" in sides else [F.col(label).alias("_label")]))
    rows = encoded_words(df, id_col, sides, vocab, special, max_length, carried)
    ids = F.col("source.ids")
    labels = F.col("target.ids") if "target" in sides else align_labels(F.col("_label"), F.col("source.word_ids"), subtokens) if task == "ner" else F.col("_label")
    more = [first_subtokens(F.col("source.word_ids")).alias("idx_first")] if task == "ner" and first_places else []
    return rows.select(id_col, ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), labels.alias("labels"), *more, *weight)
