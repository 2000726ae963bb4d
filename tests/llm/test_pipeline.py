"""The pipeline's stages in sequence, and fitted operators, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from poolsieve.llm import langid, neardup, packing, quality, shingles

from . import brute
from .test_llm_operators import DOCS, prose

COLUMNS = [c.split()[0] for c in DOCS.split(", ")]


def corpus():
    """Three languages, copies, near copies, shared passages, junk, nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(12)
    rows = []
    for i in range(150):
        lang = ("xx", "yy", "zz")[i % 3]
        rows.append([i, prose(rng, lang, rng.randint(15, 120)), lang if i % 7 else None, f"s{i % 4}" if i % 11 else None, None])
    passage = prose(rng, "xx", 60)
    for i in (9, 30, 60, 90):
        rows[i][1] += "\n" + passage
    for i, j in ((100, 3), (101, 3), (102, 6)):
        rows[i][1] = rows[j][1]
    for i, j in ((110, 12), (111, 12)):
        words = rows[j][1].split() + prose(rng, "xx", 60).split()
        rows[j][1] = " ".join(words)
        rows[i][1] = " ".join([*words[:-1], f"other{i}"])
    rows[120][1] = prose(rng, "yy", 6000)
    rows[130][1], rows[131][1], rows[132][1], rows[133][1] = None, "", "12 34 ...", "é" * 30
    rows.append(list(rows[5]))
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s, _ in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def plain_grams(data):
    """{feature: share} of the hashed n-grams of bytes, one at a time."""
    count = Counter()
    low = (1 << 32) - 1
    for at in range(len(data)):
        h = 0
        for n in langid.GRAMS:
            byte = data[at - n + 1] + 1 if at - n + 1 >= 0 else 0
            h = (h * 0x9E3779B1 + byte * 0x85EBCA6B + n) & low
            count[((h ^ (h >> 15)) * 0x2C1B3C6D & low) >> (32 - langid.DIMENSIONS.bit_length() + 1)] += 1
    total = sum(count.values())
    return {k: v / total for k, v in count.items()}


def plain_prediction(model, text):
    """(language, score, ambiguous) by adding up losses bit by bit."""
    if text is None or not regex.search(r"\p{L}", text):
        return "und", 0.0, False
    shares = plain_grams(text.encode())
    margins = [sum(v * model.weights[k, b] for k, v in shares.items()) + model.bias[b] for b in range(len(model.bias))]
    losses = [sum(math.log1p(math.exp(-4 * m * word[b])) for b, m in enumerate(margins)) / len(margins) for word in model.code]
    order = sorted(range(len(losses)), key=lambda k: (losses[k], k))
    chances = [math.exp(-4 * (x - losses[order[0]])) for x in losses]
    gap = (losses[order[1]] - losses[order[0]]) / (losses[order[0]] + losses[order[1]]) if len(losses) > 1 else 1.0
    return model.languages[order[0]], max(chances) / sum(chances), gap < langid.AMBIGUOUS


def test_language_matches_plain_version(spark, rows, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    # the model is fitted on shares that are worked out one gram at a time, the sample being all labelled rows that are not held out, once each
    fitted = {(r[0], r[1], r[2]) for r in rows if r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 3 != 1}
    dense = np.zeros((len(fitted), langid.DIMENSIONS), np.float32)
    for n, (_, text, _) in enumerate(sorted(fitted)):
        for k, v in plain_grams(text.encode()).items():
            dense[n, k] = v
    own = langid.fit(dense, [lang for _, _, lang in sorted(fitted)])
    got = {r["doc_id"]: r for r in langid.op3_language_id(spark, table).collect()}
    assert model.languages == own.languages == ["xx", "yy", "zz"]
    for i, text, *_ in rows:
        lang, score, _ = plain_prediction(own, text)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-3)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def kept_languages(rows, model):
    out = []
    for r in rows:
        lang, _, unsure = plain_prediction(model, r[1])
        if lang != "und" and not unsure:
            out.append(r)
    return out


def cut_repeats(rows):
    """Rows without the bytes that a document with a smaller id has too."""
    gone = brute.repeated_bytes([(r[0], r[1]) for r in rows])
    out = []
    for k, r in enumerate(rows):
        data = (r[1] or "").encode()
        text = np.frombuffer(data, np.uint8)[~gone[k]].tobytes().decode("utf-8", "ignore")
        if len(data) and gone[k].all():
            continue
        out.append((*r[:1], text, *r[2:4], len(text)))
    return out


def test_pipeline_matches_brute_force(spark, rows, table):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "suffix_dedup", "mix_sources", "pack"]
    docs = spark.read.parquet(f"{table}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    want = kept_languages(rows, model)
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, table)
        found[name] = docs
        if name == "language_id":
            assert docs.columns == COLUMNS
            assert sorted(map(tuple, docs.collect())) == sorted(want, key=lambda r: r[0]) or Counter(map(tuple, docs.collect())) == Counter(want)
        if name == "near_dedup":
            # equal rows are one
            once = list(dict.fromkeys(want))
            kind = brute.near_classes([(r[0], r[1]) for r in once])
            want = [r for r, c in zip(once, kind, strict=True) if r[0] == c]
            assert len(want) < len(once) and Counter(map(tuple, docs.collect())) == Counter(want)
        if name == "suffix_dedup":
            want = cut_repeats(want)
            assert Counter(map(tuple, docs.collect())) == Counter(want)
        if name == "mix_sources":
            taken = brute.mixed([(r[0], r[1], r[3]) for r in want])
            copies = {i: n // z if z else 0 for i, z, _, _, n in taken}
            want = [r for r in want for _ in range(copies[r[0]])]
            assert Counter(map(tuple, docs.collect())) == Counter(want)
        if name == "pack":
            encode = packing.Encoder(packing.default_vocabulary())
            got = docs.collect()
            expected, bins = Counter(), {}
            for r in want:
                ids, at = encode(r[1] or "") + b"\0\0\0\0", 0
                for k, n in enumerate(packing.cut_lengths(len(ids) // 4, 2048)):
                    expected[r[0], k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])] += 1
                    at += n
            assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
            for r in got:
                bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            for places in bins.values():
                ends = [0, *(o + n for o, n in sorted(places))]
                assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
            assert -(-sum(r["length"] for r in got) // 2048) <= len(bins) <= brute.best_fit([r["length"] for r in got], 2048)
        docs = docs.persist()
    assert Counter(map(tuple, corpus_pipeline.run(spark, table).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == expected


def test_pipeline_of_odd_tables(spark, rows, tmp_path):
    """No rows; only nulls; columns with clashing names come through to the last stage but one."""
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([(None, None, None, None, None)] * 3, DOCS).write.parquet(str(tmp_path / "nulls" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "nulls")).count() == 0
    clash = {c: F.lit("clash") for c in ("id", "size", "keys", "row", "block", "pattern", "copies", "length", "score", "kept", "_row", "a.b")}
    docs = spark.createDataFrame(rows[:60], DOCS).withColumns(clash)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [*COLUMNS, *clash]
        assert docs.where(" and ".join(f"`{c}` = 'clash'" for c in clash if c != "copies")).count() == docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0


def test_classes_of_all_pairs_on_skewed_texts(spark):
    """A long shared text with many small edits, many unlike texts that share a passage, exact copies: no link is lost."""
    rng = random.Random(21)
    base = prose(rng, "xx", 120).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(120)] = f"edit{i}"
        rows.append((i, " ".join(words)))
    shared = " ".join(base[:40])
    rows += [(200 + i, shared + " " + prose(rng, "yy", rng.randint(1, 60))) for i in range(150)]
    rows += [(400 + i, rows[3][1]) for i in range(100)]
    got = {r["id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = dict(zip([i for i, _ in rows], brute.near_classes(rows), strict=True))
    # links at the threshold are found with the chance that the docstring tells
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want) and all(want[got[i]] == want[i] for i in want)


LETTER, CAPITAL = regex.compile(r"\p{L}"), regex.compile(r"\p{Lu}")


def plain_votes(text):
    share = lambda a, b: a / b if b else None
    vote = lambda good, bad: 1 if good else 0 if bad else -1
    words, chars = len(re.findall(r"[^\x20\x09-\x0D]+", text)), len(text)
    if not words:
        return (0,) * 6
    letters, capitals = len(LETTER.findall(text)), len(CAPITAL.findall(text))
    ends = len(regex.findall(r"[.!?](?:[ \t\n\x0b\f\r]|$)", text))
    odd = len(regex.findall(r"[^\p{L}\p{N} \t\n\x0b\f\r.,;:!?'\"()-]", text))
    runs = len(regex.findall(r"([^\p{L}\p{N} \t\n\x0b\f\r])\1", text))
    again = len(regex.findall(r"(?<![^ \t\n\x0b\f\r])([^ \t\n\x0b\f\r]{2,}) \1(?: \1)+", text))
    at = lambda x, test: x is not None and test(x)
    return (
        vote(at(share(letters, chars), lambda x: x >= 0.72), at(share(letters, chars), lambda x: x < 0.6)),
        vote(at(share(capitals, letters), lambda x: x <= 0.12), at(share(capitals, letters), lambda x: x > 0.3)),
        vote(at(share(words, ends), lambda x: 2 <= x <= 60), words > 60 and (not ends or words / ends > 120)),
        vote(at(share(odd, words), lambda x: x <= 0.02), at(share(odd, words), lambda x: x > 0.1)),
        vote(at(share(runs, words), lambda x: x <= 0.01), at(share(runs, words), lambda x: x > 0.08)),
        vote(not again, again > 0),
    )


def plain_em(votes, steps=100):
    """Posterior of each document, a document at a time."""
    post = [0.3 if 0 in v else 0.9 if 1 in v else 0.5 for v in votes]
    for _ in range(steps):
        good = (sum(post) + 1) / (len(post) + 2)
        chance = []
        for j in range(len(votes[0])):
            table = [[1.0 + (c == v) + sum((p if c else 1 - p) for p, x in zip(post, votes, strict=True) if x[j] == v) for v in (0, 1)] for c in (0, 1)]
            chance.append([[x / sum(row) for x in row] for row in table])
        new = []
        for v in votes:
            a, b = math.log(1 - good), math.log(good)
            for j, x in enumerate(v):
                if x >= 0:
                    a, b = a + math.log(chance[j][0][x]), b + math.log(chance[j][1][x])
            new.append(1 / (1 + math.exp(max(-500, min(500, a - b)))))
        done = max(abs(x - y) for x, y in zip(new, post, strict=True)) < 1e-9
        post = new
        if done:
            break
    return post


def plain_features(text):
    """{feature: share} of words and of the shapes of four bytes."""
    count = Counter(int(h >> np.uint64(64 - quality.BITS)) for h in shingles.word_hashes(text)[1])
    kinds = [int(k) for k in quality._class[np.frombuffer(text, np.uint8)]]
    for a, b, c, d in zip(kinds, kinds[1:], kinds[2:], kinds[3:], strict=False):
        count[int(shingles.mixed(np.array([a + 40 * b + 1600 * c + 64000 * d + 1], np.uint64))[0] >> np.uint64(64 - quality.BITS))] += 1
    total = sum(count.values())
    return {k: v / total for k, v in count.items()}


def test_quality_matches_plain_version(spark, tmp_path):
    """Posteriors by a document at a time; scores by gradient steps over dense rows."""
    rng = random.Random(31)
    texts = [prose(rng, "xx", rng.randint(20, 80)).capitalize() + "." for _ in range(25)]
    texts += ["".join(rng.choice("#$%&*!!@@ ab") for _ in range(rng.randint(20, 200))) for _ in range(12)] + [("BUY NOW " * 6).strip(), "", None, "spam " * 90]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1]), (None, texts[1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = quality.op2_quality_classifier(spark, str(tmp_path)).collect()
    post = plain_em([plain_votes(t or "") for _, t in rows])
    want = {(i, hashlib.md5((t or "").encode()).hexdigest()): p for (i, t), p in zip(rows, post, strict=True)}
    by_id = {i: p for (i, _), p in want.items()}
    assert len(got) == len(rows)
    for r in got:
        assert r["posterior"] == pytest.approx(by_id[r["doc_id"]], abs=1e-6) and r["keep"] == (r["score"] >= 0.5)
    once = list(dict.fromkeys((i, t or "") for i, t in rows))
    x = np.zeros((len(once), 1 << quality.BITS))
    for n, (_, t) in enumerate(once):
        for k, v in plain_features(t.encode()).items():
            x[n, k] = v
    y = np.array([by_id[i] for i, _ in once])
    scale = 1 / (np.sqrt((x**2).mean(0)) + 1e-3)
    z, good = x * scale, min(0.999, max(0.001, y.mean()))
    weight = y * 0.5 / good + (1 - y) * 0.5 / (1 - good)
    weight /= weight.sum()
    w, b, dw, db = np.zeros(z.shape[1]), 0.0, np.zeros(z.shape[1]), 0.0
    rate = 1 / (0.25 * (z * z).sum(1).max() + 1)
    for _ in range(300):
        error = weight * (1 / (1 + np.exp(-(z @ w + b))) - y)
        dw, db = 0.95 * dw - rate * (z.T @ error + quality.RIDGE * w), 0.95 * db - rate * error.sum()
        w, b = w + dw, b + db
    scores = {i: s for (i, _), s in zip(once, 1 / (1 + np.exp(-(z @ w + b))), strict=True)}
    scores |= {i: by_id[i] for i, t in once if not t.split()}  # nothing to score
    for r in got:
        assert r["score"] == pytest.approx(scores[r["doc_id"]], abs=1e-4)
