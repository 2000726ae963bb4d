import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsieve.llm import chat, common, langid, merkle, mixing, neardup, packing, quality, shingles, suffix, vectors, warc

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"xx": "ka to mi re su no".split(), "yy": "schl ung ber ein heit".split(), "zz": "eaux oui tion ment".split()}


def prose(rng, lang, n):
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]))
    return " ".join(out)


def corpus():
    """Small documents with nulls, empty and long texts, copies, near copies, shared passages, repeated characters."""
    rng = random.Random(5)
    docs = [[i, prose(rng, rng.choice(list(SYLLABLES)), rng.randint(5, 160)), None, f"s{i % 4}"] for i in range(60)]
    passage = prose(rng, "xx", 60)
    for i in (7, 20, 33, 48):
        docs[i][1] += "\n" + passage + "\n" + prose(rng, "yy", 30)
    for i, j in ((40, 2), (41, 2), (42, 9)):
        docs[i][1] = docs[j][1]
    for j in (3, 11):
        docs[j][1] += " " + prose(rng, "zz", 90)
    for i, j in ((50, 3), (51, 3), (52, 11)):
        words = docs[j][1].split()
        words[len(words) - 1 - i % 2] = "changed"
        docs[i][1] = " ".join(words)
    docs[55][1], docs[56][1], docs[57][1], docs[58][1] = None, "", "a" * 400, "a" * 200 + "é" * 100
    docs[59][1], docs[59][3] = "...", None
    return [(i, t, next((k for k, s in SYLLABLES.items() if t and t.split() and s[0] in t), "xx") if i % 5 else None, s, len(t or "")) for i, t, _, s in docs]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


# components


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (5, 5), (None, 1)]
    got = {r["id"]: r["root"] for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in (100, 101, 102)}}


# mixing


def test_targets_are_capped_and_reshared():
    got = mixing.targets({"a": 10, "b": 1000, "c": 1000})
    assert got["a"] <= 30 and sum(got.values()) == pytest.approx(2010)
    assert mixing.targets({"x": 1, "y": 1, None: 400}) == {"x": 3, "y": 3, None: 396}
    assert mixing.targets({"x": 0}) == {"x": 0} and mixing.targets({}) == {}


def test_flow_prefers_first_copies():
    given = mixing.route([(("a",), 10), (("a", "b"), 10), (("b",), 10)], {"a": 15.0, "b": 15.0})
    assert [sum(g.values()) for g in given] == [10, 10, 10]
    given = mixing.route([(("a",), 10)], {"a": 25.0})
    assert given == [{"a": 25}]
    assert mixing.route([(("a",), 10)], {"a": 99.0}) == [{"a": 30}]


def test_mix(docs, rows, empty):
    got = mixing.mix(mixing.sized_documents(docs)).collect()
    again = mixing.mix(mixing.sized_documents(docs.repartition(5))).collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in again}
    source = {i: s for i, _, _, s, _ in rows}
    size = {r["doc_id"]: r["size"] for r in got}
    assert size[55] == size[56] == 0 and size[59] == 1
    for s in set(source.values()):
        own = [r for r in got if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(mixing.sized_documents(empty)).count() == 0


def test_mix_of_overlapping_sources(spark):
    t = spark.createDataFrame([(i, 10, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", None]) for i in range(90)], "doc_id long, size long, members array<string>")
    got = mixing.mix(t)
    assert got.count() == 90 and got.agg(F.sum("taken")).first()[0] == pytest.approx(900, abs=20)


def test_flow_is_cheapest():
    """Against unit steps along cheapest paths, found by relaxing all arcs."""
    rng = random.Random(6)
    for _ in range(40):
        names = ["a", "b", "c", None][: rng.randint(1, 4)]
        patterns = [(tuple(rng.sample(names, rng.randint(1, len(names)))), rng.randint(0, 6)) for _ in range(rng.randint(1, 5))]
        quotas = {s: float(rng.randint(0, 12)) for s in names}
        given = mixing.route(patterns, quotas)
        got = [sum(g.values()) for g in given]
        for s in names:
            assert sum(g.get(s, 0) for g in given) <= quotas[s]
        assert all(n <= 3 * size for n, (_, size) in zip(got, patterns, strict=True))
        cost = sum(max(0, min(n, c * size) - (c - 1) * size) * c for n, (_, size) in zip(got, patterns, strict=True) for c in (1, 2, 3))
        assert (sum(got), cost) == brute.unit_flow(patterns, quotas)


def test_mix_matches_brute_force(spark, docs, rows):
    """With control characters, quotes and a null among sources, repeated rows, and columns with clashing names."""
    odd = ["x\x1fy", 'q"\\', "é", None]
    given = [(i, t, odd[i % 4]) for i, t, *_ in rows] + [(3, "a b c", odd[0])] * 3
    t = spark.createDataFrame(given, "doc_id long, text string, source string")
    sized = mixing.sized_documents(t).join(t.select("doc_id").distinct(), "doc_id")
    clash = {c: F.lit(f"clash {c}") for c in ("mark", "range", "pattern", "base", "rest", "last", "before", "more", "row", "doc", "a.b")}
    got = mixing.mix(sized.withColumns(clash))
    assert set(clash) <= set(got.columns)
    found = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got.collect())
    assert found == brute.mixed(given)
    assert got.where(" and ".join(f"`{c}` = 'clash {c}'" for c in clash)).count() == len(given)


def test_mixed_documents_repeat(docs):
    out = mixing.mixed_documents(docs.withColumn("size", F.lit("clash")).withColumn("copies", F.lit(1)))
    assert out.columns == [*docs.columns, "size", "copies"]
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


# language identification


def test_codewords_differ():
    for k in (1, 2, 3, 4, 5, 9, 20):
        code = langid.codewords(k)
        assert len(code) == k and len({tuple(r) for r in code}) == k


def test_language_accuracy_on_held_out(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, 60), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 60)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held", langid.held_out())
    model = langid.train(t.where(~F.col("held")))
    got = langid.predict(t, model).where("held").collect()
    assert len(got) > 30 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(docs, empty):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert len(got) == 60 and {got[i]["lang_pred"] for i in (55, 56, 59)} == {"und"} and got[55]["score"] == 0
    assert langid.train(empty) is None
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0
    long = docs.limit(1).withColumn("text", F.repeat(F.lit("kato mi. "), 60000))
    assert langid.predict(long, model).first()["lang_pred"] in model.languages
    kept = langid.keep_identified(docs.withColumn("lang_pred", F.lit("x")))
    assert kept.columns == [*docs.columns, "lang_pred"] and not {55, 56, 59} & {r["doc_id"] for r in kept.collect()}


# WARC


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a", "x"), (2, None, "x"), (3, "http://c\r\nd", None), (4, "u", "é\r\n\r\nWARC/1.1\r\n"), (5, "u", ""), (None, "u", "x"), (2, None, "x")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, sha string")
    got = sorted(warc.round_trip(df).collect(), key=lambda r: (r["page_id"] or -1, r["record_type"]))
    assert [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got] == [(None, "revisit", 2, 1), (1, "revisit", 2, 1), (2, "response", None, 1), (2, "response", None, 1), (3, "revisit", 5, 0), (4, "response", None, 16), (5, "response", None, 0)]
    assert got[1]["payload_digest"] == base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    assert warc.round_trip(df.where("page_id < 0")).count() == 0
    assert {r["record_type"] for r in warc.round_trip(df, min_bytes=5).collect()} == {"response"}


def record(n, body=b"hello"):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Block-Digest: sha1:{warc.base32_sha1(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_warc_salvage(packed):
    parts = [gzip.compress(record(i), mtime=0) if packed else record(i) for i in range(5)]
    bad = bytearray(parts[2])
    bad[len(bad) // 2] ^= 0xFF
    data = parts[0] + b"junk" + parts[1] + bytes(bad) + parts[3][:-9] + parts[4]
    found = list(warc.salvage(data))
    assert [warc.page_of(x.headers["warc-record-id"]) for x in found if isinstance(x, warc.Record)] == [0, 1, 4]
    gaps = [x for x in found if isinstance(x, tuple)]
    assert sum(x[1] for x in gaps) + sum(len(parts[i]) for i in (0, 1, 4)) == len(data)
    assert gaps[0][:2] == (len(parts[0]), 4) and all(g[2] for g in gaps)
    assert list(warc.salvage(b"")) == []


def test_warc_many_records_in_a_damaged_member():
    member = gzip.compress(b"".join(record(i, bytes(random.Random(i).choices(range(256), k=3000))) for i in range(40)), mtime=0)
    data = member[: len(member) // 2] + gzip.compress(record(99), mtime=0)
    found = [warc.page_of(x.headers["warc-record-id"]) for x in warc.salvage(data) if isinstance(x, warc.Record)]
    assert found[:5] == [0, 1, 2, 3, 4] and found[-1] == 99


def test_warc_every_record_before_damage_comes_back():
    """Two bytes damaged near the end of a member of 80 records: the records before them come back, and the next member."""
    body = lambda i: bytes(random.Random(i).choices(b"abcdefgh \n", k=700))
    member = bytearray(gzip.compress(b"".join(record(i, body(i)) for i in range(80)), mtime=0))
    at = len(member) * 9 // 10
    member[at : at + 2] = bytes(x ^ 0xFF for x in member[at : at + 2])
    data = bytes(member) + gzip.compress(record(99), mtime=0)
    found = [warc.page_of(x.headers["warc-record-id"]) for x in warc.salvage(data) if isinstance(x, warc.Record)]
    assert found[:65] == list(range(65)) and found[-1] == 99
    gap = next(x for x in warc.salvage(data) if isinstance(x, tuple))
    assert gap[0] > at // 2 and gap[0] + gap[1] == len(member)


def test_warc_written_archive_survives_damage(spark, tmp_path):
    """Damage at several places of a written archive costs the records it hits; all others come back, and gaps are exact."""
    rows = [(i, f"http://h/{i}", f"<p>page {i} " + "word " * (i % 50)) for i in range(300)]
    rows.append((300, "http://long", "".join(random.Random(1).choices("abcdefghijklmnop", k=20 << 20))))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = tmp_path / "archive"
    warc.write_archive(df, f"file://{path}", compression="gzip")
    clean = {r["page_id"]: r for r in warc.read_archive(spark, f"file://{path}").drop("payload").collect()}
    assert len(clean) == 301 and clean[300]["payload_bytes"] == 20 << 20
    hit = set()
    for file in path.glob("part-*"):
        data = bytearray(file.read_bytes())
        assert gzip.decompress(bytes(data)).count(b"WARC-Record-ID") == sum(r["file"].endswith(file.name) for r in clean.values())
        for at in (len(data) // 7, len(data) // 3, len(data) // 2):
            data[at] ^= 0x55
            hit |= {i for i, r in clean.items() if r["file"].endswith(file.name) and r["offset"] <= at < r["offset"] + r["length"]}
        file.write_bytes(bytes(data))
        (path / f".{file.name}.crc").unlink(missing_ok=True)
    back = warc.read_archive(spark, f"file://{path}").drop("payload").collect()
    assert {r["page_id"] for r in back if r["status"] == "record"} == set(clean) - hit and hit
    gaps = {(r["file"], r["offset"], r["length"]) for r in back if r["status"] == "gap"}
    covered = sum(n for *_, n in gaps)
    assert covered == sum(clean[i]["length"] for i in hit)


# chat


def test_fold_of_events(spark):
    log = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "he"), (1, 4, 1, "delta", None, "llo"), (1, 5, 2, "message", "user", "more"), (1, 6, 3, "delta", "assistant", "old"), (1, 7, 1, "regenerate", None, None), (1, 8, 1, "delta", "assistant", "bye"), (1, 9, 0, "edit", None, "hey"), (1, 10, 0, "delta", None, "!"), (2, 1, 0, "nonsense", "user", "x")]
    got = chat.fold(spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")).orderBy("turn").collect()
    assert [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in got] == [(1, 0, "user", "hey!"), (1, 1, "assistant", "bye")]


def test_chat_reads_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "<\\|im_end|>", "<<SYS>>\\<</SYS>>", "", None, "é<" * 3, "[\\\\INST]", "\\n"]
    rows = [(c, t, ["user", "assistant", "to\\ol\n<s>", None][t % 4], texts[((c or 0) + t) % len(texts)], "clash") for c in (1, 2, None) for t in range(12)] + [(1, 3, "assistant", "again", ""), (9, None, "assistant", "no turn", "")]
    back = chat.parse(chat.render(chat.fold(chat.log_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string"))))).collect()
    for r in back:
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss_text"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]
    assert len(back) == 4


def test_chat_roles_and_edges(spark, empty):
    """Roles of any characters; texts that begin with a byte order mark, astral ones; many turns; clashing columns; no rows."""
    roles = ["ro\x00le", "a\\n", "a\n", "a\\", "\\e\\n\n\\", "<|im_end|>", "<\\|im_end|>\n", "assistant", ""]
    texts = ["\ufeffmark", "\U0001f600 wide", "\ufeff", "plain"]
    rows = [(1, t, roles[t % 9], texts[t % 4]) for t in range(72)] + [(2, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(6000)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    folded = chat.fold(chat.log_of_turns(t)).withColumns({c: F.lit("clash") for c in ("head", "body", "whole", "start", "m")})
    back = {r["conv_id"]: r for r in chat.parse(chat.render(folded)).collect()}
    for c in (1, 2):
        own = [x for x in rows if x[0] == c]
        assert [(x["role"], x["text"]) for x in back[c]["turns"]] == [(x[2], x[3]) for x in own]
        assert back[c]["loss_text"] == "".join(x[3] for x in own if x[2] == "assistant")
    assert chat.parse(chat.render(chat.fold(chat.log_of_turns(t.where("conv_id < 0"))))).count() == 0


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.parse(chat.render(chat.fold(chat.log_of_turns(df))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# near duplicates


def test_near_classes_match_brute_force(docs, rows):
    got = {r["id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    want = dict(zip([r[0] for r in rows], brute.near_classes([(r[0], r[1]) for r in rows]), strict=True))
    assert got == want and want[50] == want[51] == 3 and want[40] == 2


def test_large_groups(spark):
    rng = random.Random(3)
    base = prose(rng, "xx", 300).split()
    out = []
    for i in range(200):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(300)] = f"w{i}"
        out.append((i, " ".join(words)))
    out += [(200 + i, prose(rng, "yy", 100)) for i in range(60)]
    got = {r["id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert got == dict(zip(range(260), brute.near_classes(out), strict=True))


def test_chains_in_one_large_bucket(spark, monkeypatch):
    """Windows of a long text: neighbours are similar, others are not, and all documents share one band only."""
    rng, out = random.Random(4), []
    ids = rng.sample(range(1400), 1400)
    for chain in range(40):
        words = [f"{w}{chain}" for w in prose(rng, "xx", 40 + 3 * 25).split()]
        out += [(ids.pop(), " ".join(words[3 * i : 3 * i + 40])) for i in range(25)]
    out += [(i, prose(rng, "yy", 40)) for i in ids]
    monkeypatch.setattr(neardup, "signed", lambda docs, idf: docs.select("id", "digest", F.octet_length("text").cast("long").alias("size"), F.array(F.lit(1).cast("long")).alias("keys")))
    got = {r["id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    want = dict(zip([i for i, _ in out], brute.near_classes(out), strict=True))
    assert got == want and len(set(want.values())) < 450


def test_near_edges(spark, docs, empty):
    t = docs.select("doc_id", "text").limit(3).union(spark.createDataFrame([(None, "x y"), (None, None), (5, "x y"), (5, "x y")], "doc_id long, text string"))
    got = neardup.classes(t).collect()
    assert len(got) == 7 and all(r["kept"] and r["class_id"] is None for r in got if r["id"] is None)
    assert neardup.classes(empty).count() == 0
    clash = {c: F.lit("clash") for c in ("_id", "id", "digest", "mark", "key", "kept")}
    kept = neardup.keep_one(docs.withColumns(clash))
    assert kept.columns == [*docs.columns, *clash] and not {40, 41, 42, 50, 51} & {r["doc_id"] for r in kept.collect()}


def test_near_repeated_ids_and_long_texts(spark):
    """Each text of a repeated id has its own class; a very long text and its near copy, ties and repeated rows."""
    rng = random.Random(8)
    words = prose(rng, "xx", 200_000).split()
    long, other = " ".join(words), " ".join([*words[:-1], "changed"])
    rows = [(7, long), (9, other), (9, "one text of nine"), (3, "one text of nine"), (12, long), (12, long), (14, "alone")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"], r["class_id"], r["kept"]) for r in neardup.classes(t).collect())
    assert got == [(3, 3, True), (7, 7, True), (9, 3, False), (9, 7, False), (12, 7, False), (12, 7, False), (14, 14, True)]
    assert sorted(r["doc_id"] for r in neardup.keep_one(t).collect()) == [3, 7, 14]
    twice = neardup.keep_one(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "a b")], "doc_id long, text string"))
    assert sorted((r["doc_id"] or 0) for r in twice.collect()) == [0, 1]


def test_consistent_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**48, 300, dtype=np.uint64)
    h.sort()
    w = rng.uniform(0.5, 3, 300).astype(np.float32)
    v = w * rng.uniform(0.4, 1.6, 300).astype(np.float32)
    owner, want = np.repeat([0, 1], 300), np.minimum(w, v).sum() / np.maximum(w, v).sum()
    agree = []
    for shift in range(40):
        s = neardup.samples(owner, np.sort(np.tile(shingles.mixed(h + np.uint64(shift)) >> np.uint64(16), 1))[np.argsort(np.argsort(h))][np.tile(np.arange(300), 2)], np.concatenate([w, v]))
        agree.append((s[0] == s[1]).mean())
    assert np.mean(agree) == pytest.approx(want, abs=0.04)


# fingerprints


def test_fingerprints(spark, docs, rows):
    got = {r["id"]: r for r in merkle.edited_and_next(docs).withColumn("fp", merkle.fingerprint(F.col("text"))).collect()}
    ids = sorted((r[0] for r in rows), reverse=True)
    text = {r[0]: r[1] or "" for r in rows}
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        assert got[i]["head"] == text[nxt][: len(text[i]) // 2]
        assert got[i]["next_fp"] == got[nxt]["fp"]
    assert got[2]["fp"] == got[40]["fp"] and len({r["fp"] for r in got.values()}) == len(set(text.values()))


def test_fingerprint_edges(spark, empty):
    t = spark.createDataFrame([(None, "z"), (1, "ab"), (1, "cd"), (3, None)], "doc_id long, text string")
    got = sorted((r["id"] or -1, r["text"], r["head"]) for r in merkle.edited_and_next(t).collect())
    assert [g[0] for g in got] == [-1, 1, 1, 3] and {g[2] for g in got if g[0] == 1} == {"z"}
    assert merkle.edited_and_next(empty).count() == 0
    alone = merkle.edited_and_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert alone["head"] == "ab"


def test_edits_are_located(spark):
    a, b = "One. Two.\nThree. Four.\n\nFive. Six.", "One. Two.\nThree. Changed.\n\nFive. Six."
    r = spark.range(1).select(merkle.differing_branches(merkle.fingerprint(F.lit(a)), merkle.fingerprint(F.lit(b))).alias("d"), merkle.likeness(merkle.fingerprint(F.lit(a)), merkle.fingerprint(F.lit(b))).alias("l"), merkle.likeness(merkle.fingerprint(F.lit("")), merkle.fingerprint(F.lit(""))).alias("e")).first()
    assert len(r["d"]) == 1 and 0 < r["l"] < 1 and r["e"] == 1


# repeated strings


def check_repeats(spark, given):
    df = spark.createDataFrame([(n, *x) for n, x in enumerate(given)], "n long, doc_id long, text string").repartition(4)
    gone = brute.repeated_bytes(given)
    got = {r["row"]: r for r in suffix.deduplicate(df, block_bytes=900, carry="n").collect()}
    assert len(got) == len(given)
    for n, mask in gone.items():
        data = (given[n][1] or "").encode()
        kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
        spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
        assert (got[n]["n_bytes"], got[n]["n_removed"], got[n]["n_spans"], got[n]["kept_sha256"], bytes(got[n]["kept"])) == (len(data), int(mask.sum()), spans, brute.sha(kept), kept), n


def test_repeats_match_brute_force(spark, rows):
    check_repeats(spark, [(r[0], r[1]) for r in rows] + [(None, rows[2][1]), (None, "new " * 30), (4, rows[4][1]), (70, ("kato" * 30 + "x") * 3)])


def test_repeats_of_few_letters(spark):
    rng = random.Random(8)
    check_repeats(spark, [(i, "".join(rng.choice("ab") * rng.randint(1, 30) for _ in range(20))) for i in range(12)])


def test_repeats_of_hot_phrases(spark, rows, monkeypatch):
    """A phrase of more than a gram in all documents, in many contexts; names that several blocks have are told apart."""
    monkeypatch.setattr(suffix, "HOT", 1)
    rng = random.Random(18)
    phrase, tails = "the same phrase in all documents", [prose(rng, "yy", 9) for _ in range(12)]
    made = [(i, " ".join(prose(rng, "xx", rng.randint(0, 6)) + phrase + rng.choice(tails) for _ in range(4))) for i in range(60)]
    for given in (made, [(r[0], r[1]) for r in rows], [(i, ("ab" * rng.randint(10, 60) + "c") * 3) for i in range(20)]):
        df = spark.createDataFrame(given, "doc_id long, text string")
        got = {r["doc_id"]: r["n_removed"] for r in suffix.deduplicate(df, block_bytes=3000).collect()}
        want = brute.repeated_bytes(given)
        assert got == {i: int(want[k].sum()) for k, (i, _) in enumerate(given)} and sum(got.values()) > 500


def test_repeats_edges(docs, empty):
    assert suffix.deduplicate(empty).count() == 0
    cut = suffix.cut_documents(docs.withColumn("row", F.lit(1)).withColumn("block", F.lit(2)))
    assert cut.columns == [*docs.columns, "row", "block"]
    got = {r["doc_id"]: r for r in cut.collect()}
    assert got[55]["text"] is None and got[56]["text"] == "" and 40 not in got
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["text"] is not None)


def test_first_occurrences():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 40))) for _ in range(30)]
    ids = np.arange(30)[::-1].copy()
    first = {}
    for t, i in zip(texts, ids, strict=True):
        for at in range(len(t) - 4):
            first[t[at : at + 5]] = min(first.get(t[at : at + 5], 99), i)
    assert suffix.first_occurrences(texts, ids, 5).tolist() == [first[t[at : at + 5]] for t in texts for at in range(len(t) - 4)]


def test_first_occurrences_of_many_bytes():
    """More places than keys leave bits for."""
    rng = random.Random(9)
    piece = [bytes(rng.choices(range(256), k=80)) for _ in range(400)]
    texts = [rng.choice(piece)[:60] + rng.choice(piece)[:20] for _ in range(30_000)]
    ids = np.arange(30_000)[::-1].copy()
    first = {}
    for t, i in zip(texts, ids.tolist(), strict=True):
        for at in range(31):
            first[t[at : at + 50]] = min(first.get(t[at : at + 50], i), i)
    assert sum(map(len, texts)) > 1 << 21
    assert suffix.first_occurrences(texts, ids).tolist() == [first[t[at : at + 50]] for t in texts for at in range(31)]


def test_repeats_in_very_long_texts(spark):
    """Texts longer than a segment; one is a copy of another with some characters changed."""
    rng = random.Random(10)
    long = prose(rng, "xx", 90_000)
    other = list(long)
    for at in (0, 1000, 1040, len(long) // 2, len(long) - 1):
        other[at] = "#"
    rows = [(2, "".join(other)), (1, long), (3, long)]
    assert len(long) > suffix.SEGMENT
    got = {r["doc_id"]: r for r in suffix.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] < len(long) and got[3]["n_removed"] == got[3]["n_bytes"] and got[3]["n_spans"] == 1
    # between 1000 and 1040 no string of 50 bytes is the same; all else is, unless a changed character is in it
    kept = bytes(got[2]["kept"]).decode()
    assert kept.count("#") == 5 and len(kept) < 200


# vectors


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[0] + rng.normal(size=(60, 16)) * 0.2
    x[160:170] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    rows += [(400, None), (401, [0.0] * 16), (402, [float("nan")] * 16), (403, [None] * 16), (404, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("h", F.lit(1))
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    want = brute.vector_links(rows)
    found = sum(min(got[i][0], want[i][0]) for i in want)
    assert found >= 0.99 * sum(v[0] for v in want.values()) and all(got[i][0] <= want[i][0] for i in want)
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


def test_vectors_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(none).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r["id"], r["n_links"], r["kept"]) for r in vectors.near_duplicates(bad).collect()) == [(1, 0, True), (2, 0, True)]
    same = spark.createDataFrame([(3, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(same).collect()) == [(3, 2, 3), (4, 2, 3), (4, 2, 3)]


def test_vectors_of_one_id_and_of_other_widths(spark, monkeypatch):
    """Rows with one id are vectors of their own; widths do not mix; blocks of a list meet."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8 + 8 * (i % 2)).tolist()) for i in range(160)]
    rows += [(1000 + i, (np.array(rows[i % 2][1]) + rng.normal(size=8 + 8 * (i % 2)) * 0.05).tolist()) for i in range(80)]
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {w: brute.vector_links([r for r in rows if len(r[1]) == w]) for w in (8, 16)}
    assert got == want[8] | want[16] and got[1002][0] >= 39


# packing


def test_cut_lengths():
    assert packing.cut_lengths(5, 4) == [1, 4] and packing.cut_lengths(8, 4) == [4, 4] and packing.cut_lengths(4, 4) == [4]


@pytest.mark.parametrize("seed", range(5))
def test_bins_hold_all_pieces(seed):
    rng = np.random.default_rng(seed)
    for low, high in ((1, 60), (25, 40), (30, 70), (1, 100)):
        sizes = rng.integers(low, high, 400)
        histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True))
        found = packing.local_search(histogram, 100)
        held = {}
        for b, k in found.items():
            assert packing._fill(b) <= 100
            for n, c in b:
                held[n] = held.get(n, 0) + c * k
        assert held == histogram
        # bins are emptied from one a piece to no more than best fit leaves
        assert -(-int(sizes.sum()) // 100) <= sum(found.values()) <= brute.best_fit(sizes.tolist(), 100)


def test_packing_is_optimal_on_small_cases():
    rng = random.Random(2)
    extra = 0
    for _ in range(60):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(1, 9))]
        found = sum(packing.local_search(packing.Counter(sizes), 12).values())
        extra += found - brute.fewest_bins(sizes, 12)
        assert found - brute.fewest_bins(sizes, 12) in (0, 1)
    assert extra <= 3


def test_local_search_exchanges():
    """No piece can move; one for one, and two for one, can."""
    kinds = packing.Bins({((9, 1),): 1, ((5, 1), (4, 1)): 1, ((8, 1), (1, 1)): 1}, 10)
    assert packing._move(kinds, ((5, 1), (4, 1))) is None
    assert packing._exchange(packing.Bins({((4, 1), (3, 1)): 1, ((6, 1), (3, 1)): 1}, 10), ((4, 1), (3, 1))) == (((4, 1), (3, 1)), ((6, 1), (3, 1)), (4,), (3,))
    assert packing._exchange(packing.Bins({((2, 2),): 1, ((6, 1), (3, 1)): 1}, 10), ((2, 2),)) == (((2, 2),), ((6, 1), (3, 1)), (2, 2), (3,))


def test_ids_equal_the_library(rows):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    encode = packing.Encoder(path)
    texts = [r[1] or "" for r in rows] + ["It's we'll  \n\n x²½ Ⅷ 12 345\t_a_b <|endoftext|> é ñ", "\x1c a", "日本語 🎉🎉 ok", "   ", " '  's 're"]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_packing(docs, rows, empty):
    given = docs.union(docs.where("doc_id = 3")).withColumn("salt", F.lit("clash"))
    got = packing.pack_documents(given, capacity=64).collect()
    encode = packing.Encoder(packing.default_vocabulary())
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    for i, t, *_ in rows:
        ids = encode(t or "") + b"\0\0\0\0"
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        if i != 3:
            assert [p[0] for p in own] == list(range(len(own)))
            assert all(zlib.crc32(ids[4 * s : 4 * (s + n)]) == crc for _, s, n, crc in own)
    total = sum(r["length"] for r in got)
    assert len(by) <= 1.02 * total / 64 + 1
    assert packing.pack_documents(empty).count() == 0


def test_packing_a_very_long_text(spark, monkeypatch):
    """Many full pieces, each a sequence; lengths dealt into several parts; no id and repeated rows."""
    monkeypatch.setattr(packing, "PART", 3)
    long = " ".join(str(i) for i in range(60_000))
    rows = [(1, long), (2, "ab"), (None, "ab"), (2, "ab"), (None, None)] + [(10 + i, "x y z") for i in range(40)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), capacity=128).collect()
    n = len(packing.Encoder(packing.default_vocabulary())(long)) // 4 + 1
    own = sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 1)
    assert sum(x[2] for x in own) == n and [x[2] for x in own[1:]] == [128] * (n // 128) and len(got) == len(own) + 44
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(by) == -(-sum(r["length"] for r in got) // 128)
    for places in by.values():
        ends = [0, *(o + k for o, k in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 128


# quality


def test_em_finds_accurate_labellers():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.9]
    votes = np.stack([np.where(rng.random(20000) < 0.2, -1, np.where(rng.random(20000) < a, good, ~good)) for a in accuracy], 1)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, chance, post = quality.expectation_maximisation(patterns, counts.astype(float))
    assert share == pytest.approx(0.8, abs=0.03)
    assert chance[0, 1, 1] == pytest.approx(0.95, abs=0.03) and chance[2, 0, 0] == pytest.approx(0.85, abs=0.04)
    assert ((post[where.ravel()] > 0.5) == good).mean() > 0.95


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, "xx", 80).replace(".", ".\n"), "") for i in range(120)]
    rows += [(200 + i, " ".join(w + rng.choice(["***", "$$$", "###"]) for w in prose(rng, "xx", 80).split()), "") for i in range(20)]
    rows += [(300, None, ""), (301, "", ""), (302, "WORD " * 100, ""), (302, "WORD " * 100, "")]
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string, votes string")).collect()
    assert len(got) == 144 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["keep"] for r in got if r["id"] < 120)
    assert not any(r["keep"] for r in got if 200 <= r["id"] < 220)
    assert quality.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0
