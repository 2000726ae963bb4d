"""Near-duplicate documents by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

Each document's weighted shingles give HASHES samples; two documents agree in a sample with a probability
of their weighted Jaccard similarity. BANDS bands of ROWS samples are keys; documents that share one are
candidates, and are compared by their exact weighted Jaccard similarity. At a similarity of 0.8 a pair is a candidate
with probability 1 - (1 - 0.8^3)^10 = 0.9992, at 0.85 with 0.9999.

Equal texts are settled first, by their SHA-256; only one of them goes on. All documents of a key are compared in one pass over all bands: a key
with many documents, or many bytes of text, is dealt into parts, each with the same few leads of the key as well. Documents that
a part connects with the leads' main component are connected with each other, whatever their part. Each of the
rest is then compared with all documents of the key, in pairs of blocks. So every pair of a key is connected by links or compared;
a pair that is connected already is not tested. A large group of copies is done once its documents hang
together; a key of many unlike documents takes work by the number of these times the number of its documents, dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

SIMILARITY = 0.8
BANDS, ROWS = 10, 3
HASHES = BANDS * ROWS
#: Documents, and bytes of text, that a part of a key has about; and leads that come into each of its parts.
PART, PART_BYTES, LEADS = 56, 4 << 20, 8
#: Documents, and bytes, of a side in a pair of blocks.
BLOCK, BLOCK_BYTES = 128, 8 << 20


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles (i + 1/2) / n of the gamma distribution with shape 2: 1 - (1 + x) exp(-x)."""
    x = np.concatenate([np.geomspace(1e-7, 1e-2, 20_000), np.linspace(1e-2, 40, 400_000)[1:]])
    return np.interp((np.arange(n) + 0.5) / n, -np.expm1(-x) - x * np.exp(-x), x)


_R = _gamma_quantiles(1 << 16).astype(np.float32)
_LN_C = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)
_KEYS = np.random.default_rng(7).integers(1, 2**63, HASHES, dtype=np.uint64)


def samples(owner: np.ndarray, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """HASHES samples (columns) of each document (rows) from its shingles, which lie together.

    For a shingle of weight S: t = floor(ln S / r + b), ln a = ln c - r (t - b) - r, with r, c gamma(2)
    and b uniform, all from a hash of shingle and sample number; the shingle of the smallest a, with its t,
    is the sample. Ties go to the smaller hash.
    """
    head = np.flatnonzero(np.diff(owner, prepend=-1))
    size = np.diff(head, append=len(owner))
    out = np.empty((len(head), HASHES), np.uint64)
    step = 1 << 16  # bounds what is in work at once
    log_s = np.log(weight)
    for j in range(HASHES):
        a, t = np.empty(len(h), np.float32), np.empty(len(h), np.float32)
        for i in range(0, len(h), step):
            x = h[i : i + step] * np.uint64(0x9E3779B97F4A7C15) ^ _KEYS[j]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            low = x.astype(np.uint32)
            r = _R[low & np.uint32(0xFFFF)]
            b = (x >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
            t_ = np.floor(log_s[i : i + step] / r + b)
            t[i : i + step] = t_
            a[i : i + step] = _LN_C[low >> np.uint32(16)] - r * (t_ - b + np.float32(1))
        least = np.minimum.reduceat(a, head)
        hit = np.flatnonzero(a == np.repeat(least, size))
        first = np.searchsorted(hit, head)
        out[:, j] = shingles.mixed(h[hit[first]] ^ (t[hit[first]].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
    return out


def band_keys(sampled: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sampled), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sampled), band + 1, np.uint64)
        for j in range(band * ROWS, (band + 1) * ROWS):
            key = shingles.mixed(key * np.uint64(0x9E3779B97F4A7C15) + sampled[:, j])
        keys[:, band] = key
    return keys.view(np.int64)


def similar(texts: list[bytes], idf: np.ndarray, threshold: float = SIMILARITY, root: np.ndarray | None = None, apart: int = 0) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the pairs of texts with a weighted Jaccard similarity of ``threshold`` or more, and each text's root then.
    Texts without words have none. Texts of the same ``root`` are connected already; with ``apart``, only pairs of one of
    the first ``apart`` texts and one of the others are compared."""
    owner, h, w = (np.concatenate(x) for x in zip(*[(o + a, *rest) for a, b in shingles.groups(texts) for o, *rest in [shingles.weighted(texts[a:b], idf)]], strict=True))
    total = np.bincount(owner, w.astype(np.float64), len(texts))
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    by = np.argsort(h, kind="stable")
    sorted_h, sorted_w, sorted_owner = h[by], w[by].astype(np.float64), owner[by]
    root = np.arange(len(texts)) if root is None else root.copy()
    forest: list[tuple[int, int]] = []
    for i in range(apart or len(texts)):
        start = apart or i + 1
        later = np.flatnonzero(root[start:] != root[i]) + start
        if not len(later) or not total[i]:
            continue
        mine, weight = h[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]].astype(np.float64)
        # where each of its shingles is among all: those in sorted_h[lo:hi]
        lo, hi = np.searchsorted(sorted_h, mine), np.searchsorted(sorted_h, mine, side="right")
        each = hi - lo
        at = np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(each.sum())
        shared = np.bincount(sorted_owner[at], np.minimum(np.repeat(weight, each), sorted_w[at]), len(texts))
        enough = (total > 0) & (shared >= threshold * (total[i] + total - shared) - 1e-9)
        for j in later[enough[later]].tolist():
            if root[j] != root[i]:
                forest.append((i, j))
                root[root == root[j]] = root[i]
    return forest, root


def signed(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """Rows (id, digest, size, keys) of rows (id, digest, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
            keys: list[list[int]] = [[] for _ in texts]
            for a, b in shingles.groups(texts):
                owner, h, w = shingles.weighted(texts[a:b], shared.value)
                if len(owner):
                    made = band_keys(samples(owner, h, w)).tolist()
                    for i, k in zip(owner[np.flatnonzero(np.diff(owner, prepend=-1))].tolist(), made, strict=True):
                        keys[a + i] = k
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), sizes, pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "size", "keys"])
            common.trim()

    return docs.mapInArrow(sign, "id long, digest binary, size long, keys array<long>")


#: What a comparison tells: a link of two documents, or a document that its key still has to compare with all others.
FOUND = "kind int, key long, id long, mark long, id2 long, mark2 long"
FOUND_ARROW = pa.schema([("kind", pa.int32()), *((c, pa.int64()) for c in ("key", "id", "mark", "id2", "mark2"))])
LINK, REST = 0, 1


def _found(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND_ARROW, strict=True)], schema=FOUND_ARROW)


def _ordered(rows: pa.Table, first: str) -> tuple[list[int], list[int], list[int], list[bytes]]:
    """(first, id, mark, text) of the documents of a group, those with ``first`` first, each once."""
    flags, ids, marks = (rows.column(c).to_pylist() for c in (first, "id", "mark"))
    order = sorted(range(len(ids)), key=lambda i: (not flags[i], ids[i], marks[i]))
    order = [i for n, i in enumerate(order) if not n or (ids[i], marks[i]) != (ids[order[n - 1]], marks[order[n - 1]])]
    column = rows.column("text").combine_chunks()
    return *([x[i] for i in order] for x in (flags, ids, marks)), [column[i].as_buffer().to_pybytes() for i in order]


def _with_texts(member: DataFrame, base: DataFrame) -> DataFrame:
    """``member`` (id, mark, any others) with their texts. Shuffled at any size: a document may be in many parts."""
    return member.hint("merge").join(base, ["id", "mark"])


def _compared(member: DataFrame, base: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """Rows FOUND of the parts (key, part) of all keys."""
    shared = member.sparkSession.sparkContext.broadcast(idf)

    def run(key, rows):  # noqa: ANN001, ANN202
        common.trim()
        leads, ids, marks, texts = _ordered(rows, "lead")
        dealt = rows.column("dealt")[0].as_py()
        n, root = sum(leads) if dealt else 0, None
        if n:
            # links between leads alone are the same in every part
            among, own = similar(texts[:n], shared.value, threshold)
            root = np.concatenate([own, np.arange(n, len(texts))])
            roots, count = np.unique(own, return_counts=True)
            main = int(roots[count.argmax()])
        found, root = similar(texts, shared.value, threshold, root)
        out = [(LINK, None, ids[i], marks[i], ids[j], marks[j]) for i, j in [*found, *(among if n else [])]]
        if n:
            own_part = key[1].as_py() == 0
            out += [(REST, key[0].as_py(), ids[i], marks[i], None, None) for i in range(0 if own_part else n, len(ids)) if root[i] != root[main]]
        return _found(out)

    given = _with_texts(member, base).select("key", "part", "id", "mark", "lead", "dealt", "text")
    return given.groupBy("key", "part").applyInArrow(run, FOUND)


def _blocks(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(size / F.lit(BLOCK_BYTES))).cast("int")


def _across(member: DataFrame, rest: DataFrame, base: DataFrame, idf: np.ndarray, threshold: float, n_docs: int) -> DataFrame:
    """Rows FOUND (links) of each document in ``rest`` (key, id, mark) with all of its key, in pairs of blocks: side 0 from
    block i of the rest, side 1 from block j of the rest (kind 0, j >= i) or of the others (kind 1), which are connected."""
    shared = member.sparkSession.sparkContext.broadcast(idf)
    rest = rest.withColumn("open", F.lit(True))
    keys = rest.select("key").distinct()
    own = member.join(keys, "key", "left_semi").join(rest, ["key", "id", "mark"], "left")
    own = common.stored(own.select("key", "id", "mark", "size", F.col("open").isNotNull().alias("open")), "open", n_docs)
    how = lambda c: _blocks(F.count(F.when(c, 1)), F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)))
    blocks = common.stored(own.groupBy("key").agg(F.greatest(how(F.col("open")), F.lit(1)).alias("ni"), how(~F.col("open")).alias("nj")), "blocks", n_docs)
    mine = F.pmod(F.xxhash64("id", "mark", F.lit(9)), F.when(F.col("open"), F.col("ni")).otherwise(F.greatest("nj", F.lit(1)))).cast("int")
    own = own.join(blocks, "key").withColumn("mine", mine)
    at = lambda i, kind, j, side: F.struct(i.cast("int").alias("i"), F.lit(kind).alias("kind"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    mine = F.col("mine")
    meets = F.concat(
        F.transform(F.when(F.col("nj") > 0, upto(F.col("nj"))).otherwise(F.array().cast("array<int>")), lambda j: at(mine, 1, j, 0)),
        F.transform(F.sequence(mine, F.col("ni") - 1), lambda j: at(mine, 0, j, 0)),
        F.transform(F.filter(upto(F.col("ni")), lambda i: i < mine), lambda i: at(i, 0, mine, 1)),
    )
    where = F.when(F.col("open"), meets).otherwise(F.transform(upto(F.col("ni")), lambda i: at(i, 1, mine, 1)))

    def run(key, rows):  # noqa: ANN001, ANN202
        common.trim()
        zero, ids, marks, texts = _ordered(rows, "first")
        apart = sum(zero)
        if not apart or (apart == len(ids) and not (key[2].as_py() == 0 and key[1] == key[3])):
            return _found([])
        root = np.arange(len(ids))
        if key[2].as_py() == 1:
            root[apart:] = len(ids)
        links, _ = similar(texts, shared.value, threshold, root, apart % len(ids))
        return _found([(LINK, None, ids[i], marks[i], ids[j], marks[j]) for i, j in links])

    given = _with_texts(own.select("key", F.explode(where).alias("w"), "id", "mark").select("key", "w.*", "id", "mark"), base)
    given = given.select("key", "i", "kind", "j", (F.col("side") == 0).alias("first"), "id", "mark", "text")
    return given.groupBy("key", "i", "kind", "j").applyInArrow(run, FOUND)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """Rows (id, class_id, kept, digest), one a row of ``docs``: the smallest id of the documents connected with it by
    links of ``threshold`` or more, or by equal texts; ``digest`` tells equal texts. Null text is empty; empty texts are equal to each other. A
    row without an id has a null class and is kept; of rows with the same id, each has its own text's class. Other columns, whatever
    their names, are not read. An empty table gives none."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # mark tells texts with one id apart
    base = base.withColumn("digest", F.unhex(F.sha2(F.encode("text", "utf-8"), 256))).withColumn("mark", F.xxhash64("digest"))
    common.modest_batches(docs.sparkSession)
    idf, n_docs = shingles.inverse_frequencies(base, "text")
    rows = signed(base.select("id", "digest", "text"), idf).where("id is not null")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys"))
    firsts = common.stored(firsts.withColumn("mark", F.xxhash64("digest")), "firsts", n_docs)
    bucket = firsts.select("id", "mark", "size", F.explode("keys").alias("key"))
    print_ = F.xxhash64("id", "mark")
    sets = bucket.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.bit_xor(print_).alias("x"), F.sum(F.pmod(print_, F.lit(1 << 40))).alias("y"), F.min(F.struct("id", "mark")).alias("head"))
    # keys with the same documents are one
    sets = sets.where("n > 1").groupBy("n", "s", "x", "y", "head").agg(F.min("key").alias("key"))
    parts = F.when((F.col("n") > PART + LEADS) | (F.col("s") > PART_BYTES), F.least("n", F.greatest(F.ceil(F.col("n") / PART), F.ceil(F.col("s") / PART_BYTES)))).otherwise(1)
    member = bucket.join(sets.select("key", "n", "head", parts.cast("int").alias("parts")), "key")
    lead = ((F.col("id") == F.col("head.id")) & (F.col("mark") == F.col("head.mark"))) | (F.pmod(F.xxhash64("id", "mark", F.lit(6)), F.col("n")) < LEADS)
    member = member.select("key", "id", "mark", "size", (lead & (F.col("parts") > 1)).alias("lead"), "parts")
    member = common.stored(member, "member", n_docs)
    # whole texts are shuffled once, to single out those of candidates; only these go on
    wanted = member.select("id", "mark").distinct().hint("shuffle_hash")
    texts = common.stored(base.select("id", "mark", "text").join(wanted, ["id", "mark"], "left_semi"), "candidates")
    own = F.array(F.pmod(F.xxhash64("id", "mark", F.lit(8)), F.col("parts")).cast("int"))
    where = F.when(F.col("lead"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)
    dealt = member.select("key", F.explode(where).alias("part"), "id", "mark", "lead", (F.col("parts") > 1).alias("dealt"))
    found = common.stored(_compared(dealt, texts, idf, threshold), "compared")
    links, rest = found.where(F.col("kind") == LINK), found.where(F.col("kind") == REST).select("key", "id", "mark")
    if not rest.isEmpty():
        links = links.union(common.stored(_across(member, rest, texts, idf, threshold, n_docs), "across"))
    node = lambda a, b: F.when(F.col(a).isNotNull(), F.struct(F.col(a).alias("id"), F.col(b).alias("mark")))
    by_node = common.components(links.select(node("id", "mark").alias("a"), node("id2", "mark2").alias("b")))
    by_node = by_node.select(F.col("id.id").alias("id"), F.col("id.mark").alias("mark"), F.col("root.id").alias("root"))
    roots = firsts.select("digest", "id", "mark").join(by_node, ["id", "mark"], "left").select("digest", F.coalesce("root", "id").alias("class_id"))
    # both sides are shuffled for this join, so that adaptive execution can split a text that most rows have
    out = base.select("id", "digest").join(roots, "digest", "left")
    root = F.when(F.col("id").isNotNull(), F.col("class_id"))
    return out.select("id", root.alias("class_id"), F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"), "digest")


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) that stay: one of each class, the one with the smallest id. Of rows that
    share id and text one stays, whatever their other columns; rows without an id stay, one of each text."""
    kept = classes(docs, threshold=threshold).where("kept").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    found = common.stored(kept.groupBy("_id", "_digest").agg(F.count("*").alias("_n")), "kept", 0)
    digest = F.unhex(F.sha2(F.encode(F.coalesce(docs["text"].cast("string"), F.lit("")), "utf-8"), 256))
    same = docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (digest == found["_digest"])
    stay = docs.join(found, same, "left_semi")
    # without a row that is there twice, there is nothing to drop
    return stay if found.where("_n > 1").isEmpty() else stay.dropDuplicates(["doc_id", "text"])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "kept")
