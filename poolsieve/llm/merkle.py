"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences. DataFrame functions only.

A text is cut without loss: sections end after a blank line or before a heading line ('#'), paragraphs end
after a line break, leaves end after '. ', '! ' or '? '. A leaf's hash is the SHA-256 of its bytes; each node's is the
SHA-256 of its kind and its children's hashes; the root's kind names the tree. Equal texts have equal
trees; texts that differ have different roots.

A fingerprint is a string, ``root:section;section``, a section being ``hash=paragraph|paragraph`` and a
paragraph ``leaf,leaf``: the root has 64 hex digits, section hashes 16, leaves 16. Null counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SECTION = r"(?<=\n)(?=#)|(?<=\n\n)(?=[^\n])"
PARAGRAPH = r"(?<=\n)(?=[^\n])"
LEAF = r"(?<=[.!?] )"
SHORT = 16


def _sha(c: Column) -> Column:
    return F.sha2(F.encode(c, "utf-8"), 256)


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text. A hash at each level is kept in full until its parent is made."""
    text = F.coalesce(text, F.lit(""))

    def paragraph(p: Column) -> Column:
        return F.array_join(F.transform(F.split(p, LEAF, -1), _sha), ",")

    def section(s: Column) -> Column:
        return F.array_join(F.transform(F.split(s, PARAGRAPH, -1), paragraph), "|")

    # full leaf hashes, then section hashes over paragraph hashes, then the root over section hashes
    full = F.transform(F.split(text, SECTION, -1), section)

    def node(s: Column) -> Column:
        return _sha(F.concat(F.lit("section:"), F.array_join(F.transform(F.split(s, r"\|", -1), lambda p: _sha(F.concat(F.lit("paragraph:"), p))), ",")))

    nodes = F.transform(full, lambda s: F.struct(node(s).alias("h"), s.alias("s")))
    short = lambda x: F.concat(F.substring(x["h"], 1, SHORT), F.lit("="), F.regexp_replace(x["s"], rf"([0-9a-f]{{{SHORT}}})[0-9a-f]{{{64 - SHORT}}}", "$1"))
    # the outer transform holds the nodes once, so that they are not worked out anew for root and branches
    packed = F.transform(F.array(nodes), lambda n: F.concat(_sha(F.concat(F.lit("root:"), F.array_join(F.transform(n, lambda x: x["h"]), ","))), F.lit(":"), F.array_join(F.transform(n, short), ";")))
    return F.element_at(packed, 1)


def root(fp: Column) -> Column:
    return F.substring(fp, 1, 64)


def leaves(fp: Column) -> Column:
    """All leaf hashes, in order."""
    return F.split(F.regexp_replace(F.substring(fp, F.lit(66), F.length(fp)), rf"(?:^|;)[0-9a-f]{{{SHORT}}}=", ","), r"[,|]+", -1)


def likeness(a: Column, b: Column) -> Column:
    """Share of the two trees' different leaves that both have (Dice), 0 to 1; 1 for equal roots."""
    x, y = F.array_distinct(_full(leaves(a))), F.array_distinct(_full(leaves(b)))
    dice = 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(dice)


def _full(hashes: Column) -> Column:
    return F.filter(hashes, lambda h: h != "")


def differing_branches(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: array of (section, paragraph, leaf), counted from 0, of ``b``'s leaves
    that are not in ``a``. Sections whose hash is in ``a`` are not entered. Empty for equal roots."""
    known_sections = F.transform(_full(F.split(F.substring(a, F.lit(66), F.length(a)), ";", -1)), lambda s: F.substring(s, 1, SHORT))
    known = leaves(a)
    sections = F.split(F.substring(b, F.lit(66), F.length(b)), ";", -1)

    def of_section(s: Column, i: Column) -> Column:
        paragraphs = F.split(F.substring(s, F.lit(SHORT + 2), F.length(s)), r"\|", -1)
        found = F.flatten(F.transform(paragraphs, lambda p, j: F.transform(F.split(p, ",", -1), lambda h, k: F.struct(i.alias("section"), j.alias("paragraph"), k.alias("leaf"), h.alias("h")))))
        return F.when(F.array_contains(known_sections, F.substring(s, 1, SHORT)), F.filter(found, lambda x: F.lit(False))).otherwise(F.filter(found, lambda x: ~F.array_contains(known, x["h"])))

    found = F.flatten(F.transform(sections, of_section))
    return F.transform(found, lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph"), x["leaf"].alias("leaf")))


def next_ids(ids: DataFrame, key: str, partitions: int) -> DataFrame:
    """Rows (key, n, next): for each row of ``ids`` (key, n; keys differ) the next key in descending order,
    null last; after the last comes the first. Keys are range-partitioned; each range's last row takes the
    first of the next range from a table of one row a range (``partitions`` rows at most)."""
    order = F.col(key).desc_nulls_last()
    ranged = common.cut(ids.repartitionByRange(partitions, order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(order)
    rows = ranged.withColumn("last", F.lead(F.lit(False), 1, True).over(within)).withColumn("next", F.lead(key).over(within))
    edge = ranged.groupBy("part").agg(F.max_by(key, F.coalesce(F.struct(F.col(key).isNotNull(), F.col(key)))).alias("head"))
    over = Window.orderBy("part")  # a row for each range
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = edge.select("part", F.when(F.lead(F.lit(True), 1, False).over(over), F.lead("head").over(over)).otherwise(F.first("head").over(whole)).alias("head"))
    joined = rows.join(F.broadcast(edge), "part")
    return joined.select(key, "n", F.when(F.col("last"), F.col("head")).otherwise(F.col("next")).alias("next"))


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text, next_text_head, next_fp): each document with the head of the next one in descending id
    order, as many code points as half its own, and the next one's fingerprint.

    Ids and lengths are ordered apart from the texts. Texts are shuffled by id once; both joins read that
    exchange. The next document of rows with the same id is that of the next smaller id; where the next id
    itself has several rows, the smallest fingerprint's row stands for it.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = base.groupBy("id").agg(F.max(F.char_length("text")).alias("n"), F.count("*").alias("c"))
    ids = common.cut(ids)
    total, most = ids.agg(F.count("*"), F.max("c")).first()
    if not total:
        return base.withColumn("head", F.lit("")).withColumn("next_fp", fingerprint(F.lit("")))
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    follow = next_ids(ids.select("id", "n"), "id", parts)
    want = follow.select(F.col("next").alias("id"), F.col("id").alias("prior"), F.floor(F.col("n") / 2).cast("int").alias("need"))
    other = base.join(want, base["id"].eqNullSafe(want["id"])).select(F.col("prior").alias("prior"), F.expr("substring(text, 1, need)").alias("head"), fingerprint(F.col("text")).alias("next_fp"))
    if most > 1:
        other = other.groupBy("prior").agg(F.min(F.struct("next_fp", "head")).alias("x")).select("prior", "x.head", "x.next_fp")
    joined = base.join(other, base["id"].eqNullSafe(other["prior"]))
    return joined.select("id", "text", F.expr("substring(head, 1, cast(char_length(text) div 2 as int))").alias("head"), "next_fp")


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_and_next(common.table(spark, sf_dir, "documents"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), F.col("head"))
    rows = rows.select("id", "n_chars", "next_fp", fingerprint(F.col("text")).alias("fingerprint"), F.struct(_sha(edited).alias("sha"), fingerprint(edited).alias("fp")).alias("edited"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.col("edited.sha").alias("edited_sha256"),
        "fingerprint",
        F.col("edited.fp").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited.fp")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
    )


# RE2 has no lookaround: the same cuts as marks set behind (or before) what ends (or begins) a part
OP7_SQL = r"""
with base as (
    select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n_chars,
        coalesce(lead(coalesce(text, '')) over (order by doc_id desc), first_value(coalesce(text, '')) over (order by doc_id desc)) as next_text
    from documents
), texts as (
    select doc_id, n_chars, next_text, text, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) as edited from base
), long as (
    select doc_id, 'a' as k, text as t from texts union all select doc_id, 'b', edited from texts union all select doc_id, 'c', next_text from texts
), parts as (
    select doc_id, k, list_transform(string_split(regexp_replace(regexp_replace(t, '\n#', chr(10) || chr(1) || '#', 'g'), '\n\n([^\n\x01])', chr(10) || chr(10) || chr(1) || '\1', 'g'), chr(1)),
        lambda s: list_transform(string_split(regexp_replace(s, '\n([^\n])', chr(10) || chr(1) || '\1', 'g'), chr(1)),
            lambda p: list_transform(string_split(regexp_replace(p, '([.!?] )', '\1' || chr(1), 'g'), chr(1)), lambda l: sha256(l)))) as tree
    from long
), nodes as (
    select doc_id, k, flatten(flatten(tree)) as leaves,
        list_transform(tree, lambda s: sha256('section:' || array_to_string(list_transform(s, lambda p: sha256('paragraph:' || array_to_string(p, ','))), ','))) as h,
        list_transform(tree, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda l: l[1:16]), ',')), '|')) as s
    from parts
), prints as (
    select doc_id, k, list_distinct(list_transform(leaves, lambda l: l[1:16])) as d, sha256('root:' || array_to_string(h, ',')) as root,
        sha256('root:' || array_to_string(h, ',')) || ':' || array_to_string(list_transform(list_zip(h, s), lambda x: x[1][1:16] || '=' || x[2]), ';') as fp
    from nodes
)
select t.doc_id, t.n_chars, sha256(t.edited) as edited_sha256, a.fp as fingerprint, b.fp as edited_fingerprint,
    case when a.root = b.root then 1.0 else 2.0 * length(list_intersect(a.d, b.d)) / (length(a.d) + length(b.d)) end as near_edited,
    case when a.root = c.root then 1.0 else 2.0 * length(list_intersect(a.d, c.d)) / (length(a.d) + length(c.d)) end as near_next
from texts t join prints a on a.doc_id = t.doc_id and a.k = 'a' join prints b on b.doc_id = t.doc_id and b.k = 'b' join prints c on c.doc_id = t.doc_id and c.k = 'c'
"""
