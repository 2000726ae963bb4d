"""Event-sourced chat logs: fold a log into final messages and render them for training. DataFrame functions only.

A log row is (conv_id, seq, turn, kind, role, text). ``kind`` is

* ``message``     starts or replaces the message of its turn (role and text),
* ``delta``       appends its text to the message of its turn,
* ``edit``        replaces the text of its turn so far; the role stays,
* ``regenerate``  drops its turn and every later turn as logged so far; later rows rebuild them.

Anything else is ignored. Rows of a conversation are folded in order of ``seq`` (ties: turn, kind, role,
text). A null text counts as empty, a null role as '', a null conv_id is a conversation of its own.
Messages come in order of ``turn``, null first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# fixed values: the control strings of the common chat templates that a text must not contain as they are
CONTROL = r"([<\[])(\\*)(\|(?:im_start|im_end|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)"
ESCAPED = r"([<\[])\\(\\*)(\|(?:im_start|im_end|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)"
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Adds a backslash after the first character of each control string, however many it has: one to
    one, as the number of backslashes of each occurrence grows by one and no occurrence arises."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role is one line: backslashes and newlines become \\e and \\n, so that each backslash is followed by e or n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\e")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\e"), F.lit("\\"))


def log_of_turns(rows: DataFrame) -> DataFrame:
    """A log of a table (conv_id, turn, role, text): one ``message`` event a row. Rows that share a turn,
    repeated rows included, are messages of their own, in order of role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    # cast first: all later steps then keep the rows where this shuffle has put them
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text"))
    rows = rows.withColumn("seq", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "seq", F.col("seq").alias("turn"), F.lit("message").alias("kind"), "role", "text")


def fold(log: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text): the final messages of a log."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    log = log.select("conv_id", "seq", "turn", "kind", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text)
    log = log.where(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    # what a regeneration of this or an earlier turn has dropped
    upto = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    log = log.withColumn("cut", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(upto))
    log = log.where("kind <> 'regenerate' and (cut is null or seq > cut)")
    events = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    turn = log.groupBy("conv_id", "turn").agg(events.alias("e"))
    # the text since the last row that replaces it, the role of the last message row, or of the first row
    last = F.greatest(F.size("e") - F.expr("array_position(reverse(transform(e, x -> x.kind <> 'delta')), true)").cast("int"), F.lit(0))
    turn = turn.withColumn("last", F.when(F.expr("exists(e, x -> x.kind <> 'delta')"), last).otherwise(F.lit(0)))
    roles = F.expr("coalesce(try_element_at(filter(e, x -> x.kind = 'message'), -1).role, e[0].role)")
    return turn.select("conv_id", "turn", roles.alias("role"), F.expr("array_join(transform(slice(e, last + 1, size(e)), x -> x.text), '')").alias("text"))


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row a conversation: ``formatted``, and ``loss_spans``, array of (start, length) in code points
    from 0: where the model is trained, the texts of ``trained_role``. Each message is

        <|im_start|>ROLE newline TEXT<|im_end|> newline

    with control strings in ROLE and TEXT escaped by ``escape``. A conversation is one output row, so its
    messages meet in one task; nothing larger does. Places are running sums over its rows: the work is linear in its messages.
    Other columns are not read; an empty table gives none.
    """
    whole = F.concat(F.lit(START), F.col("head"), F.lit("\n"), F.col("body"), F.lit(END))
    m = messages.select("conv_id", "turn", escape_role(F.col("role")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == trained_role).alias("loss"))
    m = m.withColumn("whole", whole).withColumn("length", F.char_length("body").cast("long"))
    upto = Window.partitionBy("conv_id").orderBy("turn", "head", "body", "loss").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(F.char_length("whole").cast("long")).over(upto)
    m = m.withColumn("start", ends - len(END) - F.col("length"))
    parts = F.array_sort(F.collect_list(F.struct("start", "length", "loss", "whole")))
    conv = m.groupBy("conv_id").agg(parts.alias("m"))
    spans = F.transform(F.filter("m", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return conv.select("conv_id", F.array_join("m.whole", "").alias("formatted"), spans.alias("loss_spans"))


def parse(rendered: DataFrame) -> DataFrame:
    """Adds ``turns``, array of (role, text), and ``loss_text``, both read back from the rendered output."""
    turns = F.transform(
        F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x: x != ""),
        lambda x: F.struct(
            unescape_role(F.regexp_extract(x, r"(?s)\A<\|im_start\|>([^\n]*)\n(.*)\z", 1)).alias("role"),
            unescape(F.regexp_extract(x, r"(?s)\A<\|im_start\|>([^\n]*)\n(.*)\z", 2)).alias("text"),
        ),
    )
    # code points of four bytes each: a span is found without counting from the start. Each slice is read behind a byte order mark of its own
    wide = F.array(F.encode("formatted", "UTF-32"))
    piece = lambda u, s: F.decode(F.concat(F.lit(b"\x00\x00\xfe\xff"), F.substring(u, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int"))), "UTF-32")
    loss = F.transform(wide, lambda u: F.array_join(F.transform("loss_spans", lambda s: unescape(piece(u, s))), ""))
    return rendered.withColumn("turns", turns).withColumn("loss_text", F.element_at(loss, 1))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    back = parse(render(fold(log_of_turns(rows.union(more)))))
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha(joined).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = """
with rows as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped as (
    select *, length(regexp_replace(text, '([<\\[])(\\\\*)(\\|(?:im_start|im_end|endoftext)\\|>|/?s>|/?INST\\]|</?SYS>>)', '\\1\\\\\\2\\3', 'g')) as n
    from rows
), conv as (
    select conv_id, count(*) as n_turns,
        string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
        coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
        sum(24 + length(role) + n) as formatted_chars
    from escaped group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
    cast(formatted_chars as bigint) as formatted_chars
from conv
"""
