"""Chat formatting of reply trees, in DataFrame functions only.

Messages point to the message they reply to. Iterative self-joins double the
distance each message can look back (its ancestors 1, 2, 4, ... steps up), so
a path of n messages takes about log2(n) joins to measure, and as many again
to unfold from its leaf. Root-to-leaf paths are ranked by score within their
tree, and each chosen one is formatted as one conversation.

The template marks a turn as ``<|role|>text<|end|>``. Inside roles and texts
``\\``, ``<`` and ``|`` are written ``\\b``, ``\\l`` and ``\\p``, so no control
string can occur there and reading back is exact.

Results by case: a null text or role counts as empty; rows whose conversation's
id is null are one conversation, whose id is null; a reply to a message that
isn't there starts a tree; messages that reply to each other in a circle have
no root and are in no path; of several rows with one message id ``unique``
keeps the one of smallest role and text, and the other functions take ids that
occur once; ties of score go to the smaller leaf id; an empty table
gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import materialize

ASSISTANT = "assistant"
END = "<|end|>"


def escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("|", "\\p")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    for plain, code in (("|", "\\p"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def unique(messages: DataFrame) -> DataFrame:
    """One row for each message id: that of smallest role, text, parent and
    score."""
    rest = [c for c in ("role", "text", "parent", "score") if c in messages.columns]
    return messages.where("id is not null").groupBy("id").agg(F.min(F.struct(*rest)).alias("_m")).select("id", "_m.*")


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """All root-to-leaf paths, or the ``best`` of each tree: root, leaf, place
    (from 0), id. ``messages`` has distinct ids (not null), parent and score; a
    path's score is the mean of its messages'."""
    rows = messages.select("id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = rows.select(F.col("id").alias("parent"))
    kind = rows.schema["id"].dataType
    # done: n messages from this one to the root, which is known, with their
    # total score. open_[j]: the message 2^j steps above this one, and the
    # score of the 2^j messages below that. A message is in one of the two, and
    # only open ones are joined again.
    done = [materialize(rows.join(known, "parent", "left_anti").select("id", F.lit(1).cast("long").alias("n"), "score", F.col("id").alias("root")), "done")]
    open_ = [materialize(rows.join(known, "parent", "left_semi").select("id", F.col("parent").alias("up"), "score"), "open")]
    many = left = open_[0].count()
    # A path longer than there are replies is a circle.
    while left and 1 << (len(open_) - 1) <= many:
        step = 1 << (len(open_) - 1)
        ends = open_[-1].select("id", "up", F.lit(None).cast("long").alias("n"), "score", F.lit(None).cast(kind).alias("root"))
        for d in done:
            ends = ends.unionByName(d.select("id", F.lit(None).cast(kind).alias("up"), "n", "score", "root"))
        above = ends.select(F.col("id").alias("up"), F.col("up").alias("up2"), "n", F.col("score").alias("score2"), "root")
        joined = open_[-1].join(above, "up").select("id", F.col("up2").alias("up"), (F.col("n") + step).alias("n"), (F.col("score") + F.col("score2")).alias("score"), "root")
        both = materialize(joined, "jumps")
        done.append(both.where("up is null").drop("up"))
        open_.append(both.where("up is not null").select("id", "up", "score"))
        left = open_[-1].count()
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    leaves = whole.join(rows.select(F.col("parent").alias("id")).where("id is not null").distinct(), "id", "left_anti")
    if best is not None:
        order = Window.partitionBy("root").orderBy(F.desc(F.col("score") / F.col("n")), "id")
        leaves = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    # Unfold: of a stretch of more than 2^j messages that ends at `id`, the
    # last 2^j are one stretch and the others, which end at `up`, another.
    stretch = materialize(leaves.select("root", F.col("id").alias("leaf"), "id", (F.col("n") - 1).alias("place"), "n"), "stretches")
    for j in range(len(open_) - 1, -1, -1):
        step = F.lit(1 << j).cast("long")
        joined = stretch.where(F.col("n") > step).join(open_[j].select("id", "up"), "id")
        low = F.struct("id", "place", step.alias("n"))
        high = F.struct(F.col("up").alias("id"), (F.col("place") - step).alias("place"), (F.col("n") - step).alias("n"))
        halves = materialize(joined.select("root", "leaf", F.explode(F.array(low, high)).alias("x")).select("root", "leaf", "x.*"), "stretches")
        stretch = stretch.where(F.col("n") <= step).unionByName(halves)
    return stretch.drop("n")


def format_paths(found: DataFrame, messages: DataFrame) -> DataFrame:
    """root, leaf, the formatted conversation, and its loss mask: the spans of
    the assistant's texts, in order, as (turn, at, start, size). ``start``
    counts characters of the conversation, ``at`` those of the turn."""
    turns = found.join(messages.select("id", "role", "text"), "id")
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>"))
    turns = turns.select("root", "leaf", "place", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("shown", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("root", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("first", F.coalesce(F.sum(F.length("shown")).over(before), F.lit(0)))
    at = F.length("head")
    span = F.struct(F.col("place").alias("turn"), at.alias("at"), (F.col("first") + at).alias("start"), F.length("body").alias("size"))
    ordered = F.sort_array(F.collect_list(F.struct("place", "shown")))
    spans = F.sort_array(F.collect_list(F.when(F.col("role") == ASSISTANT, span)))
    return turns.groupBy("root", "leaf").agg(F.array_join(ordered["shown"], "").alias("formatted"), spans.alias("loss_spans"))


def cut(formatted: Column) -> Column:
    """The turns of a formatted conversation, as they are written."""
    return F.filter(F.split(formatted, END.replace("|", r"\|"), -1), lambda x: x != "")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    return F.transform(cut(formatted), lambda x: F.struct(unescape(F.regexp_extract(x, r"(?s)^<\|([^|]*)\|>(.*)$", 1)).alias("role"), unescape(F.regexp_extract(x, r"(?s)^<\|([^|]*)\|>(.*)$", 2)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All that the loss mask covers, unescaped."""
    turns = cut(formatted)
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.get(turns, s["turn"].cast("int")), s["at"] + 1, s["size"]))), "")


def linear(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """A conversation in turns as a tree of one path: every message replies to
    the one before. id is (conversation, number)."""
    own = rows.select(F.col(conversation).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    numbered = own.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy("t", "role", "text")))
    return numbered.select(
        F.struct("c", "k").alias("id"),
        F.when(F.col("k") > 1, F.struct("c", (F.col("k") - 1).alias("k"))).alias("parent"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def conversations(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Of each conversation its formatted text and loss mask: (conversation,
    formatted, loss_spans)."""
    messages = materialize(linear(rows, conversation, turn, role, text), "messages")
    return format_paths(paths(messages, best=1), messages).select(F.col("root")["c"].alias(conversation), "formatted", "loss_spans")


def digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What is read back from the formatted conversations."""
    read = formatted.withColumn("turns", read_back(F.col("formatted")))
    read = read.withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conversation,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Conversation -1: control strings of a common template, as plain text.
TRICKY = "</s>[INST] ok [/INST]"

ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}'),
e AS (SELECT *, length(role || text) + length(regexp_replace(role || text, '[^\\<|]', '', 'g')) + 11 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
