"""Chat formatting: reply trees become conversations, one per chosen branch, with a loss mask over the assistant's texts.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposure.operators.skew import first_per
from exposure.session import store

# The template. A turn is HEAD role COLON text TAIL; every turn ends with TAIL and its header with a line feed.
HEAD, COLON, TAIL = "### ", ":\n", "</turn>\n"
# Characters of the control strings never occur in an escaped text. A backslash is escaped too, so each one in the output
# starts a two-character code, and decoding is unambiguous.
CODES = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"), ("\n", "\\n"))
TEXT_CODES = CODES[:3]


def escape(text: Column, codes=TEXT_CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=TEXT_CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def reply_paths(messages: DataFrame, keep: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: (root_id, leaf_id, rank, message_id, place), place 0 at the root.

    ``messages`` has message_id, parent_id, score. The self-join is repeated with doubled steps: after round k every message
    knows its ancestor 2^k replies up and the score of the replies between, so a thread of n replies needs log2(n) rounds, each
    written to the shared folder. Only messages that have not reached their root are joined again. Branches of a tree are
    ranked by the sum of their messages' scores, ties by leaf id, and the best ``keep`` are unrolled with the same steps.

    A null score counts 0. A parent that does not exist makes a root. Rows without message_id are no messages. A repeated
    message_id keeps the row with the smallest parent, then score. Messages on or below a cycle of replies have no root and
    are in no path. No rows: no rows.
    """
    rows = messages.select("message_id", "parent_id", F.coalesce("score", F.lit(0)).cast("double").alias("gain"))
    rows = first_per(rows.where("message_id IS NOT NULL"), ["message_id"], F.col("parent_id"), F.col("gain"))
    rows = store(rows, "messages")
    known = rows.select(F.col("message_id").alias("up"))
    replies = rows.where("parent_id IS NOT NULL").withColumnRenamed("parent_id", "up")
    linked = replies.join(known, "up").select("message_id", "up", F.lit(1).cast("long").alias("hops"), "gain")
    none = F.lit(None).cast(rows.schema["message_id"].dataType)
    tops = rows.join(linked.select("message_id"), "message_id", "left_anti")
    tops = tops.select("message_id", none.alias("up"), F.lit(0).cast("long").alias("hops"), "gain", F.col("message_id").alias("top"))
    state = store(tops.unionByName(linked.withColumn("top", none)), "replies")
    steps, reach, n = [], 1, rows.count()
    while True:
        steps.append(state.where("up IS NOT NULL").select("message_id", "up"))
        if reach > n or steps[-1].isEmpty():
            break
        ahead = state.select(
            F.col("message_id").alias("up"),
            F.col("up").alias("next"),
            F.col("hops").alias("more"),
            F.col("gain").alias("extra"),
            F.col("top").alias("root"),
        )
        climbed = state.where("up IS NOT NULL").join(ahead, "up").select(
            "message_id", F.col("next").alias("up"), (F.col("hops") + F.col("more")).alias("hops"),
            (F.col("gain") + F.col("extra")).alias("gain"), F.col("root").alias("top"),
        )
        state = store(state.where("up IS NULL").unionByName(climbed), "replies")
        reach *= 2
    leaves = state.where("top IS NOT NULL").join(
        steps[0].select(F.col("up").alias("message_id")), "message_id", "left_anti"
    )
    best = Window.partitionBy("top").orderBy(F.desc("gain"), "message_id")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    path = chosen.select(
        F.col("top").alias("root_id"), F.col("message_id").alias("leaf_id"), "rank", "message_id", F.col("hops").alias("place")
    )
    for k in range(len(steps) - 1, -1, -1):
        step = steps[k].withColumnRenamed("up", "_up")
        here = F.struct("message_id", "place")
        there = F.struct(F.col("_up").alias("message_id"), (F.col("place") - 2**k).alias("place"))
        both = F.when(F.col("_up").isNull(), F.array(here)).otherwise(F.array(here, there))
        path = path.join(step, "message_id", "left").select("root_id", "leaf_id", "rank", F.explode(both).alias("_at"))
        path = path.select("root_id", "leaf_id", "rank", "_at.*")
    return path


def format_turns(turns: DataFrame, keys: list[str], place: str = "place", learn: str = "assistant") -> DataFrame:
    """Rows by turn (keys, place, role, text) -> one row per key: ``formatted`` and its loss mask.

    ``turn_starts`` holds where each turn begins and ``loss_spans`` what of it is learnt, as a struct of start and end or
    null; both are in code points of ``formatted`` and stand in turn order. Null role and text count as empty. A
    conversation is one row of the result, so its turns do meet in one task; they are sorted there by their place.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(HEAD), escape(role, CODES), F.lit(COLON))
    rows = turns.select(
        *keys, F.col(place).alias("_place"), head.alias("_head"), escape(text).alias("_body"), (role == learn).alias("_learn")
    )
    size = F.char_length("_head") + F.char_length("_body") + len(TAIL)
    before = Window.partitionBy(*keys).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)))
    first = F.col("_start") + F.char_length("_head")
    span = F.when(F.col("_learn"), F.struct(first.alias("start"), (first + F.char_length("_body")).alias("end")))
    turn = F.struct(
        "_place", F.concat("_head", "_body", F.lit(TAIL)).alias("turn"), F.col("_start").alias("start"), span.alias("span")
    )
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    return grouped.select(
        *keys,
        F.array_join(F.transform("_turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform("_turns", lambda t: t["start"]).alias("turn_starts"),
        F.transform("_turns", lambda t: t["span"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, decoded."""
    turns = F.split(formatted, TAIL, -1)
    whole = F.slice(turns, 1, F.size(turns) - 1)

    def decode(turn: Column) -> Column:
        head = F.substring_index(turn, "\n", 1)
        role = F.substring(head, len(HEAD) + 1, F.char_length(head) - len(HEAD) - 1)
        text = F.substring(turn, F.char_length(head) + 2, F.char_length(turn))
        return F.struct(unescape(role, CODES).alias("role"), unescape(text).alias("text"))

    return F.transform(whole, decode)


def read_loss(formatted: Column, turn_starts: Column, loss_spans: Column) -> Column:
    """The learnt texts, decoded, as the spans cut them out of a formatted conversation."""
    turns = F.split(formatted, TAIL, -1)
    placed = F.zip_with(
        F.slice(turns, 1, F.size(turns) - 1), turn_starts, lambda turn, at: F.struct(turn.alias("turn"), at.alias("at"))
    )
    cut = F.zip_with(
        placed,
        loss_spans,
        lambda t, span: unescape(
            F.substring(t["turn"], (span["start"] - t["at"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        ),
    )
    return F.filter(cut, lambda x: x.isNotNull())


def conversations_as_replies(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as replies: each turn answers the one before it.

    Turns that tie are ordered by role and text. The id names the conversation and the place of the row in it.
    """
    order = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    place = F.row_number().over(order)
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    numbered = rows.select(conv.alias("_conv"), place.alias("_place"), "role", "text")
    return numbered.select(
        F.concat("_conv", F.lit("/"), "_place").alias("message_id"),
        F.when(F.col("_place") > 1, F.concat("_conv", F.lit("/"), F.col("_place") - 1)).alias("parent_id"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def chats(messages: DataFrame, keep: int = 1) -> DataFrame:
    """The best ``keep`` branches of each reply tree as conversations: root_id, leaf_id, rank, formatted, turn_starts, loss_spans."""
    paths = reply_paths(messages, keep)
    texts = first_per(
        messages.where("message_id IS NOT NULL").select(
            "message_id", "parent_id", F.coalesce("score", F.lit(0)).cast("double").alias("gain"), "role", "text"
        ),
        ["message_id"], F.col("parent_id"), F.col("gain"), F.col("role"), F.col("text"),
    )
    turns = paths.join(texts.select("message_id", "role", "text"), "message_id")
    return format_turns(turns, ["root_id", "leaf_id", "rank"])
