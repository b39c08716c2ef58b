"""Conversations: histories, resets and answer prompts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from passarank.functions import prompts as P
from passarank.plans.prefix import running_total, running_totals
from passarank.plans.sizing import durable

# Turns of a block, and blocks of a session that may meet in one window.
TURNS_PER_BLOCK, BLOCKS_PER_WINDOW = 64, 64


def history_fold(
    turns, session="session_id", turn="turn", question="human", answer="ai", block=TURNS_PER_BLOCK, blocks_per_window=BLOCKS_PER_WINDOW
):
    """Add ``history``: all earlier turns of the session as one text, empty for the first.

    A turn without an answer has a history but adds nothing to later ones.

    ``session`` is one column or several; ``turn`` is a whole number, unique in its session. Blocks of ``block`` consecutive turn numbers
    are folded on their own, in as many tasks as there are blocks, and then get the text of the
    blocks before them; a long session is so spread over the cluster. While no session can have more than
    ``blocks_per_window`` blocks these meet in a window over the session; else ``texts_before`` puts them together,
    and no task holds more than what one block gets.
    """
    session = [session] if isinstance(session, str) else list(session)
    text = F.when(F.col(answer).isNotNull(), P.history_turn(F.col(question), F.col(answer))).otherwise("")
    numbered = turns.withColumn("_text", text).withColumn("_block", F.floor(F.col(turn) / block))
    inside = Window.partitionBy(*session, "_block").orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    blocks = numbered.groupBy(*session, "_block").agg(F.array_sort(F.collect_list(F.struct(turn, "_text"))).alias("_turns"))
    blocks = blocks.select(*session, "_block", F.array_join("_turns._text", "").alias("_block_text"))
    ends = numbered.agg(F.coalesce(F.min("_block"), F.lit(0)), F.coalesce(F.max("_block"), F.lit(0))).first()
    if ends[1] - ends[0] < blocks_per_window:
        before = Window.partitionBy(*session).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        earlier = blocks.select(*session, "_block", F.array_join(F.collect_list("_block_text").over(before), "").alias("_earlier"))
    else:
        earlier = texts_before(durable(blocks, "history"), session, *ends)
    own = F.array_join(F.collect_list("_text").over(inside), "")
    return (
        numbered.withColumn("_own", own).join(earlier, [*session, "_block"])
        .withColumn("history", F.concat("_earlier", "_own"))
        .select(*turns.columns, "history")
    )


def texts_before(blocks, session, least, most):
    """``_earlier``: the text of all earlier blocks of the session, for stored ``blocks`` numbered from ``least`` to ``most``.

    Blocks are the leaves of a binary tree. What lies before a block is one left node for every one in the
    binary form of its number, so a block asks for few nodes, and every node that is asked for is put
    together once, in a group of its own.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(max(int(most - least).bit_length() - 1, 0)))).alias("_level")
    numbered = blocks.select(*session, "_block", (F.col("_block") - least).alias("_at"), levels)
    numbered = numbered.withColumn("_node", F.expr("shiftright(_at, _level)")).drop("_at")
    odd = F.col("_node") % 2 == 1
    asked = numbered.filter(odd).withColumn("_node", F.col("_node") - 1)
    node = [*session, "_level", "_node"]
    leaves = numbered.filter(~odd).join(asked.select(*node).distinct(), node, "left_semi")
    in_order = F.array_sort(F.collect_list(F.struct("_block", "_block_text")))["_block_text"]
    nodes = leaves.join(blocks, [*session, "_block"]).groupBy(*node).agg(F.array_join(in_order, "").alias("_node_text"))
    # Larger nodes come first in the text.
    parts = F.sort_array(F.collect_list(F.struct("_level", "_node_text")), asc=False)["_node_text"]
    found = asked.join(nodes, node).groupBy(*session, "_block").agg(F.array_join(parts, "").alias("_earlier"))
    whole = blocks.select(*session, "_block").join(found, [*session, "_block"], "left")
    return whole.withColumn("_earlier", F.coalesce("_earlier", F.lit("")))


def reset_sessions(events, user, order, is_reset, out="session_no"):
    """Number the sessions of each user: every reset starts the next one."""
    return running_total(events, is_reset.cast("int"), out, order, [user])


def histories(turns, user, order, is_reset, question="human", answer="ai", block=TURNS_PER_BLOCK):
    """Add ``session_no`` and ``history`` to the turns of each user: a reset empties the history.

    ``order`` need not be a number: turns are numbered per user, which keeps blocks full.
    """
    sessions = running_totals(turns, {"_turn": F.lit(1), "session_no": is_reset.cast("int")}, order, [user])
    return history_fold(sessions, [user, "session_no"], "_turn", question, answer, block).drop("_turn")


def answer_prompts(turns, context, key, question="human"):
    """Fill the answer prompt of every turn with its context and history; without a context those slots stay empty."""
    prompt = P.answer_prompt(F.col("info"), F.col("review"), F.col("history"), F.col(question))
    return turns.join(context, key, "left").withColumn("prompt", prompt)


def summary_prompts(requests, context, key="request_id", text="text"):
    """Prompt of the opening turn, which asks for a summary and has no history yet."""
    asked = P.summary_input(F.col(text))
    return requests.join(context, key).withColumn("input", asked).withColumn(
        "prompt", P.answer_prompt(F.col("info"), F.col("review"), F.lit(""), F.col("input"))
    )
