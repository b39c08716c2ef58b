"""Prompt texts and model output as column expressions."""

from pyspark.sql import functions as F

from passarank import fixed_values as fixed
from passarank.functions.text import fill, strip


def split_prompt(request, example="hosted"):
    """Few-shot prompt that asks to split a request into the two kinds of sub-queries."""
    return fill(
        fixed.SPLIT_TEMPLATE,
        query=strip(request),
        example_query=F.lit(fixed.SPLIT_EXAMPLE_QUERIES[example]),
        example_answer=F.lit(fixed.SPLIT_EXAMPLE_ANSWER),
    )


def _message(role, content):
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(prompt):
    """System message and user prompt, as the array a chat model takes."""
    return F.array(_message("system", F.lit(fixed.SPLIT_SYSTEM_MESSAGE)), _message("user", prompt))


def render_messages(messages):
    """Messages as one text, one ``role: content`` block each."""
    blocks = F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return F.array_join(blocks, "\n")


def _between(text, start, end):
    """Characters from zero-based ``start`` up to, not including, ``end``."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def clean_output(text, start=fixed.INSTRUCTION_END, end=fixed.END_OF_TEXT):
    """JSON text inside raw model output: cut at the tokens, then at the braces, then join quotes.

    A missing token counts as position -1 and is applied as such, so that output without an
    end token loses its last character and output without ``}`` gives an empty text.
    """

    def position(token, where):
        return F.locate(token, where) - 1

    def last_before(where):
        return F.greatest(F.length(where) - 1, F.lit(0))

    stop = position(end, text)
    answer = _between(text, position(start, text) + len(start), F.when(stop < 0, last_before(text)).otherwise(stop))
    opening = position("{", answer)
    opening = F.when(opening < 0, last_before(answer)).otherwise(opening)
    return F.replace(_between(answer, opening, position("}", answer) + 1), F.lit(' "'), F.lit('"'))


def answer_prompt(info, review, history, question):
    return fill(fixed.ANSWER_TEMPLATE, info=info, review=review, history=history, input=question)


def summary_input(query):
    return fill(fixed.SUMMARY_TEMPLATE, query=query)


def history_turn(question, answer):
    """One finished turn as it is appended to the history."""
    return fill(fixed.HISTORY_TURN, input=question, answer=answer)
