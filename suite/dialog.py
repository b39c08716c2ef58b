"""Requests and conversations: prompts, model output, histories."""

from pyspark.sql import functions as F

from passarank import fixed_values as fixed
from passarank.functions import prompts as P
from passarank.functions import text as X
from passarank.operators import dialog as D
from passarank.operators import recommend as R
from passarank.operators import requests as Q
from suite import common as C
from suite.registry import Registry
from suite.retrieval import TEXT_STAGES, _enriched

register = Registry()


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def sql_fill(template, **slots):
    """A template with SQL expressions in its slots."""
    from string import Formatter

    parts = []
    for literal, slot, _, _ in Formatter().parse(template):
        parts += [quoted(literal)] if literal else []
        parts += [slots[slot]] if slot else []
    return "(" + " || ".join(parts) + ")"


SPLIT_SQL = sql_fill(
    fixed.SPLIT_TEMPLATE, query=C.STRIP.format("text"), example_query="example", example_answer=quoted(fixed.SPLIT_EXAMPLE_ANSWER)
)


@register(f"""
    SELECT conv_id, turn, variant, {SPLIT_SQL} AS prompt,
           'system: ' || {quoted(fixed.SPLIT_SYSTEM_MESSAGE)} || chr(10) || 'user: ' || {SPLIT_SQL} AS messages
    FROM conversations, (VALUES {', '.join(f"('{k}', {quoted(v)})" for k, v in fixed.SPLIT_EXAMPLE_QUERIES.items())}) e(variant, example)
""")
def prompt_build(spark, folder):
    """Both variants of the splitting prompt for every turn."""
    turns = C.table(spark, folder, "conversations")
    parts = [Q.split_requests(turns, "text", v).withColumn("variant", F.lit(v)) for v in fixed.SPLIT_EXAMPLE_QUERIES]
    return parts[0].unionByName(parts[1]).select(
        "conv_id", "turn", "variant", "prompt", P.render_messages(F.col("messages")).alias("messages")
    )


def _raw_output(spark, folder):
    """Turns as raw model output: proper, without end token, without any structure."""
    body = F.concat(F.lit('{"k": ["'), "text", F.lit('"]}'))
    raw = (
        F.when(F.col("role") == "user", F.concat(F.lit("ask [/INST] sure: "), body, F.lit(" done</s>")))
        .when(F.col("role") == "assistant", F.concat(F.lit("ask [/INST]"), body))
        .otherwise(F.col("text"))
    )
    return C.table(spark, folder, "conversations").select("conv_id", "turn", raw.alias("raw"))


@register("""
    WITH r AS (SELECT conv_id, turn,
                      CASE role WHEN 'user' THEN 'ask [/INST] sure: {"k": ["' || text || '"]} done</s>'
                                WHEN 'assistant' THEN 'ask [/INST]{"k": ["' || text || '"]}' ELSE text END AS raw FROM conversations),
         a AS (SELECT *, instr(raw, '[/INST]') - 1 + 7 AS b, CASE WHEN instr(raw, '</s>') > 0 THEN instr(raw, '</s>') - 1
                                                              ELSE greatest(length(raw) - 1, 0) END AS e FROM r),
         t AS (SELECT conv_id, turn, CASE WHEN e > b THEN substr(raw, b + 1, e - b) ELSE '' END AS s FROM a),
         o AS (SELECT *, CASE WHEN instr(s, '{') > 0 THEN instr(s, '{') - 1 ELSE greatest(length(s) - 1, 0) END AS b, instr(s, '}') AS e FROM t)
    SELECT conv_id, turn, replace(CASE WHEN e > b THEN substr(s, b + 1, e - b) ELSE '' END, ' "', '"') AS output FROM o
""")
def clean_output(spark, folder):
    return _raw_output(spark, folder).select("conv_id", "turn", P.clean_output(F.col("raw")).alias("output"))


def _split_outputs(spark, folder):
    """Turns as split requests, their sentences and lines as the two lists; system turns hold no JSON."""
    lists = F.struct(
        C.not_blank(X.sentences(F.col("text"))).alias(fixed.TOPIC_KEY), C.not_blank(X.lines(F.col("text"))).alias(fixed.EVALUATION_KEY)
    )
    output = F.when(F.col("role") == "system", F.col("text")).otherwise(F.to_json(lists))
    return C.table(spark, folder, "conversations").select(
        F.concat_ws(":", "conv_id", "turn").alias("request_id"), output.alias("output")
    )


SPLIT_ROWS = f"""
    WITH l AS (SELECT conv_id || ':' || turn AS request_id, list_filter({C.SENTENCES.format('text')}, lambda t: t <> '') AS topic,
                      list_filter(string_split(text, chr(10)), lambda t: t <> '') AS evaluation FROM conversations WHERE role <> 'system')
    SELECT request_id, 'topic' AS aspect, generate_subscripts(topic, 1) - 1 AS query_idx, len(topic) AS n_queries, unnest(topic) AS text FROM l
    UNION ALL
    SELECT request_id, 'evaluation', generate_subscripts(evaluation, 1) - 1, len(evaluation), unnest(evaluation) FROM l
"""


@register(SPLIT_ROWS)
def split_parse(spark, folder):
    return Q.sub_queries(Q.parse_split(_split_outputs(spark, folder)))


@register("SELECT conv_id || ':' || turn AS request_id, text AS output FROM conversations WHERE role = 'system'")
def split_rejected(spark, folder):
    """Output that is no split request is kept apart, not lost."""
    return Q.parse_split(_split_outputs(spark, folder)).filter(~F.col("valid")).select("request_id", "output")


PAIRS = """
    SELECT u.conv_id AS session_id, u.turn, u.text AS human, a.text AS ai
    FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'
"""
HISTORY = f"""
    SELECT *, coalesce(string_agg(chr(10) || chr(10) || 'Human: ' || human || chr(10) || 'AI: ' || ai, '')
                         OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history
    FROM ({PAIRS})
"""


def _turns(spark, folder):
    """Questions with the answer that follows each, null where there is none yet."""
    said = C.table(spark, folder, "conversations")
    asked = said.filter("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("human"))
    answered = said.filter("role = 'assistant'").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("ai")
    )
    return asked.join(answered, ["session_id", "turn"], "left")


@register(f"SELECT session_id, turn, history FROM ({HISTORY})")
def history_fold(spark, folder):
    """Blocks of two turns, so that sessions span several blocks."""
    return D.history_fold(_turns(spark, folder), block=2).select("session_id", "turn", "history")


@register(f"SELECT session_id, turn, history FROM ({HISTORY})")
def history_tree(spark, folder):
    """The same with all blocks put together by a tree, as for sessions of any length."""
    return D.history_fold(_turns(spark, folder), block=1, blocks_per_window=1).select("session_id", "turn", "history")


@register("""
    SELECT event_id, user_id, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM events
""")
def reset_sessions(spark, folder):
    """A signup starts the next session of a user."""
    events = C.table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    numbered = D.reset_sessions(events, "user_id", ["ts", "event_id"], F.col("event_type") == "signup")
    return numbered.select("event_id", "user_id", "session_no")


@register("""
    SELECT event_id, user_id, session_no,
           coalesce(string_agg(chr(10) || chr(10) || 'Human: ' || event_type || chr(10) || 'AI: ' || props, '')
                      OVER (PARTITION BY user_id, session_no ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history
    FROM (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM events)
""")
def reset_histories(spark, folder):
    """Events as turns: what a user did since the last signup."""
    events = C.table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type", "props")
    told = D.histories(events, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", "event_type", "props")
    return told.select("event_id", "user_id", "session_no", "history")


ANSWER_SQL = sql_fill(fixed.ANSWER_TEMPLATE, info="d.text", review="d.source", history="h.history", input="h.human")


@register(f"SELECT h.session_id, h.turn, {ANSWER_SQL} AS prompt FROM ({HISTORY}) h JOIN documents d ON d.doc_id = h.session_id")
def answer_prompt(spark, folder):
    """Every question with the document of the same number as its context."""
    context = C.table(spark, folder, "documents").select(
        F.col("doc_id").alias("session_id"), F.col("text").alias("info"), F.col("source").alias("review")
    )
    prompts = D.answer_prompts(D.history_fold(_turns(spark, folder)), context, "session_id")
    return prompts.select("session_id", "turn", "prompt")


INPUT_SQL = sql_fill(fixed.SUMMARY_TEMPLATE, query="b.text")
SUMMARY_SQL = sql_fill(fixed.ANSWER_TEMPLATE, info="e.info", review="array_to_string(e.reviews, chr(10))", history="''", input=INPUT_SQL)


@register(f"WITH {TEXT_STAGES} SELECT e.request_id, {SUMMARY_SQL} AS prompt FROM enriched e JOIN benchmark b ON b.item_id::VARCHAR = e.request_id WHERE e.place = 1")
def summary_prompt(spark, folder):
    """Opening prompt of each request: its best entity, the reviews behind it, the request itself."""
    requests = C.table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("request_id"), "text")
    return D.summary_prompts(requests, R.evidence(_enriched(spark, folder))).select("request_id", "prompt")
