"""Records out of pages and the checks after extraction."""

from pyspark.sql import functions as F

from passarank.functions import html as H
from passarank.functions import text as X
from passarank.operators import extract as E
from passarank.plans.sizing import input_bytes, spread
from suite import common as C
from suite.registry import Registry

register = Registry()

# The labels of the events, as an ordinal scale.
EVENT_SCALE = {"signup": 5, "purchase": 4, "click": 3, "view": 2, "error": 1}


# The references that the derived pages hold, spelled out for the twin on its own.
SPELLED = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&#8217;", "’"),
           ("&#x2019;", "’"), ("&#12288;", "\u3000"), ("&amp;", "&")]


def element_text(source):
    """SQL twin of ``html.element_text`` on the references that occur."""
    text = rf"regexp_replace({source}, '(?s)<[^>]*>', '', 'g')"
    for reference, character in SPELLED:
        quoted = character.replace("'", "''")
        text = f"replace({text}, '{reference}', '{quoted}')"
    return text


def elements(tag, html="html"):
    return rf"regexp_extract_all({html}, '(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1)"


LI_ROWS = f"""
    SELECT page_id, unnest(r) AS source, generate_subscripts(r, 1) - 1 AS row_no FROM (SELECT page_id, {elements('li')} AS r FROM pages)
"""


@register(f"SELECT page_id, row_no, source, len({elements('a', 'source')}) AS n_cells FROM ({LI_ROWS})")
def page_rows(spark, folder):
    rows = E.page_rows(C.table(spark, folder, "pages").drop("url"), "li", "a")
    return rows.select("page_id", "row_no", "source", F.size("cells").alias("n_cells"))


@register(f"""
    SELECT page_id, row_no, {element_text(elements('a', 'source') + '[1]')} AS link, CAST(NULL AS VARCHAR) AS absent FROM ({LI_ROWS})
    WHERE {element_text(elements('a', 'source') + '[1]')} <> ''
""")
def page_fields(spark, folder):
    """Cells by position, rows without the required one left out."""
    rows = E.page_rows(C.table(spark, folder, "pages").drop("url"), "li", "a")
    return E.required(E.map_cells(rows, {"link": 0, "absent": 1}), "link")


@register(f"""
    SELECT page_id, {element_text("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
           try_cast(regexp_extract(html, 'track\\((\\d+)\\)', 1) AS DOUBLE) AS tracked,
           try_cast({element_text("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS DOUBLE) AS not_a_number
    FROM pages
""")
def page_selectors(spark, folder):
    """One text and two numbers at fixed places, one of which never is a number."""
    html = F.col("html")
    return C.table(spark, folder, "pages").select(
        "page_id",
        H.element_text(H.first_match(html, "(?s)<h1>(.*?)</h1>")).alias("heading"),
        H.number_at(html, r"track\((\d+)\)").alias("tracked"),
        H.number_at(html, "(?s)<title>(.*?)</title>").alias("not_a_number"),
    )


BLOCKS = f"""
    SELECT page_id, unnest(r) AS source, generate_subscripts(r, 1) - 1 AS review_no FROM (SELECT page_id, {elements('p')} AS r FROM pages)
"""


@register(f"""
    SELECT page_id, review_no, {element_text('source')} AS text, replace(badges[len(badges)], '''', '') AS badge
    FROM (SELECT *, regexp_extract_all(source, '([^\\s<>]+)', 1) AS badges FROM ({BLOCKS}))
""".replace("replace(badges[len(badges)]", "replace(" + element_text("badges[len(badges)]")))
def page_paragraphs(spark, folder):
    """Paragraphs as review blocks, their words as badges: the text and the last badge."""
    block = r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"
    pages = C.table(spark, folder, "pages").drop("url")
    return E.review_rows(pages, block, r"(?s)^(.*)$", r"([^\s<>]+)")


@register("""
    SELECT o_orderkey, try_cast(substr(o_orderpriority, 1, 1) AS INT) AS priority, try_cast(substr(o_orderstatus, 1, 1) AS INT) AS status
    FROM orders
""")
def leading_int(spark, folder):
    return C.table(spark, folder, "orders").select(
        "o_orderkey", X.leading_int(F.col("o_orderpriority")).alias("priority"), X.leading_int(F.col("o_orderstatus")).alias("status")
    )


@register(rf"""
    WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: string_split_regex({C.STRIP.format('x')}, '\s+')) AS w
               FROM documents)
    SELECT doc_id, array_to_string(list_filter(list_transform(w, lambda x: nullif(x[1], '')), lambda x: x IS NOT NULL), ' ') AS timeslot,
           array_to_string(w[1][2:], ' ') AS room FROM l
""")
def time_room_parse(spark, folder):
    """First word of every line, and the other words of the first line."""
    text = F.col("text")
    return C.table(spark, folder, "documents").select("doc_id", X.timeslot(text).alias("timeslot"), X.room(text).alias("room"))


@register("""
    SELECT doc_id, lang FROM documents WHERE text <> '' AND lang <> ''
""")
def required_filter(spark, folder):
    return E.required(C.table(spark, folder, "documents"), "text", "lang").select("doc_id", "lang")


@register("""
    SELECT p_partkey, 'https://plans.example.org/view?dept=100&no=' || p_brand || '&cls=' || p_size AS url, p_brand || ' ' || p_name AS search_key
    FROM part
""")
def url_template(spark, folder):
    template = "https://plans.example.org/view?dept={dept}&no={p_brand}&cls={p_size}"
    urls = E.detail_urls(C.table(spark, folder, "part"), template, dept="100")
    return urls.select("p_partkey", "url", X.search_key(F.col("p_brand"), F.col("p_name")).alias("search_key"))


@register("""
    SELECT page_id, CASE WHEN NOT contains(html, '***') THEN title || chr(10) || heading END AS prerequisite
    FROM (SELECT page_id, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading
          FROM pages)
""")
def marker_fields(spark, folder):
    """Two cells in one text, unset on pages that hold a marker."""
    html = F.col("html")
    both = X.two_cells(H.first_match(html, "(?s)<title>(.*?)</title>"), H.first_match(html, "(?s)<h1>(.*?)</h1>"))
    return C.table(spark, folder, "pages").select("page_id", H.unless_marked(html, "***", both).alias("prerequisite"))


@register(rf"""
    WITH r AS (SELECT page_id, {elements('p')}[1:16] AS rows FROM pages)
    SELECT page_id, array_to_string(list_transform(rows, lambda x: regexp_extract(x, '^\s*(\S+)', 1) || ': ' || {C.STRIP.format('x')} || chr(10)), '') AS syllabus
    FROM r
""")
def capped_lines(spark, folder):
    """A page's first 16 paragraphs (the format's own limit), each led by its first word."""
    rows = F.regexp_extract_all("html", F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    syllabus = X.numbered_lines(rows, lambda row: F.regexp_extract(row, r"^\s*(\S+)", 1), lambda row: row)
    return C.table(spark, folder, "pages").select("page_id", syllabus.alias("syllabus"))


SCALE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in EVENT_SCALE.items()) + " END"
# Tenths of the mean grade, halves decided by the exact binary value of the mean.
GRADE_SQL = f"""
    SELECT user_id, (whole + CASE WHEN rest > 2251799813685248 OR (rest = 2251799813685248 AND whole % 2 = 1) THEN 1 ELSE 0 END) / 10.0::DOUBLE AS grade
    FROM (SELECT user_id, t // 4503599627370496 AS whole, t % 4503599627370496 AS rest
          FROM (SELECT user_id, (avg({SCALE_SQL}) * 4503599627370496.0::DOUBLE)::BIGINT * 10 AS t FROM events GROUP BY user_id))
"""


@register(f"SELECT event_id, {SCALE_SQL} AS number FROM events")
def ordinal_encode(spark, folder):
    from passarank.functions.scores import encode_label

    return C.table(spark, folder, "events").select("event_id", encode_label(F.col("event_type"), EVENT_SCALE).alias("number"))


@register(GRADE_SQL)
def ordinal_mean(spark, folder):
    return E.mean_grade(C.table(spark, folder, "events"), "user_id", "event_type", EVENT_SCALE)


# Means to six decimals come out of whole cents here, so that both sides round the same exact number.
@register(
    f"WITH g AS ({GRADE_SQL}), e AS (SELECT user_id, event_type, sum(round(value * 100)::BIGINT) AS cents, count(*) AS n FROM events GROUP BY ALL), "
    "m AS (SELECT user_id, event_type, ((20000 * cents + n) // (2 * n))::DOUBLE / 1000000.0 AS mean FROM e) "
    "SELECT user_id, grade, "
    + ", ".join(f"max(CASE WHEN event_type = '{k}' THEN mean END) AS {k}" for k in EVENT_SCALE)
    + " FROM m JOIN g USING (user_id) GROUP BY user_id, grade"
)
def stat_pivot(spark, folder):
    """Long facts to one record per user, beside the mean grade."""
    events = C.table(spark, folder, "events")
    facts = events.withColumn("value", F.col("value").cast("decimal(18,2)"))
    wide = E.pivot_stats(facts, "user_id", "event_type", "value", EVENT_SCALE)
    wide = wide.select("user_id", *[F.col(name).cast("double").alias(name) for name in EVENT_SCALE])
    return wide.join(E.mean_grade(events, "user_id", "event_type", EVENT_SCALE), "user_id")


@register("SELECT user_id, grade FROM (" + GRADE_SQL + ") WHERE grade BETWEEN 2.9 AND 3.1")
def score_filter(spark, folder):
    grades = E.mean_grade(C.table(spark, folder, "events"), "user_id", "event_type", EVENT_SCALE)
    return E.valid_scores(grades, ["grade"], 2.9, 3.1)


@register("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 77)")
def resume_from_marker(spark, folder):
    return E.resume_from(C.table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", 77)


@register("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def missing_children(spark, folder):
    documents = C.table(spark, folder, "documents").select("doc_id", "source")
    return E.without_result(documents, C.table(spark, folder, "labels"), "doc_id")


SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TAGGED = "'<TR Class=x><Td>' || url || '&nbsp;&middot;&#8217;&#x2019;&amp;lt;&unknown; b</TD ></tr>' || chr(10) || '<LI>' || page_id || '&#12288;x</li>'"


@register(rf"""
    WITH s AS (SELECT page_id, {TAGGED} AS source FROM pages),
         c AS (SELECT page_id, {element_text("regexp_extract(source, '(?is)<td>(.*?)</td *>', 1)")} AS cell,
                      {element_text("regexp_extract(source, '(?is)<li>(.*?)</li>', 1)")} AS item FROM s)
    SELECT page_id, replace(cell, '&lt;', '&lt;') AS cell, regexp_extract(cell, '^{SPACE}*([^\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{3000}}]+)', 1) AS first_word,
           split_part(item, chr(12288), 1) AS timeslot, split_part(item, chr(12288), 2) AS room
    FROM c
""")
def page_text_forms(spark, folder):
    """Upper-case tags, numeric and named references, and white space beyond ASCII."""
    source = F.concat(
        F.lit("<TR Class=x><Td>"), "url", F.lit("&nbsp;&middot;&#8217;&#x2019;&amp;lt;&unknown; b</TD ></tr>\n<LI>"),
        "page_id", F.lit("&#12288;x</li>"),
    )
    pages = C.table(spark, folder, "pages").select("page_id", source.alias("source"))
    texts = pages.select(
        "page_id",
        H.element_text(F.element_at(H.elements(F.element_at(H.elements(F.col("source"), "tr"), 1), "td"), 1)).alias("cell"),
        H.element_text(F.element_at(H.elements(F.col("source"), "li"), 1)).alias("item"),
    )
    return texts.select(
        "page_id", "cell", F.element_at(X.words(F.col("cell")), 1).alias("first_word"), X.timeslot(F.col("item")).alias("timeslot"),
        X.room(F.col("item")).alias("room"),
    )


# A list page per part. The first row holds a table of its own, a comment, a script and a quoted ">"; the second
# has no instructor. The twins name what must come out of it.
CELL = "concat('<td class=\"c\" title=\"1 > 0\">', {0}, '</td>')"
LIST_PAGE = [
    "'<TABLE id=list><!-- <tr><td>none</td></tr> --><tr title=\"a>b\"><td></td>'", CELL.format("p_brand"), CELL.format("p_size"),
    CELL.format("p_type"), CELL.format("'R&amp;D &copy &euro;'"), CELL.format("concat(p_name, '<table><tr><td>', p_size, '</td></tr></table>')"),
    CELL.format("concat('maker of <b>', p_brand, '</b><script>\"<td>\"</script>')"), CELL.format("'3(4)'"),
    CELL.format("concat('Mon(', p_size, ') Hall 202\n\nWed(2) Hall 301')"), "'</tr><tr><td></td><td>'", "p_brand",
    "'</td><td></td><td></td><td></td><td></td><td></td><td></td><td></td></tr></TABLE>'",
]


def _list_pages(spark, folder):
    source = ", ".join(LIST_PAGE)
    # Parts are small, a file split holds very many of the pages made of them.
    return spread(C.table(spark, folder, "part")).select(F.col("p_partkey").alias("page_id"), F.expr(f"concat({source})").alias("html"))


@register(r"""
    WITH cells AS (
        SELECT *, '<td class="c" title="1 > 0">' AS o, '</td>' AS e, p_name || '<table><tr><td>' || p_size || '</td></tr></table>' AS named FROM part
    ), rows AS (
        SELECT p_partkey AS page_id, 0 AS row_no, 10 AS n_cells, '' AS first, '<td></td>' || o || p_brand || e || o || p_size || e || o || p_type || e
            || o || 'R&amp;D &copy &euro;' || e || o || named || e || o || 'maker of <b>' || p_brand || '</b><script>"<td>"</script>' || e
            || o || '3(4)' || e || o || 'Mon(' || p_size || ') Hall 202' || chr(10) || chr(10) || 'Wed(2) Hall 301' || e AS source FROM cells
        UNION ALL SELECT p_partkey, 1, 1, p_size::VARCHAR, '<td>' || p_size || '</td>' FROM cells
        UNION ALL SELECT p_partkey, 2, 9, '', '<td></td><td>' || p_brand || '</td>' || repeat('<td></td>', 7) FROM cells
    )
    SELECT page_id, CAST(row_no AS INT) AS row_no, source, CAST(n_cells AS INT) AS n_cells, first FROM rows
""")
def nested_page_rows(spark, folder):
    """Rows of pages with a table in a cell, a comment, a script and quoted ``>``: by depth, nested ones included."""
    rows = E.page_rows(_list_pages(spark, folder))
    return rows.select("page_id", "row_no", "source", F.size("cells").alias("n_cells"), H.cell(F.col("cells"), 0).alias("first"))


@register(r"""
    SELECT p_partkey AS page_id, p_brand AS course_no, p_size::VARCHAR AS course_class, p_type AS course_type, 'R&D © €' AS department,
        p_name || p_size AS course_name, 'maker of ' || p_brand AS instructor, CAST(3 AS INT) AS credit, 'Mon(' || p_size || ') Wed(2)' AS timeslot,
        'Hall 202' AS room FROM part
""")
def course_list_rows(spark, folder):
    """Course records of eight cells; rows without an instructor are left out."""
    cells = {"course_no": 1, "course_class": 2, "course_type": 3, "department": 4, "course_name": 5, "instructor": 7, "credit": 8, "room": 9}
    return E.course_rows(_list_pages(spark, folder), cells).drop("row_no")


# A review page per user: one block per event, the label as last badge, scalars in fixed places.
EVENT_BLOCK = "concat('<div><div><div><div>no</div><div><div>event <i>', event_id, '</i><br>of &lt;', event_type, '&gt;</div><div><em>x</em><span>old</span><span>&#39;', event_type, '&#39;</span></div></div></div></div></div>')"
REVIEW_PAGE = (
    "concat('<body><p>top</p><div id=\"root\"><section>first</section><section><p>', satisfaction, '</p><p>', satisfaction * 2, '</p><em>매번함</em></section>"
    "<section class=\"wide reviews\">', blocks, '</section></div></body>')"
)


PAGES_INPUT = 8 * 1024 * 1024  # bytes of events per task, whose pages take some ten times as much


def _review_pages(spark, folder):
    events = C.table(spark, folder, "events")
    # Events are small before their pages are made, and merging partitions by bytes would leave few tasks to take the pages
    # apart; some more than there are cores, so that none waits long for the last.
    tasks = max(4 * spark.sparkContext.defaultParallelism, input_bytes(events) // PAGES_INPUT)
    events = events.select("event_id", "user_id", "event_type").repartition(tasks, "user_id")
    # One user's page holds all their events, as a landed page would.
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.expr(EVENT_BLOCK).alias("block")))), lambda b: b["block"])
    users = events.groupBy("user_id").agg(F.array_join(blocks, "").alias("blocks"), F.expr("min(event_id) % 5").alias("satisfaction"))
    return users.select("user_id", F.expr(REVIEW_PAGE).alias("html"))


@register("""
    SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS review_no,
        'event ' || event_id || 'of <' || event_type || '>' AS text, event_type AS badge FROM events
""")
def review_blocks(spark, folder):
    """Review blocks by their place among the page's elements: the text and the last badge of each."""
    return E.review_rows_at(_review_pages(spark, folder), "#root > section.reviews > *", "div/div/div[2]/div[1]", "div/div/div[2]/div[2]/span")


@register(f"""
    WITH p AS (SELECT user_id, min(event_id) % 5 AS satisfaction FROM events GROUP BY user_id)
    SELECT user_id, satisfaction::DOUBLE AS satisfaction, (satisfaction * 2)::DOUBLE AS workload, NULL::DOUBLE AS difficulty,
        satisfaction::DOUBLE AS delivery, (satisfaction * 2)::DOUBLE AS achievement, grade, 5.0::DOUBLE AS attendance
    FROM p JOIN ({GRADE_SQL}) USING (user_id)
""")
def stat_record(spark, folder):
    """One stat record per page: scalars, attendance by its label, and the mean of the blocks' grades."""
    pages = _review_pages(spark, folder)
    badge = r"(?s)<span>([^<]*)</span></div></div></div></div></div>"
    reviews = E.review_rows(pages, r"(?s)(<div><div><div><div>no.*?</div></div></div></div></div>)", r"(?s)<div>(event.*?)</div>", badge)
    first, second = r"<section><p>(.*?)</p>", r"<section><p>.*?</p><p>(.*?)</p>"
    scalars = {"satisfaction": first, "workload": second, "difficulty": "<b>(.*?)</b>", "delivery": first, "achievement": second}
    return E.review_stats(pages, reviews, "user_id", scalars, "<em>(매.*?)</em>", scale=EVENT_SCALE)


@register(r"""
    SELECT page_id, 'about ' || page_id AS course_intro, CASE WHEN page_id % 3 <> 0 THEN 'needs ' || page_id || chr(10) || 'or not' END AS prerequisite,
        CASE WHEN page_id % 3 <> 0 THEN array_to_string(list_transform(range(1, 17), lambda i: i || ': topic ' || (page_id + i) || chr(10)), '') END AS syllabus
    FROM pages
""")
def course_detail_fields(spark, folder):
    """Intro, prerequisite and the first 16 weeks of detail pages; pages with an attachment have the intro alone."""
    weeks = "array_join(transform(sequence(1, 20), i -> concat('<tr><td> ', i, '</td><td>topic <b>', page_id + i, '</b></td></tr>')), '')"
    pages = C.table(spark, folder, "pages").select(
        "page_id",
        F.expr(
            "concat('<div id=intro>about ', page_id, '</div><p id=a>needs ', page_id, '</p><p id=b>or not</p><tbody>', "
            f"{weeks}, '</tbody>', if(page_id % 3 = 0, '▶ 첨부파일', ''))"
        ).alias("html"),
    )
    patterns = {"intro": "(?s)<div id=intro>(.*?)</div>", "prerequisite_1": "(?s)<p id=a>(.*?)</p>", "prerequisite_2": "(?s)<p id=b>(.*?)</p>", "syllabus": "(?s)<tbody>(.*?)</tbody>"}
    return E.course_details(pages, patterns)
