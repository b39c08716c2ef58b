"""Fields out of page source as column expressions: elements by nesting depth, patterns, character references.

A source is cut into pieces (tags, comments, scripts, text) that together give it back. An element runs from
its opening tag to the closing one at the same depth of that tag, whatever lies between; what comments,
scripts, styles and quoted attributes hold are no tags. An element that is not closed runs to the end of the source.
"""

import json
import re
from html.entities import html5

from pyspark.sql import functions as F

from passarank.functions.text import strip

# Named character references by the names of the HTML standard: those that end in a semicolon, and the
# old ones that also count without it.
REFERENCES = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
OPEN_REFERENCES = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
_REFERENCE = r"^(#[xX][0-9a-fA-F]{1,8};?|#[0-9]{1,9};?|[A-Za-z][A-Za-z0-9]*;)"
_OPEN_REFERENCE = rf"^({'|'.join(OPEN_REFERENCES)})"
# Numbers 128 to 159 mean the Windows characters of these places.
_WINDOWS = {str(code): bytes([code]).decode("cp1252", "replace") for code in range(0x80, 0xA0)}
# A lookup goes through its table from the beginning, so the references that pages are full of have a short one.
_COMMON = {name: REFERENCES[name] for name in "amp lt gt quot apos nbsp middot".split()} | {f"#{code}": chr(code) for code in (34, 38, 39, 60, 62, 160)}
_TABLES = {"common": json.dumps(_COMMON), "names": json.dumps(REFERENCES), "windows": json.dumps({k: v for k, v in _WINDOWS.items() if v != "\ufffd"})}

# Tags without content, whose closing tag does not exist (fixed values of the HTML standard).
VOID = "area base br col embed hr img input link meta param source track wbr".split()
_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_REST_OF_TAG = rf"(?:{_QUOTED}|[^>]*+>)"
_TAG = rf"</?[a-z]{_REST_OF_TAG}"
_SKIPPED = rf"<!--.*?(?:-->|\z)|<(?:script|style)(?=[\s/>]){_QUOTED}.*?(?:</(?:script|style)\s*+>|\z)|<[!?][^>]*+>"
_PIECES = rf"(?is){_SKIPPED}|{_TAG}|[^<]++|<"


def _let(value, body):
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _inner(pieces, first, last):
    """The source between two pieces."""
    return F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")


def _split(html):
    return F.regexp_extract_all(html, F.lit(_PIECES), F.lit(0))


def _split_at(html, tag):
    """``_split`` with all that lies between two tags of one name, if anything, as one piece."""
    if tag.lower() in ("script", "style"):  # whole pieces with what they hold
        return _split(html)
    own = rf"</?{tag}(?=[\s/>]){_REST_OF_TAG}"
    return F.regexp_extract_all(html, F.lit(rf"(?is){own}|(?:(?!{own})(?:{_SKIPPED}|{_TAG}|[^<]++|<))++"), F.lit(0))


_NAME = r"[a-z][^\s/>]*"
_EMPTY = rf"(?i)^<(?:{'|'.join(VOID)})[\s/>]|/>$"


def _marks(pieces, name=_NAME):
    """Where elements of a tag open (1) and close (-1); one without content does both."""
    opens, closes = rf"(?i)^<{name}[\s/>]", rf"(?i)^</{name}[\s/>]"

    def marks(piece, at):
        once = lambda *steps: F.array(*[F.struct(at.alias("at"), F.lit(step).alias("step")) for step in steps])
        # The closing mark of an empty element belongs to the same piece.
        opened = F.when(piece.rlike(opens), F.when(piece.rlike(_EMPTY), once(1, -1)).otherwise(once(1)))
        return F.when(F.startswith(piece, F.lit("</")), F.when(piece.rlike(closes), once(-1))).when(F.startswith(piece, F.lit("<")), opened)

    return F.flatten(F.filter(F.transform(pieces, marks), lambda m: m.isNotNull()))


def _numbered(marks):
    return F.transform(marks, lambda m, k: F.struct(k.alias("k"), m["at"].alias("at"), m["step"].alias("step")))


def _by_depth(marks):
    """Numbered marks by the depth at which they open or to which they return, then by place.

    The depth of the k-th mark follows from how many of the marks before it open: the j-th opening one
    stands at depth 2j - k, the j-th closing one returns to k - 2j - 1.
    """

    def of(step, depth):
        return F.transform(
            F.filter(marks, lambda m: m["step"] == step),
            lambda m, j: F.struct(depth(m["k"], j).alias("depth"), m["k"].alias("k"), m["at"].alias("at"), m["step"].alias("step")),
        )

    return F.sort_array(F.concat(of(1, lambda k, j: j * 2 - k), of(-1, lambda k, j: k - j * 2 - 1)))


def _paired(marks):
    """``first`` and ``last`` place of every element and its ``depth``, by first place; the last place of one that
    is not closed is null. By depth, then place, an opening mark is followed by the closing one of its element.
    """

    def pair(a, number):
        closed = lambda b: F.when((b["depth"] == a["depth"]) & (b["step"] == -1), b["at"])
        last = closed(F.get(marks, number + 1))
        return F.when(a["step"] == 1, F.struct(a["at"].alias("first"), last.alias("last"), a["depth"].alias("depth")))

    return F.sort_array(F.filter(F.transform(marks, pair), lambda p: p.isNotNull()))


def _pairs(marks):
    """The elements of marks. All steps are linear but for two sorts."""
    return _let(_numbered(marks), lambda numbered: _let(_by_depth(numbered), _paired))


def element_stages(source, tag):
    """``elements`` in steps: functions from a frame's columns to the next column, the last of which is the result.

    As columns one after another they are far cheaper to plan than one nested expression.
    """
    yield "_pieces", lambda c: _split_at(F.col(source), tag)
    yield "_marks", lambda c: _numbered(_marks(c("_pieces"), tag))
    yield "_marks", lambda c: _by_depth(c("_marks"))
    yield "_marks", lambda c: _paired(c("_marks"))
    yield "_found", lambda c: _sources(c("_pieces"), c("_marks"))


def _sources(pieces, pairs):
    return F.transform(pairs, lambda p: _inner(pieces, p["first"], F.coalesce(p["last"], F.size(pieces))))


def elements(html, tag):
    """Inner source of every ``<tag>`` element, nested ones included, in page order, as an array.

    Case does not matter. One that is not closed ends with the source. Null gives null.
    """
    if tag.lower() in ("script", "style"):  # nothing nests in them
        return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?=[\s/>]){_QUOTED}(.*?)</{tag}\s*>"), F.lit(1))
    return _let(_split_at(html, tag), lambda pieces: _sources(pieces, _pairs(_marks(pieces, tag))))


def tree(html):
    """A source as ``pieces`` and ``elements`` (``first`` and ``last`` piece, ``depth``), for ``steps``.

    The source is cut once, whatever paths are followed in it. It is taken to be well nested; an element
    that is not closed ends with the source.
    """

    def of(pieces):
        ends = F.transform(
            _pairs(_marks(pieces)),
            lambda p: F.struct(p["first"].alias("first"), F.coalesce(p["last"], F.size(pieces)).alias("last"), p["depth"].alias("depth")),
        )
        return F.struct(pieces.alias("pieces"), ends.alias("elements"))

    return F.when(html.isNotNull(), _let(_split(html), of))


def whole(tree):
    """The place of a whole source in its tree, where paths start."""
    return F.array(F.struct(F.lit(-1).alias("first"), F.size(tree["pieces"]).alias("last"), F.lit(-1).alias("depth")))


def inner_at(tree, places):
    """The inner sources of places in a tree."""
    return F.transform(places, lambda p: _inner(tree["pieces"], p["first"], p["last"]))


_STEP = re.compile(r"(?P<tag>\*|[A-Za-z][A-Za-z0-9]*)?(?:#(?P<id>[\w-]+))?(?:\.(?P<cls>[\w-]+))?(?:\[(?P<nth>\d+)\]|:nth-child\((?P<child>\d+)\))?")


def _holds(opening, attribute, word):
    word = re.escape(word)
    return opening.rlike(rf"""(?is)\s{attribute}\s*=\s*(?:"(?:[^"]*\s)?{word}(?:\s[^"]*)?"|'(?:[^']*\s)?{word}(?:\s[^']*)?'|{word}(?=[\s/>]))""")


def steps(path):
    """The steps of a path of children: functions from a tree and places in it to the places they lead to.

    Steps are parted by ``/`` or ``>``: ``div``, ``*``, ``div[2]`` (the second child of that tag),
    ``div:nth-child(2)`` (the second child, if it has that tag), ``div.page`` (by class), ``#root`` (the element with
    that id, at any depth).
    """
    for written in re.split(r"\s*[/>]\s*", path.strip()):
        step = _STEP.fullmatch(written)
        if not step or not written:
            raise ValueError(f"not a step of a path: {written!r}")
        yield lambda tree, places, parts=step.groupdict(): F.flatten(F.transform(places, lambda place: _step(tree, place, **parts)))


def _step(tree, place, tag, id, cls, nth, child):
    opening = lambda e: F.element_at(tree["pieces"], e["first"] + 1)
    inside = lambda e: (e["first"] > place["first"]) & (e["last"] <= place["last"])
    at_depth = inside if id else lambda e: (e["depth"] == place["depth"] + 1) & inside(e)
    found = F.filter(tree["elements"], at_depth)
    if child:
        found = F.slice(found, int(child), 1)
    if tag and tag != "*":
        found = F.filter(found, lambda e: opening(e).rlike(rf"(?i)^<{tag}[\s/>]"))
    if id:
        found = F.slice(F.filter(found, lambda e: _holds(opening(e), "id", id)), 1, 1)
    if cls:
        found = F.filter(found, lambda e: _holds(opening(e), "class", cls))
    if nth:
        found = F.slice(found, int(nth), 1)
    return found


def _character(code):
    """The character of a code point; numbers that are none give the replacement character."""
    sound = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    digits = F.lpad(F.hex(F.when(sound, code).otherwise(F.lit(0xFFFD)).cast("long")), 8, "0")
    return F.coalesce(_looked_up("windows", code.cast("string")), F.decode(F.unhex(digits), "UTF-32"))


def _looked_up(table, key):
    """A value of a fixed table, one literal that is folded when the plan is made."""
    return F.try_element_at(F.from_json(F.lit(_TABLES[table]), "map<string,string>"), key)


def _resolved(piece):
    """A text that follows ``&`` with its reference resolved, or with the ``&`` put back."""

    def put(reference, character, otherwise):
        rest = F.substr(piece, F.length(reference) + 1)
        found = F.when(reference != "", F.coalesce(_looked_up("common", F.rtrim(reference, F.lit(";"))), character))
        return _let(found, lambda known: F.when(known.isNotNull(), F.concat(known, rest)).otherwise(otherwise))

    def by(reference):
        digits = F.rtrim(reference, F.lit(";"))
        number = F.when(
            reference.rlike("^#[xX]"), F.conv(F.substring(digits, 3, 8), 16, 10).try_cast("long")
        ).otherwise(F.substring(digits, 2, 9).try_cast("long"))
        character = F.when(F.startswith(reference, F.lit("#")), _character(number)).otherwise(_looked_up("names", digits))
        return put(reference, character, _let(F.regexp_extract(piece, _OPEN_REFERENCE, 1), by_beginning))

    def by_beginning(reference):
        return put(reference, _looked_up("names", reference), F.concat(F.lit("&"), piece))

    return _let(F.regexp_extract(piece, _REFERENCE, 1), by)


def unescape(text):
    """Resolve character references, each once; unknown names stay as they are."""

    def all_references(pieces):
        head, tail = F.try_element_at(pieces, F.lit(1)), F.slice(pieces, 2, F.size(pieces))
        return F.concat(head, F.array_join(F.transform(tail, _resolved), ""))

    return _let(text, lambda t: F.when(F.contains(t, F.lit("&")), _let(F.split(t, "&"), all_references)).otherwise(t))


def element_text(source):
    """Text of a piece of source: tags, comments, scripts and styles dropped, character references resolved."""
    plain = F.when(F.contains(source, F.lit("<")), F.regexp_replace(source, rf"(?is){_SKIPPED}|{_TAG}", "")).otherwise(source)
    return unescape(plain)


def cell(cells, index):
    """Text of the cell at a zero-based index, NULL if the row is shorter."""
    return element_text(F.try_element_at(cells, F.lit(index + 1)))


def last_badge(badges):
    """Text of the last badge without quotes."""
    return F.replace(element_text(F.try_element_at(badges, F.lit(-1))), F.lit("'"), F.lit(""))


def first_match(html, pattern):
    """First group of a pattern, NULL if the page has no match."""
    return F.try_element_at(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), F.lit(1))


def number_at(html, pattern):
    """First group of a pattern as a double, NULL if absent or not a number."""
    return strip(first_match(html, pattern)).try_cast("double")


def unless_marked(html, marker, field):
    """``field``, or NULL on pages that hold the marker."""
    return F.when(~F.contains(html, F.lit(marker)), field)
