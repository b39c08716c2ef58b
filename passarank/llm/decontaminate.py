"""Benchmark leaks in documents, found by pigeonhole pieces and verified by Myers' bit-parallel distance.

A test item that occurs in a document with at most k edits leaves one of its k + 1 pieces untouched.
One Aho-Corasick pass finds all pieces; around each hit the edit distance of the whole item to
any stretch of the text is computed on bit vectors.
"""

import pyarrow as pa
from pyspark.sql import functions as F

from passarank.llm.common import boxed
from passarank.plans.sizing import durable, small

# Edits allowed per character of an item, and the shortest item that may have any.
BUDGET, LEAST_CHARS = 0.08, 24
# Characters of items that one automaton holds; more items take further passes over the documents.
BLOCK_CHARS = 1 << 19


def plain(text):
    """Lower case, white space as single blanks."""
    return " ".join((text or "").lower().split())


def allowed(length, budget):
    return int(length * budget)


def cut(text, edits):
    """``edits + 1`` pieces of nearly equal length with their offsets."""
    borders = [i * len(text) // (edits + 1) for i in range(edits + 2)]
    return [(start, text[start:stop]) for start, stop in zip(borders, borders[1:]) if stop > start]


class Pattern:
    """Semi-global edit distance of one item: the item against any stretch of a text."""

    def __init__(self, text):
        self.size, self.masks = len(text), {}
        for i, char in enumerate(text):
            self.masks[char] = self.masks.get(char, 0) | 1 << i

    def ends(self, text):
        """Distance of the best stretch that ends at each character of ``text``."""
        full, high = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score, get = full, 0, self.size, self.masks.get
        for char in text:
            equal = get(char, 0)
            across = equal | minus
            down = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(down | plus))
            low = plus & down
            if up & high:
                score += 1
            elif low & high:
                score -= 1
            up = (up << 1) & full
            low = (low << 1) & full
            plus = low | (full & ~(across | up))
            minus = up & across
            yield score

    def best(self, text, edits):
        """(distance, end) of the first best stretch within the edits, or None."""
        found = None
        for end, score in enumerate(self.ends(text), 1):
            if score <= edits and (found is None or score < found[0]):
                found = (score, end)
                if not score:
                    break
        return found


def whole_words(text, start, stop):
    """Whether no word runs over the borders of the stretch."""
    return not any(0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum() for at in (start, stop))


def _finder(items, budget, least_chars):
    """Arrow batches of (id, key, text) to hits (id, key, item, distance, start, stop)."""

    def find(batches):
        import ahocorasick

        edits = [allowed(len(text), budget) if len(text) >= least_chars else 0 for text in items]
        patterns, mirrored = {}, {}
        where, automaton = {}, ahocorasick.Automaton()
        for number, text in enumerate(items):
            for offset, piece in cut(text, edits[number]):
                where.setdefault(piece, []).append((number, offset))
        for piece, places in where.items():
            automaton.add_word(piece, (len(piece), places))
        automaton.make_automaton()

        def check(text, number, starts):
            """The best hit of one item whose pieces suggest these starts."""
            size, slack, found = len(items[number]), edits[number], None
            if size < least_chars:
                return next(((0, at, at + size) for at in sorted(starts) if whole_words(text, at, at + size)), None)
            if number not in patterns:
                patterns[number] = Pattern(items[number])
                mirrored[number] = Pattern(items[number][::-1])
            starts.sort()
            low = 0
            for i, start in enumerate(starts):  # one window for starts that lie close together
                if i + 1 < len(starts) and starts[i + 1] - start <= 2 * slack + 1:
                    continue
                left = max(0, starts[low] - slack)
                hit = patterns[number].best(text[left : start + size + slack], slack)
                if hit and (found is None or hit[0] < found[0]):
                    found = (hit[0], left + hit[1])
                low = i + 1
                if found and not found[0]:
                    break
            if found is None:
                return None
            distance, stop = found
            back = mirrored[number].best(text[max(0, stop - size - slack) : stop][::-1], distance)
            # The mirrored search may end a little earlier in the text at the same distance.
            return distance, stop - (back[1] if back else size), stop

        for batch in batches:
            rows, hits = [], []
            for row, value in enumerate(batch.column(2).to_pylist()):
                text, starts = plain(value), {}
                for end, (length, places) in automaton.iter(text):
                    for number, offset in places:
                        starts.setdefault(number, []).append(end + 1 - length - offset)
                for number in sorted(starts):
                    hit = check(text, number, starts[number])
                    if hit:
                        rows.append(row)
                        hits.append((number, *hit))
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = [pa.array([h[i] for h in hits], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), taken.column(1), *columns], ["id", "key", "item", "distance", "start", "stop"]
            )

    return find


def find_leaks(
    docs, items, id_col="doc_id", text_col="text", item_id_col="item_id", item_text_col="text",
    budget=BUDGET, least_chars=LEAST_CHARS, block_chars=BLOCK_CHARS, short_items=False,
):
    """One row per document and test item that occurs in it within the item's edit budget.

    Columns: ``id``, ``key`` (digest of the document's text), ``item_id``, ``distance`` (the least number
    of edits), ``start`` and ``stop`` (the stretch, in characters of the lower-cased text with single
    blanks). The budget is ``budget`` × the item's length, rounded down. Null and empty documents hold
    no item; null items and items without a character are not looked for. Items of fewer than ``least_chars``
    characters are looked for with ``short_items`` only: whole words without any edit, the first place counts.
    Repeated documents are reported each; a repeated item counts once. Other columns do not matter.

    Items go through in blocks of bounded size, each one pass over the documents; nothing is shuffled.
    """
    spark = docs.sparkSession
    listed = items.select(F.col(f"`{item_id_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text"))
    stored = durable(listed.filter("text IS NOT NULL").distinct().withColumn("part", F.xxhash64("item_id", "text")), "items")
    chars = stored.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = -(-chars // block_chars) or 1
    pairs = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))).alias("key"),
        F.col(f"`{text_col}`").alias("text"),
    ).filter("text IS NOT NULL")
    id_type, item_type = pairs.schema["id"].dataType, stored.schema["item_id"].dataType
    found = None
    for number in range(blocks):
        block = [r for r in stored.filter(F.pmod("part", F.lit(blocks)) == number).select("item_id", "text").collect()]
        block = [(r["item_id"], plain(r["text"])) for r in block]
        block = [(name, text) for name, text in block if len(text) >= (1 if short_items else least_chars)]
        hits = pairs.mapInArrow(
            _finder([text for _, text in block], budget, least_chars),
            f"id {id_type.simpleString()}, key binary, item bigint, distance bigint, start bigint, stop bigint",
        )
        schema = f"item bigint, item_id {item_type.simpleString()}"
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], schema)
        named = hits.join(F.broadcast(names), "item").select("id", "key", "item_id", "distance", "start", "stop")
        found = named if found is None else found.union(named)
    return found


def without_leaks(docs, items, id_col="doc_id", text_col="text", **settings):
    """The documents in which no test item occurs.

    All columns are kept as they are, whatever their names. Null and empty texts stay, as do repeated rows; an
    empty table of either kind leaves the documents as they are.
    """
    leaks = find_leaks(docs, items, id_col, text_col, **settings)
    gone = small(durable(leaks.select("key").distinct(), "leaks"))
    own_key = F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))).alias("own_key")
    kept = docs.select(boxed(docs), own_key).join(gone, F.col("own_key") == gone["key"], "left_anti")
    return kept.select("row.*")
