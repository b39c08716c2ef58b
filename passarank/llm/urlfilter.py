"""URL verdicts: rules first, else words segmented out of the address and multinomial naive Bayes.

Concatenated names such as ``cheappills`` are split by Viterbi under a unigram model of words, whose counts
come from the pages' own text. Naive Bayes over the words of host and path is learned from the addresses
themselves, in two rounds. In the first one the addresses that hold a word of a stated list are the block
examples and the others the allow ones, and the listed words are no features: the words beside them have to
tell. In the second round the examples are what the first model says, and all words are features, so a
listed word weighs as much as the company it keeps.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passarank.llm import kernels
from passarank.plans.sizing import durable

# Fixed values: (verdict, host, path) of the rules; a rule holds for the host and its subdomains.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Words that make an address a block example.
BLOCK_WORDS = """
    ad ads adserver adult banner bet bets betting bingo casino clickbait escort gamble gambling hentai jackpot
    loan loans lottery malware nude pharma phishing pill pills poker popup porn roulette scam sex slots spam
    spyware tracker track tracking viagra warez webcam xxx
""".split()
# Words of the unigram model that are kept, longest word tried, and buckets of the naive Bayes counts.
VOCABULARY, LONGEST, TOKEN_BITS = 50_000, 24, 18
# The count that smoothing adds to each token.
START = 0.1
# What a block word counts in the unigram model at least, as a share of the most frequent word.
SEED_SHARE = 1e-3


def host_path(df, url):
    """``df`` with string columns ``host`` and ``path`` of the address column ``url``.

    The host lies between the first ``://`` and ``/``, ``?`` or ``#``, A-Z lower-cased; the path then goes up to
    ``?`` or ``#``. Without ``://`` both are empty.
    """
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return df.withColumn("host", F.translate(host, upper, upper.lower())).withColumn("path", path)


def rule_of(rules=None):
    """Columns (rule, verdict) of the longest rule that fits ``host`` and ``path``, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(RULES if rules is None else rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _word_counts(batches):
    """Arrow batches of (text) to (word, n) of each partition: ASCII words outside of tags."""
    held = {}
    tags, words = re.compile(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>"), re.compile(r"[^\W\d_]+")
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for word in words.findall(tags.sub(" ", text).lower()):
                if len(word) <= LONGEST and word.isascii():
                    held[word] = held.get(word, 0) + 1
            if len(held) > 1 << 18:
                yield from _listed(held)
                held = {}
    yield from _listed(held)


def _listed(held):
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def vocabulary(pages, text_col="html", size=VOCABULARY, block_words=BLOCK_WORDS, seed_share=SEED_SHARE):
    """Log probabilities of the most frequent words of the texts and of the block words.

    All texts are counted; the ``size`` most frequent words reach the driver, ties by word.
    """
    texts = pages.select(F.col(f"`{text_col}`").alias("text")).dropna()
    counts = texts.mapInArrow(_word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = durable(counts.withColumn("power", F.floor(F.log2("n")).cast("int")), "words")
    # Powers of two of the counts tell how rare a word may be, so that only about ``size`` words are sent.
    left, least = size, 0
    for row in counts.groupBy("power").count().orderBy(F.desc("power")).collect():
        left, least = left - row["count"], row["power"]
        if left <= 0:
            break
    best = counts.filter(F.col("power") >= least).orderBy(F.desc("n"), "word").limit(size).collect()
    counted = {r["word"]: r["n"] for r in best}
    floor = max(1.0, seed_share * max(counted.values(), default=1))
    for word in block_words:
        counted[word] = max(counted.get(word, 0), floor)
    total = sum(counted.values())
    return {word: math.log(n / total) for word, n in counted.items()}


class Segmenter:
    """Most probable split of a run of letters into words of a unigram model."""

    def __init__(self, words, longest=LONGEST, held=100_000):
        self.words, self.longest, self.kept, self.held = words, longest, {}, held
        # A letter outside of all words costs more than any word.
        self.unknown = min(words.values(), default=-10.0) - 10.0

    def __call__(self, text):
        if text in self.kept:
            return self.kept[text]
        best, back = [0.0], [0]
        for stop in range(1, len(text) + 1):
            found = (best[stop - 1] + self.unknown, stop - 1)
            for start in range(max(0, stop - self.longest), stop):
                chance = self.words.get(text[start:stop])
                if chance is not None and best[start] + chance > found[0]:
                    found = (best[start] + chance, start)
            best.append(found[0])
            back.append(found[1])
        out, stop = [], len(text)
        while stop:
            out.append(text[back[stop] : stop])
            stop = back[stop]
        out = self._joined(out[::-1])
        if len(self.kept) >= self.held:
            self.kept = {}
        self.kept[text] = out
        return out

    def _joined(self, parts):
        """Neighbouring single letters that are no words make one unknown token."""
        out, run = [], ""
        for part in parts:
            if part in self.words:
                if run:
                    out.append(run)
                    run = ""
                out.append(part)
            else:
                run += part
        return [*out, run] if run else out


def tokens(segment, host, path):
    """Words of host and path: ``h:`` and ``p:`` before them; digits count as one kind of token."""
    out = []
    for mark, text in (("h:", host), ("p:", path.lower())):
        for run in re.findall(r"[a-z]+|[0-9]+|[^\W\d_]+", text):
            if run[0].isascii() and run.isalpha():
                out.extend(mark + word for word in segment(run))
            else:
                out.append(mark + ("0" if run.isdigit() else run))
    return out


def bucket(token, bits):
    """A stable number of a token."""
    value = 0xCBF29CE484222325
    for byte in token.encode("utf-8", "surrogatepass"):
        value = (value ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return int(kernels.mix64(np.array([value], np.uint64))[0] >> np.uint64(64 - bits))


class Buckets:
    """``bucket`` with a bounded memory of tokens."""

    def __init__(self, bits, held=1 << 20):
        self.bits, self.kept, self.held = bits, {}, held

    def __call__(self, token):
        found = self.kept.get(token)
        if found is None:
            if len(self.kept) >= self.held:
                self.kept = {}
            found = self.kept[token] = bucket(token, self.bits)
        return found


class Odds:
    """Log odds of blocking of a list of tokens under a model."""

    def __init__(self, model, bits):
        self.prior, (known, values, rest) = model
        self.weights, self.number = np.full(1 << bits, rest, np.float32), Buckets(bits)
        self.weights[known] = values

    def __call__(self, tokens):
        return self.prior + float(sum(self.weights[self.number(t)] for t in tokens))


def seed_tokens(block_words):
    return frozenset(mark + word for mark in ("h:", "p:") for word in block_words)


def _examples(words, block_words, bits, model=None):
    """Arrow batches of (host, path) to counts (blocked, bucket, n); bucket −1 counts the addresses.

    Without a model the listed words say what is blocked and are not counted themselves.
    """
    seeds = seed_tokens(block_words)

    def count(batches):
        segment, number = Segmenter(words), Buckets(bits)
        odds = None if model is None else Odds(model, bits)
        held = np.zeros((2, (1 << bits) + 1), np.int64)
        for batch in batches:
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = tokens(segment, host, path)
                blocked = int(odds(found) > 0 if odds else not seeds.isdisjoint(found))
                held[blocked, -1] += 1
                for token in found:
                    if odds or token not in seeds:
                        held[blocked, number(token)] += 1
        for blocked in (0, 1):
            at = np.flatnonzero(held[blocked])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(at.size, blocked)), pa.array(np.where(at == 1 << bits, -1, at)), pa.array(held[blocked][at])],
                ["blocked", "bucket", "n"],
            )

    return count


def _fitted(addresses, examples, bits):
    """The model of counted examples: (prior, (buckets, their log odds, log odds of all others))."""
    counts = addresses.select("host", "path").mapInArrow(examples, "blocked bigint, bucket bigint, n bigint")
    table = np.zeros((2, (1 << bits) + 1))
    for row in counts.groupBy("blocked", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        table[row["blocked"], row["bucket"]] = row["n"]
    seen = np.flatnonzero(table[:, :-1].any(axis=0))
    whole = table[:, :-1].sum(axis=1, keepdims=True) + START * max(seen.size, 1)
    chance = np.log(table[:, seen] + START) - np.log(whole)
    unseen = np.log(START) - np.log(whole[:, 0])
    prior = math.log(table[1, -1] + 1.0) - math.log(table[0, -1] + 1.0)
    return prior, (seen, (chance[1] - chance[0]).astype(np.float32), float(unseen[1] - unseen[0]))


def learn(addresses, words, block_words=BLOCK_WORDS, bits=TOKEN_BITS):
    """Naive Bayes log odds of blocking, from all addresses, in two rounds.

    Counts are kept in 2^``bits`` buckets, so what reaches the driver is bounded. Every token bucket that
    occurs starts with ``START`` in both classes. Without any address that holds a listed word nothing
    is blocked.
    """
    first = _fitted(addresses, _examples(words, block_words, bits), bits)
    return _fitted(addresses, _examples(words, block_words, bits, first), bits)


def _judge(words, model, bits):
    def judge(batches):
        segment, odds = Segmenter(words), Odds(model, bits)
        for batch in batches:
            host, path = (batch.column(i).to_pylist() for i in (1, 2))
            found = [tokens(segment, h, p) for h, p in zip(host, path)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.string())), pa.array([odds(f) for f in found], pa.float64())],
                [*batch.schema.names, "tokens", "score"],
            )

    return judge


def verdicts(pages, id_col="page_id", url_col="url", text_col="html", rules=None, block_words=BLOCK_WORDS, bits=TOKEN_BITS):
    """One row per page: ``id``, ``host``, ``path``, ``rule``, ``verdict``, ``tokens`` and ``score``.

    The longest rule that fits decides; else the score, the log odds of blocking, does: block if above
    0. A null address or one without ``://`` has empty host and path, no tokens and the prior as
    score. A null text teaches no words. Rows may repeat; each counts as an example. Vocabulary and
    counts come from all rows; a hot host is only counted, never gathered.
    """
    listed = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    addresses = host_path(listed, "url").select("id", "host", "path")
    words = vocabulary(pages, text_col, block_words=block_words)
    model = learn(addresses, words, block_words, bits)
    rule, verdict = rule_of(rules)
    ruled = addresses.select("id", "host", "path", rule.alias("rule"), verdict.alias("ruling"))
    schema = T.StructType([*ruled.schema.fields]).add("tokens", T.ArrayType(T.StringType())).add("score", T.DoubleType())
    scored = ruled.mapInArrow(_judge(words, model, bits), schema)
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("id", "host", "path", "rule", F.coalesce("ruling", own).alias("verdict"), "tokens", "score")
