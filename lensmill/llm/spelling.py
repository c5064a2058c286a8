"""Spelling variants: words that are one edit from a far more frequent word.

Pairs of words at one edit come from an even-partition pigeonhole join. A word of length l is cut into two even
segments; an edit touches one of them, so words of length l that differ by a replaced code point share the other
segment at its place, and a word with one code point more shares it at its place or one further. Words are grouped by
(length, segment, place): those of length l are its index and probe it too, words of length l + 1 probe it. A group of
too many words is divided in the same way: the rest of its words is cut into two even segments, and each word is
grouped anew by what was shared and either of them. So no group is unbounded: at the latest, one open code point is
left. Within a group, words are verified by the hash of the rest with one code point masked (replaced) or left out
(inserted), never pair by pair. Of the groups in which a pair meets, only the one that holds the pair's first
difference reports it, so links are not repeated.

Defined results: null text has no words; a null id is the empty string; only A-Z are lower-cased; rows that are repeated
count each; words of any length are taken whole; an empty table gives an empty result; other columns are dropped, so
clashing names do no harm.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmill.llm.common import materialise, rows_of, short, to_batch

#: Code points of a word at least, occurrences at least, and how much more frequent a form is.
LETTERS, OCCURRENCES, RATIO = 7, 2, 10
#: One occurrence in so many loses a letter.
DAMAGED = 31
#: Words of a group that one task compares; larger groups are divided.
GROUP = 4096
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_LINKS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def occurrences(docs: DataFrame, letters: int = LETTERS) -> DataFrame:
    """word, n: counted within stretches of each task's documents."""
    # Shorter runs only lose letters, so they never become words.
    runs = re.compile(rf"[a-zÀ-ÿ]{{{letters},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = defaultdict(int)
        for batch in short(batches):
            for doc_id, text in rows_of(batch, "doc_id", "text"):
                started = zlib.crc32(f"{doc_id or ''}:".encode())
                for word, n in Counter(runs.findall(text.lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), started)
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < letters:
                            continue
                    held[word] += n
            if len(held) > HELD:
                yield to_batch(_COUNTS, [list(held), list(held.values())])
                held.clear()
        yield to_batch(_COUNTS, [list(held), list(held.values())])

    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return own.mapInArrow(count, "word string, n bigint")


def vocabulary(docs: DataFrame, letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    return occurrences(docs, letters).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def halves(rows: DataFrame) -> DataFrame:
    """Each word grouped twice: its open part [lo, hi) is cut evenly, and either segment joins what is shared already.

    l: the length of the group's shorter words, in whose places lo and hi are; key: l and what is shared, * for the rest.
    """
    c = F.col
    cut, more = (c("lo") + F.floor((c("hi") - c("lo")) / 2)).cast("int"), F.length("word") - c("l")

    def grouped(lo: Column, hi: Column) -> Column:
        shared = F.concat(c("l").cast("string"), F.lit(":"), F.substring("word", F.lit(1), lo), F.lit("*"), F.substring("word", hi + more + 1, F.length("word")))
        return F.struct(shared.alias("key"), lo.alias("lo"), hi.alias("hi"))

    both = rows.withColumn("g", F.explode(F.array(grouped(cut, c("hi")), grouped(c("lo"), cut))))
    return both.select("word", "n", "l", "g.key", "g.lo", "g.hi")


def groups(words: DataFrame, letters: int = LETTERS, most: int = GROUP) -> DataFrame:
    """word, n, l, key, lo, hi: every word in the groups in which it may meet another, none larger than can be compared."""
    length = F.length("word")
    placed = words.withColumn("l", F.explode(F.array(length, length - 1))).where(F.col("l") >= letters)
    rows = halves(placed.withColumns({"lo": F.lit(0), "hi": F.col("l")}))
    out = None
    while True:
        rows = materialise(rows.withColumn("bin", F.xxhash64("key")), "segments")
        heavy = rows.where("hi - lo > 1").groupBy("bin").agg(F.count("*").alias("n_in")).where(F.col("n_in") > most).select("bin")
        heavy = materialise(heavy, "large-groups")
        done = heavy.isEmpty()
        # Another group with the same hash is divided too, or not: each way finds the same pairs.
        light = rows if done else rows.where("hi - lo <= 1").unionByName(rows.where("hi - lo > 1").join(heavy, "bin", "left_anti"))
        out = light if out is None else out.unionByName(light)
        if done:
            return out.drop("bin")
        rows = halves(rows.where("hi - lo > 1").join(heavy, "bin", "left_semi").drop("key", "bin"))


def first_difference(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def linked(l: int, lo: int, hi: int, own: list[tuple[str, int]], longer: list[tuple[str, int]]) -> Iterator[tuple]:  # noqa: E741
    """Pairs at one edit whose first difference lies in [lo, hi), or at the words' end if hi is there."""
    few = len(own) + len(longer) <= max(2, hi - lo)
    reported = lambda at: lo <= at < hi or at == hi == l
    if few:
        # Fewer words than open places: compared directly, as a long word has many places to mask.
        for k, a in enumerate(own):
            for b in (*own[k + 1 :], *longer):
                at = first_difference(a[0], b[0])
                if reported(at) and a[0][at + (len(b[0]) == l) :] == b[0][at + 1 :]:
                    yield a, b
        return
    masked = defaultdict(list)
    for a in own:
        for i in range(lo, hi):
            masked[i, a[0][lo:i] + a[0][i + 1 : hi]].append(a)
    for alike in masked.values():
        for k, a in enumerate(alike):
            for b in alike[k + 1 :]:
                yield a, b
    whole = {a[0][lo:hi]: a for a in own}
    for b in longer:
        s = b[0]
        for i in range(lo, hi + 1):
            # Of equal letters in a row the last one counts as inserted.
            if reported(i) and s[i : i + 1] != s[i + 1 : i + 2] and (a := whole.get(s[lo:i] + s[i + 1 : hi + 1])):
                yield a, b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, own, longer = None, [], []
    out: list[tuple] = []

    def close() -> None:
        if own and len(own) + len(longer) > 1:
            for a, b in linked(*now[1:], own, longer):
                out.append((a[0], *b))
                out.append((b[0], *a))

    for batch in batches:
        for word, n, l, key, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):  # noqa: E741
            if now is None or key != now[0]:
                if now:
                    close()
                now, own, longer = (key, l, lo, hi), [], []
            (own if len(word) == l else longer).append((word, n))
            if len(out) > 20_000:
                yield to_batch(_LINKS, list(zip(*out, strict=True)))
                out.clear()
    if now:
        close()
    yield to_batch(_LINKS, list(zip(*out, strict=True)) if out else [[]] * 3)


def links(words: DataFrame, letters: int = LETTERS, most: int = GROUP) -> DataFrame:
    """word, near, near_n: each pair of words at one edit, once in either direction."""
    own = groups(words, letters, most).select("word", "n", "l", "key", "lo", "hi")
    return own.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "word string, near string, near_n bigint")


def variants(docs: DataFrame, letters: int = LETTERS, least: int = OCCURRENCES, ratio: int = RATIO, most: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of at least so many letters and occurrences."""
    words = materialise(vocabulary(docs, letters, least), "words")
    near = links(words, letters, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    own = words.join(near, "word", "left")
    chosen = -F.col("top.less") >= ratio * F.col("n")
    own = own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("top.near")).alias("form"), F.when(chosen, -F.col("top.less")).alias("form_n"))
    own = materialise(own, "forms")
    # Each step up multiplies n, which bounds the way to a root; every round doubles the steps taken.
    largest = own.agg(F.max("n")).first()[0] or 0
    steps = max(1, math.floor(math.log(max(1, largest / least), ratio) + 1e-9))
    up = own.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        up = materialise(up, "roots")
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return own.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
