"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are found by pattern in each whole text (assign, access, hex). The method adds candidates of one more
kind, ``bare``: a token of 20 or more characters of [A-Za-z0-9+/_-] that mixes upper case, lower case and digits, and
touches no base span. Every candidate value, base or bare, is hashed and counted over the corpus by distinct
repository and owner (here: text and source). A value held by more than ``max_owners`` owners or ``max_repos``
repositories is widely copied, an example; the others are live-looking. Bare candidates become spans only if they are
live-looking; base spans always stay and say which of them are live-looking.

Positions come from cutting the text at the matches: lengths of pieces and matches add up to starts and ends in code
points. Texts are scanned once, and only ids, spans and hashes are shuffled. Counting is by (value, owner,
repository), then by (value, owner), then by value, aggregated before each shuffle, so a value in a third of all
texts never meets in one task.

Defined results: null text is empty and has no span; a null owner counts as one owner; rows that repeat an id, or the
whole document, keep a result each; an empty table gives an empty result; other columns are dropped, so clashing
names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensmill.llm.common import materialise

#: Fixed values of the contract: kind, pattern (Java), least length, and of what.
ASSIGN = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = (("assign", ASSIGN, 12), ("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16))
BARE = "[A-Za-z0-9+/_-]{20,}"
SPAN = "struct<start:int,end:int,kind_at:int,value:string>"
#: Spans of a text that are appended to, or searched, at a time, so that a text's cost grows with its spans and not their square.
BLOCK = 256


def _matches(kind_at: int, pattern: str, value: Column) -> Column:
    """Spans of all matches. value: what of a match m is the candidate."""
    text = F.col("text")
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast(f"array<{SPAN}>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("block"), F.array().cast(f"array<array<{SPAN}>>").alias("blocks"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind_at).alias("kind_at"), value(x["match"]).alias("value"))
        full = F.size(acc["block"]) >= BLOCK
        block = F.when(x["match"].isNull(), acc["block"]).when(full, F.array(span)).otherwise(F.concat(acc["block"], F.array(span)))
        blocks = F.when(x["match"].isNotNull() & full, F.concat(acc["blocks"], F.array(acc["block"]))).otherwise(acc["blocks"])
        return F.struct(end.alias("at"), block.alias("block"), blocks.alias("blocks"))

    # The last piece has no match after it.
    spans = F.aggregate(F.arrays_zip(pieces.alias("piece"), found.alias("match")), zero, step, lambda acc: F.concat(F.flatten(acc["blocks"]), acc["block"]))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _at_least(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda s: F.length(s["value"]) >= least)


def _count_of(spans: str, kind_at: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind_at"] == kind_at)).cast("long")


def scanned(docs: DataFrame) -> DataFrame:
    """Adds base and bare span arrays to doc_id, text, owner."""
    bounded = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}"}
    arrays = []
    for k, (kind, _, least) in enumerate(KINDS):
        value = (lambda m: F.regexp_extract(m, ASSIGN, 2)) if kind == "assign" else (lambda m: m)
        spans = _matches(k, bounded[kind], value)
        arrays.append(_at_least(spans, least) if kind == "assign" else spans)
    base = F.array_sort(F.concat(*arrays), lambda a, b: F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["kind_at"] < b["kind_at"])), -1).otherwise(1))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("base") - 1) / BLOCK).cast("int")), lambda i: F.slice("base", i * BLOCK + 1, BLOCK))
    bounds = lambda b: F.struct(b[0]["start"].alias("start"), F.array_max(F.transform(b, lambda s: s["end"])).alias("end"), b.alias("spans"))
    blocks = F.transform(F.when(F.size("base") > 0, cut).otherwise(F.array().cast(f"array<array<{SPAN}>>")), bounds)
    out = docs.withColumn("base", base)
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    mixed = lambda s: s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[0-9]")
    apart = lambda s, held: ~F.exists(held, lambda b: meets(b, s) & F.exists(b["spans"], lambda x: meets(x, s)))
    bare = _matches(len(KINDS), BARE, lambda m: m)
    # The blocks are handed to a lambda, so that they are made once a text and not once a span.
    return out.withColumn("bare", F.transform(F.array(blocks), lambda held: F.filter(bare, lambda s: mixed(s) & apart(s, held)))[0])


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repos of candidates (value_hash, owner, repo)."""
    triples = candidates.groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = triples.groupBy("value_hash", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan(
    df: DataFrame, max_owners: int = 2, max_repos: int = 5, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, base array<span>, spans array<span> (base and added, by start, then kind), live array<boolean> (of each span, whether it looks live).

    A span is struct<start, end, kind_at, value_hash>; carry names further columns to keep, as they are, in the result.
    """
    own = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(owner_col).cast("string").alias("owner"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind_at"].alias("kind_at"), F.xxhash64(s["value"]).alias("value_hash")))
    found = scanned(own).select("doc_id", "owner", F.xxhash64("text").alias("repo"), hashed(F.col("base")).alias("base"), hashed(F.col("bare")).alias("bare"), *[f"carry_{c}" for c in carry])
    rows = materialise(found.withColumn("uid", F.monotonically_increasing_id()), "secret-rows")
    some = (F.size("base") > 0) | (F.size("bare") > 0)
    candidates = rows.where(some).select("uid", "owner", "repo", F.explode(F.concat("base", "bare")).alias("s"))
    candidates = candidates.select("uid", "owner", "repo", "s", F.col("s.value_hash").alias("value_hash"))
    counted = ownership(candidates).select(F.col("value_hash").alias("h"), "n_owners", "n_repos")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = candidates.join(counted, F.col("value_hash") == F.col("h")).select("uid", "s", live.alias("live"))
    # Each row's spans come back with their verdicts, in order of start, then kind: none is looked up in a list.
    spans = F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.kind_at").alias("kind_at"), F.col("s.end").alias("end"), F.col("s.value_hash").alias("value_hash"), "live"))
    by_row = judged.where(F.col("live") | (F.col("s.kind_at") < len(KINDS))).groupBy(F.col("uid").alias("row")).agg(F.array_sort(spans).alias("judged"))
    named = rows.where(some).join(by_row, F.col("uid") == F.col("row"), "left")
    everything = F.transform("judged", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind_at"].alias("kind_at"), s["value_hash"].alias("value_hash")))
    keep = [F.col(f"carry_{c}").alias(c) for c in carry]
    flags = F.transform("judged", lambda s: s["live"])
    with_some = named.select("doc_id", "base", F.coalesce(everything, F.col("base")).alias("spans"), F.coalesce(flags, F.array().cast("array<boolean>")).alias("live"), *keep)
    none = rows.where(~some).select("doc_id", "base", F.col("base").alias("spans"), F.array().cast("array<boolean>").alias("live"), *keep)
    return with_some.unionAll(none)


def spelled(spans: str) -> Column:
    """kind:start:end joined by commas."""
    names = F.array(*[F.lit(k) for k, _, _ in KINDS], F.lit("bare"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_at"] + 1), s["start"], s["end"])), ",")


def digests(df: DataFrame, **named) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example of every row."""
    out = scan(df, **named)
    counts = [_count_of("base", k).alias(f"n_{kind}") for k, (kind, _, _) in enumerate(KINDS)]
    live = F.size(F.filter("live", lambda x: x)).cast("long")
    return out.select("doc_id", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"), live.alias("n_live"), (F.size("spans") - live).cast("long").alias("n_example"))


def redact(df: DataFrame, mark: str = "[secret]", text_col: str = "text", owner_col: str = "source", max_owners: int = 2, max_repos: int = 5) -> DataFrame:
    """df with each live-looking span of its texts replaced by a mark; other columns and all rows stay.

    The result of the scan carries the columns, so no text is joined; overlapping spans are replaced as one.
    """
    columns, own = df.columns, [f"c_{i}" for i in range(len(df.columns))]
    named = df.toDF(*own).withColumn("row_id", F.lit(None).cast("long"))
    text_at, owner_at = own[columns.index(text_col)], own[columns.index(owner_col)]
    out = scan(named, max_owners, max_repos, "row_id", text_at, owner_at, carry=tuple(own))
    pairs = F.transform(F.filter(F.arrays_zip(F.col("spans").alias("s"), F.col("live").alias("l")), lambda x: x["l"]), lambda x: x["s"])
    text = F.col(text_at)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        part = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), part.alias("out"))

    replaced = F.aggregate("hits", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    out = out.withColumn("hits", pairs)
    return out.withColumn(text_at, F.when(F.size("hits") > 0, replaced).otherwise(text)).select(*own).toDF(*columns)
