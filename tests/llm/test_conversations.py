"""The prefix trie against a plain version."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from lensmill.llm import conversations
from lensmill.llm import queries as q

SF = "/root/testdata/sf0.001"


def plain(rows):
    """rows: (conv_id, turn, role, text). A dict (conv_id, depth) to the other columns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30], role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(set)
    final = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].add(c)
        final[whole].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[x] for x in children[n]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        saved[n] = (len(members[n]) - 1) * words + sum(saved[x] for x in children[n])
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(final.get(n, [])))).encode()).hexdigest()
    return {(min(m), len(n)): (min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], sha(n)) for n, m in members.items()}


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert found(q.queries()["op12_trie"](spark, SF)) == plain(rows)


@pytest.fixture
def made(spark):
    def make(rows):
        return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")

    return make


def test_copies_branches_and_ends(made):
    """Copies of one conversation, ends inside a chain, branches below branches, and one that holds a third of all rows."""
    rows = []
    for c in range(60):
        for t in range(3 + c % 7):
            rows.append((c, t, "user" if t % 2 else "system", f"same words {t}" if t < 3 + c % 4 else f"other {c % 5} {t}"))
    rows += [(1007, t, "user", f"turn {t}") for t in range(200)]
    rows += [(2007 + 20 * i, t, "user", f"turn {t} of many") for i in range(3) for t in range(30)]
    assert found(conversations.trie(made(rows))) == plain(rows)


def test_comb(made):
    """A branch at every depth: as many rounds as branches."""
    rows = [(c * 20, t, "user", "on" if t < c else f"off {c}") for c in range(7) for t in range(c + 1)]
    assert found(conversations.trie(made(rows))) == plain(rows)


def test_edges(spark, made):
    rows = [
        (0, 0, "user", "a b"), (0, None, None, None), (0, 0, "user", "a b"), (0, 1, None, "x" * 50_000 + " y"), (0, 1, "user", None), (None, 0, "user", "nobody's"),
        (7, 0, "user", ""), (33, 0, "a", "bc"), (33, 0, "ab", "c"), (33, 0, "a", "bc"), (45, 5, "u", "alone"), (46, 5, "u", "alone"), (21, 0, "u", "v"), (22, 0, "u", "v"),
    ]
    df = made(rows)
    assert found(conversations.trie(df)) == plain(rows)
    clashing = df.withColumns({"k1": df.turn, "depth": df.text, "c": df.role})
    assert found(conversations.trie(clashing)) == plain(rows)
    assert found(conversations.trie(made([(5, 0, "u", "one two")]))) == plain([(5, 0, "u", "one two")])
    assert conversations.trie(made([])).count() == 0
