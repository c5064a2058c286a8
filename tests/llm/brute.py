"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

KINDS = (
    ("assign", re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def secret_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(KINDS) for m in rx.finditer(text or "") if ok(m)]
    return [(KINDS[k][0], a, b) for a, k, b in sorted(found)]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text):
    own = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(len(own) - 2)] or [" ".join(own)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in linked:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


def removed(docs, length=100):
    """docs: (id, bytes) in order; for each, a mask of the bytes that go."""
    seen, out = set(), []
    for _, data in docs:
        mask = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                mask[i : i + length] = True
            seen.add(part)
        out.append(mask)
    return out


def is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0
