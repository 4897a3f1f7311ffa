"""Small documents with everything awkward, and plain versions of what the operators compute."""

import random
import zlib
from collections import Counter, defaultdict

#: Columns whose names the operators use themselves.
CLASHING = (
    "row spans found h key seg cid cls kept window pos hash owner repo rid bucket length salt rank good id label_id score "
    "anchors k1 k2 chunk word first numbers item_id leak_id leak_key refers_to digest tree part dim stay value"
).split()
BASE = "doc_id long, text string, lang string, source string, n_chars long"
SCHEMA = BASE + "".join(f", `{c}` string" for c in CLASHING)


def words(rng, n, pool):
    return [rng.choice(pool) for _ in range(n)]


def pool(rng, letters, size=400):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(size)]


def awkward(seed=1):
    """(doc_id, text, lang, source): copies, near copies, repeated rows and ids, nulls, blanks, ties, one very long text."""
    rng = random.Random(seed)
    en, fr = pool(rng, "abcdefghinorst"), pool(rng, "éèàçuvxylmqpoa")
    out = []
    for k in range(24):
        own = en if k % 3 else fr
        out.append((k, " ".join(words(rng, 120, own)), "en" if k % 3 else "fr", f"s{k % 5}"))
    base = out[3][1].split()
    near = base[:]
    near[60] = "changed"
    out += [
        (30, " ".join(base), "en", "s1"),
        (30, " ".join(base), "en", "s1"),
        (31, " ".join(near), "en", "s2"),
        (32, None, "en", "s1"),
        (33, "", "fr", None),
        (34, " \n\t ", None, "s1"),
        (35, "two words", "en", "s0"),
        (36, "Two  WORDS", "en", "s0"),
        (None, " ".join(words(rng, 50, en)), "en", "s4"),
        (37, "12 34 !!", "fr", "s4"),
        (38, "a" * 1500, "en", "s2"),
        (39, " ".join(words(rng, 30_000, en)), "en", "s3"),
        (40, " ".join(words(rng, 80, en)) + " " + " ".join(base[10:110]), None, "s3"),
        (4, " ".join(words(rng, 90, fr)), "fr", "s2"),
        (41, "naïve café 日本語 текст \U0001f600 \x01 tail", "xx", "s1"),
    ]
    return out


def table(spark, rows=None, columns=True):
    rows = awkward() if rows is None else rows
    full = [(d, t, l, s, None if t is None else len(t), *((str(k) for k in range(len(CLASHING))) if columns else ())) for d, t, l, s in rows]
    return spark.createDataFrame([tuple(r) for r in full], SCHEMA if columns else BASE).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(text):
    return (text or "").encode().lower().split()


def shingles(text, size=4):
    w = tokens(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(rows, size=4, percent=80):
    """(doc_id, n_shingles, component_id, kept) a row, by comparing all pairs."""
    sets = [shingles(t, size) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[find(k)].append(row[0])
    out = []
    for k, row in enumerate(rows):
        c = min(least[find(k)], default=None)
        out.append((row[0], len(sets[k]), c, row[0] is not None and row[0] == c))
    return out


def stripped(texts, length):
    """(kept bytes, spans) of each text, by counting all strings."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((kept, sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))))
    return out


def held(doc_id, modulus, value):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == value


def same(a, b):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)
