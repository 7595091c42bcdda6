"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib

import numpy as np
import xxhash
from skysift.llm.common import text_rows

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def documents(spark, rows, extra=True):
    """A table of documents from (doc_id, text), with columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    full = [(d, t, "en", "src0", None if t is None else len(t)) for d, t in rows]
    if not extra:
        return spark.createDataFrame(full, schema)
    names = ["id", "row", "row_key", "row_hash", "fp", "n", "key1", "place", "score", "ids", "decoded", "level", "gone", "parts",
             "id_key", "tail_probability", "expected_grade", "word", "held_out", "kept_text", "fingerprint", "head"]
    schema += "".join(f", `{n}` string" for n in names)
    return spark.createDataFrame([r + ("x",) * len(names) for r in full], schema)


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, repeated ids."""
    long = " ".join(f"w{i % 977}" for i in range(6000))
    line = "the same line stands in several of these documents\n"
    return [
        (3, "one two three"), (3, "one two three"), (3, "another text of this id " * 6), (None, "a text without an id " * 9),
        (None, "a text without an id " * 9), (None, None), (5, None), (6, ""), (7, " \t\n "), (8, long), (9, long + " end"),
        (10, line * 3 + "tail"), (11, line + "Another line"), (12, "Ünïcödé 日本語 текст 😀 " * 5), (-4, line + "first by id"),
    ]


def words(text):
    return (text or "").encode().split()


def lower(data):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in data)


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def first_key(doc_id):
    return (doc_id is not None, doc_id or 0)


def substrings(rows, window):
    """(n_words, n_removed, kept digest) per row, in the order of the rows."""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key, place = tuple(w[i : i + window]), (*first_key(d), i)
            first[key] = min(first.get(key, place), place)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if (*first_key(d), i) > first[tuple(w[i : i + window])]:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def within(a, b, most):
    """Whether two texts are within so many edits; the table is filled as far as ``most`` edits reach."""
    if abs(len(a) - len(b)) > most:
        return False
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    before = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            options = [before.get(j, most) + 1, now.get(j - 1, most) + 1, before.get(j - 1, most + 1) + (j == 0 or x != b[j - 1])]
            now[j] = min(options) if j else i
        before = now
        if min(before.values()) > most:
            return False
    return before.get(len(b), most + 1) <= most


def lines(rows, max_edits, per_edit, grows=False):
    """(doc_id, text, n_removed) per row; with ``grows`` there is no upper limit of edits."""
    first = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if re.search(r"[^\x09-\x0D\x20]", line):
                place = (*first_key(d), i)
                first[line] = min(first.get(line, place), place)
    near = set()
    texts = sorted(first, key=len)
    # An edit touches three runs of three characters, so texts far apart in the counts of these cannot be near.
    grams = np.zeros((len(texts), 512), np.int16)
    for i, t in enumerate(texts):
        np.add.at(grams[i], [zlib.crc32(t[k : k + 3].encode()) % 512 for k in range(len(t) - 2)], 1)
    for i, a in enumerate(texts):
        most = len(a) // per_edit if grows else max_edits
        close = np.flatnonzero(np.abs(grams[i + 1 :] - grams[i]).sum(axis=1) <= 6 * most)
        for b in (texts[i + 1 + j] for j in close):
            allowed = len(a) // per_edit if grows else min(max_edits, len(a) // per_edit)
            if len(b) - len(a) > allowed:
                break
            if allowed and within(a, b, allowed):
                near.add(max((a, b), key=first.get))
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0))
            continue
        all_lines = t.split("\n")
        kept = [x for i, x in enumerate(all_lines) if x not in first or (x not in near and (*first_key(d), i) == first[x])]
        out.append((d, "\n".join(kept), len(all_lines) - len(kept)))
    return out


def simhash(text, size):
    w = lower((text or "").encode()).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, size, bits):
    """(doc_id, fingerprint, component_id) per row."""
    prints = [simhash(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, f"{prints[i]:016x}", least.get(root(i))) for i, (d, _) in enumerate(rows)]


def table_rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(row):
    return tuple((v is not None, str(v)) for v in row)


__all__ = ["documents", "odd_rows", "text_rows"]
