"""Rows that every operator has to take, and plain versions of what the operators compute."""

import itertools
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHING = ["h", "seed", "digest", "rep", "band", "bands", "word", "set_key", "component", "signature", "ids", "row", "block", "y", "rn", "item_id", "shift", "__digest"]


def frame(spark, rows, clashing=False):
    """Documents from (doc_id, text) pairs."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)
    for c in CLASHING if clashing else []:
        df = df.selectExpr("*", f"'x' as `{c}`")
    return df


ODD = [
    (1, None), (2, ""), (3, "   "), (4, "\n\n\t"), (5, "one"), (6, "Plain words, some of them twice twice.\nNext line."), (6, "Plain words, some of them twice twice.\nNext line."),
    (7, "word " * 30_000), (8, "x" * 50_000), (9, "été À l'été ß 日本語 😀"), (10, "a  b   c\t\td \n e\r\nf"), (11, "<|endoftext|> </s> <unk> ▁x"), (None, "a null id has words as well"), (None, None),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_components(rows, percent=85):
    """{doc_id: smallest doc_id reachable}, all pairs compared."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        both = len(a & b)
        if a and b and 100 * both >= percent * (len(a) + len(b) - both):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def crc_mod(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def base_statistics(text):
    w = words(text)
    covered = [False] * len(w)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                covered[i : i + 5] = [True] * 5
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, sum(covered)


def overlap_pairs(docs, items):
    """{(doc_id, item_id): most equal words in a window}, every alignment tried."""
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        if text is None or item is None or i is None:
            continue
        a, b = cut(text), cut(item)
        if not b:
            continue
        width = min(13, len(b))
        least = width - (2 if len(b) >= 13 else 0)
        for shift in range(-len(b), len(a)):
            equal = [0 <= q + shift < len(a) and a[q + shift] == x for q, x in enumerate(b)]
            best = max(sum(equal[s : s + width]) for s in range(len(b) - width + 1))
            if best >= least:
                out[d, i] = max(best, out.get((d, i), 0))
    return out
