"""Plain Python versions of the definitions, and tables with awkward rows."""

import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = {c: c + 32 for c in range(65, 91)}

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("digest", T.StringType()), T.StructField("row", T.StringType()), T.StructField("bucket", T.IntegerType()),
    T.StructField("node", T.StringType()), T.StructField("_id", T.StringType()), T.StructField("_own", T.StringType()),
    T.StructField("component", T.StringType()), T.StructField("places", T.StringType()), T.StructField("n", T.StringType()),
])
LONG = " ".join(f"word{i} É{i % 7}" for i in range(30_000))
PROSE = " ".join(f"w{i}" for i in range(120))


def awkward_rows():
    texts = [
        (1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, "One two", "a"), (5, "one TWO", "b"), (6, "ONE two É", "b"),
        (7, "one two é", "b"), (8, LONG, "a"), (9, PROSE, "a"), (10, PROSE + " more", "a"), (10, PROSE + " more", "a"),
        (None, "One two", "c"), (None, None, "c"), (11, "x y\x1cz \U0001F600 İ Σ", "c"),
        (12, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" and 4785380592391139", None),
        (13, "same line of some length here\n" * 3 + PROSE, "a"), (14, "Same  line of some lengths here\n" + PROSE[::-1], "a"),
        (15, "<|endoftext|> and <|startoftext|>", "a"),
    ]
    return [(i, t, "en", s, None if t is None else len(t), "d", "r", 1, "n", "i", "o", "c", "p", "n") for i, t, s in texts]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCUMENTS).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)


def lower(text):
    return (text or "").translate(AZ)


def words(text):
    return WORD.findall(text or "")


class Forest:
    def __init__(self, nodes):
        self.parent = {x: x for x in nodes}

    def find(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def near_components(texts):
    """doc_id -> (size of the set, smallest doc_id reachable)."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    forest = Forest(sets)
    for i, s in sets.items():
        common = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                forest.join(i, j)
    return {i: (len(s), forest.find(i)) for i, s in sets.items()}


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def base_statistics(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {k + d for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for d in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
