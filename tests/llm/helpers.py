"""Small tables with every awkward case, and plain versions of the contracts."""

import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SENTENCE = "the quick brown fox jumps over the lazy dog and then runs back to the old barn where it sleeps until the morning comes"
TEXTS = [
    SENTENCE, SENTENCE, SENTENCE.upper(), SENTENCE.replace("lazy", "tired"), None, "", " ", "\n\n", "a", "a b c d", "A b\tC d",
    "é ü\r\né ü\r\n漢字 テスト 🙂 <|endoftext|> it's 'S", "word " * 3000, "x" * 20_000, "ab" * 500 + "\n" + "ab" * 500,
    "Licensed under the MIT License. under the mit license\nCC BY-NC 4.0; Apache License, Version 2.0", "  two  spaces \n\n x ", "trail \x1c y\x85z　q ",
]


def rows(texts=TEXTS):
    return [(i, t, ("en", "de", None)[i % 3], "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def documents(spark: SparkSession, texts=TEXTS, extra: dict | None = None) -> DataFrame:
    """The texts as documents, dealt over several partitions."""
    df = spark.createDataFrame(rows(texts), SCHEMA).repartition(3, "doc_id")
    for name, column in (extra or {}).items():
        df = df.withColumn(name, column)
    return df


def plain(df: DataFrame) -> pd.DataFrame:
    return pd.DataFrame([r.asDict(recursive=True) for r in df.collect()], columns=df.columns)


def shingle_set(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) >= n:
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return {tuple(words)} if words else set()


def jaccard_brute(pairs):
    """{doc_id: (n_shingles, component_id, n_links)} over all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in pairs}
    lists, overlap, parent, links = defaultdict(list), defaultdict(int), {i: i for i in sets}, defaultdict(int)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    for members in lists.values():
        for k, b in enumerate(members):
            for a in members[:k]:
                overlap[a, b] += 1

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), o in overlap.items():
        if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            links[a] += 1
            links[b] += 1
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(sets[i]), root(i), links[i]) for i in sets}
