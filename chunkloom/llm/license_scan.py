"""License scans: ordered signature rules that hang on keywords, with suppression of contained detections.

Texts are lower-cased (A-Z) and taken as words. A text without any keyword is only counted. Elsewhere each
keyword is looked at with the words around it, and every rule of its keyword that matches there makes a detection: a label,
a priority and the words it spans. A detection inside the span of one of better priority, or of the same priority and longer, is
dropped; of rules with the same span and priority the first stays. All of it happens inside the row, with SQL functions.

Base phrases are rules of priority 0 as well; their places are counted one by one, and their labels always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Words looked at on each side of a keyword.
SIDE = 12
#: Words looked at behind a keyword that a list of licences may follow.
LIST_SIDE = 60
#: How sure a detection of each priority is.
SURE = {0: 1.0, 1: 0.9, 2: 0.7, 3: 0.3}

# Licence names as people write them, by label; {v} stands for a version in the label and in the words.
NAMED = {
    "mit": "mit|expat|x11",
    "bsd": "bsd|berkeley software distribution",
    "bsd-2-clause": "bsd 2 clause|2 clause bsd|simplified bsd|freebsd",
    "bsd-3-clause": "bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd",
    "bsd-4-clause": "bsd 4 clause|4 clause bsd|original bsd",
    "isc": "isc|internet systems consortium",
    "zlib": "zlib|zlib libpng",
    "unlicense": "unlicense",
    "wtfpl": "wtfpl",
    "boost": "boost software|boost|bsl 1 0",
    "python": "python software foundation|psf|python",
    "ruby": "ruby",
    "perl-artistic": "artistic|perl artistic",
    "eclipse": "eclipse public|epl",
    "postgresql": "postgresql",
    "openssl": "openssl",
    "ncsa": "ncsa|university of illinois ncsa open source",
    "odbl": "open database|odbl",
    "sil-ofl": "sil open font|open font|ofl",
    "proprietary": "proprietary|commercial|evaluation|enterprise",
}
VERSIONED = {
    "apache": ("apache|apache software", ("1", "1 1", "2", "2 0")),
    "gpl": ("gpl|gnu gpl|gnu general public|general public", ("1", "2", "2 0", "3", "3 0")),
    "lgpl": ("lgpl|gnu lgpl|gnu lesser general public|lesser general public|library general public", ("2", "2 1", "3", "3 0")),
    "agpl": ("agpl|gnu agpl|gnu affero general public|affero general public", ("1", "3", "3 0")),
    "gfdl": ("gfdl|gnu free documentation|free documentation", ("1 1", "1 2", "1 3")),
    "mpl": ("mpl|mozilla public", ("1 0", "1 1", "2 0")),
    "epl": ("epl|eclipse public", ("1 0", "2 0")),
    "cddl": ("cddl|common development and distribution", ("1 0", "1 1")),
    "eupl": ("eupl|european union public", ("1 1", "1 2")),
    "osl": ("osl|open software", ("2 1", "3 0")),
    "afl": ("afl|academic free", ("2 1", "3 0")),
}
CC_PARTS = ("by nc nd", "by nc sa", "by nd", "by nc", "by sa", "by")
CC_WORDS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Sentences that stand in the licence texts and notices themselves, with their keyword marked.
TEXTS = (
    ("mit", "permission is <hereby> granted free of charge to any person obtaining a copy"),
    ("boost", "permission is <hereby> granted free of charge to any person or organization obtaining a copy"),
    ("isc", "distribute this software for any purpose with or without fee is <hereby> granted"),
    ("postgresql", "for any purpose without fee and without a written agreement is <hereby> granted"),
    ("bsd", "<redistribution> and use in source and binary forms with or without modification"),
    ("bsd-3-clause", "(?:be used to )?<endorse> or promote products derived from this software"),
    ("bsd-4-clause", "(?:all )?<advertising> materials mentioning features or use of this software"),
    ("zlib", "<altered> source versions must be plainly marked as such"),
    ("unlicense", "this is free and <unencumbered> software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public <license>"),
    ("apache-2", "apache org <licenses> license 2 0"),
    ("apache-1.1", "apache org <licenses> license 1 1"),
    ("python", "python software foundation <license> version 2"),
)
#: Keywords, the words that rules hang on.
LICENSE_WORDS = ("license", "licence")
PLURALS = ("licenses", "licences")
GNU = ("gpl", "lgpl", "agpl")
JOINED = {f"{family}{v}{major}": (family, major) for family in GNU for v in ("v", "") for major in "123"} | {
    f"{family}{v}2": (family, "2") for family in ("apache", "mpl") for v in ("v", "")
}
KEYWORDS = (
    *LICENSE_WORDS, "licensed", "licenced", "spdx", "cc", "cc0", "creative", "domain", "copyright", *GNU, *PLURALS, *JOINED, "creativecommons", "clause",
    *(f for f in VERSIONED if f not in GNU), "hereby", "redistribution", "endorse", "advertising", "altered", "unencumbered",
)
#: One licence of a list, in words: a name, its version, an exception.
OPERAND = r"[^ ]+(?: (?:[0-9][^ ]*|clause|by|nc|nd|sa|v|version))*(?: or later| only)?(?: with (?:[^ ]+ ){0,4}?[^ ]+)?"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against the words around ``keyword``, which stands in it as ``<keyword>``.

    A detection spans the whole match, or its group 1 where that is one of a list: at the ``head`` or the ``tail`` of the match.
    """

    priority: int
    label: str
    keyword: str
    pattern: str
    part: str = "all"


def signature_rules(base: Mapping[str, str] = BASE_PHRASES) -> list[Rule]:
    """All rules in order: of those that match the same words with the same priority the first wins."""
    return sorted(set(_rules(base)), key=lambda r: (r.priority, -len(r.pattern), r.label, r.keyword, r.pattern))


def _rules(base: Mapping[str, str]) -> Iterator[Rule]:
    for phrase, label in base.items():
        keyword = _base_keyword(phrase)
        yield Rule(0, label, keyword, re.sub(rf"(?<![^ ]){keyword}(?![^ ])", f"<{keyword}>", phrase, count=1))
    named = [(label, words, 2, "") for label, words in NAMED.items()]
    for label, (words, versions) in VERSIONED.items():
        named += [(f"{label}-{v.removesuffix(' 0').replace(' ', '.')}", words, 1, v) for v in versions]
        named.append((label, words, 2, ""))
    for label, words, priority, version in named:
        name = f"(?:{words})"
        v = f" (?:version |v |v)?{version}(?: or later| only)?" if version else ""
        for keyword in LICENSE_WORDS:
            yield Rule(priority, label, keyword, f"(?:under |the |a |an |terms of )*{name}{v} <{keyword}>")
            if version:
                yield Rule(priority, label, keyword, f"(?:under |the |terms of )*{name} <{keyword}>{v}")
        for keyword in ("licensed", "licenced"):
            yield Rule(priority, label, keyword, f"<{keyword}> (?:under |by |the |a |terms |of )+{name}(?: license| licence)?{v}")
            yield Rule(priority, label, keyword, f"<{keyword}> (?:under |by |the |a |either |of |terms )+(?:{OPERAND}(?: license| licence)? (?:or|and) (?:the )?)+({name}{v})", "tail")
        for keyword in PLURALS:
            yield Rule(priority, label, keyword, f"({name}{v})(?: (?:or|and)(?: [^ ]+){{1,5}}?)? <{keyword}>", "head")
        yield Rule(1, label, "spdx", f"<spdx> license identifier (?:{OPERAND} (?:or|and) )*({name}{v.replace('(?:version |v |v)?', '')})", "tail")
    for label, pattern in TEXTS:
        yield Rule(1, label, re.search("<(.*)>", pattern)[1], pattern)
    for clauses in "234":
        yield Rule(1, f"bsd-{clauses}-clause", "clause", f"bsd {clauses} <clause>")
    for family, (_, versions) in VERSIONED.items():
        for version in versions if family not in GNU else ():
            if " " in version:  # a name and a whole number alone may be anything
                yield Rule(2, f"{family}-{version.removesuffix(' 0').replace(' ', '.')}", family, f"<{family}> (?:version |v |v)?{version}(?: or later| only)?")
    for word, (family, major) in JOINED.items():
        for version in VERSIONED[family][1]:
            if version.split()[0] == major:
                minor = version[1:]
                yield Rule(1, f"{family}-{version.removesuffix(' 0').replace(' ', '.')}", word, f"<{word}>{minor}(?: or later| only)?")
        if not any(v in (major, f"{major} 0") for v in VERSIONED[family][1]):
            yield Rule(2, family, word, f"<{word}>")
        elif major not in VERSIONED[family][1]:
            yield Rule(1, f"{family}-{major}", word, f"<{word}>")
    for family in GNU:
        names = VERSIONED[family][0]
        for version in VERSIONED[family][1]:
            for keyword in LICENSE_WORDS:
                yield Rule(1, f"{family}-{version.removesuffix(' 0').replace(' ', '.')}", keyword, f"(?:under |the |terms of )*(?:{names}) <{keyword}> as published by the free software foundation (?:inc )?(?:either )?version {version}")
        for version in VERSIONED[family][1]:
            yield Rule(1, f"{family}-{version.removesuffix(' 0').replace(' ', '.')}", family, f"<{family}> (?:version |v |v)?{version}(?: or later| only)?")
        yield Rule(2, family, family, f"<{family}>")
    for parts in CC_PARTS:
        label = "cc-" + parts.replace(" ", "-")
        spelled = "(?: and)? ".join(CC_WORDS[p] for p in parts.split())
        for version in CC_VERSIONS:
            yield Rule(1, f"{label}-{version.replace(' ', '.')}", "cc", f"<cc> {parts} {version}")
            yield Rule(1, f"{label}-{version.replace(' ', '.')}", "creative", f"<creative> commons {spelled} {version}")
            yield Rule(1, f"{label}-{version.replace(' ', '.')}", "creativecommons", f"<creativecommons> org licenses {parts} {version}")
        yield Rule(2, label, "creativecommons", f"<creativecommons> org licenses {parts}")
        yield Rule(2, label, "cc", f"<cc> {parts}")
        yield Rule(2, label, "creative", f"<creative> commons {spelled}")
    yield Rule(2, "cc0", "cc0", "<cc0>")
    yield Rule(2, "cc0", "creative", "<creative> commons (?:zero|0)")
    yield Rule(2, "public-domain", "domain", "(?:in |into |to )?(?:the )?public <domain>")
    yield Rule(2, "cc0", "creativecommons", "<creativecommons> org publicdomain zero")
    yield Rule(2, "public-domain", "creativecommons", "<creativecommons> org publicdomain mark")
    yield Rule(3, "proprietary", "copyright", "<copyright> (?:[^ ]+ ){1,8}all rights reserved")
    for keyword in LICENSE_WORDS:
        yield Rule(3, "unspecified", keyword, f"(?:under|see) (?:the |this |that |following |above |a )*<{keyword}>")
        yield Rule(3, "unspecified", keyword, f"<{keyword}> (?:agreement|terms|file|notice)")


def _base_keyword(phrase: str) -> str:
    found = [w for w in phrase.split() if w in KEYWORDS]
    if not found:
        raise ValueError(f"no word of the phrase {phrase!r} is a keyword")
    return found[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED), BETWEEN_WORDS), "")


def scanned(docs: DataFrame, base: Mapping[str, str] = BASE_PHRASES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections), one row per input row.

    Null and empty texts have no words and the score 0. Repeated rows are scanned one by one; columns of other names are ignored.
    """
    if any(len(p.split()) > SIDE for p in base):
        raise ValueError(f"a base phrase has more than {SIDE} words")
    rules = signature_rules(base)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.translate(F.coalesce(F.col(text_column).cast("string"), F.lit("")), UPPER, LOWERED).alias("lowered"))
    rows = rows.select("doc_id", F.array_remove(F.split("lowered", BETWEEN_WORDS), "").alias("words"))
    words = F.col("words")
    worth = F.arrays_overlap("words", F.array(*[F.lit(k) for k in KEYWORDS]))
    places = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*KEYWORDS), i).otherwise(-1)), lambda i: i >= 0)
    rows = rows.select("doc_id", F.size("words").alias("n_words"), "words", F.when(worth, places).otherwise(F.array().cast("array<int>")).alias("places"))

    def around(i: Column) -> Column:
        left = F.least(i, F.lit(SIDE))
        return F.concat(
            F.lit(" "), F.array_join(F.slice(words, i - left + 1, left), " "), F.lit(" <"), F.element_at(words, i + 1), F.lit("> "),
            F.array_join(F.slice(words, i + 2, F.when(F.element_at(words, i + 1).isin("spdx", "licensed", "licenced"), LIST_SIDE).otherwise(SIDE)), " "), F.lit(" "),
        )

    rows = rows.select("doc_id", "n_words", F.transform("places", lambda i: F.struct(i.alias("at"), F.element_at(words, i + 1).alias("word"), around(i).alias("seen"))).alias("places"))

    spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    # One SQL text: a thousand columns made one by one would take seconds. Patterns hold neither quotes nor backslashes.
    listed = lambda values: "array(" + ", ".join(values) + ")"
    quoted = lambda value: f"'{value}'"
    matched = {k: listed(f"CASE WHEN p.seen RLIKE ' {r.pattern}(?= )' THEN {i} END" for i, r in enumerate(rules) if r.keyword == k) for k in KEYWORDS if any(r.keyword == k for r in rules)}
    cases = " ".join(f"WHEN '{k}' THEN {found}" for k, found in matched.items())
    of_rule = lambda values: f"element_at({listed(values)}, r + 1)"
    ruled = F.expr(f"transform(places, p -> struct(p AS place, filter(CASE p.word {cases} END, r -> r IS NOT NULL) AS ranks))")
    named = (
        f"struct(r AS rank, {of_rule(quoted(r.pattern) for r in rules)} AS pattern, {of_rule(quoted(r.part) for r in rules)} AS part, "
        f"{of_rule(str(r.priority) for r in rules)} AS priority, {of_rule(quoted(r.label) for r in rules)} AS label)"
    )
    texts = F.expr(
        f"transform(ruled, x -> struct(x.place AS place, transform(transform(coalesce(x.ranks, array()), r -> {named}), n -> struct(n AS rule, "
        "regexp_extract(x.place.seen, concat(' ', n.pattern, '(?= )'), 0) AS text, "
        "if(n.part = 'all', '', regexp_extract(x.place.seen, concat(' ', n.pattern, '(?= )'), if(n.part = 'all', 0, 1))) AS part)) AS found))"
    )

    def span(place: Column, found: Column) -> Column:
        rule, text = found["rule"], found["text"]
        start = place["at"] - spaces(F.substring_index(text, "<", 1)) + 1
        last = place["at"] + spaces(F.substring_index(text, ">", -1))
        begin = F.when(rule["part"] == "tail", last - spaces(found["part"])).otherwise(start)
        end = F.when(rule["part"] == "head", start + spaces(found["part"])).otherwise(last)
        return F.struct(begin.cast("long").alias("start"), end.cast("long").alias("last"), rule["priority"].alias("priority"), rule["rank"].alias("rank"), rule["label"].alias("label"))

    def better(e: Column, d: Column) -> Column:
        longer = e["last"] - e["start"] > d["last"] - d["start"]
        same = (e["start"] == d["start"]) & (e["last"] == d["last"]) & (e["rank"] < d["rank"])
        return (e["start"] <= d["start"]) & (e["last"] >= d["last"]) & ((e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & (longer | same)))

    # Of one place: what nothing better covers, and unspecified licences only if there is nothing else.
    rows = rows.select("doc_id", "n_words", "places", ruled.alias("ruled")).select("doc_id", "n_words", "places", texts.alias("texts"))
    rows = rows.select("doc_id", "n_words", "places", F.transform("texts", lambda t: F.transform(t["found"], lambda f: span(t["place"], f))).alias("found"))
    own = F.transform("found", lambda found: F.filter(found, lambda d: ~F.exists(found, lambda e: better(e, d) | ((d["priority"] == 3) & (e["priority"] < 3)))))
    rows = rows.select("doc_id", "n_words", "places", own.alias("found"))
    spans = F.array_sort(F.flatten("found"))
    most = F.coalesce(F.array_max(F.transform("found", F.size)), F.lit(0))
    # A base phrase counts wherever its words stand, also where a better or longer rule was found first.
    base_spans = F.flatten(F.array(*[_base_places(*shape) for shape in _base_shapes(base)]))
    rows = rows.select("doc_id", "n_words", spans.alias("spans"), most.alias("most"), base_spans.alias("base"))

    def inside_better(d: Column, i: Column) -> Column:
        # A span has its keyword within it or less than LIST_SIDE words before it: only so many can contain another one.
        reach = F.col("most") * (2 * LIST_SIDE + 4 * SIDE)
        return F.exists(F.slice("spans", F.greatest(i - reach + 1, F.lit(1)), 2 * reach), lambda e: better(e, d))

    kept = F.filter("spans", lambda d, i: ~inside_better(d, i))
    rows = rows.select("doc_id", "n_words", "base", kept.alias("kept"))
    # A reserved right says nothing where a licence is named.
    named = (F.size("base") > 0) | F.exists("kept", lambda e: e["priority"] < 3)
    kept = F.filter("kept", lambda d: ~(named & (d["priority"] == 3) & (d["label"] == "proprietary")))
    kept = F.transform(kept, lambda d: F.struct(*[d[k].alias(k) for k in ("start", "last", "priority", "label")]))
    rows = rows.select("doc_id", "n_words", "base", F.array_distinct(kept).alias("kept"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), F.transform("kept", lambda d: d["label"]))))
    best = F.array_min(F.concat(F.transform("kept", lambda d: d["priority"]), F.transform("base", lambda b: b["priority"])))
    sure = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SURE.items() for x in kv]), best), F.lit(0.0))
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["start"])).alias("first_word"), F.array_max(F.transform("base", lambda b: b["start"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), sure.alias("score"), F.col("kept").alias("detections"),
    )


def _base_places(keyword: str, marked: str, lead: int, n: int, label: str) -> Column:
    here = F.filter("places", lambda p: (p["word"] == keyword) & F.contains(p["seen"], F.lit(f" {marked} ")))
    start = lambda p: (p["at"] - lead).cast("long")
    return F.transform(here, lambda p: F.struct(start(p).alias("start"), (start(p) + n - 1).alias("last"), F.lit(0).alias("priority"), F.lit(label).alias("label")))


def _base_shapes(base: Mapping[str, str]) -> Iterator[tuple[str, str, int, int, str]]:
    """Keyword, words with the keyword marked, place of the keyword, number of words, label."""
    for phrase, label in base.items():
        parts, keyword = phrase.split(), _base_keyword(phrase)
        lead = parts.index(keyword)
        yield keyword, " ".join([*parts[:lead], f"<{keyword}>", *parts[lead + 1 :]]), lead, len(parts), label
