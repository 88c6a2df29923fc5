"""License scans by ordered signature rules, in DataFrame functions only.

Rules are regular expressions over the words of a text. A rule is tried only where one of its keywords occurs,
and rules at all only where a word begins like an anchor. Both are read off the patterns: every match holds them. Of
overlapping detections one that lies inside another of higher or equal priority is suppressed, in one sweep over
the detections by start. Every step is local to its row: nothing is shuffled.
"""

from __future__ import annotations

import re
import re._constants as C
import re._parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .license_rules import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that are no part of a word: `[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` but A-Z.
_OTHER = "".join(chr(c) for c in range(128) if not (chr(c).isalnum()))
BASE = {"cc-by": ("cc", "by"), "gpl": ("general", "public", "license"), "reserved": ("all", "rights", "reserved")}

MOST = 12  # literals of a rule at most


def _ends_with_space(parsed) -> bool:
    op, arg = parsed[-1]
    if op is C.LITERAL:
        return chr(arg) == " "
    if op is C.BRANCH:
        return all(len(x) and _ends_with_space(x) for x in arg[1])
    return op is C.SUBPATTERN and _ends_with_space(arg[3])


def _all_texts(op, arg) -> list[str] | None:
    """All texts that a piece of a pattern matches, where they are few."""
    if op is C.LITERAL:
        return [chr(arg)]
    if op is C.IN and all(k is C.LITERAL for k, _ in arg):
        return [chr(c) for _, c in arg]
    if op is C.SUBPATTERN or op is C.BRANCH:
        found: list[str] = []
        for branch in [arg[3]] if op is C.SUBPATTERN else arg[1]:
            texts = [""]
            for piece in branch:
                more = _all_texts(*piece)
                if more is None or len(texts) * len(more) > MOST:
                    return None
                texts = [x + y for x in texts for y in more]
            found += texts
        return found if len(found) <= MOST else None
    return None


def required(pattern: str) -> list[tuple[list[str], bool]]:
    """Sets of literals of which every match of ``pattern`` holds one, and whether they begin at a word's start."""
    runs, texts, start, here = [], [""], True, True

    def close() -> None:
        if all(texts):
            runs.append((list(texts), start))

    for op, arg in P.parse(pattern):
        more = _all_texts(op, arg)
        if more is not None and len(texts) * len(more) <= MOST:
            texts = [x + y for x in texts for y in more]
            here = all(x.endswith(" ") for x in texts)
            continue
        close()
        optional = op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == 0
        body = arg[2] if op in (C.MAX_REPEAT, C.MIN_REPEAT) else [(op, arg)]
        here = _ends_with_space(body) and (here or not optional)
        texts, start = [""], here
        if more is not None:
            texts = more
            here = all(x.endswith(" ") for x in texts)
    texts = [f"{x} " for x in texts] if all(texts) else texts  # a match ends with its word
    close()
    return runs


def _keywords(pattern: str) -> list[str]:
    """The literals of :func:`required` that tell most: long without the word license, and few."""

    def worth(r: tuple[list[str], bool]) -> tuple[int, int, int]:
        least = min(len(x.replace("license", "")) for x in r[0])
        return min(8, least), -len(r[0]), least

    texts, start = max(required(pattern), key=worth)
    return [f" {x}" if start else x for x in texts]


def _anchor(keyword: str) -> str:
    """A space and the longest word of the literal, with a mark for its end where that is known; all of a literal without one."""
    *whole, begun = keyword.split(" ")[1:] if " " in keyword else [""]
    found = max([begun, *[w + _END for w in whole if w]], key=len)
    return f" {found}" if found else keyword


_END = "\n"


def _trie(words: list[str]) -> str:
    """A pattern that matches where one of ``words`` begins, one branch for each next character."""
    if "" in words:
        return ""
    heads = sorted({w[0] for w in words})
    parts = [P_ESCAPE.get(h, h) + _trie([w[1:] for w in words if w[0] == h]) for h in heads]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


P_ESCAPE = {c: f"\\{c}" for c in ".?+*()[]{}|^$\\"} | {_END: "(?= )"}
KEYWORDS = [_keywords(p) for *_, p in RULES]
ANCHORS = _trie(sorted({_anchor(k) for ks in KEYWORDS for k in ks}))


def _anchors(keywords: list[str]) -> list[str]:
    """What :data:`ANCHORS` finds of the keywords' anchors: the shortest anchor that each begins with."""
    return sorted({re.match(ANCHORS, _anchor(k).replace(_END, " ")).group() for k in keywords})


_FOUND = "array<struct<rule:int,label:string,priority:int,score:double,start:int,end:int>>"


def _rule_table() -> Column:
    rows = [
        F.struct(F.lit(i).alias("rule"), F.lit(a).alias("label"), F.lit(b).alias("priority"), F.lit(c).alias("score"), F.array(*map(F.lit, KEYWORDS[i])).alias("keywords"), F.array(*map(F.lit, _anchors(KEYWORDS[i]))).alias("anchors"), F.lit(f"(?<= )(?:{p})(?= )").alias("pattern"))
        for i, (a, b, c, p) in enumerate(RULES)
    ]
    return F.array(*rows)


def _detections(joined: Column, anchors: Column) -> Column:
    """All matches of rules that have one of ``anchors`` and whose keyword occurs: array<struct(rule, label, priority, score, start, end)>."""

    def places(r: Column) -> Column:
        def at(gaps: Column) -> Column:
            # Gaps and matches in turn; a place is the sum of all lengths before it.
            def step(acc: Column, x: Column) -> Column:
                start = acc["at"] + F.length(x["gap"])
                one = F.struct(r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), r["score"].alias("score"), start.alias("start"), (start + F.length(x["match"])).alias("end"))
                return F.struct((start + F.length(x["match"])).alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

            begin = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("found"))
            matches = F.regexp_extract_all(joined, r["pattern"], F.lit(0))
            pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
            return F.aggregate(pairs, begin, step)["found"]

        return let(F.split(joined, r["pattern"], F.lit(-1)), at)

    tried = F.filter(_rule_table(), lambda r: F.arrays_overlap(r["anchors"], anchors) & F.exists(r["keywords"], lambda k: F.contains(joined, k)))
    return F.flatten(F.transform(tried, places))


def _survivors(found: Column) -> Column:
    """The detections that lie inside no other of higher or equal priority; of equal places and priorities the first rule's stays.

    By start, longer and then higher ones first, whatever suppresses a detection comes before it. ``open`` holds
    those before that still reach beyond its start, and one character a detection says whether it stays."""
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["start"], (-d["end"]).alias("minus"), (-d["priority"]).alias("less"), d["rule"], d["label"], d["score"])))

    def step(acc: Column, d: Column) -> Column:
        still = F.filter(acc["open"], lambda e: e["end"] > d["start"])
        hidden = F.exists(still, lambda e: (e["end"] >= -d["minus"]) & (e["less"] <= d["less"]))
        here = F.array(F.struct((-d["minus"]).alias("end"), d["less"].alias("less")))
        return F.struct(F.when(hidden, still).otherwise(F.concat(still, here)).alias("open"), F.concat(acc["kept"], F.when(hidden, "0").otherwise("1")).alias("kept"))

    def stay(ds: Column) -> Column:
        begin = F.struct(F.array().cast("array<struct<end:int,less:int>>").alias("open"), F.lit("").alias("kept"))
        kept = F.split(F.aggregate(ds, begin, step)["kept"], "")
        left = F.filter(F.arrays_zip(ds.alias("d"), kept.alias("k")), lambda x: x["k"] == "1")
        return F.transform(left, lambda x: F.struct(x["d"]["rule"].alias("rule"), x["d"]["label"].alias("label"), (-x["d"]["less"]).alias("priority"), x["d"]["score"].alias("score"), x["d"]["start"].alias("start"), (-x["d"]["minus"]).alias("end")))

    return let(order, stay)


def _words(text: Column) -> Column:
    """Words in a text of words with one space around each, or their number before a place in it."""
    return F.greatest(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) - 1, F.lit(0))


def scan(text: Column) -> Column:
    """struct(n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of a text.

    Null and empty texts have no words, no places (null first and last), empty labels and score 0. Texts are scanned whole, however
    long; what is done follows their length and the number of detections. start and end count characters of the words joined by spaces.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHER, _LOWER + " " * len(_OTHER))

    def of_joined(joined: Column) -> Column:
        def base(label: str, phrase: tuple[str, ...]) -> Column:
            words = " ".join(phrase)

            def places(gaps: Column) -> Column:
                last = F.element_at(gaps, -1)
                return F.struct(F.lit(label).alias("label"), (F.size(gaps) - 1).alias("n"), _words(F.get(gaps, F.lit(0))).alias("first"), (_words(joined) - _words(last) - len(phrase)).alias("last"))

            found = let(F.split(joined, f"(?<= ){words}(?= )", F.lit(-1)), places)
            return F.when(F.contains(joined, F.lit(f" {words} ")), found)

        def of_base(b: Column) -> Column:
            none = F.array().cast(_FOUND)
            labels = F.transform(b, lambda x: x["label"])
            met = F.array_distinct(F.regexp_extract_all(joined, F.lit(ANCHORS), F.lit(0)))
            found = let(met, lambda anchors: F.when(F.size(anchors) > 0, let(_detections(joined, anchors), _survivors)).otherwise(none))
            return let(found, lambda d: F.struct(
                _words(joined).cast("long").alias("n_words"), F.aggregate(b, F.lit(0), lambda a, x: a + x["n"]).cast("long").alias("n_base"),
                F.array_min(F.transform(b, lambda x: x["first"])).cast("long").alias("first_word"), F.array_max(F.transform(b, lambda x: x["last"])).cast("long").alias("last_word"),
                F.array_join(F.array_sort(labels), ",").alias("base_labels"),
                F.array_join(F.array_sort(F.array_union(labels, F.transform(d, lambda x: x["label"]))), ",").alias("labels"),
                F.greatest(F.coalesce(F.array_max(F.transform(d, lambda x: x["score"])), F.lit(0.0)), F.when(F.size(b) > 0, 0.5).otherwise(0.0)).alias("score"),
                d.alias("detections"),
            ))

        return let(F.array_compact(F.array(*[base(k, p) for k, p in sorted(BASE.items())])), of_base)

    return let(F.regexp_replace(F.concat(F.lit(" "), spaced, F.lit(" ")), " {2,}", " "), of_joined)


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, and the fields of :func:`scan`. Repeated rows are scanned alike. An empty table gives an empty table."""
    return docs.select(*keep, scan(F.col(text_col)).alias("__s")).select(*keep, "__s.*")
