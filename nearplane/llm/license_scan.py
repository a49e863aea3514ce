"""License scans: normalised texts against licence templates by Dice over word bigrams, natively.

Dice >= t bounds sizes: a template of b bigrams can only match text of b t / (2 - t) to b (2 - t) / t
bigrams, so most lines meet no template at all and the rest only a few. Templates are a parameter of
bounded number and stand in the plan as a constant.

Beside lines and whole texts, runs of consecutive sentences are compared, within a line or across lines.
Whatever reaches the threshold against a template has most of its bigrams, and so one of a few words of the
template, the anchors; texts and lines without an anchor are passed over, and only texts that have enough of a
template's bigrams in all are cut into sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from fractions import Fraction
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_TEMPLATES = 1000
#: Notices in the wording commonly used with each licence, and below them whole licence texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
TEMPLATES |= {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
_SENTENCE = r"(?<=[.!?:;])\s+"
#: Words of everyday prose, which make poor anchors.
_COMMON = frozenset(
    """a about above after all also an and any are as at b be because been before being between both but by can could did do does
    each either etc every few first for from further general given had has have having he her here him his how i if in into is it
    its last less like made make making many may me means might mit more most must my new no non nor not now of off offer on once
    one only or other others otherwise our out over own part person s same section see shall she should so some such than that the
    their them then there these they this those through time to too two under until up upon use used using very was way we were
    what when where which while who will with within without would you your""".split()
)


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    w = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def size_bounds(b: int, threshold: float) -> tuple[int, int]:
    """The fewest and most bigrams that can reach the threshold against b, exactly; the threshold is read as a decimal."""
    t = Fraction(str(threshold))
    return math.ceil(b * t / (2 - t)), math.floor(b * (2 - t) / t)


def fewest_common(b: int, threshold: float) -> int:
    """The fewest bigrams that a text shares with a template of b when it reaches the threshold."""
    return math.ceil(Fraction(str(threshold)) * (size_bounds(b, threshold)[0] + b) / 2)


def anchor_words(known: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which every text that reaches the threshold against a template has one; rare ones if possible."""
    chosen: list[str] = []
    for grams in sorted(known.values(), key=len):
        left = [g.split() for g in grams if not set(g.split()) & set(chosen)]
        while len(left) >= fewest_common(len(grams), threshold):
            count = Counter(w for g in left for w in set(g))
            chosen.append(max(sorted(count), key=lambda w: (w not in _COMMON and not w.isdigit(), count[w])))
            left = [g for g in left if chosen[-1] not in g]
    return chosen


def _by_first(words: list[str]) -> str:
    """A pattern of any of words that looks at a letter once."""
    first = {c: sorted(w[1:] for w in words if w[0] == c) for c in sorted({w[0] for w in words})}
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items())


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _runs(lines: Column, known: dict[str, list[str]], threshold: float) -> Column:
    """Runs of sentences that reach the threshold: from and to (sentences), line, last (line), whole, common, dice, license.

    Of runs of one template that overlap the best stays, of runs of several that with most bigrams in common.
    """
    gram = lambda b: F.split(F.lit("|".join(b)), "[|]")
    low = lambda b: size_bounds(len(b), threshold)
    table = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(len(b)).alias("b"), F.lit(low(b)[0]).alias("lo"), F.lit(low(b)[1]).alias("hi"), F.lit(fewest_common(len(b), threshold)).alias("need"), gram(b).alias("grams")) for k, b in known.items()))
    cut = F.flatten(F.transform(lines, lambda x, i: F.transform(F.split(x, _SENTENCE), lambda y: F.struct(i.cast("long").alias("line"), _words(y).alias("w")))))
    cut = F.filter(cut, lambda x: x["w"][0] != "")
    overlap = lambda x, y: (x["from"] <= y["to"]) & (y["from"] <= x["to"])
    none = F.expr("cast(array() as array<struct<key:struct<far:double,size:int,from:int>,from:int,to:int,line:bigint,last:bigint,whole:boolean,common:int,dice:double,license:string>>)")
    start = F.expr("named_struct('w', cast(array() as array<string>), 'open', true, 'dice', cast(0 as double), 'common', 0, 'to', 0)")

    def grow(s: Column, t: Column, i: Column) -> Column:
        """The best run from sentence i."""

        def step(acc: Column, j: Column) -> Column:
            def scored(w: Column, g: Column, common: Column) -> Column:
                n = F.size(g)
                dice = 2.0 * common / (n + t["b"])
                better = (n >= t["lo"]) & (n <= t["hi"]) & (dice > acc["dice"])
                return F.struct(w.alias("w"), (n <= t["hi"]).alias("open"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, common).otherwise(acc["common"]).alias("common"), F.when(better, j).otherwise(acc["to"]).alias("to"))

            more = lambda w: F.when(F.size(w) <= t["lo"], F.struct(w.alias("w"), F.lit(True).alias("open"), acc["dice"].alias("dice"), acc["common"].alias("common"), acc["to"].alias("to"))).otherwise(_let(_bigrams(w), lambda g: _let(F.size(F.array_intersect(g, t["grams"])), lambda c: scored(w, g, c))))
            return F.when(~acc["open"], acc).otherwise(_let(F.concat(acc["w"], s[j]["w"]), more))

        best = F.aggregate(F.sequence(i, F.size(s) - 1), start, step)
        return _let(best, lambda r: F.struct(F.struct((-r["dice"]).alias("far"), (r["to"] - i).alias("size"), i.alias("from")).alias("key"), i.alias("from"), r["to"].alias("to"), s[i]["line"].alias("line"), s[r["to"]]["line"].alias("last"), ((i == 0) & (r["to"] == F.size(s) - 1)).alias("whole"), r["common"].alias("common"), r["dice"].alias("dice"), t["license"].alias("license")))

    def of_template(s: Column, t: Column) -> Column:
        # a best run begins with a bigram of the template, or the sentence would only lower its Dice
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.arrays_overlap(_bigrams(F.when(i + 1 < F.size(s), F.concat(s[i]["w"], F.slice(s[F.least(i + 1, F.size(s) - 1)]["w"], 1, 1))).otherwise(s[i]["w"])), t["grams"]))
        found = F.array_sort(F.filter(F.transform(begins, lambda i: grow(s, t, i)), lambda r: r["dice"] >= threshold))
        return F.aggregate(found, none, lambda acc, r: F.when(F.exists(acc, lambda x: overlap(x, r)), acc).otherwise(F.concat(acc, F.array(r))))

    def of_text(s: Column) -> Column:
        live = _let(_bigrams(F.flatten(F.transform(s, lambda x: x["w"]))), lambda g: F.filter(table, lambda t: (F.size(g) >= t["need"]) & (F.size(F.array_intersect(g, t["grams"])) >= t["need"])))
        most = lambda r: F.struct(r["common"], r["dice"], -r["from"], r["license"])
        return _let(F.flatten(F.transform(live, lambda t: of_template(s, t))), lambda all_: F.filter(all_, lambda r: ~F.exists(all_, lambda x: overlap(x, r) & (most(x) > most(r)))))

    return _let(cut, lambda s: F.when(F.size(s) > 0, of_text(s)).otherwise(none))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, line, license, dice of every line (from 0), or whole text (line -1), that is like a template.

    Only the best template of a line is given, ties by name; a text of one line is only compared as its
    line. A run of sentences that is like a template is given with its first line, unless it lies in a line
    that is given, is the whole text, or has a line given for the same licence. Text is normalised to
    lower-case words of a-z and 0-9. Null and empty texts give no rows; texts of a row that repeats give
    rows each; other columns are not read; an empty table gives no rows.
    """
    known = {n: template_bigrams(t) for n, t in sorted((templates or TEMPLATES).items())}
    known = {n: b for n, b in known.items() if b}
    if not 0 < len(known) <= MAX_TEMPLATES:
        raise ValueError(f"from 1 to {MAX_TEMPLATES} templates of two words at least")
    bounds = {n: size_bounds(len(b), threshold) for n, b in known.items()}
    fewest, most = min(lo for lo, _ in bounds.values()), max(hi for _, hi in bounds.values())

    def best(bigrams: Column) -> Column:
        n = F.size(bigrams)
        scored = [F.when(n.between(*bounds[k]), F.struct((2.0 * F.size(F.array_intersect(bigrams, F.split(F.lit("|".join(b)), "[|]"))) / (n + len(b))).alias("dice"), F.lit(k).alias("license"))) for k, b in known.items()]
        none = F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("license"))
        return F.when(n.between(fewest, most), F.aggregate(F.array(*scored), none, lambda a, x: F.when(x["dice"] > a["dice"], x).otherwise(a)))

    anchor = rf"(?<![a-z0-9])(?:{_by_first(anchor_words(known, threshold))})(?![a-z0-9])"
    anchored = lambda text: F.lower(text).rlike(anchor)

    def hit(unit: Column) -> Column:
        words = _words(unit)
        # a unit of n characters has (n + 1) / 2 words at most
        return F.when((F.length(unit) >= 2 * fewest + 1) & anchored(unit), _let(words, lambda w: F.when(F.size(w) > fewest, _let(_bigrams(w), best))))

    none = "cast(array() as array<struct<line:bigint,unit:string>>)"
    whole = F.when(F.size("lines") > 1, F.array(F.struct(F.lit(-1).cast("long").alias("line"), F.col("text").alias("unit")))).otherwise(F.expr(none))
    units = F.concat(whole, F.transform("lines", lambda x, i: F.struct(i.cast("long").alias("line"), x.alias("unit"))))
    found = F.filter(F.transform(units, lambda u: F.struct(u["line"].alias("line"), hit(u["unit"]).alias("b"))), lambda x: x["b"]["dice"] >= threshold)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = texts.where(F.col("text").isNotNull() & anchored(F.col("text"))).select("doc_id", "text", F.split("text", "\n").alias("lines"))
    # line units from 0 are all lines, so a run's own line is told by its number
    fresh = lambda r, h: ~r["whole"] & ~F.exists(h, lambda x: (x["line"] >= r["line"]) & (x["line"] <= r["last"]) & ((r["line"] == r["last"]) | (x["b"]["license"] == r["license"])))
    as_hit = lambda r: F.struct(r["line"].alias("line"), F.struct(r["dice"].alias("dice"), r["license"].alias("license")).alias("b"))
    runs = lambda h: F.concat(h, F.transform(F.filter(_runs(F.col("lines"), known, threshold), lambda r: fresh(r, h)), as_hit))
    hits = lines.select("doc_id", F.explode(_let(found, runs)).alias("h"))
    return hits.select("doc_id", "h.line", "h.b.license", F.round("h.b.dice", 6).alias("dice"))
