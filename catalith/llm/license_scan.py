"""License detections by ordered signature rules, in DataFrame functions only.

A rule is a label, a priority, a keyword and a regular expression over a text's words, one blank between two words.
The words that a rule's expression can't do without decide which texts are looked at (gate_of), a keyword that all its
alternatives hold decides which rules look at a text. A detection is an interval of words; it is suppressed when an
interval of a rule that ranks at least as high contains it.
"""

from __future__ import annotations

from re import _constants, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import ascii_lower, bound, count_runs

#: Words are runs of digits, letters and everything beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What separates words of a text not yet lower-cased.
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Expressions that match an ordinary word (German 'mit'), and the strings of which the text must hold one besides.
UNSURE = {r"(?:mit(?: x11)?(?: open source)?)": ("cc", "copyleft", "copyright", "domain", "gpl", "licen", "rights", "spdx")}
#: Confidence by priority.
CONFIDENCE = (0.0, 0.4, 0.6, 0.8, 0.95, 1.0)
_V = r"(?: v(?:ersion)?)?"
#: label, keyword, name (a regular expression over words), SPDX words.
LICENSES = (
    ("mit", "mit", r"mit(?: x11)?(?: open source)?", "mit"),
    ("mit-0", "mit", r"mit no attribution", "mit 0"),
    ("x11", "x11", r"x11", "x11"),
    ("isc", "isc", r"isc", "isc"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd 2 clause", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new|revised|modified|3 clause|three clause) bsd|bsd 3 clause", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd|bsd 4 clause", "bsd 4 clause"),
    ("0bsd", "bsd", r"(?:zero clause|free public|0) bsd|0bsd", "0bsd"),
    ("bsd", "bsd", r"bsd(?: style)?", "bsd"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?" + _V + r" 1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?" + _V + r" 2(?: 0)?", "apache 2 0"),
    ("apache", "apache", r"apache(?: software)?", "apache"),
    ("gpl-1.0", "g", r"(?:gnu )?(?:general public(?: license)?|gpl)" + _V + r" 1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "g", r"(?:gnu )?(?:general public(?: license)?|gpl)" + _V + r" 2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "g", r"(?:gnu )?(?:general public(?: license)?|gpl)" + _V + r" 3(?: 0)?", "gpl 3 0"),
    ("gpl", "g", r"gnu general public|gnu gpl|gpl", "gpl"),
    ("lgpl-2.0", "l", r"(?:gnu )?(?:library general public(?: license)?|lgpl)" + _V + r" 2(?: 0)?", "lgpl 2 0"),
    ("lgpl-2.1", "l", r"(?:gnu )?(?:lesser general public(?: license)?|lgpl)" + _V + r" 2 1", "lgpl 2 1"),
    ("lgpl-3.0", "l", r"(?:gnu )?(?:lesser general public(?: license)?|lgpl)" + _V + r" 3(?: 0)?", "lgpl 3 0"),
    ("lgpl", "l", r"gnu (?:lesser|library) general public|gnu lgpl|lgpl", "lgpl"),
    ("agpl-1.0", "affero", r"affero general public(?: license)?" + _V + r" 1(?: 0)?", "agpl 1 0"),
    ("agpl-3.0", "gpl", r"agpl" + _V + r" 3(?: 0)?", "agpl 3 0"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public(?: license)?" + _V + r" 3(?: 0)?", "agpl 3 0 or later"),
    ("agpl", "affero", r"(?:gnu )?affero general public", "agpl"),
    ("gfdl", "g", r"gnu free documentation|gfdl", "gfdl"),
    ("mpl-1.0", "mozilla", r"mozilla public(?: license)?" + _V + r" 1 0", "mpl 1 0"),
    ("mpl-1.1", "mozilla", r"mozilla public(?: license)?" + _V + r" 1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public(?: license)?" + _V + r" 2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public", "mpl"),
    ("epl-1.0", "eclipse", r"eclipse public(?: license)?" + _V + r" 1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public(?: license)?" + _V + r" 2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse", r"eclipse public|eclipse distribution", "epl"),
    ("cddl-1.0", "cddl", r"cddl" + _V + r" 1(?: 0)?", "cddl 1 0"),
    ("cddl", "distribution", r"common development and distribution", "cddl"),
    ("cpl-1.0", "common", r"common public(?: license)?" + _V + r" 1(?: 0)?", "cpl 1 0"),
    ("eupl-1.1", "european", r"european union public(?: license| licence)?" + _V + r" 1 1", "eupl 1 1"),
    ("eupl-1.2", "european", r"european union public(?: license| licence)?" + _V + r" 1 2", "eupl 1 2"),
    ("eupl", "european", r"european union public", "eupl"),
    ("artistic-1.0", "artistic", r"artistic(?: license)?" + _V + r" 1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic(?: license)?" + _V + r" 2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", r"(?:perl )?artistic", "artistic"),
    ("psf", "p", r"python software foundation|psf", "psf 2 0"),
    ("python", "python", r"python(?: 2 0)?", "python 2 0"),
    ("zlib", "zlib", r"zlib(?: libpng)?", "zlib"),
    ("libpng", "libpng", r"libpng", "libpng"),
    ("openssl", "openssl", r"openssl", "openssl"),
    ("boost-1.0", "boost", r"boost software(?: license)?" + _V + r"(?: 1(?: 0)?)?", "bsl 1 0"),
    ("busl-1.1", "business", r"business source(?: license)?(?: 1 1)?", "busl 1 1"),
    ("elastic-2.0", "elastic", r"elastic(?: license)?(?: 2(?: 0)?)?", "elastic 2 0"),
    ("sspl-1.0", "server", r"server side public(?: license)?(?: 1)?", "sspl 1 0"),
    ("polyform-nc", "polyform", r"polyform noncommercial", "polyform noncommercial 1 0 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "what", r"do what the fuck you want to public", "wtfpl"),
    ("beerware", "beer", r"beer ?ware", "beerware"),
    ("ofl-1.1", "font", r"(?:sil )?open font(?: license)?" + _V + r"(?: 1 1)?", "ofl 1 1"),
    ("ms-pl", "microsoft", r"microsoft public", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal", "ms rl"),
    ("nasa-1.3", "nasa", r"nasa open source(?: agreement)?(?: 1 3)?", "nasa 1 3"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)?(?: open source)?", "ncsa"),
    ("osl-3.0", "open", r"open software(?: license)?" + _V + r" 3(?: 0)?", "osl 3 0"),
    ("afl-3.0", "academic", r"academic free(?: license)?" + _V + r" 3(?: 0)?", "afl 3 0"),
    ("ecl-2.0", "educational", r"educational community(?: license)?" + _V + r" 2(?: 0)?", "ecl 2 0"),
    ("upl-1.0", "universal", r"universal permissive(?: license)?(?: 1 0)?", "upl 1 0"),
    ("vim", "vim", r"vim", "vim"),
    ("php-3.01", "php", r"php(?: license)?" + _V + r"(?: 3 01)?", "php 3 01"),
    ("ruby", "ruby", r"ruby", "ruby"),
    ("postgresql", "postgresql", r"postgresql", "postgresql"),
    ("curl", "curl", r"curl", "curl"),
    ("icu", "c", r"unicode(?: dfs 2016)?|icu", "icu"),
    ("w3c", "w3c", r"w3c(?: software)?", "w3c"),
    ("odbl-1.0", "database", r"open (?:data commons )?(?:open )?database(?: license)?(?: 1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "commons", r"open data commons attribution(?: license)?(?: 1 0)?", "odc by 1 0"),
    ("pddl-1.0", "domain", r"public domain dedication and license", "pddl 1 0"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?", "cc by nc nd 4 0"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?", "cc by nc sa 4 0"),
    ("cc-by-nc-4.0", "cc", r"cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc-3.0", "cc", r"cc by nc 3 0", "cc by nc 3 0"),
    ("cc-by-nc-2.0", "cc", r"cc by nc 2 0", "cc by nc 2 0"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?", "cc by nd 4 0"),
    ("cc-by-sa-4.0", "cc", r"cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-sa-3.0", "cc", r"cc by sa 3 0", "cc by sa 3 0"),
    ("cc-by-sa", "cc", r"cc by sa", "cc by sa 2 5"),
    ("cc-by-4.0", "cc", r"cc by 4 0", "cc by 4 0"),
    ("cc-by-3.0", "cc", r"cc by 3 0", "cc by 3 0"),
    ("cc-by", "cc", r"cc by", "cc by 2 5"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?", "cc by nc nd 3 0"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "cc by nc sa 3 0"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?", "cc by nc 2 5"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?", "cc by nd 3 0"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?", "cc by sa 2 0"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?", "cc by 2 0"),
    ("cc0-1.0", "creative", r"creative commons (?:zero|public domain dedication)", "cc0 universal"),
    ("cc", "creative", r"creative commons", "cc"),
)
#: label, priority, keyword, regular expression: notices that name no license in the usual form.
NOTICES = (
    ("all-rights-reserved", 2, "rights", r"all rights reserved"),
    ("proprietary", 3, "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 2, "licen", r"proprietary licen[sc]e"),
    ("commercial", 2, "licen", r"commercial licen[sc]e"),
    ("public-domain", 3, "domain", r"(?:released|placed|dedicated|donated)(?: in)?(?: in)?to the public domain"),
    ("public-domain", 2, "domain", r"(?:in|is|of) the public domain"),
    ("mit", 4, "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 4, "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 4, "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", 4, "warranty", r"provided as is without any express or implied warranty in no event will the authors"),
    ("gpl", 4, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 4, "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("boost-1.0", 4, "boost", r"distributed under the boost software license version 1 0"),
    ("unlicense", 4, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", 4, "what", r"you just do what the fuck you want to"),
    ("mit", 2, "mit", r"mit(?: x11)? open source|mit x11"),
    ("copyleft", 1, "copyleft", r"copyleft"),
    ("unknown", 1, "licen", r"licen[sc]ed under"),
)


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, expression) in order: base phrases, then the signatures of each license, then notices."""
    out = [(label, 5, phrase.split()[-2], phrase) for label, phrase in BASE]
    for label, keyword, name, spdx in LICENSES:
        out += [
            (label, 4, "spdx", rf"spdx licen[sc]e identifier {spdx}(?: only| or later)?"),
            (label, 4, keyword, rf"(?:licen[sc]ed|released|distributed|available|published|redistributed|provided)(?: only)? under (?:the )?(?:terms of (?:the )?)?(?:{name})(?: (?:public )?licen[sc]e)?(?:{_V} [1-4](?: [0-9])?)?"),
            (label, 3, keyword, rf"(?:{name})(?: public)? licen[sc]e(?:{_V} [1-4](?: [0-9])?)?"),
        ]
        if " " in name or "[" in name:
            out.append((label, 2, keyword, rf"(?:{name})"))
    out += [tuple(x) for x in NOTICES]
    return out


def needs(x: str) -> list[tuple[str, ...]]:
    """What a lower-cased text must hold for x to match its words: of each tuple one string.

    The literals of x itself, cut at blanks, and of each group with alternatives the longest literal of every one. Optional
    parts need nothing.
    """
    return _needs(_parser.parse(x))


def _needs(parsed) -> list[tuple[str, ...]]:
    out, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if op is _constants.LITERAL and arg != 32:
            run += chr(arg)
            continue
        if run:
            out.append((run,))
        run = ""
        if op is _constants.SUBPATTERN:
            out += _needs(arg[3])
        elif op is _constants.BRANCH:
            each = [_needs(a) for a in arg[1]]
            if all(each):  # of an alternative, the tuple whose shortest string is longest
                out.append(tuple(sorted({w for a in each for w in max(a, key=lambda c: (min(map(len, c)), -len(c)))})))
    return out


def gate_of(items: list[tuple[str, int, str, str]]) -> list[list[tuple[str, ...]]]:
    """The needs of all rules, without those that another's imply; a text that meets none of them matches no rule.

    The rules that say 'license' need 'licen'; those that say 'released under' and the like need that verb and 'under'.
    """
    found = set()
    for _, _, _, x in items:
        n = {*needs(x), *([UNSURE[x]] if x in UNSURE else [])}
        wide = [c for c in n if c == ("licen",) or "released" in c and len(c) > 1]
        if ("licen",) in wide:
            n = {("licen",)}
        elif wide and ("under",) in n:
            n = {*wide, ("under",)}
        found.add(frozenset(n))
    least = [n for n in found if not any(o < n for o in found)]
    longest = lambda c: -min(map(len, c))
    return sorted((sorted(n, key=lambda c: (longest(c), c)) for n in least), key=lambda n: (len(n), n))


def words_of(text: Column) -> Column:
    """' w1 w2 ... ' of a lower-cased text; ' ' if it has no words."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(ascii_lower(text), F.lit(" ")), SEPARATORS, " ")))


def _rule_array(items: list[tuple[str, int, str, str]]) -> Column:
    return F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(p).alias("p"), F.lit(k).alias("k"), F.lit(f"(?<= )({x})(?= )").alias("x"), F.lit(i).alias("i"), F.array(*[F.lit(w) for w in UNSURE.get(x, ())]).cast("array<string>").alias("besides"))
        for i, (label, p, k, x) in enumerate(items)
    ])


def detections(norm: Column, items: list[tuple[str, int, str, str]]) -> Column:
    """array of (s, e, p, i, label): the word interval [s, e) of every match of every rule, by s, longest first."""

    def found(r: Column) -> Column:
        # a mark before the first word of each match; the marked words' places are the matches' starts
        marked = F.split(F.trim(F.regexp_replace(norm, r["x"], F.lit("\x01$1"))), " ")
        starts = F.filter(F.transform(marked, lambda w, j: F.when(w.startswith("\x01"), j)), lambda j: j.isNotNull())
        texts = F.regexp_extract_all(norm, r["x"], F.lit(1))
        return F.zip_with(starts, texts, lambda s, t: F.struct(
            s.alias("s"), (s + F.size(F.split(t, " "))).alias("e"), r["p"].alias("p"), r["i"].alias("i"), r["label"].alias("label")
        ))

    gated = F.filter(_rule_array(items), lambda r: F.contains(norm, r["k"]) & ((F.size(r["besides"]) == 0) | F.exists(r["besides"], lambda w: F.contains(norm, w))))
    return F.flatten(F.transform(F.filter(gated, lambda r: F.call_function("rlike", norm, r["x"])), found))


def kept(found: Column) -> Column:
    """Without the detections that one of at least their priority contains (of equals, the first rule stays).

    One sweep in the order (start, longest first, priority, rule): a detection is contained by an earlier one exactly if
    that ends no sooner, so the furthest end for each priority so far decides. Base detections always stay.
    """
    order = F.array_sort(F.transform(found, lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("e"), (-d["p"]).alias("p"), d["i"].alias("i"), d["label"].alias("label"))))
    ends = F.array(*[F.lit(-1)] * 6)
    zero = F.struct(ends.alias("ends"), F.array().cast("array<struct<s:int,e:int,p:int,label:string>>").alias("out"))

    def step(acc: Column, d: Column) -> Column:
        e, p = -d["e"], -d["p"]
        inside = (p < 5) & F.exists(F.slice(acc["ends"], p + 1, F.lit(6)), lambda x: x >= e)
        one = F.array(F.struct(d["s"].alias("s"), e.alias("e"), p.alias("p"), d["label"].alias("label")))
        return F.struct(
            F.transform(acc["ends"], lambda x, j: F.when(j == p, F.greatest(x, e)).otherwise(x)).alias("ends"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"),
        )

    return F.aggregate(order, zero, step, lambda acc: acc["out"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections of each row.

    detections are the (s, e, p, label) that stay. A null text is empty: no words, no labels (''), score 0, null first
    and last word. One row for each input row, whatever its doc_id; other columns are ignored. No shuffle.
    """
    items = rules()
    ways = F.array(*[F.array(*[F.array(*[F.lit(w) for w in c]) for c in n]) for n in gate_of(items)])
    gate = bound(F.lower(F.col("text")), lambda low: F.exists(ways, lambda n: F.forall(n, lambda c: F.exists(c, lambda w: F.contains(low, w)))))
    d = docs.select("doc_id", "text").withColumn("n_words", count_runs(F.col("text"), BETWEEN))
    d = d.withColumn("norm", F.when(gate, words_of(F.col("text"))))
    empty = F.array().cast("array<struct<s:int,e:int,p:int,i:int,label:string>>")
    d = d.withColumn("found", F.coalesce(F.when(F.col("norm").isNotNull(), detections(F.col("norm"), items)), empty)).drop("text", "norm")
    base = F.filter("found", lambda x: x["p"] == 5)
    d = d.withColumn("base", base).withColumn("detections", F.when(F.size("found") > 0, kept(F.col("found"))).otherwise(F.array().cast("array<struct<s:int,e:int,p:int,label:string>>")))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    confidence = F.array(*[F.lit(x) for x in CONFIDENCE])
    return d.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["s"])).cast("long").alias("first_word"), F.array_max(F.transform("base", lambda x: x["s"])).cast("long").alias("last_word"),
        names("base").alias("base_labels"), names("detections").alias("labels"),
        F.when(F.size("detections") > 0, F.element_at(confidence, F.array_max(F.transform("detections", lambda x: x["p"])) + 1)).otherwise(F.lit(0.0)).alias("score"), "detections",
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
