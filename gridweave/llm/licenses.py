"""License scan: ordered signature rules behind a keyword prefilter.

A text is read as words (runs of letters, digits and non-ASCII characters, A-Z lower-cased). Texts that
hold no keyword and no word of the gate are done after the prefilter; the gate is made from the rules, so
that it holds back no text in which one matches. In the others every rule is tried where its first
word, the anchor, stands, on that word and the ``REACH`` words after it. Overlaps are resolved by interval
containment: of two detections of which one contains the other, the one with the stronger priority stays,
and at equal priority the longer one, then the one whose rule comes first.

All of it is one projection of DataFrame functions, so documents are never shuffled, whatever their ids,
and copies of a row are scanned each for itself. Null text counts as empty: no words, no labels, score 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import ascii_lower, text_or_empty

#: A word before and after lower-casing A-Z.
WORD_ANY_CASE = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Words after an anchor that a rule may cover; no rule is longer.
REACH = 30

#: Phrases that are reported wherever they stand, whatever the rules say.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: What most rules hold, in any place of a text and in any order. A rule without any is found by its anchor (``gate_words``).
KEYWORDS = ("licen", "gpl", "bsd", "copyright", "copyleft", "spdx", "public domain", "creative", "rights reserved", "wtfpl", "free of charge", "redistribution")

SPECIFIC, FAMILY, NOTICE = 1, 2, 3
CONFIDENCE = {SPECIFIC: 1.0, FAMILY: 0.8, NOTICE: 0.5}


@dataclass(frozen=True)
class Rule:
    """A regular expression over words joined by blanks; its first word is ``anchor``."""

    anchor: str
    pattern: str
    label: str
    priority: int


LICENCE = "licen[cs]e"


def _gnu() -> list[Rule]:
    kinds = {
        "gpl": ("general public", ("1", "2", "3")),
        "lgpl": ("(?:lesser|library) general public", ("2", "2 1", "3")),
        "agpl": ("affero general public", ("1", "3")),
        "gfdl": ("free documentation", ("1 1", "1 2", "1 3")),
    }
    tails = {
        "-or-later": " (?:only )?(?:of the license )?or (?:at your option )?(?:any )?later(?: version)?",
        "-only": " only",
        "": "",
    }
    rules = []
    for short, (name, versions) in kinds.items():
        for version in versions:
            number = version if " " in version else f"{version}(?: 0)?"
            label = f"{short}-{version.replace(' ', '.') if ' ' in version else version + '.0'}"
            for suffix, tail in tails.items():
                said = f"(?: v| version)? ?{number}{tail}"
                rules += [
                    Rule("gnu", f"gnu {name} {LICENCE}{said}", label + suffix, SPECIFIC),
                    Rule("gnu", f"gnu {name} {LICENCE} as published by the free software foundation(?: either)?{said}", label + suffix, SPECIFIC),
                    Rule("gnu", f"gnu {short}{said}", label + suffix, SPECIFIC),
                    Rule(short, f"{short}{said}", label + suffix, SPECIFIC),
                    Rule(f"{short}v{version[0]}", f"{short}v{version}{tail}", label + suffix, SPECIFIC),
                ]
        rules += [
            Rule("gnu", f"gnu {name} {LICENCE}", short, FAMILY),
            Rule("gnu", f"gnu {short}", short, FAMILY),
            Rule(short, f"{short} licen[cs]ed?", short, FAMILY),
        ]
    return rules


def _creative_commons() -> list[Rule]:
    words = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
    rules = []
    for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        long = " ".join(words[w] for w in kind.split())
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{kind} {version.replace(' ', '.')}".replace(" ", "-")
            rules += [
                Rule("cc", f"cc {kind} {version}", label, SPECIFIC),
                Rule("creative", f"creative commons {long} {version}", label, SPECIFIC),
                Rule("creative", f"creative commons {long} (?:international |unported |generic )?{LICENCE}(?: version)? {version}", label, SPECIFIC),
                Rule("creativecommons", f"creativecommons org licenses {kind} {version}", label, SPECIFIC),
            ]
        label = f"cc-{kind}".replace(" ", "-")
        rules += [Rule("cc", f"cc {kind}", label, FAMILY), Rule("creative", f"creative commons {long}(?: {LICENCE})?", label, FAMILY)]
    return [
        *rules,
        Rule("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0-1.0", SPECIFIC),
        Rule("creative", "creative commons zero(?: v?1 0)?(?: universal)?", "cc0-1.0", SPECIFIC),
        Rule("creativecommons", "creativecommons org publicdomain zero 1 0", "cc0-1.0", SPECIFIC),
        Rule("creative", f"creative commons {LICENCE}", "cc", FAMILY),
    ]


def _versioned() -> list[Rule]:
    """Licenses named by a word or two and a version."""
    names = {
        "apache": ("apache(?: software)?", ("1 0", "1 1", "2 0"), ()),
        "mpl": ("mozilla public", ("1 0", "1 1", "2 0"), ("mpl",)),
        "epl": ("eclipse public", ("1 0", "2 0"), ("epl",)),
        "cddl": ("common development and distribution", ("1 0", "1 1"), ("cddl",)),
        "eupl": ("european union public", ("1 0", "1 1", "1 2"), ("eupl",)),
        "osl": ("open software", ("1 0", "2 0", "2 1", "3 0"), ("osl",)),
        "afl": ("academic free", ("1 1", "1 2", "2 0", "2 1", "3 0"), ("afl",)),
        "artistic": ("artistic", ("1 0", "2 0"), ()),
        "bsl": ("boost software", ("1 0",), ("bsl",)),
        "cpl": ("common public", ("1 0",), ("cpl",)),
        "lppl": ("latex project public", ("1 0", "1 1", "1 2", "1 3"), ("lppl",)),
        "ofl": ("sil open font", ("1 0", "1 1"), ("ofl",)),
        "odbl": ("open database", ("1 0",), ("odbl",)),
        "zpl": ("zope public", ("1 1", "2 0", "2 1"), ("zpl",)),
    }
    rules = []
    for short, (name, versions, codes) in names.items():
        anchor = name.split("(")[0].split()[0]
        for version in versions:
            label = f"{short}-{version.replace(' ', '.')}"
            number = f"(?: v| version)? ?{version.replace(' 0', '(?: 0)?') if version.endswith(' 0') else version}"
            rules.append(Rule(anchor, f"{name} {LICENCE}{number}", label, SPECIFIC))
            rules += [Rule(code, f"{code}{number}", label, SPECIFIC) for code in codes]
            if short in ("apache", "artistic"):
                rules.append(Rule(short, f"{short} {version}", label, SPECIFIC))
        rules.append(Rule(anchor, f"{name} {LICENCE}", short, FAMILY))
    return [*rules, Rule("apache", "apache org licenses license 2 0", "apache-2.0", SPECIFIC)]


def _plain() -> list[Rule]:
    rules = []
    for words, n in (("2 clause", "2"), ("two clause", "2"), ("3 clause", "3"), ("three clause", "3"), ("4 clause", "4"), ("four clause", "4")):
        rules += [
            Rule("bsd", f"bsd {words}(?: {LICENCE})?", f"bsd-{n}-clause", SPECIFIC),
            Rule(words.split()[0], f"{words} bsd(?: {LICENCE})?", f"bsd-{n}-clause", SPECIFIC),
        ]
    for qualifier, label in (("new", "bsd-3-clause"), ("revised", "bsd-3-clause"), ("modified", "bsd-3-clause"), ("simplified", "bsd-2-clause"), ("original", "bsd-4-clause")):
        rules.append(Rule(qualifier, f"{qualifier} bsd {LICENCE}", label, SPECIFIC))
    for name, label in (("bsd", "bsd"), ("mit", "mit"), ("isc", "isc"), ("zlib", "zlib"), ("x11", "x11"), ("expat", "mit"), ("ncsa", "ncsa"), ("curl", "curl"), ("openssl", "openssl"), ("unicode", "unicode"), ("python", "psf")):
        rules += [
            Rule(name, f"{name} {LICENCE}", label, SPECIFIC if label == "mit" else FAMILY),
            Rule(name, f"{name} style {LICENCE}", f"{label}-style", SPECIFIC),
        ]
    return [
        *rules,
        Rule("0bsd", "0bsd", "0bsd", SPECIFIC),
        Rule("unlicense", "unlicense", "unlicense", SPECIFIC),
        Rule("wtfpl", "wtfpl", "wtfpl", SPECIFIC),
        Rule("beerware", f"beerware {LICENCE}", "beerware", SPECIFIC),
        Rule("permission", "permission is hereby granted free of charge to any person obtaining a copy", "mit", SPECIFIC),
        Rule("permission", "permission to use copy modify and or distribute this software for any purpose", "isc", SPECIFIC),
        Rule("redistribution", "redistribution and use in source and binary forms with or without modification are permitted", "bsd", FAMILY),
        Rule("this", "this is free and unencumbered software released into the public domain", "unlicense", SPECIFIC),
        Rule("released", "released into the public domain", "public-domain", FAMILY),
        Rule("dedicated", "dedicated to the public domain", "public-domain", FAMILY),
        Rule("in", "in the public domain", "public-domain", NOTICE),
        Rule("all", "all rights reserved", "all-rights-reserved", FAMILY),
        Rule("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright-notice", NOTICE),
        Rule("licensed", f"licensed under (?:[^ ]+ ){{1,8}}{LICENCE}(?: version)?(?: v?[0-9]+)?(?: [0-9]+)?", "license-notice", NOTICE),
        Rule("released", f"released under (?:[^ ]+ ){{1,8}}{LICENCE}(?: version)?(?: v?[0-9]+)?(?: [0-9]+)?", "license-notice", NOTICE),
        Rule("distributed", f"distributed under (?:[^ ]+ ){{1,8}}{LICENCE}(?: version)?(?: v?[0-9]+)?(?: [0-9]+)?", "license-notice", NOTICE),
        Rule("spdx", "spdx license identifier [^ ]+(?: [0-9]+){0,2}(?: only| or later)?", "spdx-tag", NOTICE),
    ]


RULES: tuple[Rule, ...] = tuple(_gnu() + _creative_commons() + _versioned() + _plain())

# --- prefilter --------------------------------------------------------------------------------------


def fixed_parts(pattern: str) -> list[str]:
    """Runs of letters and digits that every match of ``pattern`` holds."""
    before = None
    while before != pattern:  # innermost groups first, whatever follows them
        before, pattern = pattern, re.sub(r"\(\?:[^()]*\)(?:[?*+]|\{[^}]*\})?", "|", pattern)
    return re.findall("[a-z0-9]+", re.sub(r"\[[^]]*\](?:[?*+]|\{[^}]*\})?|.(?:[?*]|\{[^}]*\})", "|", pattern))


def gate_words(rules: tuple[Rule, ...], base: dict[str, str]) -> list[str]:
    """First words of the rules and phrases that may match without any keyword; of "cc by" both."""
    words = set()
    for anchor, pattern in [(r.anchor, r.pattern) for r in rules] + [(phrase.split()[0], phrase) for phrase in base]:
        parts = fixed_parts(pattern)
        if not any(all(any(piece in part for part in parts) for piece in keyword.split()) for keyword in KEYWORDS):
            words.add("cc by" if parts[:2] == ["cc", "by"] and pattern.startswith("cc by") else anchor)
    return sorted(words)


def may_match(rules: tuple[Rule, ...], base: dict[str, str]) -> Column:
    low = F.lower("_text")
    words = "|".join(w.replace(" ", GAP) for w in gate_words(rules, base))
    edge = GAP.removesuffix("+")
    hit: Column = F.col("_text").rlike(f"(?i)(?:^|{edge})(?:{words})(?:{edge}|$)") if words else F.lit(False)
    for keyword in KEYWORDS:
        pieces = keyword.split()
        hit = hit | (low.contains(pieces[0]) if len(pieces) == 1 else F.forall(F.array(*map(F.lit, pieces)), lambda p: low.contains(p)))
    return hit


# --- expressions ------------------------------------------------------------------------------------
# ``let`` binds a value to a lambda variable, so that it is computed once.

ENDED = "(?= |$)"
NO_DETECTION = "cast(null AS struct<priority: int, shorter: int, rule: int, label: string, start: int>)"


def let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def best_at_word(rules: tuple[Rule, ...]) -> str:
    """The detection that begins at word ``w``, number ``i``, or null; ``c`` is the context from there."""
    by_anchor: dict[str, list[str]] = {}
    for number, rule in enumerate(rules):
        found = f"regexp_extract(c, '^{rule.pattern}{ENDED}', 0)"
        count = f"CASE WHEN {found} = '' THEN 0 ELSE size(split({found}, ' ')) END"
        one = f"named_struct('priority', {rule.priority}, 'shorter', -({count}), 'rule', {number}, 'label', '{rule.label}', 'start', i)"
        by_anchor.setdefault(rule.anchor, []).append(one)
    cases = " ".join(
        f"WHEN '{anchor}' THEN array_min(filter(array({', '.join(options)}), d -> d.shorter < 0))" for anchor, options in by_anchor.items()
    )
    anchors = ", ".join(f"'{a}'" for a in by_anchor)
    chosen = let("c", f"array_join(slice(_words, i + 1, {REACH}), ' ')", f"CASE w {cases} END")
    return f"CASE WHEN w IN ({anchors}) THEN {chosen} ELSE {NO_DETECTION} END"


def base_at_word(base: dict[str, str]) -> str:
    cases = " ".join(
        f"WHEN w = '{phrase.split()[0]}' AND array_join(slice(_words, i + 1, {len(phrase.split())}), ' ') = '{phrase}' THEN '{label}'"
        for phrase, label in base.items()
    )
    return f"CASE {cases} END"


#: d gives way to e. Starts differ and lie within REACH words, one detection a word.
GIVES_WAY = """
    ((e.start <= d.start AND e.start - e.shorter >= d.start - d.shorter)
      OR (e.start >= d.start AND e.start - e.shorter <= d.start - d.shorter))
    AND e.start <> d.start
    AND (e.priority, e.shorter, e.rule) < (d.priority, d.shorter, d.rule)
"""


def scan(
    docs: DataFrame,
    text: str = "text",
    rules: tuple[Rule, ...] = RULES,
    base: dict[str, str] = BASE,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep`` columns, n_words, base_places array of (start, label) and detections array of
    (label, start, words, priority), one row per row of ``docs``."""
    source = docs.select(*[F.col(c) for c in keep], text_or_empty(text).alias("_text"))
    gated = source.withColumn("_hit", may_match(rules, base))
    words = F.regexp_extract_all(ascii_lower(F.col("_text")), F.lit(WORD_ANY_CASE), 0)
    read = gated.select(
        *keep,
        F.size(F.regexp_extract_all("_text", F.lit(WORD_ANY_CASE), 0)).cast("long").alias("n_words"),
        F.when(F.col("_hit"), words).otherwise(F.array().cast("array<string>")).alias("_words"),
    )
    found = f"filter(transform(_words, (w, i) -> {best_at_word(rules)}), d -> d IS NOT NULL)"
    near = f"slice(ds, greatest(j - {REACH} + 1, 1), {2 * REACH + 1})"
    kept = f"filter(ds, (d, j) -> NOT exists({near}, e -> {GIVES_WAY}))"
    places = f"filter(transform(_words, (w, i) -> named_struct('start', cast(i AS bigint), 'label', {base_at_word(base)})), b -> b.label IS NOT NULL)"
    shown = "transform(_kept, d -> named_struct('label', d.label, 'start', cast(d.start AS bigint), 'words', -d.shorter, 'priority', d.priority))"
    return (
        read.withColumn("base_places", F.expr(places))
        .withColumn("_kept", F.expr(let("ds", found, kept)))
        .select(*keep, "n_words", "base_places", F.expr(shown).alias("detections"))
    )


def report(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: word and base counts, labels and a score."""
    labels = "array_sort(array_distinct(transform({}, x -> x.label)))"
    weight = " ".join(f"WHEN {p} THEN {c}D" for p, c in CONFIDENCE.items())
    score = f"greatest(CASE WHEN size(base_places) > 0 THEN {CONFIDENCE[FAMILY]}D ELSE 0D END, coalesce(array_max(transform(detections, d -> CASE d.priority {weight} END)), 0D))"
    return scan(docs, text, keep=(id_column,)).select(
        id_column,
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.expr("array_min(transform(base_places, b -> b.start))").alias("first_word"),
        F.expr("array_max(transform(base_places, b -> b.start))").alias("last_word"),
        F.expr(f"array_join({labels.format('base_places')}, ',')").alias("base_labels"),
        F.expr(f"array_join({labels.format('concat(transform(base_places, b -> named_struct(\"label\", b.label)), transform(detections, d -> named_struct(\"label\", d.label)))')}, ',')").alias("labels"),
        F.expr(score).alias("score"),
        "detections",
    )
