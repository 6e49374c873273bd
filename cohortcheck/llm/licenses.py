"""Licence scans by sentence rules (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortcheck.llm.common import let, read_table

# Sentences of licence texts and notices, each with an identifier of ours. They are public texts.
SENTENCES = {
    "APR": "Licensed under the Apache License, Version 2.0",
    "APH": "Apache License, Version 2.0",
    "APC": "You may not use this file except in compliance with the License",
    "APO": "You may obtain a copy of the License at",
    "MIR": "Released under the MIT License",
    "MIH": "MIT License",
    "MIP": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "MIN": "The above copyright notice and this permission notice shall be included in all copies",
    "MIW": "The software is provided as is, without warranty of any kind",
    "GPR": "This work is licensed under the GNU General Public License, version 3",
    "GPH": "GNU General Public License",
    "GPV": "Version 3, 29 June 2007",
    "GPF": "This program is free software",
    "GPM": "You can redistribute it and/or modify it under the terms of the GNU General Public License",
    "BSR": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "BSS": "Redistributions of source code must retain the above copyright notice",
    "BSB": "Redistributions in binary form must reproduce the above copyright notice",
    "CNR": "Licensed under CC BY-NC 4.0",
    "CBR": "Licensed under CC BY 4.0",
    "CSR": "Licensed under CC BY-SA 4.0",
    "ARR": "All rights reserved",
}

# Licence rules in order: the first whose sentences stand next to each other in the sequence names the licence.
RULES = [
    ("Apache-2.0", "APR APC APO"),
    ("MIT", "MIH MIP MIN MIW"),
    ("GPL-3.0", "GPH GPV"),
    ("GPL-3.0", "GPF GPM"),
    ("BSD", "BSR BSS BSB"),
    ("MIT", "MIP MIN"),
    ("CC-BY-NC-4.0", "CNR"),
    ("GPL-3.0", "GPR"),
    ("CC-BY-SA-4.0", "CSR"),
    ("CC-BY-4.0", "CBR"),
    ("Apache-2.0", "APR"),
    ("Apache-2.0", "APH"),
    ("MIT", "MIR"),
    ("MIT", "MIH"),
    ("proprietary", "ARR"),
]

# Sentences as the texts and notices are published, by the same identifiers. They are long and so are found inside of a
# longer sentence too: after a heading, a copyright line or a number, or before an address that no mark parts from them.
PUBLISHED = [
    ("APR", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("APR", 'Licensed to you under the Apache License, Version 2.0 (the "License")'),
    ("APR", 'licenses this file to you under the Apache License, Version 2.0 (the "License")'),
    ("APC", "you may not use this file except in compliance with the License"),
    ("APC", "you may not use this work except in compliance with the License"),
    ("APC", "you may not use this software except in compliance with the License"),
    ("APO", "You may obtain a copy of the License at"),
    (
        "MIP",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
    ),
    (
        "MIN",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software",
    ),
    (
        "MIN",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all "
        "copies or substantial portions of the Software",
    ),
    ("MIW", 'The Software is provided "as is", without warranty of any kind, express or implied'),
    ("GPF", "is free software"),
    ("GQM", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2"),
    ("GQM", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPM", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("GPM", "under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("GPM", "under the terms of the GNU General Public License version 3 as published by the Free Software Foundation"),
    ("BSR", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    (
        "BSS",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer",
    ),
    (
        "BSB",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer",
    ),
    (
        "CNR",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    ("CSR", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CBR", "licensed under a Creative Commons Attribution 4.0 International License"),
]

# Sentences that only count as a whole, and rules for what is published besides.
HEADINGS = {
    "The MIT License": "MIH",
    "The MIT License (MIT)": "MIH",
    "MIT License (MIT)": "MIH",
    "Licensed under the MIT License": "MIR",
    "This project is licensed under the MIT License": "MIR",
    "Version 2, June 1991": "GQV",
}
PUBLISHED_RULES = [("GPL-2.0", "GPF GQM"), ("GPL-2.0", "GPH GQV")]

_MARK = r"[.!?;:]+[\x20\x09-\x0D]+"


def _normal(sentence: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def _known(sentences: dict[str, str]) -> dict[str, str]:
    return {_normal(text): name for name, text in sentences.items()}


def _plain(text: Column) -> Column:
    """A whole text in lower case with single spaces and line breaks, and ``S`` where a mark ends a sentence.

    Lower case holds no ``S``. A mark ends a sentence if white space follows, so that ``2.0`` stays whole.
    """
    broken = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _MARK, "S")
    return F.regexp_replace(broken, r"[^a-z0-9\nS]+", " ")


def _pattern(whole: Iterable[str], inside: Iterable[str]) -> str:
    """Finds sentences whose lines may be wrapped, the longest first: ``whole`` ones between ends of lines or sentences."""

    def any_of(texts: Iterable[str]) -> str:
        # A wrapped line may start with a sign of a comment, which is a space here. An empty line has two breaks.
        return "|".join(t.replace(" ", r"(?: ?\n ?| )") for t in sorted(texts, key=lambda t: (-len(t), t))) or "(?!)"

    alone = rf"(?<=^|[\nS]|[\nS] |^ )(?:{any_of(whole)})(?= ?(?:[\nS]|$))"
    return rf"(?<![a-z0-9])(?:(?:{any_of(inside)})(?![a-z0-9])|{alone})"


def scan(
    docs: DataFrame,
    sentences: dict[str, str] = SENTENCES,
    rules: list[tuple[str, str]] = RULES,
    published: list[tuple[str, str]] = PUBLISHED,
    headings: dict[str, str] = HEADINGS,
    published_rules: list[tuple[str, str]] = PUBLISHED_RULES,
) -> DataFrame:
    """``doc_id, n_sentences, sequence, license`` for every row of ``docs(doc_id, text)``.

    ``sequence`` lists the known sentences in text order, ``license`` the first rule that it satisfies (else null). Null
    and empty texts have no sentence and an empty sequence. A known sentence may be wrapped over lines, but not over an empty
    one; ``n_sentences`` counts a line as a sentence at least. Each row is worked on alone: no shuffle, and a scan
    of two columns. Identifiers have no blanks; the tables are parameters of the job, not data.
    """
    inside = {_normal(text): name for name, text in published}
    whole = {**{_normal(text): name for text, name in headings.items()}, **_known(sentences)}
    names = F.create_map(*[F.lit(x) for pair in {**inside, **whole}.items() for x in pair])
    first = let(docs.select("doc_id", "text"), ["doc_id"], _plain=_plain(F.btrim("text")))
    n_sentences = F.size(F.array_remove(F.split("_plain", r" ?[\nS][ \nS]*"), "")).cast("long")
    n_sentences = F.when(F.btrim("_plain") == "", F.lit(0).cast("long")).otherwise(n_sentences)
    found = F.regexp_extract_all("_plain", F.lit(_pattern(whole.keys() - inside.keys(), inside)), F.lit(0))
    named = F.transform(found, lambda s: names[F.regexp_replace(s, "[ \n]+", " ")])
    second = let(first, ["doc_id", n_sentences.alias("n_sentences")], sequence=F.array_join(named, " "))
    spaced = F.concat(F.lit(" "), "sequence", F.lit(" "))
    license_ = F.lit(None).cast("string")
    for name, wanted in reversed([*rules, *published_rules]):
        license_ = F.when(F.contains(spaced, F.lit(f" {wanted} ")), name).otherwise(license_)
    return second.select("doc_id", "n_sentences", "sequence", license_.alias("license"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


_CASES = " ".join(f"WHEN contains(' ' || sequence || ' ', ' {wanted} ') THEN '{name}'" for name, wanted in RULES)
_NAMES = ", ".join(f"'{text}': '{name}'" for text, name in _known(SENTENCES).items())
SQL = {
    "op6_license_scan": rf"""
WITH s AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(lower(coalesce(text, '')),
    '[.!?;:]+[\x20\x09-\x0D]+|\n'), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS a
  FROM documents
), q AS (
  SELECT doc_id, len(a)::BIGINT AS n_sentences,
    coalesce(array_to_string(list_filter(list_transform(a, lambda x: (MAP {{{_NAMES}}})[x]), lambda x: x IS NOT NULL), ' '), '')
      AS sequence
  FROM s
)
SELECT doc_id, n_sentences, sequence, CASE {_CASES} END AS license FROM q""",
}
