"""Licence scans by sentence rules, all column functions on one row.

A text is lower-cased, cut into sentences at ``. ! ? : ;`` before white space and at line
breaks, once as it stands and once with wrapped lines joined, and each sentence is reduced to letters and digits with single blanks. Sentences of
``SENTENCES`` become identifiers, all others are dropped, and the row of identifiers is
matched against ``RULES``: ordered identifiers that must follow each other with at most
``GAP`` other known sentences between. Looking sentences up is a test against a constant set,
so no join and no shuffle is needed, and whole texts of any length are read.

Defined results: null, empty and blank texts have no sentence and no licence. A licence found
twice is named once. Repeated rows are scanned one by one. Other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 2
BREAK = r"[.!?:;]+(?:[ \t-\r]|$)"

# Sentences of public licence texts and notices, already normalised, by identifier.
SENTENCES = {
    "grant-mit": "released under the mit license",
    "grant-mit-2": "licensed under the mit license",
    "grant-mit-3": "this project is licensed under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "grant-apache2": "licensed under the apache license version 2 0",
    "grant-apache2-2": "licensed under the apache license version 2 0 the license",
    "apache2-compliance": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "grant-gpl2": "this work is licensed under the gnu general public license version 2",
    "grant-gpl3": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl2-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-public": "this is free and unencumbered software released into the public domain",
    "grant-cc-by-4": "licensed under cc by 4 0",
    "grant-cc-by-sa-4": "licensed under cc by sa 4 0",
    "grant-cc-by-nc-3": "licensed under cc by nc 3 0",
    "grant-cc-by-nc-4": "licensed under cc by nc 4 0",
    "grant-cc-by-nc-sa-4": "licensed under cc by nc sa 4 0",
    "grant-cc-by-nd-4": "licensed under cc by nd 4 0",
    "grant-cc0": "released under cc0 1 0",
    "reserved": "all rights reserved",
    "spdx": "spdx license identifier",
    "name-mit": "mit",
    "name-apache2": "apache 2 0",
    "name-gpl2": "gpl 2 0 only",
    "name-gpl3": "gpl 3 0 only",
    "name-bsd3": "bsd 3 clause",
    "name-isc": "isc",
    "name-mpl2": "mpl 2 0",
    "name-bsd2": "bsd 2 clause",
    "name-gpl2-later": "gpl 2 0 or later",
    "name-gpl3-later": "gpl 3 0 or later",
    "name-unlicense": "unlicense",
    "name-cc0": "cc0 1 0",
    "name-cc-by-4": "cc by 4 0",
    "name-cc-by-nc-3": "cc by nc 3 0",
    "name-cc-by-nc-4": "cc by nc 4 0",
    "name-cc-by-nc-sa-4": "cc by nc sa 4 0",
    "name-cc-by-nd-4": "cc by nd 4 0",
    "name-cc-by-sa-4": "cc by sa 4 0",
}

# Licence -> sequences of identifiers, any of which names it.
RULES = {
    "Apache-2.0": (("grant-apache2",), ("grant-apache2-2",), ("apache2-compliance", "apache2-copy"), ("spdx", "name-apache2")),
    "BSD-2-Clause": (("bsd-conditions", "bsd-source", "bsd-binary"), ("spdx", "name-bsd2")),
    "BSD-3-Clause": (("bsd-conditions", "bsd-source", "bsd-binary", "bsd-endorse"), ("spdx", "name-bsd3")),
    "CC-BY-4.0": (("grant-cc-by-4",), ("spdx", "name-cc-by-4")),
    "CC-BY-NC-3.0": (("grant-cc-by-nc-3",), ("spdx", "name-cc-by-nc-3")),
    "CC-BY-NC-4.0": (("grant-cc-by-nc-4",), ("spdx", "name-cc-by-nc-4")),
    "CC-BY-NC-SA-4.0": (("grant-cc-by-nc-sa-4",), ("spdx", "name-cc-by-nc-sa-4")),
    "CC-BY-ND-4.0": (("grant-cc-by-nd-4",), ("spdx", "name-cc-by-nd-4")),
    "CC-BY-SA-4.0": (("grant-cc-by-sa-4",), ("spdx", "name-cc-by-sa-4")),
    "CC0-1.0": (("grant-cc0",), ("spdx", "name-cc0")),
    "GPL-2.0-only": (("grant-gpl2",), ("spdx", "name-gpl2")),
    "GPL-2.0-or-later": (("gpl-free", "gpl2-later"), ("spdx", "name-gpl2-later")),
    "GPL-3.0-only": (("grant-gpl3",), ("spdx", "name-gpl3")),
    "GPL-3.0-or-later": (("gpl-free", "gpl3-later"), ("spdx", "name-gpl3-later")),
    "ISC": (("isc-permission",), ("spdx", "name-isc")),
    "MIT": (("grant-mit",), ("grant-mit-2",), ("grant-mit-3",), ("mit-permission", "mit-notice"), ("spdx", "name-mit")),
    "MPL-2.0": (("mpl2-subject",), ("spdx", "name-mpl2")),
    "Proprietary": (("reserved",),),
    "Unlicense": (("unlicense-public",), ("spdx", "name-unlicense")),
}


def rule_pattern(sequence: tuple[str, ...], gap: int = GAP) -> str:
    """A pattern over identifiers that each stand between blanks."""
    between = f" (?:[a-z0-9-]+ ){{0,{gap}}}"
    return " " + between.join(re.escape(s).replace(r"\-", "-") for s in sequence) + " "


def sentences(text: Column) -> Column:
    """Normalised sentences in order; empty ones stay and match nothing."""
    lines = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BREAK, "\n")
    plain = F.regexp_replace(F.regexp_replace(lines, r"[\r\n]+", "\n"), r"[^a-z0-9\n]+", " ")
    return F.transform(F.split(plain, "\n"), lambda s: F.btrim(s))


def unwrapped(text: Column) -> Column:
    """Text whose single line breaks, with comment signs, are blanks; blank lines stay breaks."""
    sign = r"(?://+|/?\*+/?|#+|;+|--+|%+|<!--|-->)?"
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), rf"(?m)^[ \t]*{sign}[ \t]*", "")
    # A version after an abbreviation goes on with the sentence.
    return F.regexp_replace(F.regexp_replace(bare, r"(?<!\n)\n(?!\n)", " "), r"(?i)\bv\.\s+(?=[0-9])", "v ")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_known, sentence_ids, licences): identifiers and licences joined by commas."""
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable((s, i) for i, s in SENTENCES.items())])

    def known(body: Column) -> Column:
        return F.transform(F.filter(sentences(body), lambda s: s.isin(list(SENTENCES.values()))), lambda s: F.element_at(table, s))

    rows = docs.select(F.col(key).alias("doc_id"), known(F.col(text)).alias("by_line"), known(unwrapped(F.col(text))).alias("joined"))
    # The cut that knows more sentences is named; licences are those of both, which a sign between keeps apart.
    rows = rows.withColumn("ids", F.when(F.size("joined") > F.size("by_line"), F.col("joined")).otherwise(F.col("by_line")))
    both = [F.array_join("by_line", " "), F.array_join("joined", " ")]
    spaced = rows.withColumn("row", F.concat(F.lit(" "), both[0], F.lit(" | "), both[1], F.lit(" ")))
    named = [
        F.when(F.col("row").rlike("|".join(rule_pattern(s) for s in ways)), F.lit(name)) for name, ways in RULES.items()
    ]
    found = F.when(F.size("ids") > 0, F.array_join(F.array(*named), ",")).otherwise("")
    return spaced.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), found.alias("licences")
    )
