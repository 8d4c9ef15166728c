"""Operator 6, licence scans by sentence rules.

A text is split into sentences at sentence ends followed by white space and at blank
lines, also those of comment signs; a single line end is a blank, as licence texts are
wrapped. Sentences are normalised (lower case, anything but letters and digits one
blank) and those of known licences become identifiers; where a sentence isn't known,
its lines are looked up one by one, for notices that end with their line. A licence is
found where its rule, a list of identifiers in order, stands in the text's identifiers
one after the other; other sentences in between don't matter. A licence whose text
holds another's, such as the three BSD clauses the two, takes that one's place.

All is native. Only texts that hold one of the words that every known sentence
holds are split; this loses nothing, as a test over the tables below asserts.

Defined results: null and empty texts have no sentence and no licence; whole texts of
any length are read, in time that grows with the length; repeated
rows are scanned each; an empty table gives an empty result; other columns are
not read.
"""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsieve.functions.patterns import let

# Normalised sentences of public licences and notices, and their identifiers.
SENTENCES = {
    "mit-notice": ["released under the mit license", "licensed under the mit license", "spdx license identifier mit"],
    "mit-title": ["mit license", "the mit license", "the mit license mit"],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit-condition": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software"
    ],
    "mit-warranty": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "apache-notice": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license",
        "released under the apache license version 2 0",
        "spdx license identifier apache 2 0",
    ],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-copy": ["you may obtain a copy of the license at"],
    "gpl3-notice": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "spdx license identifier gpl 3 0 only",
        "spdx license identifier gpl 3 0 or later",
    ],
    "gpl-free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version"
    ],
    "ccbync-notice": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0"],
    "ccby-notice": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0"],
    "bsd-source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer"
    ],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "bsd-endorse": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission"
    ],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies"
    ],
    # The abbreviation of "version" ends a sentence.
    "mpl2-form": ["this source code form is subject to the terms of the mozilla public license v"],
    "gpl2-free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 2 of the license or at your option any later "
        "version"
    ],
    "lgpl21-free": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
        "public license as published by the free software foundation either version 2 1 of the license or at your option any "
        "later version"
    ],
    "agpl3-free": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
        "public license as published by the free software foundation either version 3 of the license or at your option any "
        "later version"
    ],
    "unlicense-free": ["this is free and unencumbered software released into the public domain"],
    "rights": ["all rights reserved"],
}
# Licences by the names that notices use, besides their identifier; all normalised.
NAMES = {
    "MIT": ["mit license", "the mit license"],
    "Apache-2.0": ["apache license version 2 0", "the apache license version 2 0", "apache license 2 0", "the apache license 2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "the bsd 2 clause license"],
    "BSD-3-Clause": ["bsd 3 clause license", "the bsd 3 clause license"],
    "ISC": ["isc license", "the isc license"],
    "MPL-2.0": ["mozilla public license version 2 0", "the mozilla public license 2 0", "the mozilla public license version 2 0"],
    "GPL-2.0": ["gnu general public license version 2", "the gnu general public license version 2"],
    "GPL-3.0": ["gnu general public license version 3", "the gnu general public license version 3"],
    "LGPL-2.1": ["the gnu lesser general public license version 2 1"],
    "LGPL-3.0": ["the gnu lesser general public license version 3"],
    "AGPL-3.0": ["the gnu affero general public license version 3"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "Unlicense": ["the unlicense"],
}
# Notices; the first forms take a name, the last an identifier.
NOTICES = (
    "licensed under {}", "released under {}", "this project is licensed under {}", "this software is licensed under {}",
    "this work is licensed under {}", "distributed under {}", "distributed under the terms of {}",
)
SPDX = ("spdx license identifier {}", "spdx license identifier {} only", "spdx license identifier {} or later")
# The licence whose text holds that of the other.
HOLDS = {"BSD-3-Clause": "BSD-2-Clause"}
# Rules in order of rank; each is a licence and the identifiers that follow each other.
RULES = [
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-notice", "apache-comply", "apache-copy"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0", ["gpl-free"]),
    ("GPL-2.0", ["gpl2-free"]),
    ("LGPL-2.1", ["lgpl21-free"]),
    ("AGPL-3.0", ["agpl3-free"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-free"]),
    ("BSD-3-Clause", ["bsd-source", "bsd-binary", "bsd-endorse"]),
    ("CC-BY-NC-4.0", ["ccbync-notice"]),
    ("CC-BY-4.0", ["ccby-notice"]),
    ("BSD-2-Clause", ["bsd-source", "bsd-binary"]),
    ("LicenseRef-AllRightsReserved", ["rights"]),
]
# Every known sentence holds one of these words.
MARKERS = ("licens", "permission", "copyright", "software", "rights reserved", "distributed under", "released under")



def _add_notices() -> None:
    """Every notice with every name, as sentences of the licence's own identifier."""
    known = {form for forms in SENTENCES.values() for form in forms}
    for licence, names in NAMES.items():
        short = licence.lower().replace("-", " ").replace(".", " ")
        forms = [notice.format(name) for notice in NOTICES for name in names] + [form.format(short) for form in SPDX]
        own = [form for form in forms if form not in known]
        SENTENCES[f"{licence.lower()}-named"] = own
        RULES.append((licence, [f"{licence.lower()}-named"]))


_add_notices()

# A run of signs is read once, from its begin.
SENTENCE_END = r"(?<![.!?])[.!?]++(?:[ \t\r\f\n]|\z)"
# One blank line is enough; signs that others leave behind are normalised away.
BLANK_LINE = r"\n[ \t\r\f*#/%-]*+\n"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def sentences(text: Column) -> Column:
    """Sentences that may be known, in order, as they stand."""
    parts = F.split(F.regexp_replace(text, SENTENCE_END, "\n\n"), BLANK_LINE)
    return F.filter(parts, lambda p: _marked(F.lower(p)))


def _marked(low: Column) -> Column:
    found = F.lit(False)
    for word in MARKERS:
        found = found | F.contains(low, F.lit(word))
    return found


def identifiers(text: Column) -> Column:
    """Identifiers of the known sentences, in order."""
    table = json.dumps({form: name for name, forms in SENTENCES.items() for form in forms})
    known = F.from_json(F.lit(table), "map<string,string>")
    none = F.array().cast("array<string>")

    def lines_of(part: Column) -> Column:
        found = F.transform(F.split(part, "\n"), lambda line: F.try_element_at(known, normalised(line)))
        return F.when(F.contains(part, F.lit("\n")), F.array_compact(found)).otherwise(none)

    def of(part: Column) -> Column:
        return let(
            F.try_element_at(known, normalised(part)),
            lambda name: F.when(name.isNotNull(), F.array(name)).otherwise(lines_of(part)),
        )

    return F.flatten(F.transform(sentences(text), of))


def licences(ids: Column) -> Column:
    """Licences whose rule the identifiers hold, each once, in order of the rules."""
    line = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    hits = [F.when(F.contains(line, F.lit(" " + "  ".join(rule) + " ")), F.lit(name)) for name, rule in RULES]
    found = F.array_distinct(F.array_compact(F.array(*hits)))
    for whole, part in HOLDS.items():
        found = let(found, _in_place_of(whole, part))
    return found


def _in_place_of(whole: str, part: str):
    return lambda found: F.when(F.array_contains(found, whole), F.array_remove(found, part)).otherwise(found)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, sentence_ids (array), licenses (array)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<string>")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    ids = F.when(_marked(F.lower("text")), identifiers(F.col("text"))).otherwise(none)
    return rows.select(F.col("id").alias(id_col), ids.alias("sentence_ids")).withColumn(
        "licenses", F.when(F.size("sentence_ids") > 0, licences(F.col("sentence_ids"))).otherwise(none)
    )
