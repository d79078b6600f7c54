"""Licence scan by sentence rules (operator 6), in DataFrame operations only.

A text is cut into sentences at line ends and after full stops, question and exclamation
marks that white space follows; a known sentence is also found where it is wrapped over
lines (with comment marks or indents before them, not over a blank line) and where a
semicolon or colon ends it, and stands as one sentence then.  Sentences are normalised (lower case, runs of anything
but letters and digits become one space) and mapped to the identifiers of known licence
sentences; all others are gaps.  The sequence of identifiers is matched against ordered
rules, each a sequence of identifiers that must follow each other without a gap; a rule
that matches takes its sentences away, so rules further down don't see them again.

Null and empty texts have no sentence and no licence; repeated rows get equal answers; an
empty table gives no rows; other columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known licence sentences, normalised, by identifier.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "licensed under the apache license version 2 0",
    4: "this work is licensed under the gnu general public license version 3",
    5: "licensed under cc by nc 4 0",
    6: "licensed under cc by 4 0",
    7: "licensed under cc by sa 4 0",
    8: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    9: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    10: "you may not use this file except in compliance with the license",
    11: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    12: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    13: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    14: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    15: "all rights reserved",
    16: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    17: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    18: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    19: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    20: "see the license for the specific language governing permissions and limitations under the license",
    21: "apache license",
    22: "version 2 0 january 2004",
    23: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    24: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    25: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    26: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    27: "gnu general public license",
    28: "version 3 29 june 2007",
    29: "version 2 june 1991",
    30: "gnu lesser general public license",
    31: "version 2 1 february 1999",
    32: "gnu affero general public license",
    33: "version 3 19 november 2007",
    34: "this source code form is subject to the terms of the mozilla public license v 2 0",
    35: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    36: "mozilla public license version 2 0",
    37: "this work is licensed under a creative commons attribution 4 0 international license",
    38: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    39: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    40: "attribution 4 0 international",
    41: "attribution sharealike 4 0 international",
    42: "attribution noncommercial 4 0 international",
    43: "cc0 1 0 universal",
    44: "this is free and unencumbered software released into the public domain",
    45: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    46: "boost software license version 1 0 august 17th 2003",
    47: "distributed under the boost software license version 1 0",
    48: "the mit license",
    49: "mit license",
}
#: Licences that a one-line identifier can name; their sentences are numbered from 101 in this order.
NAMED = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense", "Zlib", "BSL-1.0"]
SENTENCES |= {101 + i: "spdx license identifier " + " ".join(n.lower().replace("-", " ").replace(".", " ").split()) for i, n in enumerate(NAMED)}
#: Ordered rules, a licence and the sentences that state it; longer forms first.
RULES = [
    ("MIT", [48, 8, 9]),
    ("MIT", [49, 8, 9]),
    ("MIT", [8, 9]),
    ("Apache-2.0", [3, 10, 11, 19, 20]),
    ("Apache-2.0", [3, 10, 11]),
    ("Apache-2.0", [21, 22]),
    ("Apache-2.0", [3, 10]),
    ("BSD-3-Clause", [13, 14, 16, 17]),
    ("BSD-2-Clause", [13, 14, 16]),
    ("BSD", [13, 14]),
    ("MPL-2.0", [34, 35]),
    ("GPL-3.0", [27, 28]),
    ("GPL-2.0", [27, 29]),
    ("LGPL-2.1", [30, 31]),
    ("LGPL-3.0", [30, 28]),
    ("AGPL-3.0", [32, 33]),
    ("GPL-3.0", [12]),
    ("GPL-3.0", [4]),
    ("GPL-2.0", [23]),
    ("LGPL-2.1", [24]),
    ("LGPL-3.0", [25]),
    ("AGPL-3.0", [26]),
    ("MPL-2.0", [34]),
    ("MPL-2.0", [36]),
    ("MIT", [8]),
    ("MIT", [1]),
    ("MIT", [2]),
    ("MIT", [48]),
    ("MIT", [49]),
    ("ISC", [18]),
    ("Apache-2.0", [3]),
    ("BSD", [13]),
    ("CC-BY-NC-4.0", [5]),
    ("CC-BY-SA-4.0", [7]),
    ("CC-BY-4.0", [6]),
    ("CC-BY-NC-4.0", [39]),
    ("CC-BY-SA-4.0", [38]),
    ("CC-BY-4.0", [37]),
    ("CC-BY-NC-4.0", [42]),
    ("CC-BY-SA-4.0", [41]),
    ("CC-BY-4.0", [40]),
    ("CC0-1.0", [43]),
    ("Unlicense", [44]),
    ("Zlib", [45]),
    ("BSL-1.0", [46]),
    ("BSL-1.0", [47]),
    *((name, [101 + i]) for i, name in enumerate(NAMED)),
    ("proprietary", [15]),
]
#: Further wordings, normalised, and the sentence that each stands for.
VARIANTS = {
    "licensed under the apache license version 2 0 the license": 3,
    "you may obtain a copy of the license at https www apache org licenses license 2 0": 11,
    "neither the name of the copyright owner nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": 17,
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": 18,
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": 35,
}
#: Sentences that notices print with a blank line inside.
PARTED = {11}
#: Sentences with a full stop inside.
STOPPED = {34}
#: Every known sentence has one of these; texts without any are not cut up.
ANCHOR = "licen|copyright|permission|redistribut|rights reserved|public domain|cc0|attribution"
#: List marks, which stand as sentences of their own and are none.
MARK = "[0-9]{1,2}"


def unwrapped(text: Column) -> Column:
    """``text`` with every known sentence that begins and ends like a sentence on a line of its own, normalised."""
    wordings = [*VARIANTS.items(), *((s, i) for i, s in SENTENCES.items())]
    for words, i in wordings:
        blank = "" if i in PARTED else r"\n[^a-zA-Z0-9]*?\n|"
        # possessive: what follows a gap begins with a letter or digit, which no gap holds, and the engine repeats such a group without recursion
        stop = "(?!)" if i in STOPPED else r"[.!?]\s"
        gap = rf"(?:(?!{blank}{stop})[^a-zA-Z0-9])++"
        pattern = rf"(?i)(\A|\n|[.!?]\s+)[^a-zA-Z0-9\n]*{gap.join(words.split())}(?=[^a-zA-Z0-9\n]*(?:\n|\z)|[^a-zA-Z0-9\s]*[.!?;:]\s)"
        text = F.regexp_replace(text, pattern, f"$1{SENTENCES[i]}\n")
    return text


def identifiers(text: Column) -> Column:
    """Array with the identifier of each sentence (0: not known), in order; empty without an anchor."""
    cut = F.split(F.regexp_replace(unwrapped(text), r"([.!?])[ \t\r\f\n]+", "$1\n"), "\n")
    plain = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    known = F.create_map(*[F.lit(x) for i, s in SENTENCES.items() for x in (s, i)])
    ids = F.transform(F.filter(plain, lambda s: (s != "") & ~s.rlike(f"^{MARK}$")), lambda s: F.coalesce(known[s], F.lit(0)))
    return F.when(F.coalesce(text.rlike(f"(?i){ANCHOR}"), F.lit(False)), ids).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licences (names in rule order, '; ' between), n_sentences (known ones), first_sentence (place of the first, from 0)."""
    ids = docs.select(F.col(id_col), identifiers(F.col(text_col)).alias("ids"))
    # every sentence is written ",id,", so that neighbours don't share a comma
    out = ids.withColumn("seq", F.array_join(F.transform("ids", lambda i: F.concat(F.lit(","), i.cast("string"), F.lit(","))), ""))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f",{i}," for i in sentences)).alias("pattern")) for name, sentences in RULES])
    begin = F.struct(F.col("seq").alias("seq"), F.array().cast("array<string>").alias("names"))
    matched = F.aggregate(rules, begin, lambda s, r: F.when(F.contains(s["seq"], r["pattern"]), F.struct(F.replace(s["seq"], r["pattern"], F.lit(",0,")).alias("seq"), F.concat(s["names"], F.array(r["name"])).alias("names"))).otherwise(s))
    # a text without a known sentence meets no rule
    names = F.when(F.exists("ids", lambda i: i > 0), matched["names"]).otherwise(F.array().cast("array<string>"))
    known = F.filter("ids", lambda i: i > 0)
    place = F.array_position(F.transform("ids", lambda i: i > 0), True) - 1
    return out.select(
        id_col,
        F.array_join(F.array_distinct(names), "; ").alias("licences"),
        F.size(known).cast("long").alias("n_sentences"),
        F.when(place >= 0, place).cast("long").alias("first_sentence"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _oracle() -> str:
    known = " ".join(f"WHEN '{s}' THEN {i}" for s, i in [*((s, i) for i, s in SENTENCES.items()), *VARIANTS.items()])
    seq, names = "seq", []
    steps = []
    for n, (name, sentences) in enumerate(RULES):
        pattern = "".join(f",{i}," for i in sentences)
        steps.append(f"r{n} AS (SELECT *, CASE WHEN contains(s{n}, '{pattern}') THEN '{name}' END AS l{n}, replace(s{n}, '{pattern}', ',0,') AS s{n + 1} FROM {'q' if not n else f'r{n - 1}'})")
        names.append(f"l{n}")
    distinct = ", ".join(names)
    return f"""
WITH d AS (
  SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '(?i){ANCHOR}')
    THEN list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\f\\n]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '' AND NOT regexp_full_match(s, '{MARK}'))
    ELSE [] END AS sentences FROM documents
), i AS (
  SELECT doc_id, list_transform(sentences, lambda s: CASE s {known} ELSE 0 END) AS ids FROM d
), q AS (
  SELECT doc_id, ids, coalesce(list_aggregate(list_transform(ids, lambda i: ',' || i || ','), 'string_agg', ''), '') AS s0 FROM i
), {", ".join(steps)}, u AS (
  SELECT doc_id, ids, list_filter([{distinct}], lambda x: x IS NOT NULL) AS found FROM r{len(RULES) - 1}
)
SELECT doc_id,
  coalesce(array_to_string(list_filter(found, lambda x, k: list_position(found, x) = k), '; '), '') AS licences,
  CAST(len(list_filter(ids, lambda i: i > 0)) AS BIGINT) AS n_sentences,
  CAST(list_position(list_transform(ids, lambda i: i > 0), true) - 1 AS BIGINT) AS first_sentence
FROM u
"""


ORACLE_SQL = _oracle()
