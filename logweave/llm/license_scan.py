"""Licence scan by sentences and ordered rules, in DataFrame functions only.

A text is cut into pieces at single line breaks and after sentence ends; pieces are normalised (lower case, runs of
anything but a-z and 0-9 become one space). Known licence sentences, each with an identifier, are looked up in the
pieces: a sentence must begin and end with a piece, and may run over any number of neighbouring ones, so hard-wrapped
texts (also behind comment marks) and sentences with an inner '.' or ';' are found. No sentence runs over a blank
line; a line of marks alone is blank. Where several sentences begin at one piece, the longest counts. A document
thus becomes a sequence of identifiers. The rules are tried in order: a rule whose identifiers stand next to each other in the
sequence reports its licence and consumes them, so longer, more telling rules come before shorter ones. "All rights
reserved" reports a proprietary text only where no licence is found.

Edge cases: null and empty texts have no sentence and no licence; the same sentence twice counts twice;
several licences in one text are all reported, each once, in sorted order; repeated rows are scanned alike; other columns pass
through, and columns with the names of the results are replaced. No row is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences (public licence texts and notices) and their identifiers.
SENTENCES = {
    "released under the mit license": "mit_line",
    "licensed under the mit license": "mit_line",
    "this project is licensed under the mit license": "mit_line",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_warranty",
    "licensed under the apache license version 2 0": "apache2_line",
    "licensed under the apache license version 2 0 the license": "apache2_line",
    "you may not use this file except in compliance with the license": "apache2_use",
    "you may obtain a copy of the license at": "apache2_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_see",
    "this work is licensed under the gnu general public license version 3": "gpl3_line",
    "licensed under the gnu general public license version 3": "gpl3_line",
    "this work is licensed under the gnu general public license version 2": "gpl2_line",
    "licensed under the gnu general public license version 2": "gpl2_line",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_later_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2_later_grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl_warranty",
    "see the gnu general public license for more details": "gpl_see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2_line",
    "licensed under cc by nc 4 0": "ccbync4_line",
    "licensed under cc by 4 0": "ccby4_line",
    "licensed under cc by sa 4 0": "ccbysa4_line",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4_line",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4_line",
    "this is free and unencumbered software released into the public domain": "unlicense_line",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit0_grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21_later_grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_later_grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_later_grant",
    "licensed under the gnu lesser general public license version 3": "lgpl3_line",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_later_grant",
    "licensed under the gnu affero general public license version 3": "agpl3_line",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2_line",
    "this software is provided as is without any express or implied warranty": "zlib_warranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0_line",
    "licensed under cc0 1 0": "cc0_line",
    "distributed under the boost software license version 1 0": "boost_line",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost_grant",
    "all rights reserved": "reserved",
}

# Further sentences of public licence texts.
SENTENCES |= {
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4_line",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc_warranty",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_warranty",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gpl_copying",
    "gnu general public license version 3 29 june 2007": "gpl3_title",
    "gnu general public license version 2 june 1991": "gpl2_title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3_title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21_title",
    "gnu affero general public license version 3 19 november 2007": "agpl3_title",
    "apache license version 2 0 january 2004": "apache2_title",
    "mozilla public license version 2 0": "mpl2_title",
    "boost software license version 1 0 august 17th 2003": "boost_title",
}
#: Grants under one version of the GPL, with the version before or behind the publisher.
for _v in ("2", "3"):
    _grant = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
    for _tail in (f"version {_v} as published by the free software foundation", f"as published by the free software foundation version {_v}", f"as published by the free software foundation version {_v} of the license", f"as published by the free software foundation either version {_v} of the license"):
        SENTENCES[f"{_grant} {_tail}"] = f"gpl{_v}_grant"

# What licences are called in notices, by the identifier of their line.
NAMES = {
    "mit_line": ["mit license", "mit"],
    "apache2_line": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"],
    "gpl2_line": ["gnu general public license version 2", "gnu gpl version 2", "gpl version 2", "gpl 2 0", "gplv2", "gpl v2"],
    "gpl3_line": ["gnu general public license version 3", "gnu gpl version 3", "gpl version 3", "gpl 3 0", "gplv3", "gpl v3"],
    "lgpl3_line": ["gnu lesser general public license version 3", "lgpl version 3", "lgpl 3 0", "lgplv3"],
    "agpl3_line": ["gnu affero general public license version 3", "agpl version 3", "agpl 3 0", "agplv3"],
    "bsd2_line": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"],
    "bsd3_line": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "bsd 3 clause"],
    "isc_line": ["isc license", "isc"],
    "mpl2_line": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "epl2_line": ["eclipse public license 2 0", "eclipse public license version 2 0", "epl 2 0"],
    "boost_line": ["boost software license version 1 0", "boost software license", "bsl 1 0"],
    "zlib_line": ["zlib license"],
    "cc0_line": ["cc0 1 0"],
    "ccby4_line": ["cc by 4 0"],
    "ccbysa4_line": ["cc by sa 4 0"],
    "ccbync4_line": ["cc by nc 4 0"],
    "unlicense_line": ["unlicense"],
}
NAMES |= {k.replace("_line", "_later_line"): [f"{n} or {x}" for n in NAMES[k] for x in ("later", "any later version")] for k in ("gpl2_line", "gpl3_line", "lgpl3_line", "agpl3_line")}
#: Notices are an opening and a name; what stands in SENTENCES already keeps its identifier.
OPENINGS = ["licensed under", "licensed under the", "license", "licence", "this project is licensed under the", "this software is licensed under the", "this work is licensed under the", "this file is licensed under the", "released under the", "distributed under the", "available under the"]
for _id, _names in NAMES.items():
    for _n in _names:
        for _o in OPENINGS:
            if "licen" in _o or "licen" in _n:
                SENTENCES.setdefault(f"{_o} {_n}", _id)

# Licence identifiers that may stand behind "SPDX-License-Identifier:", and old names of some.
SPDX = ["MIT", "MIT-0", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "Zlib", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense"]
OLD_SPDX = ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
SENTENCES |= {"spdx license identifier " + re.sub("[^a-z0-9]+", " ", s.lower()): f"spdx_{s.lower()}" for s in SPDX}
SENTENCES |= {"spdx license identifier " + re.sub("[^a-z0-9]+", " ", s.lower()): f"spdx_{s.lower()}-only" for s in OLD_SPDX}
#: An expression of several identifiers is cut before each further one, so often at most.
OPERANDS = 6
#: The identifier that an operator follows, in lower-cased text, and what stands between.
EXPRESSION = r"(spdx-license-identifier:[\x20\x09]*)\(?([a-z0-9.+-]+)\)?[\x20\x09]+(?:or|and)[\x20\x09]+"

# Ordered rules, the licence and its run of identifiers.
RULES = [
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("Apache-2.0", ["apache2_line", "apache2_use", "apache2_copy", "apache2_basis", "apache2_see"]),
    ("GPL-3.0-or-later", ["gpl3_later_grant", "gpl_warranty", "gpl_see"]),
    ("GPL-2.0-or-later", ["gpl2_later_grant", "gpl_warranty", "gpl_see"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("GPL-3.0-or-later", ["gpl3_later_grant"]),
    ("GPL-2.0-or-later", ["gpl2_later_grant"]),
    ("GPL-3.0-only", ["gpl3_line"]),
    ("GPL-2.0-only", ["gpl2_line"]),
    ("Apache-2.0", ["apache2_line"]),
    ("MIT", ["mit_line"]),
    ("ISC", ["isc_grant"]),
    ("MPL-2.0", ["mpl2_line"]),
    ("CC-BY-NC-4.0", ["ccbync4_line"]),
    ("CC-BY-SA-4.0", ["ccbysa4_line"]),
    ("CC-BY-4.0", ["ccby4_line"]),
    ("Unlicense", ["unlicense_line"]),
    ("MIT-0", ["mit0_grant"]),
    ("LGPL-2.1-or-later", ["lgpl21_later_grant"]),
    ("LGPL-3.0-or-later", ["lgpl3_later_grant"]),
    ("LGPL-3.0-only", ["lgpl3_line"]),
    ("AGPL-3.0-or-later", ["agpl3_later_grant"]),
    ("AGPL-3.0-only", ["agpl3_line"]),
    ("EPL-2.0", ["epl2_line"]),
    ("Zlib", ["zlib_warranty", "zlib_grant"]),
    ("Zlib", ["zlib_grant"]),
    ("CC0-1.0", ["cc0_line"]),
    ("BSL-1.0", ["boost_line"]),
    ("BSL-1.0", ["boost_grant"]),
]
RULES += [
    ("ISC", ["isc_grant", "isc_warranty"]),
    ("GPL-2.0-only", ["gpl2_grant"]),
    ("GPL-3.0-only", ["gpl3_grant"]),
    ("GPL-2.0-only", ["gpl2_title"]),
    ("GPL-3.0-only", ["gpl3_title"]),
    ("LGPL-2.1-only", ["lgpl21_title"]),
    ("LGPL-3.0-only", ["lgpl3_title"]),
    ("AGPL-3.0-only", ["agpl3_title"]),
    ("Apache-2.0", ["apache2_title"]),
    ("MPL-2.0", ["mpl2_title"]),
    ("BSL-1.0", ["boost_title"]),
    ("GPL-2.0-or-later", ["gpl2_later_line"]),
    ("GPL-3.0-or-later", ["gpl3_later_line"]),
    ("LGPL-3.0-or-later", ["lgpl3_later_line"]),
    ("AGPL-3.0-or-later", ["agpl3_later_line"]),
    ("BSD-2-Clause", ["bsd2_line"]),
    ("BSD-3-Clause", ["bsd3_line"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_warranty"]),
    ("ISC", ["isc_line"]),
    ("Zlib", ["zlib_line"]),
]
RULES += [(s, [f"spdx_{s.lower()}"]) for s in SPDX]
#: Reported where no rule before it matches: the line also stands in the headers of open licences.
LAST = ("Proprietary", "reserved")

# Every known sentence holds one of these words (single ones: a line may end between two), so a text without any of them needs no cutting.
TRIGGERS = ["licen", "permission", "copyright", "warrant", "redistribut", "domain", "reserved"]

#: A piece ends at a line break, or after one of these marks if white space follows.
PIECE_END = r"[.!?;][\x20\x09-\x0D]+"
#: A hint at a file ends a notice, as a full stop would.
HINT = r"[\x20\x09]*[,(][\x20\x09]*see[\x20\x09]+"


def one_of(sentences: list[str]) -> str:
    """Pattern of any of the sentences, the longest that fits; each space may be a piece end ("|"), but two ends are a blank line.

    Words that sentences begin with alike are looked at once.
    """
    tree: dict = {}
    for s in sentences:
        node = tree
        for word in s.split():
            node = node.setdefault(word, {})
        node[""] = {}

    def rest(node: dict) -> str:
        inner = [word + rest(below) for word, below in sorted(node.items()) if word]
        if not inner:
            return ""
        if len(inner) == 1 and "" not in node:
            return r" (?:\| )?" + inner[0]
        return r"(?: (?:\| )?(?:" + "|".join(inner) + "))" + ("?" if "" in node else "")

    return "(?:" + "|".join(word + rest(below) for word, below in sorted(tree.items())) + ")"


#: The known sentences between piece ends.
KNOWN = r"(?<=\| )" + one_of(list(SENTENCES)) + r"(?= \|)"


def pieces(text: Column) -> Column:
    """The normalised pieces of a text between bars; two bars stand for a blank line.

    Lower-cased text has no A-Z, so S (a piece ends) and H (a blank line) serve as marks on the way.
    """
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    steps = [
        *[(EXPRESSION, "$1$2\n$1")] * (OPERANDS - 1),
        (HINT, ". see "),
        (r"\r\n?", "\n"),
        (r"\n[^a-z0-9\n]*+\n[^a-z0-9]*+", "H"),
        (r"\n[^a-z0-9H]*+", "S"),
        (PIECE_END, "S"),
        (r"[^a-z0-9HS]+", " "),
        (r"S[S ]*+", "S"),
        (r" ?S?H[HS ]*+", " | | "),
        (r" ?S", " | "),
    ]
    for pattern, mark in steps:
        lower = F.regexp_replace(lower, pattern, mark)
    return F.concat(F.lit(" | "), F.trim(lower), F.lit(" | "))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    found = F.regexp_extract_all(pieces(text), F.lit(KNOWN), F.lit(0))
    named = F.transform(found, lambda s: known[F.replace(s, F.lit("| "), F.lit(""))])
    return F.when(holds_trigger(text), named).otherwise(F.array().cast("array<string>"))


def holds_trigger(text: Column) -> Column:
    """Whether a trigger occurs, in any case: each is looked for without its first letter's case mattering."""
    lower = F.lower(text)
    found = F.contains(lower, F.lit(TRIGGERS[0]))
    for word in TRIGGERS[1:]:
        found |= F.contains(lower, F.lit(word))
    return found


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``docs`` with ``sentence_ids array<string>`` and ``licenses array<string>``."""
    keep = [c for c in docs.columns if c not in ("sentence_ids", "licenses")]
    with_ids = docs.select(*keep, sentence_ids(F.col("text")).alias("sentence_ids"))
    # each identifier stands between its own blanks, so neighbours of a run are joined by two
    left, found = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" ")), []
    for name, run in RULES:
        pattern = F.lit(f" {'  '.join(run)} ")
        found.append(F.when(F.contains(left, pattern), name))
        left = F.replace(left, pattern, F.lit(" | "))
    hits = F.filter(F.array(*found), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    last = F.when(F.array_contains("sentence_ids", LAST[1]), F.array(F.lit(LAST[0]))).otherwise(none)
    told = with_ids.withColumn("licenses", F.when(F.size("sentence_ids") > 0, F.array_sort(F.array_distinct(hits))).otherwise(none))
    return told.withColumn("licenses", F.when(F.size("licenses") > 0, F.col("licenses")).otherwise(last))


def oracle() -> str:
    """The same in SQL for an outside engine.

    Pieces are numbered within their document and paragraph; a known sentence that begins at a piece is compared with the
    pieces from there on. Of the sentences that begin at one piece the longest counts, and the next is looked for behind it.
    """
    expressions = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for _ in range(OPERANDS - 1):
        expressions = f"regexp_replace({expressions}, '{EXPRESSION}', '\\1\\2' || chr(10) || '\\1', 'g')"
    expressions = f"regexp_replace({expressions}, '{HINT}', '. see ', 'g')"
    quoted = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps = ["s0 AS (SELECT doc_id, n, ids, ' ' || coalesce(ids, '') || ' ' AS seq, [] :: VARCHAR[] AS got FROM joined)"]
    for k, (name, run) in enumerate(RULES):
        pattern = f" {'  '.join(run)} "
        steps.append(f"s{k + 1} AS (SELECT doc_id, n, ids, replace(seq, '{pattern}', ' | ') AS seq, CASE WHEN contains(seq, '{pattern}') THEN list_append(got, '{name}') ELSE got END AS got FROM s{k})")
    return rf"""
WITH RECURSIVE known(s, i) AS (VALUES {quoted}),
low AS (SELECT doc_id, replace(replace({expressions}, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
told AS (SELECT doc_id, t FROM low WHERE regexp_matches(t, '{"|".join(TRIGGERS)}')),
line AS (SELECT doc_id, unnest(l) AS l, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM told)),
para AS (SELECT doc_id, k, l, count(*) FILTER (WHERE NOT regexp_matches(l, '[a-z0-9]')) OVER (PARTITION BY doc_id ORDER BY k) AS para FROM line),
cut AS (SELECT doc_id, para, k, unnest(c) AS c, generate_subscripts(c, 1) AS j FROM (SELECT doc_id, para, k, regexp_split_to_array(l, '{PIECE_END}') AS c FROM para)),
piece AS (SELECT doc_id, para, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS p, c FROM (SELECT doc_id, para, k, j, trim(regexp_replace(c, '[^a-z0-9]+', ' ', 'g')) AS c FROM cut) WHERE c <> ''),
ahead AS (SELECT doc_id, p, c, list(c) OVER w AS l FROM piece WINDOW w AS (PARTITION BY doc_id, para ORDER BY p ROWS BETWEEN CURRENT ROW AND 99 FOLLOWING)),
near AS (SELECT doc_id, p, l, s, i FROM ahead JOIN known ON starts_with(s, c) AND (length(s) = length(c) OR s[length(c) + 1] = ' ')),
whole AS (SELECT doc_id, p, k, i FROM near, unnest(range(1, len(l) + 1)) AS t(k) WHERE array_to_string(l[1:k], ' ') = s),
best AS (SELECT doc_id, p, max(k) AS k, arg_max(i, k) AS i FROM whole GROUP BY doc_id, p),
taken AS (SELECT doc_id, p, k, i FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM best) WHERE r = 1
  UNION ALL SELECT doc_id, p, k, i FROM (SELECT b.*, row_number() OVER (PARTITION BY b.doc_id ORDER BY b.p) AS r FROM taken t JOIN best b ON b.doc_id = t.doc_id AND b.p >= t.p + t.k) WHERE r = 1),
per AS (SELECT doc_id, count(*) AS n, string_agg(i, '  ' ORDER BY p) AS ids FROM taken GROUP BY doc_id),
joined AS (SELECT d.doc_id, coalesce(per.n, 0) AS n, per.ids FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id),
{', '.join(steps)}
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, replace(coalesce(ids, ''), '  ', ',') AS sentence_ids,
       CASE WHEN len(got) > 0 THEN array_to_string(list_sort(list_distinct(got)), ',') WHEN contains(' ' || coalesce(ids, '') || ' ', ' {LAST[1]} ') THEN '{LAST[0]}' ELSE '' END AS licenses FROM s{len(RULES)}
"""
