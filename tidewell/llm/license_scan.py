"""License recognition by sentence rules.

Texts are normalised (lower case, comment marks and punctuation gone, one space), with marks
left at line feeds and at sentence ends that white space follows. A known licence sentence, of a
table of fixed size, is recognised where it stands between two marks; line feeds inside it do not
count, so notices wrapped at any column are found, but blank lines and sentence ends do. A
licence rule is an ordered list of sentence identifiers: it matches where its identifiers occur
in this order among a document's recognised sentences with none of another licence between. All
of it is SQL functions. The SQL knows the one-line notices only (``SENTENCES`` and ``RULES``).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tables import whole_text

#: Known licence sentences (fixed values), as they are after normalising, with their identifiers.
SENTENCES = {
    "MIT-REL": "released under the mit license",
    "MIT-LIC": "licensed under the mit license",
    "MIT-HEAD": "the mit license",
    "MIT-PERM": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "MIT-ASIS": "the software is provided as is without warranty of any kind express or implied",
    "APACHE-LIC": "licensed under the apache license version 2 0",
    "APACHE-HEAD": "licensed under the apache license version 2 0 the license",
    "APACHE-USE": "you may not use this file except in compliance with the license",
    "APACHE-COPY": "you may obtain a copy of the license at",
    "GPL3-WORK": "this work is licensed under the gnu general public license version 3",
    "GPL3-LIC": "licensed under the gnu general public license version 3",
    "GPL2-LIC": "licensed under the gnu general public license version 2",
    "GPL-FREE": "this program is free software",
    "GPL-REDIST": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "LGPL-LIC": "licensed under the gnu lesser general public license version 3",
    "AGPL-LIC": "licensed under the gnu affero general public license version 3",
    "MPL-LIC": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "BSD-REDIST": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSD-NAME": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "CC0-LIC": "this work is dedicated to the public domain under cc0 1 0",
    "CCBY-LIC": "licensed under cc by 4 0",
    "CCBYSA-LIC": "licensed under cc by sa 4 0",
    "CCBYNC-LIC": "licensed under cc by nc 4 0",
    "ISC-PERM": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "UNLICENSE": "this is free and unencumbered software released into the public domain",
    "RESERVED": "all rights reserved",
}
#: Licence rules: licence, ordered sentence identifiers, and the confidence of a match. All that match count.
RULES = [
    ("MIT", ["MIT-REL"], 0.9),
    ("MIT", ["MIT-LIC"], 0.9),
    ("MIT", ["MIT-PERM", "MIT-ASIS"], 1.0),
    ("MIT", ["MIT-HEAD", "MIT-PERM"], 0.95),
    ("Apache-2.0", ["APACHE-LIC"], 0.9),
    ("Apache-2.0", ["APACHE-HEAD", "APACHE-USE"], 0.95),
    ("Apache-2.0", ["APACHE-HEAD", "APACHE-USE", "APACHE-COPY"], 1.0),
    ("GPL-3.0", ["GPL3-WORK"], 0.9),
    ("GPL-3.0", ["GPL3-LIC"], 0.9),
    ("GPL-2.0", ["GPL2-LIC"], 0.9),
    ("GPL-unspecified", ["GPL-FREE", "GPL-REDIST"], 0.8),
    ("LGPL-3.0", ["LGPL-LIC"], 0.9),
    ("AGPL-3.0", ["AGPL-LIC"], 0.9),
    ("MPL-2.0", ["MPL-LIC"], 1.0),
    ("BSD-2-Clause", ["BSD-REDIST", "MIT-ASIS"], 0.8),
    ("BSD-3-Clause", ["BSD-REDIST", "BSD-NAME"], 1.0),
    ("CC0-1.0", ["CC0-LIC"], 0.9),
    ("CC-BY-4.0", ["CCBY-LIC"], 0.9),
    ("CC-BY-SA-4.0", ["CCBYSA-LIC"], 0.9),
    ("CC-BY-NC-4.0", ["CCBYNC-LIC"], 0.9),
    ("ISC", ["ISC-PERM"], 1.0),
    ("Unlicense", ["UNLICENSE"], 1.0),
    ("proprietary", ["RESERVED"], 0.5),
]
_FSF = "as published by the free software foundation"
_GNU = "you can redistribute it and or modify it under the terms of the gnu"
_LATER = "of the license or at your option any later version"
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"
_MERCHANT = "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_APPEAR = "this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
#: Whole sentences of the published licences and their notices (fixed values), several of one identifier where wordings differ.
PUBLISHED = [
    ("MIT-HEAD", "mit license"),
    ("MIT-HEAD", "the mit license mit"),
    ("MIT-PERM", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MIT-ASIS", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("APACHE-TITLE", "apache license version 2 0 january 2004"),
    ("GPL-FREE", "this file is free software"),
    ("GPL-FREE", "this library is free software"),
    ("GPL3-TITLE", "gnu general public license version 3 29 june 2007"),
    ("GPL2-TITLE", "gnu general public license version 2 june 1991"),
    ("GPL3-REDIST", f"{_GNU} general public license {_FSF} either version 3 {_LATER}"),
    ("GPL3-REDIST", f"{_GNU} general public license {_FSF} version 3 of the license"),
    ("GPL3-REDIST", f"{_GNU} general public license {_FSF} version 3"),
    ("GPL3-REDIST", f"{_GNU} general public license version 3 {_FSF}"),
    ("GPL2-REDIST", f"{_GNU} general public license {_FSF} either version 2 {_LATER}"),
    ("GPL2-REDIST", f"{_GNU} general public license {_FSF} version 2 of the license"),
    ("GPL2-REDIST", f"{_GNU} general public license {_FSF} version 2"),
    ("GPL2-REDIST", f"{_GNU} general public license version 2 {_FSF}"),
    ("V3-LATER", f"either version 3 {_LATER}"),
    ("V3-ONLY", "version 3 of the license"),
    ("V2-LATER", f"either version 2 {_LATER}"),
    ("V2-ONLY", "version 2 of the license"),
    ("V21-LATER", f"either version 2 1 {_LATER}"),
    ("V21-ONLY", "version 2 1 of the license"),
    ("LGPL3-TITLE", "gnu lesser general public license version 3 29 june 2007"),
    ("LGPL21-TITLE", "gnu lesser general public license version 2 1 february 1999"),
    ("LGPL-REDIST", f"{_GNU} lesser general public license {_FSF}"),
    ("LGPL3-REDIST", f"{_GNU} lesser general public license {_FSF} either version 3 {_LATER}"),
    ("LGPL21-REDIST", f"{_GNU} lesser general public license {_FSF} either version 2 1 {_LATER}"),
    ("AGPL-TITLE", "gnu affero general public license version 3 19 november 2007"),
    ("AGPL-REDIST", f"{_GNU} affero general public license {_FSF}"),
    ("AGPL3-REDIST", f"{_GNU} affero general public license {_FSF} either version 3 {_LATER}"),
    ("MPL-TITLE", "mozilla public license version 2 0"),
    ("BSD-NAME", f"neither the name of the copyright holders nor the names of its contributors {_ENDORSE}"),
    ("BSD-NAME", f"neither the name of the university nor the names of its contributors {_ENDORSE}"),
    ("BSD-NAME", f"neither the name of the organization nor the names of its contributors {_ENDORSE}"),
    ("BSD-ASIS", f"this software is provided by the copyright holders and contributors {_MERCHANT}"),
    ("BSD-ASIS", f"this software is provided by the regents and contributors {_MERCHANT}"),
    ("ISC-PERM", f"permission to use copy modify and or distribute {_APPEAR}"),
    ("ISC-PERM", f"permission to use copy modify and distribute {_APPEAR}"),
    ("CC0-TITLE", "cc0 1 0 universal"),
    ("ZLIB-PERM", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("ZLIB-ALTER", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("BOOST-TITLE", "boost software license version 1 0 august 17th 2003"),
    ("BOOST-LIC", "distributed under the boost software license version 1 0"),
    ("BSD-ADV", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("GPL3-LIC", "gplv3"),
    ("GPL3-LIC", "licensed under gplv3"),
    ("GPL3-LIC", "licensed under the gplv3"),
    ("GPL2-LIC", "gplv2"),
    ("GPL2-LIC", "licensed under gplv2"),
    ("GPL2-LIC", "licensed under the gplv2"),
    ("EPL-LIC", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("WTFPL-TITLE", "do what the fuck you want to public license"),
    ("PSF-LIC", "licensed to psf under a contributor agreement"),
    ("ASF-LIC", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("ASF-GRANT", "the asf licenses this file to you under the apache license version 2 0 the license"),
]
#: Sentences that name somebody between a head and a tail (fixed values): identifier, head, tail; an empty tail: whatever follows.
NAMING = [
    ("BSD-NAME", "neither the name of", f"nor the names of its contributors {_ENDORSE}"),
    ("BSD-NAME", "neither the names of", f"nor the names of its contributors {_ENDORSE}"),
    ("BSD-NAME", "the name of", _ENDORSE.replace("may be used", "may not be used")),
    ("BSD-NAME", "the names of", _ENDORSE.replace("may be used", "may not be used")),
    ("BSD-ASIS", "this software is provided by", _MERCHANT),
    ("BSD-SOME-NAME", "neither the name of", ""),
    ("BSD-SOME-NAME", "neither the names of", ""),
]
#: Most words of a name in such a sentence, and of what follows a head whose tail is not known.
NAME_WORDS, REST_WORDS = 16, 60
#: How projects say what they are under, and the licences they name there (fixed values).
_SUBJECT = "(?:this|the) (?:project|software|library|package|code|repository|program|module|tool|file|application) is (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?"
NAMED = {
    "mit license": "MIT-LIC", "apache license version 2 0": "APACHE-LIC", "apache license 2 0": "APACHE-LIC", "apache 2 0 license": "APACHE-LIC", "gnu general public license version 3": "GPL3-LIC",
    "gnu general public license v3 0": "GPL3-LIC", "gnu gpl v3": "GPL3-LIC", "gpl v3": "GPL3-LIC", "gplv3": "GPL3-LIC", "gplv3 license": "GPL3-LIC", "gnu general public license version 2": "GPL2-LIC",
    "gnu general public license v2 0": "GPL2-LIC", "gnu gpl v2": "GPL2-LIC", "gpl v2": "GPL2-LIC", "gplv2": "GPL2-LIC", "gnu lesser general public license version 3": "LGPL-LIC", "gnu affero general public license version 3": "AGPL-LIC",
    "mozilla public license version 2 0": "MPL-TITLE", "mozilla public license 2 0": "MPL-TITLE", "bsd 3 clause license": "BSD3-LIC", "3 clause bsd license": "BSD3-LIC", "new bsd license": "BSD3-LIC",
    "bsd 2 clause license": "BSD2-LIC", "2 clause bsd license": "BSD2-LIC", "simplified bsd license": "BSD2-LIC", "isc license": "ISC-LIC", "unlicense": "UNLICENSE", "boost software license": "BOOST-LIC",
}
#: SPDX identifiers that are read from ``SPDX-License-Identifier`` lines (fixed values); -only, -or-later and + may follow those of GNU.
SPDX = """0BSD AFL-3.0 AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 FTL GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND ICU ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 Libpng
MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Ruby UPL-1.0 Unicode-DFS-2016 Unlicense W3C WTFPL X11 Zlib ZPL-2.1""".split()
_SPDX_HEAD = "spdx license identifier"


def spelled(name: str) -> str:
    """A name as it is after normalising."""
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()
PUBLISHED_RULES = [
    ("Apache-2.0", ["APACHE-TITLE"], 1.0),
    ("GPL-3.0", ["GPL3-TITLE"], 1.0),
    ("GPL-3.0", ["GPL-FREE", "GPL3-REDIST"], 1.0),
    ("GPL-3.0", ["GPL-FREE", "GPL-REDIST", "V3-LATER"], 1.0),
    ("GPL-3.0", ["GPL-FREE", "GPL-REDIST", "V3-ONLY"], 1.0),
    ("GPL-2.0", ["GPL2-TITLE"], 1.0),
    ("GPL-2.0", ["GPL-FREE", "GPL2-REDIST"], 1.0),
    ("GPL-2.0", ["GPL-FREE", "GPL-REDIST", "V2-LATER"], 1.0),
    ("GPL-2.0", ["GPL-FREE", "GPL-REDIST", "V2-ONLY"], 1.0),
    ("LGPL-3.0", ["LGPL3-TITLE"], 1.0),
    ("LGPL-3.0", ["GPL-FREE", "LGPL3-REDIST"], 1.0),
    ("LGPL-3.0", ["GPL-FREE", "LGPL-REDIST", "V3-LATER"], 1.0),
    ("LGPL-3.0", ["GPL-FREE", "LGPL-REDIST", "V3-ONLY"], 1.0),
    ("LGPL-2.1", ["LGPL21-TITLE"], 1.0),
    ("LGPL-2.1", ["GPL-FREE", "LGPL21-REDIST"], 1.0),
    ("LGPL-2.1", ["GPL-FREE", "LGPL-REDIST", "V21-LATER"], 1.0),
    ("LGPL-2.1", ["GPL-FREE", "LGPL-REDIST", "V21-ONLY"], 1.0),
    ("AGPL-3.0", ["AGPL-TITLE"], 1.0),
    ("AGPL-3.0", ["GPL-FREE", "AGPL3-REDIST"], 1.0),
    ("AGPL-3.0", ["GPL-FREE", "AGPL-REDIST", "V3-LATER"], 1.0),
    ("MPL-2.0", ["MPL-TITLE"], 0.9),
    ("BSD-2-Clause", ["BSD-REDIST", "BSD-ASIS"], 0.9),
    ("BSD-3-Clause", ["BSD-REDIST", "BSD-NAME", "BSD-ASIS"], 1.0),
    ("CC0-1.0", ["CC0-TITLE"], 1.0),
    ("Zlib", ["ZLIB-PERM", "ZLIB-ALTER"], 1.0),
    ("BSL-1.0", ["BOOST-TITLE"], 1.0),
    ("BSL-1.0", ["BOOST-LIC"], 0.9),
    ("BSD-4-Clause", ["BSD-REDIST", "BSD-ADV", "BSD-NAME"], 1.0),
    ("BSD-4-Clause", ["BSD-REDIST", "BSD-ADV"], 0.8),
    ("BSD-3-Clause", ["BSD3-LIC"], 0.9),
    ("BSD-2-Clause", ["BSD2-LIC"], 0.9),
    ("BSD-unspecified", ["BSD-REDIST", "BSD-SOME-NAME"], 0.8),
    ("ISC", ["ISC-LIC"], 0.9),
    ("EPL-2.0", ["EPL-LIC"], 1.0),
    ("WTFPL", ["WTFPL-TITLE"], 1.0),
    ("Python-2.0", ["PSF-LIC"], 0.8),
    ("Apache-2.0", ["ASF-LIC", "ASF-GRANT"], 1.0),
    *((name, [f"SPDX-{name}"], 1.0) for name in SPDX),
]


def rule_pattern(name: str, keys: list[str], rules: list[tuple]) -> str:
    """A pattern for the comma-framed identifier sequence: the keys in order, with only identifiers of the same licence between."""
    own = "|".join(sorted({k for n, all_keys, _ in rules if n == name for k in all_keys}))
    return "," + f",(?:(?:{own}),)*".join(keys) + ","

#: "v. 2.0" is no sentence end, nor is it at the end of a wrapped line; neither is "Inc." before a small letter.
_VERSION = r"(?<![a-z0-9])(v|ver|vers)\.[\x20\x09]*(?:\r?\n[\x20\x09#*/;%-]*)?(?=[0-9])"
_COMPANY = r"(?<![A-Za-z0-9])([Ii]nc|[Ll]td|[Cc]orp|[Cc]o|LLC|GmbH|[Dd]r|[Mm]r|[Ss]t|et al)\.(?=\s[\s#*/;%-]*[a-z])"
#: Mark-up that ends a sentence, and other mark-up.
_BLOCK, _INLINE = r"</?(?:p|br|div|li|pre|h[1-6]|td|tr|ul|ol|blockquote|body)\b[^<>]{0,200}>", r"</?(?:a|b|i|em|strong|code|span|tt|u|var)\b[^<>]{0,200}>"


def marked(text: Column) -> Column:
    """Words with one space between, ``S`` for sentence ends, blank lines and blocks of mark-up, ``N`` for other line feeds."""
    out = F.lower(F.regexp_replace(text, _COMPANY, "$1 "))
    out = F.when(F.contains(out, F.lit("<")), F.regexp_replace(F.regexp_replace(out, _INLINE, " "), _BLOCK, " S ")).otherwise(out)
    out = F.regexp_replace(F.replace(out, F.lit("spdx-license-identifier:"), F.lit(f"\n{_SPDX_HEAD} ")), _VERSION, "$1 ")
    out = F.regexp_replace(out, r"[.;:!?](?=\s|\z)", " S ")
    out = F.regexp_replace(out, r"\n[^a-z0-9\nS]*(?=\n)", " S ")
    return F.regexp_replace(F.replace(out, F.lit("\n"), F.lit(" N ")), "[^a-z0-9SN]+", " ")


def _wrapped(sentence: str) -> str:
    """A pattern for a sentence that may be wrapped at any of its spaces."""
    return sentence.replace(" ", "(?: N)? ")


def _naming(head: str, tail: str) -> str:
    words = f"(?:(?: N)? [a-z0-9]+){{1,{NAME_WORDS if tail else REST_WORDS}}}{'?' if tail else ''}"
    return _wrapped(head) + words + (f"(?: N)? {_wrapped(tail)}" if tail else "")


def _keys(sentences: Column, known: Column) -> Column:
    """Identifiers of recognised sentences, in order; an SPDX line may have several, or none."""
    ids = "|".join(sorted({spelled(x) for x in SPDX}, key=len, reverse=True))
    by_name = F.create_map(*[F.lit(x) for name in SPDX for x in (spelled(name), f"SPDX-{name}")])
    projects = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def of(sentence: Column) -> Column:
        named = F.lit(None).cast("string")
        for key, head, tail in reversed(NAMING):
            named = F.when(F.startswith(sentence, F.lit(f"{head} ")) & F.endswith(sentence, F.lit(f" {tail}" if tail else "")), key).otherwise(named)
        said = F.try_element_at(projects, F.regexp_replace(sentence, f"^{_SUBJECT}(.*?)(?: see .*)?$", "$1"))
        spdx = F.transform(F.regexp_extract_all(sentence, F.lit(f"(?<= )(?:{ids})(?= |$)"), F.lit(0)), lambda x: F.element_at(by_name, x))
        return F.when(F.startswith(sentence, F.lit(_SPDX_HEAD)), spdx).otherwise(F.array(F.coalesce(F.try_element_at(known, sentence), said, named)))

    return F.array_compact(F.flatten(F.transform(sentences, lambda s: of(F.replace(s, F.lit(" N "), F.lit(" "))))))


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple] = RULES + PUBLISHED_RULES, published: list[tuple[str, str]] = PUBLISHED) -> DataFrame:
    """One row per input row: ``doc_id, sentence_ids, licenses, license, confidence``.

    ``sentence_ids`` is the comma-joined sequence of recognised sentences in text order,
    ``licenses`` the comma-joined ascending names of all licences whose rule matches,
    ``license`` the one of the greatest confidence (ties: first name) with its ``confidence``,
    or null and 0. Null and empty texts match nothing. Other columns are ignored, repeated
    rows scanned each, an empty table gives an empty result.
    """
    pairs = [(sentence, key) for key, sentence in [*sentences.items(), *published]]
    known = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    starts = "|".join(sorted({s.split(" ")[0] for s, _ in pairs} | {h.split(" ")[0] for _, h, _ in NAMING} | {"spdx"}))
    names = "|".join(map(_wrapped, sorted(NAMED, key=len, reverse=True)))
    forms = [_wrapped(s) for s in sorted((s for s, _ in pairs), key=len, reverse=True)]
    forms += [_naming(head, tail) for _, head, tail in NAMING] + [f"{_wrapped(_SUBJECT)}(?:{names})(?:(?: N)? see(?:(?: N)? [a-z0-9]+){{1,{NAME_WORDS}}})?", f"{_SPDX_HEAD}(?: [a-z0-9]+){{1,{REST_WORDS}}}"]
    text = whole_text()
    # Texts without the first word of any known sentence are not marked.
    some = F.regexp_like(text, F.lit(rf"(?i)(?<![a-z0-9])(?:{starts})(?![a-z0-9])"))
    hits = F.regexp_extract_all(marked(text), F.lit(rf"(?:^ ?|(?<=[SN] ))({'|'.join(forms)})(?= ?(?:[SN]|$))"), F.lit(1))
    parts = F.when(some, hits).otherwise(F.array().cast("array<string>"))
    found = docs.select("doc_id", _keys(parts, known).alias("keys"))
    line = F.concat(F.lit(","), F.array_join("keys", ","), F.lit(","))
    found = found.select("doc_id", F.array_join("keys", ",").alias("sentence_ids"), line.alias("line"))
    hits = [F.when(F.regexp_like("line", F.lit(rule_pattern(name, keys, rules))), F.struct((-F.lit(float(sure))).alias("rank"), F.lit(name).alias("name"))) for name, keys, sure in rules]
    matched = F.when(F.col("sentence_ids") == "", F.array().cast("array<struct<rank:double,name:string>>")).otherwise(F.array_compact(F.array(*hits)))
    found = found.select("doc_id", "sentence_ids", matched.alias("matched"))
    best = F.array_min("matched")
    return found.select(
        "doc_id",
        "sentence_ids",
        F.array_join(F.array_sort(F.array_distinct(F.transform("matched", lambda m: m["name"]))), ",").alias("licenses"),
        best["name"].alias("license"),
        F.coalesce(-best["rank"], F.lit(0.0)).alias("confidence"),
    )


def oracle_sql() -> str:
    """The same over ``documents`` in DuckDB."""
    known = ", ".join(f"('{k}', '{s}')" for k, s in SENTENCES.items())
    rules = ", ".join(f"('{name}', '{rule_pattern(name, keys, RULES)}', {sure})" for name, keys, sure in RULES)
    return rf"""
WITH known(id, sentence) AS (VALUES {known}), rules(name, keys, sure) AS (VALUES {rules}),
parts AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS pos
          FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\n|[.;:!?][\x20\x09]+') AS p FROM documents)),
seq AS (SELECT doc_id, string_agg(id, ',' ORDER BY pos) AS ids FROM parts JOIN known
        ON sentence = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) GROUP BY doc_id),
hits AS (SELECT doc_id, name, max(sure) AS sure FROM seq JOIN rules ON regexp_matches(',' || ids || ',', keys) GROUP BY ALL),
best AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses, arg_min(name, (-sure, name)) AS license, max(sure) AS confidence FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses, license, coalesce(confidence, 0)::DOUBLE AS confidence
FROM documents d LEFT JOIN seq USING (doc_id) LEFT JOIN best USING (doc_id)
"""
