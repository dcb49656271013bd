"""Personal data, licences and quality rules against brute force."""

import hashlib
import itertools
import random
import re

import cases
import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import catalog, license_scan, pii, quality_rules, tables

SF = f"{compare.DATA}/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(n - 9 * (n > 9) for n in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def confirmed(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if confirmed(k, m.group())]


def texts(spark):
    rng = random.Random(3)
    bits = ["a", "b@", "@", "c.d", ".", "-", "_", "1", "23", "4.5", "255", "256", ".9", "+", "(", ")", " ", "  ", "4111 1111 1111 1111", "4111111111111111", "+1 (555) 010-9999", "x@y.zz", "\x01", "\x02", "é", "😀", "\n", "0", "00", "%"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(2000)]
    rows += [(9000 + i, t) for i, t in enumerate([None, "", "1" * 5000, "a." * 5000, "a@b.c" * 2000, "1 " * 5000, "a@" + "b." * 5000 + "c", "1." * 5000])]
    return rows + [(20_000 + r.doc_id, r.text) for r in tables.documents(spark, SF).collect()]


def test_pii_base(spark, monkeypatch):
    rows = texts(spark)
    monkeypatch.setattr(tables, "documents", lambda *_: spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    got = {r.doc_id: r for r in catalog.op9_pii(spark, "").collect()}
    for i, text in rows:
        spans = base(text)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[0] == k for s in spans) for k in BASE]
        assert got[i].base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest(), repr(text)
        assert {"%s:%d:%d" % s for s in spans} <= set(got[i].spans.split(","))
        assert len(got[i].spans.split(",")) == len(got[i].scores.split(","))
    monkeypatch.setattr(tables, "documents", lambda *_: spark.createDataFrame([(1, "write to a@b.co"), (2, "see a@b.co here"), (3, "call +1 555 010 9999"), (4, "see +1 555 010 9999")], "doc_id long, text string"))
    assert {r.doc_id: r.scores for r in catalog.op9_pii(spark, "").collect()} == {1: "1.0", 2: "0.9", 3: "0.95", 4: "0.6"}


def test_pii_added_and_redacted(spark):
    text = "iban GB82 WEST 1234 5698 7654 32, not GB82 WEST 1234 5698 7654 33; social 123-45-6789, code 123-45-6780, mail é a@b.co"
    row = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    found = [(s.kind, text[s.start : s.end]) for s in row.first().pii]
    assert found == [("email", "a@b.co"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")]
    assert pii.redact(row).first().text == "iban <IBAN>, not GB82 WEST 1234 5698 7654 33; social <SSN>, code 123-45-6780, mail é <EMAIL>"
    alone = pii.detect(spark.createDataFrame([(1, "part 123-45-6780 of the list"), (2, None)], "doc_id long, text string"))
    assert [r.pii for r in alone.collect()] == [[], []] and pii.redact(alone).orderBy("doc_id").collect()[1].text is None


def slow_secrets(text):
    """Keys and tokens with a context word within 40 characters, up to the neighbouring proposals."""
    found = list(re.finditer(r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{20,}(?![A-Za-z0-9_+/-])(?!@|\.[A-Za-z0-9])", text))
    out = []
    for i, m in enumerate(found):
        before = text[max(found[i - 1].end() if i else 0, m.start() - 40) : m.start()]
        after = text[m.end() : min(found[i + 1].start() if i + 1 < len(found) else len(text), m.end() + 40)]
        v = m[0]
        real = len(v) <= 512 and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and re.search("[A-Za-z0-9]{12}", v) and len(set(v)) >= 10
        if real and re.search(rf"(?i)\b(?:{pii.CONTEXT['secret']})", before + " " + after):
            out.append((m.start(), m.end()))
    return out


def test_pii_secrets(spark):
    rng = random.Random(3)
    hexes, mixed = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows = [
        'deploy with token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8".',
        "api_key=sk_live_51HqLyjWDarjtT1zdp7dc then more",
        "commit 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 fixed it",
        "the key is aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 here",
        "key points of some-long-and-winding-page-name-2020",
        "token 9b0b3c6a43eb78aa99cbd7049c572391524f37a8@mail.example.org",
        "key " + "a1b2c3d4e5f6" * 100,
        "é😀 secret: QWxhZGRpbjpvcGVuIHNlc2FtZQ1x/+ab",
    ]
    for _ in range(200):
        parts = [rng.choice(["token", "the", "key", "of", "plain words " * 5, "".join(rng.choices(hexes, k=rng.randint(15, 45))), "".join(rng.choices(mixed, k=rng.randint(15, 30))), "=", "é"]) for _ in range(8)]
        rows.append(rng.choice([" ", "", ": ", "."]).join(parts))
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.pii if s.kind == "secret"] for r in pii.detect(table).collect()}
    assert got == {i: slow_secrets(t) for i, t in enumerate(rows)}
    assert [len(got[i]) for i in range(8)] == [1, 1, 0, 0, 0, 0, 0, 1]
    assert pii.redact(pii.detect(table)).where("doc_id = 0").first().text == 'deploy with token = "<SECRET>".'


def test_pii_edges(spark):
    out = pii.redact(pii.detect(cases.edges(spark).withColumn("pii", F.lit(1))))
    assert out.columns == ["doc_id", "text", "score"] and out.count() == len(cases.EDGES)
    assert pii.detect(cases.empty(spark)).count() == 0


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.\n# THE SOFTWARE IS PROVIDED \"AS IS\", without warranty of any kind, express or implied."
    rows = [(1, mit), (2, "Intro. Released under the MIT License.\nAll rights reserved."), (3, "# Licensed under the Apache License, Version 2.0 (the License);\n# you may not use this file except in compliance with the License."), (4, "license talk only"), (5, None), (6, "\n".join(reversed(mit.split("\n"))))]
    got = {r.doc_id: (r.licenses, r.license, r.confidence) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", "MIT", 1.0), 2: ("MIT,proprietary", "MIT", 0.9), 3: ("Apache-2.0", "Apache-2.0", 0.95), 4: ("", None, 0.0), 5: ("", None, 0.0), 6: ("", None, 0.0)}
    assert license_scan.scan(cases.edges(spark)).count() == len(cases.EDGES)
    assert license_scan.scan(cases.empty(spark)).count() == 0


def test_published_licences(spark):
    mit = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
    gpl = """ * This program is free software{0} you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation{1} either version {2} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful."""
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

{0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT"""
    name = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n\n"
    isc = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
    apache = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance\n# with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0'
    texts = [mit, gpl.format(":", ",", 3), gpl.format(";", ";", 2), mpl, mpl.replace("\n *", ""), bsd.format(""), bsd.format(name), isc, apache, mit.replace("\n", "\r\n")]
    # A known sentence does not go over a blank line or a sentence end.
    texts += ["All rights\n\nreserved.", "All rights.\nReserved", "All rights\nreserved"]
    got = {r.doc_id: (r.license, r.confidence) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = ["MIT", "GPL-3.0", "GPL-2.0", "MPL-2.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "MIT"]
    assert [got[i] for i in range(len(want))] == [(x, 0.9 if x == "BSD-2-Clause" else 1.0) for x in want]
    assert [got[i] for i in range(len(want), len(texts))] == [(None, 0.0), (None, 0.0), ("proprietary", 0.5)]


NOTICES = {
    "LGPL-2.1": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Zlib": """Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.""",
}


def test_notices_in_any_dress(spark):
    """Wrapped, on one line a paragraph, and behind comment marks."""
    rows, want = [], []
    for name, text in NOTICES.items():
        joined = re.sub(r"(?<!\n)\n(?!\n)", " ", text)
        for dressed in (text, joined, *("\n".join(f"{mark} {x}".rstrip() for x in text.split("\n")) for mark in ("#", "//", " *")), f"some code\n\n{text}\n\nmore code"):
            rows.append((len(rows), dressed))
            want.append(name)
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(n, got[i]) for i, n in enumerate(want) if got[i] != n] == []


def test_rules_are_ordered_with_no_other_licence_between(spark):
    mit, head, asis, gpl = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "The MIT License.", "The software is provided as is, without warranty of any kind, express or implied.", "This program is free software."
    texts = [(mit, head, asis), (mit, asis), (asis, mit), (mit, gpl, asis), (head, mit, mit, asis)]
    got = {r.doc_id: r.confidence for r in license_scan.scan(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [1.0, 1.0, 0.0, 0.0, 1.0]


def test_licences_against_sql(spark):
    con = compare.connect(f"{compare.DATA}/sf0.01")
    assert compare.difference(catalog.op4_license_scan(spark, f"{compare.DATA}/sf0.01"), con, license_scan.oracle_sql()) == ""


def slow_counts(text):
    words, lines, at = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated)


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Neither the name of {} nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL"""
ADVERTISING = "   * All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software.\n   * Neither"
MIT_PERM = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
NAMED = {
    BSD.format("Google Inc."): ("BSD-3-Clause", "BSD-3-Clause"),
    "\n".join(f"// {x}" for x in BSD.format("Google Inc.").split("\n")): ("BSD-3-Clause", "BSD-3-Clause"),
    BSD.format("the LLVM Team, University of Illinois at\nUrbana-Champaign,"): ("BSD-3-Clause", "BSD-3-Clause"),
    BSD.format("the FreeBSD Project").replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE FREEBSD PROJECT"): ("BSD-3-Clause", "BSD-3-Clause"),
    BSD.format("X").replace("contributors may be used", "people can be used"): ("BSD-unspecified", "BSD-unspecified"),
    BSD.format("the University").replace("   * Neither", ADVERTISING): ("BSD-4-Clause", "BSD-4-Clause"),
    "# SPDX-License-Identifier: MIT\nx = 1": ("MIT", "MIT"),
    "x /* spdx-license-identifier: (GPL-2.0-or-later WITH Linux-syscall-note) OR BSD-3-Clause */ y": ("BSD-3-Clause,GPL-2.0", "BSD-3-Clause"),
    "// SPDX-License-Identifier: Apache-2.0 OR MIT": ("Apache-2.0,MIT", "Apache-2.0"),
    "SPDX-License-Identifier: LicenseRef-Own": ("", None),
    "## License\n\nThis project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.": ("MIT", "MIT"),
    "This library is released under the\n3-clause BSD license.": ("BSD-3-Clause", "BSD-3-Clause"),
    "Licensed under GPLv3.": ("GPL-3.0", "GPL-3.0"),
    f'<html><p class="x">{MIT_PERM}</p><p>THE <b>SOFTWARE</b> IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED</p>': ("MIT", "MIT"),
    "The name of the game is a good one. This project is licensed under no terms.": ("", None),
}


def test_names_expressions_and_markup(spark):
    texts = list(NAMED)
    got = {r.doc_id: (r.licenses, r.license) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {texts[i]: x for i, x in got.items()} == NAMED


def test_spdx_identifiers_are_told_apart(spark):
    rows = [(i, f"/* SPDX-License-Identifier: {x} */") for i, x in enumerate(license_scan.SPDX)]
    got = {r.doc_id: r.licenses for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(license_scan.SPDX))


def test_counts(spark):
    rng = random.Random(1)
    bits = ["a", "b", " ", "\n", "c ", "\xa0", "#", "a b a b a b ", "\n\n", "é"]
    for text in [r.text or "" for r in tables.documents(spark, SF).collect()] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2000)]:
        assert quality_rules.counts(text) == slow_counts(text)


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    chain = quality_rules.Chain(rng.normal(size=(10, 2)), rng.normal(size=(2, 2)))
    for _ in range(200):
        x = rng.normal(size=(rng.integers(1, 8), 10))

        def value(y, e=x @ chain.weights):
            return sum(e[i, y[i]] for i in range(len(y))) + sum(chain.moves[y[i - 1], y[i]] for i in range(1, len(y)))

        assert tuple(chain.viterbi(chain.lean(x))) == max(itertools.product((0, 1), repeat=len(x)), key=value)


def test_likelihood_and_gradient():
    rng = np.random.default_rng(1)
    docs = [rng.normal(size=(n, 10)) for n in (1, 4, 3, 6)]
    labels = [rng.integers(0, 2, len(x)) for x in docs]
    chain, data = quality_rules.Chain(rng.normal(size=(10, 2)), rng.normal(size=(2, 2))), quality_rules.Padded(docs, labels)

    def slow():
        total = 0.0
        for x, y in zip(docs, labels):
            e = x @ chain.weights
            score = [sum(e[i, c[i]] for i in range(len(c))) + sum(chain.moves[c[i - 1], c[i]] for i in range(1, len(c))) for c in itertools.product((0, 1), repeat=len(x))]
            total += score[int("".join(map(str, y)), 2)] - np.log(np.exp(score).sum())
        return total

    value, by_weights, by_moves = chain.likelihood(data)
    assert abs(value - slow()) < 1e-9
    for parameter, gradient in ((chain.weights, by_weights), (chain.moves, by_moves)):
        for at in np.ndindex(parameter.shape):
            parameter[at] += 1e-5
            up = slow()
            parameter[at] -= 2e-5
            assert abs((up - slow()) / 2e-5 - gradient[at]) < 1e-5
            parameter[at] += 1e-5


def test_mixed_documents_are_labelled_by_line(spark):
    sf = f"{compare.DATA}/sf0.1"
    docs, labels = tables.documents(spark, sf), tables.labels(spark, sf)
    chain = quality_rules.fit(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1 and quality is not null"), "doc_id").select("quality", "text").where("length(text) > 200").orderBy("doc_id").limit(1200).collect()
    good, bad = ([r.text.split("\n") for r in held if r.quality == q] for q in (1, 0))
    rows, truth = [], {}
    for i in range(min(200, len(bad))):
        menus = [bad[i][1:5] or bad[i], bad[-1 - i][1:4] or bad[-1 - i]]
        body = good[i][:12]
        parts = [(menus[0], "0"), (body, "1"), (menus[1], "0")] if i % 2 else [(body, "1"), (menus[0], "0"), (good[-1 - i][:6], "1")]
        rows.append((i, "\n".join(x for lines, _ in parts for x in lines)))
        truth[i] = "".join(c * len(lines) for lines, c in parts)
    got = {r.doc_id: r.content_lines for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), chain).collect()}
    right = [a == b for i in truth for a, b in zip(got[i], truth[i])]
    assert all(len(got[i]) == len(truth[i]) for i in truth) and len(truth) > 100 and np.mean(right) >= 0.9, np.mean(right)


def test_kept_follows_the_labels_and_counts(spark):
    sf = f"{compare.DATA}/sf0.01"
    texts = {r.doc_id: r.text or "" for r in tables.documents(spark, sf).collect()}
    rows = catalog.op8_quality_rules(spark, sf).collect()
    for r in rows:
        lines = texts[r.doc_id].split("\n")
        total = sum(map(len, lines))
        share = sum(len(x) for x, c in zip(lines, r.content_lines) if c == "1") / total if total else 0.0
        assert len(lines) == len(r.content_lines) and abs(share - r.content_share) < 1e-9
        n, *_, repeated = slow_counts(texts[r.doc_id])
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n) and r.kept == (not r.base_failed and r.content_share >= 0.5)
    assert sum("01" in r.content_lines or "10" in r.content_lines for r in rows) > 0.03 * len(rows)


def test_texts_of_many_lines(spark):
    chain = quality_rules.fit(tables.documents(spark, SF), tables.labels(spark, SF))
    rows = [(i, "some words here.\n" * 9) for i in range(200)] + [(1000, "\n" * 1_000_000), (1001, "a b c\n" * 300_000)]
    got = {r.doc_id: r.n for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), chain).selectExpr("doc_id", "length(content_lines) as n").collect()}
    assert got[1000] == 1_000_001 and got[1001] == 300_001 and got[5] == 10


def test_quality_rules_keep_the_clean(spark):
    sf = f"{compare.DATA}/sf0.01"
    rows = catalog.op8_quality_rules(spark, sf).join(tables.labels(spark, sf), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.99 and kept[0] < 0.2


@pytest.mark.parametrize("trained", [True, False])
def test_quality_rules_edges(spark, trained):
    chain = quality_rules.fit(tables.documents(spark, SF), tables.labels(spark, SF)) if trained else None
    rows = quality_rules.judge(cases.edges(spark), chain).collect()
    assert len(rows) == len(cases.EDGES) and not any(r.kept for r in rows if r.n_words < 10 or r.doc_id == 6)
    assert quality_rules.judge(cases.empty(spark), chain).count() == 0
