"""Usual notices, expressions of identifiers, titles and bodies of licences, found by the scan and by its SQL."""

import pandas as pd

from logweave.llm import license_scan, queries
from tests.oracle import same

NOTICES = {
    "Distributed under the MIT License.": "MIT",
    "This is licensed. Licensed under the MIT license, see LICENSE.txt": "MIT",
    "Licensed under MIT.": "MIT",
    "License: Apache-2.0": "Apache-2.0",
    "// SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT",
    "# SPDX-License-Identifier: (GPL-2.0 OR MIT) AND BSD-3-Clause": "BSD-3-Clause,GPL-2.0-only,MIT",
    "SPDX-License-Identifier: GPL-2.0": "GPL-2.0-only",
    "Licensed under the GPL version 2 or later": "GPL-2.0-or-later",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS.': "ISC",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 3 as\npublished by the Free Software Foundation.": "GPL-3.0-only",
    "  GNU GENERAL PUBLIC LICENSE\n    Version 2, June 1991\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.": "GPL-2.0-only",
    "    Apache License\n  Version 2.0, January 2004": "Apache-2.0",
    "Released under the 3-Clause BSD License (see the file).": "BSD-3-Clause",
    "This software is licensed under the Zlib license": "Zlib",
    "the license of the house": "",
    "SPDX-License-Identifier: nothing-known OR other": "",
    "mit or apache": "",
}


def test_notices(make_docs):
    rows = list(enumerate(NOTICES))
    got = {r["doc_id"]: ",".join(r["licenses"]) for r in license_scan.scan_licenses(make_docs(rows)).collect()}
    assert got == {k: NOTICES[t] for k, t in rows}


def test_every_generated_notice(make_docs):
    """Each sentence of the catalogue gives its own identifier, also where it ends a wrapped line."""
    pairs = list(license_scan.SENTENCES.items())
    rows = [(k, s.replace(" ", "\n * ", 2) + ".") for k, (s, _) in enumerate(pairs)]
    got = {r["doc_id"]: r["sentence_ids"] for r in license_scan.scan_licenses(make_docs(rows)).collect()}
    assert got == {k: [i] for k, (_, i) in enumerate(pairs)}


def test_notices_in_sql(make_docs, tmp_path):
    rows = [*enumerate([*NOTICES, " ".join(NOTICES), "\n".join(NOTICES), "SPDX-License-Identifier: " + " OR ".join(license_scan.SPDX[:9])]), (100, None), (101, "")]
    pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}).to_parquet(tmp_path / "documents.parquet")
    same(make_docs([]).sparkSession, queries.op1_license_scan, license_scan.oracle(), str(tmp_path))
