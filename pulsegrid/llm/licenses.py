"""Licence scans by sentence rules.

A text's lines are split into sentences, sentences are normalised (lower case,
letters and digits only, years and holders of copyright lines dropped), and
known licence sentences become identifiers. The sequence of identifiers is then
matched against ordered rules: a rule names a licence and the identifiers that
must follow one another, unknown sentences of the same notice aside; longer
rules win and use up what they match.

Results: one row per text, also for repeated rows and equal or null ids; a null or
empty text has no sentences and no licence, an empty table gives an empty result,
other columns are not read. The time is in proportion to a text's length.
Known sentences that no rule uses are reported as ``UNMATCHED``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.stages import bounded
from pulsegrid.llm.textops import released, slices

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "apache-ref": "Licensed under the Apache License, Version 2.0",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-ref": "Released under the MIT License",
    "mit-ref2": "Licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-ref": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-ref": "This work is licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ccbync-ref": "Licensed under CC BY-NC 4.0",
    "ccby-ref": "Licensed under CC BY 4.0",
    "ccby-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0-work": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "epl-work": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "bsd-asis": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "isc-asis": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "zero-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "version3-2007": "Version 3, 29 June 2007",
    "version3-agpl": "Version 3, 19 November 2007",
    "version2-1991": "Version 2, June 1991",
    "version21-1999": "Version 2.1, February 1999",
    "apache-title": "Apache License",
    "apache-version": "Version 2.0, January 2004",
    "mpl-title": "Mozilla Public License Version 2.0",
    "epl-title": "Eclipse Public License - v 2.0",
    "epl1-title": "Eclipse Public License - v 1.0",
    "bsl-title": "Boost Software License - Version 1.0 - August 17th, 2003",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following',
    "artistic-title": "The Artistic License 2.0",
    "ofl-work": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "ofl-title": "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007",
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cddl-title": "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0",
    "eupl-work": "Licensed under the EUPL",
    "mspl-title": "Microsoft Public License (Ms-PL)",
    "postgres-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "cc0-title": "CC0 1.0 Universal",
    "ccby-title": "Attribution 4.0 International",
    "ccbysa-title": "Attribution-ShareAlike 4.0 International",
    "ccbync-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "ccbynd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "ccbyncsa-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "ccbyncnd-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "odbl-work": "This database is made available under the Open Database License",
    "ccbysa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}

# Names that stand in sentences that only refer to a licence, and what stands before them.
NAMES = {
    "MIT": ("MIT License", "MIT licence"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"),
    "ISC": ("ISC License",),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Zlib": ("zlib License",),
    "CC-BY-4.0": ("CC BY 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC0-1.0": ("CC0 1.0",),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
    "ODbL-1.0": ("Open Database License 1.0", "ODbL 1.0"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "EUPL-1.2"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0",),
    "PSF-2.0": ("Python Software Foundation License", "PSF License"),
    "PostgreSQL": ("PostgreSQL License",),
    "MS-PL": ("Microsoft Public License",),
    "WTFPL": ("WTFPL",),
    "Unlicense": ("Unlicense",),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "Mozilla Public License 1.1"),
    "EPL-1.0": ("Eclipse Public License 1.0",),
}
REFERRING = ["Licensed", "Released", "Distributed", *(f"This {x} is {y}" for x in ("project", "software", "work", "program", "library", "package", "code", "file", "repository") for y in ("licensed", "released", "distributed"))]

# Rules in order, the longest sequences first.
RULES = [
    ("Apache-2.0", ("apache-grant", "apache-comply", "apache-copy", "apache-asis", "apache-see")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope", "lgpl-see")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-see")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-see")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0", ("gpl-title", "version3-2007")),
    ("GPL-2.0", ("gpl-title", "version2-1991")),
    ("LGPL-3.0", ("lgpl-title", "version3-2007")),
    ("LGPL-2.1", ("lgpl-title", "version21-1999")),
    ("AGPL-3.0", ("agpl-title", "version3-agpl")),
    ("Apache-2.0", ("apache-title", "apache-version")),
    ("BSL-1.0", ("bsl-title", "bsl-grant")),
    ("ISC", ("isc-grant", "isc-asis")),
    ("0BSD", ("zero-grant", "isc-asis")),
    ("Apache-2.0", ("apache-grant",)),
    ("Apache-2.0", ("apache-ref",)),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-ref2",)),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("CC-BY-NC-4.0", ("ccbync-ref",)),
    ("CC-BY-4.0", ("ccby-ref",)),
    ("CC-BY-4.0", ("ccby-work",)),
    ("CC0-1.0", ("cc0-work",)),
    ("Unlicense", ("unlicense",)),
    ("LicenseRef-All-Rights-Reserved", ("reserved",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("EPL-2.0", ("epl-work",)),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("CC-BY-SA-4.0", ("ccbysa-work",)),
    ("CC-BY-NC-4.0", ("ccbync-work",)),
    ("CC-BY-ND-4.0", ("ccbynd-work",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa-work",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd-work",)),
    ("CC0-1.0", ("cc0-title",)),
    ("CC-BY-4.0", ("ccby-title",)),
    ("CC-BY-SA-4.0", ("ccbysa-title",)),
    ("ODbL-1.0", ("odbl-work",)),
    ("MPL-2.0", ("mpl-title",)),
    ("EPL-2.0", ("epl-title",)),
    ("EPL-1.0", ("epl1-title",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-title",)),
    ("Artistic-2.0", ("artistic-title",)),
    ("OFL-1.1", ("ofl-work",)),
    ("OFL-1.1", ("ofl-title",)),
    ("WTFPL", ("wtfpl-title",)),
    ("CDDL-1.0", ("cddl-title",)),
    ("EUPL-1.2", ("eupl-work",)),
    ("MS-PL", ("mspl-title",)),
    ("PostgreSQL", ("postgres-grant",)),
    ("0BSD", ("zero-grant",)),
    *((x, (f"ref {x}",)) for x in NAMES),
]

#: Unknown sentences that may stand between two of a rule.
GAP = 3

_END = re.compile(r"(?<=[.!?;:])[\s]+|[\r\n]*\n[\s*#/-]*\n[\r\n]*|\s+(?=\(?[0-9a-z][.)]\s)")
_OUTSIDE = re.compile(r"[^a-z0-9]+")
# years and holder of a copyright line, up to the next sentence on it
_COPYRIGHT = re.compile(r"^[^\w\n(©]*(?:copyright[^\S\n]*(?:\(c\)|©|(?=[^\S\n][0-9]{4}))|(?:\(c\)|©)(?=[^\S\n]*[0-9]{4}))[^\n]*?(?=[.!?;:]\s|[.,]?[^\S\n]*$|[\s,]all rights reserved)", re.I | re.M)
_SPDX = re.compile(r"SPDX-License-Identifier:\s*([A-Za-z0-9.+-]+)")


def normalised(sentence: str) -> str:
    return _OUTSIDE.sub(" ", sentence.lower()).strip()


_KNOWN = {normalised(s): k for k, s in SENTENCES.items()}
#: First words of known sentences: only sentences that begin so are looked at.
_LONGEST = max(map(len, _KNOWN))
# a known sentence may itself be cut where a text is cut; its pieces then follow one another
_PIECES: dict[str, list[str]] = {}
for _k, _s in SENTENCES.items():
    _PIECES[_k] = [p for p in (normalised(x) for x in _END.split(_s)) if p]
for _x, _names in NAMES.items():
    for _s in dict.fromkeys(f"{r} under {the}{n}" for r in REFERRING for the in ("the ", "") for n in _names):
        if normalised(_s) not in _KNOWN:
            _PIECES[f"ref {_x}|{_s}"] = [p for p in (normalised(x) for x in _END.split(_s)) if p]
_FIRST: dict[str, list[str]] = {}
for _k, _p in _PIECES.items():
    _FIRST.setdefault(_p[0], []).append(_k)
for _k in _FIRST.values():
    _k.sort(key=lambda k: -len(_PIECES[k]))


def sentences(text: str) -> list[str]:
    """Normalised sentences; a line end ends one where the line before is a whole known sentence."""
    out: list[str] = []
    for block in _END.split(_COPYRIGHT.sub("\n\nCopyright\n\n", text)):
        if "\n" in block:
            lines = block.split("\n")
            whole = [normalised(x) for x in lines]
            if any(w in _FIRST for w in whole):
                held: list[str] = []
                for w in whole:
                    if w in _FIRST:
                        out += [" ".join(held)] if held else []
                        out.append(w)
                        held = []
                    elif w:
                        held.append(w)
                out += [" ".join(held)] if held else []
                continue
        s = normalised(block)
        if s:
            out.append(s)
    return out


def identifiers(found: list[str]) -> list[tuple[int, str]]:
    """(place, identifier) of the known sentences."""
    out, i = [], 0
    while i < len(found):
        for k in _FIRST.get(found[i], ()):
            p = _PIECES[k]
            if found[i : i + len(p)] == p:
                out.append((i, k.split("|")[0]))
                i += len(p) - 1
                break
        i += 1
    return out


def recognise(known: list[tuple[int, str]]) -> tuple[list[str], int]:
    """Licences by the first rules that match, and how many known sentences no rule used.

    Each rule walks the places of its own identifiers once, so the time is in
    proportion to the sentences for each rule.
    """
    places: dict[str, list[int]] = {}
    for j, (_, k) in enumerate(known):
        places.setdefault(k, []).append(j)
    used, got = [False] * len(known), []
    for name, rule in RULES:
        if not all(k in places for k in rule):
            continue
        rows = [[j for j in places[k] if not used[j]] for k in rule]
        at = [0] * len(rule)
        for start in rows[0]:
            if used[start]:
                continue
            picked = [start]
            for want in range(1, len(rule)):
                row = rows[want]
                while at[want] < len(row) and (row[at[want]] <= picked[-1] or used[row[at[want]]]):
                    at[want] += 1
                if at[want] == len(row) or known[row[at[want]]][0] - known[picked[-1]][0] > GAP + len(_PIECES[rule[want - 1]]):
                    break
                picked.append(row[at[want]])
            else:
                got.append((known[start][0], name))
                for j in picked:
                    used[j] = True
    return [n for _, n in sorted(got)], used.count(False)


def scan(text: str | None) -> tuple[int, int, str]:
    """(sentences, known sentences, licences in order joined by commas)."""
    if not text:
        return 0, 0, ""
    found = sentences(text)
    known = identifiers(found)
    names, unmatched = recognise(known)
    names += [m for m in _SPDX.findall(text)]
    distinct = list(dict.fromkeys(names)) + ["UNMATCHED"] * (unmatched > 0)
    return len(found), len(known), ",".join(distinct)


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_sentences, n_known, licenses of every text; one pass, no shuffle."""
    texts = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for i, j, _, _ in slices(batch.column(1)):
                got = [scan(t) for t in batch.column(1)[i:j].to_pylist()]
                n, known, names = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(names, pa.string())], names=["doc_id", "n_sentences", "n_known", "licenses"])

    return texts.mapInArrow(released(run), f"doc_id {dict(texts.dtypes)['doc_id']}, n_sentences long, n_known long, licenses string")


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
