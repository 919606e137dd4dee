"""Licence scan by recognised sentences.

Sentences of known licences have identifiers. A text is cut into pieces at marks and empty lines, wrapped and commented lines being
joined; each piece is normalised (small letters and digits, no addresses, list marks or names of holders) and looked up. The known sentences are
cut in the same way, so a sentence with a mark inside is a sequence of pieces. What remains of the text is the ordered sequence of
identifiers. Rules are sequences of identifiers in their order; a rule matches where its identifiers follow each other in the text with
nothing but unknown pieces between them. At each place the first rule that fits takes its identifiers away.
"""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

# Identifiers of licences and the names by which texts call them.
LICENCES = {
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License"),
    "AFL-3.0": ("Academic Free License version 3.0", "Academic Free License 3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3", "AGPL-3.0"),
    "Apache-1.1": ("Apache Software License, Version 1.1",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License 2.0", "Apache-2.0"),
    "Artistic-2.0": ("Artistic License 2.0", "Artistic License, Version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License", "4-Clause BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "BUSL-1.1": ("Business Source License 1.1",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0", "Common Development and Distribution License, Version 1.0"),
    "CECILL-2.1": ("CeCILL Free Software License Agreement v2.1",),
    "CPL-1.0": ("Common Public License 1.0", "Common Public License Version 1.0"),
    "ECL-2.0": ("Educational Community License, Version 2.0",),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License v. 2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2", "European Union Public Licence v1.2", "EUPL-1.2"),
    "GFDL-1.3": ("GNU Free Documentation License, Version 1.3", "GNU Free Documentation License v1.3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPL-3.0"),
    "LPPL-1.3c": ("LaTeX Project Public License, version 1.3c", "LaTeX Project Public License v1.3c"),
    "MIT": ("MIT License", "MIT Licence"),
    "MIT-0": ("MIT No Attribution License", "MIT-0 License"),
    "MPL-1.1": ("Mozilla Public License 1.1", "Mozilla Public License Version 1.1"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0"),
    "MS-PL": ("Microsoft Public License", "Microsoft Public License (Ms-PL)"),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
    "ODbL-1.0": ("Open Database License v1.0", "Open Data Commons Open Database License v1.0"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "OSL-3.0": ("Open Software License version 3.0", "Open Software License 3.0"),
    "PHP-3.01": ("PHP License, version 3.01", "PHP License v3.01"),
    "PostgreSQL": ("PostgreSQL License",),
    "PSF-2.0": ("Python Software Foundation License Version 2", "PSF License Version 2"),
    "Ruby": ("Ruby License",),
    "SSPL-1.0": ("Server Side Public License, version 1", "Server Side Public License v1"),
    "Unlicense": ("Unlicense",),
    "UPL-1.0": ("Universal Permissive License v 1.0", "Universal Permissive License (UPL), Version 1.0"),
    "Vim": ("Vim License",),
    "WTFPL": ("Do What The Fuck You Want To Public License",),
    "X11": ("X11 License",),
    "Zlib": ("zlib License", "zlib/libpng License"),
    "ZPL-2.1": ("Zope Public License, version 2.1", "Zope Public License 2.1"),
}
#: The parts of a Creative Commons licence, the versions and how each is called.
CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"4.0": "International", "3.0": "Unported"}
LICENCES |= {f"CC-{p}-{v}": (f"CC {p} {v}", f"Creative Commons {name} {v} {w}", f"Creative Commons {name} {v} {w} License", f"Creative Commons {name} {v} License") for p, name in CC_PARTS.items() for v, w in CC_VERSIONS.items()}
#: How a text says that it is under a licence, normalised; the name follows.
STATEMENT = r"^(?:(?:this [a-z]+|it) (?:is|was) )?(?:licensed|released|distributed|available|made available|published) under (?:the |an? )?(?:terms of (?:the )?)?"
# Sentences as the licences word them.
SENTENCES = {
    "apache2-grant-the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "ecl2-grant-the": "Licensed under the Educational Community License, Version 2.0 (the \"License\")",
    "apache2-comply": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "apache2-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache2-limits": "See the License for the specific language governing permissions and limitations under the License",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "gnu-hope": "{} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-asis": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-asis": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "mpl11": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")",
    "epl1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "epl2-v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which accompanies this distribution, and is available at",
    "cpl1": "This program and the accompanying materials are made available under the terms of the Common Public License v1.0 which accompanies this distribution, and is available at",
    "boost": "Distributed under the Boost Software License, Version 1.0",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "cddl": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")",
    "eupl": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\")",
    "eupl-only": "Licensed under the EUPL, Version 1.2 only (the \"Licence\")",
    "gfdl": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
    "ofl": "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "php": "This source file is subject to version 3.01 of the PHP license, that is bundled with this package in the file LICENSE, and is available through the world-wide-web at the following url",
    "postgres-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    "sspl": "you can redistribute it and/or modify it under the terms of the Server Side Public License, version 1, as published by MongoDB, Inc",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "wtfpl": "It comes without any warranty, to the extent permitted by applicable law",
    "wtfpl-terms": "You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar",
    "zope": "This software is subject to the provisions of the Zope Public License, Version 2.1 (ZPL)",
    "lppl": "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License, either version 1.3c of this license or (at your option) any later version",
    "ncsa-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers",
    "cc0-work": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "public-domain": "This work is dedicated to the public domain",
    "all-rights": "All rights reserved",
}
#: Licence and the sentences that state it, in their order; a sentence with ? may be missing.
RULES = [
    ("Apache-2.0", "apache2-grant-the apache2-comply? apache2-copy? apache2-asis? apache2-limits?"),
    ("ECL-2.0", "ecl2-grant-the apache2-comply? apache2-copy? apache2-asis? apache2-limits?"),
    ("NCSA", "mit-grant ncsa-conditions"),
    ("MIT", "mit-title? mit-grant mit-notice? mit-asis? mit-liable?"),
    ("MIT-0", "mit0-grant mit-asis? mit-liable?"),
    ("MIT", "mit-title"),
    ("BSD-4-Clause", "bsd-redistribution bsd-source bsd-binary bsd-advert bsd-endorse? bsd-asis?"),
    ("BSD-3-Clause", "bsd-redistribution bsd-source bsd-binary bsd-endorse bsd-asis?"),
    ("BSD-2-Clause", "bsd-redistribution bsd-source bsd-binary bsd-asis?"),
    ("ISC", "isc-grant isc-asis?"), ("0BSD", "0bsd-grant isc-asis?"), ("Zlib", "zlib-asis? zlib-grant"),
    ("MPL-2.0", "mpl2 mpl2-copy?"), ("MPL-1.1", "mpl11"), ("EPL-1.0", "epl1"), ("EPL-2.0", "epl2"), ("EPL-2.0", "epl2-v"), ("CPL-1.0", "cpl1"),
    ("BSL-1.0", "boost"), ("BSL-1.0", "boost-grant"), ("CDDL-1.0", "cddl"), ("EUPL-1.2", "eupl"), ("EUPL-1.2", "eupl-only"), ("GFDL-1.3-or-later", "gfdl"),
    ("OFL-1.1", "ofl"), ("PHP-3.01", "php"), ("PostgreSQL", "postgres-grant"), ("SSPL-1.0", "sspl"), ("Unlicense", "unlicense-free unlicense-anyone?"),
    ("WTFPL", "wtfpl? wtfpl-terms"), ("ZPL-2.1", "zope"), ("LPPL-1.3c", "lppl"), ("CC0-1.0", "cc0-work"), ("public-domain", "public-domain"), ("all-rights-reserved", "all-rights"),
]
#: Families of licences with one header: family, name, versions.
GNU = [("GPL", "GNU General Public License", ("2", "3")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3")), ("LGPL", "GNU Library General Public License", ("2",)), ("AGPL", "GNU Affero General Public License", ("3",))]
for _family, _name, _versions in GNU:
    _terms, _key = f"you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation", f"{_family}-{_name.split()[1]}".lower()
    SENTENCES |= {f"{_key}-terms": _terms, f"{_key}-details": f"See the {_name} for more details"}
    for _v in _versions:
        _full = f"{_family}-{_v if '.' in _v else _v + '.0'}"
        SENTENCES |= {
            f"{_key}{_v}-later": f"{_terms}, either version {_v} of the License, or (at your option) any later version",
            f"{_key}{_v}-only": f"{_terms}, version {_v} of the License",
            f"{_key}{_v}-short": f"you can redistribute it and/or modify it under the terms of the {_name} version {_v} as published by the Free Software Foundation",
            f"gnu-later-{_v}": f"either version {_v} of the License, or (at your option) any later version", f"gnu-only-{_v}": f"version {_v} of the License",
        }
        _rest = f" gnu-hope-program? gnu-hope-library? {_key}-details?"
        RULES += [(f"{_full}-or-later", f"{_key}{_v}-later{_rest}"), (f"{_full}-or-later", f"{_key}-terms gnu-later-{_v}{_rest}"), (f"{_full}-only", f"{_key}{_v}-only{_rest}"), (f"{_full}-only", f"{_key}-terms gnu-only-{_v}{_rest}"), (f"{_full}-only", f"{_key}{_v}-short{_rest}")]
_hope = SENTENCES.pop("gnu-hope")
SENTENCES |= {f"gnu-hope-{x}": _hope.format(f"This {x}") for x in ("program", "library")}
RULES += [(k, f"says-{k}") for k in LICENCES]
#: Identifiers that may stand in a line of SPDX: as they are, and for the families with -only, -or-later or a plus sign.
SPDX = {k.lower(): k for k in LICENCES} | {f"{k}{end}".lower(): f"{k}{to}" for k in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.3") for end, to in (("-only", "-only"), ("-or-later", "-or-later"), ("+", "-or-later"))}

#: Every known sentence has one of these; a text without any is not cut at all.
CUES = r"(?i)licen[sc]e|spdx|public domain|redistribut|rights reserved|permission|copyright|warrant|gnu |gpl|(released|distributed|available|published) under|free software|advertising materials|mpl was not|version [0-9.]+ of the|anyone is free"

_COMMENT = re.compile(r"(?m)^[ \t]*(?:(?:[#*/;%!|>+-]+|dnl\b|rem\b|REM\b|\(\*|<!--)[ \t]*)?")
_VERSION = re.compile(r"\b([vV])\.\s+([0-9])")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([^\n]*)")
_CUT = re.compile(r"\n[ \t]*\n\s*|(?<=[.!?;:])[\"')\]*_~`!#%&$]*\s+")
_LIST_MARK = re.compile(r"^\s*(?:\(?[0-9A-Za-z]{1,2}[.)]\s+|[-*•]\s+)")
_ADDRESS = re.compile(r"(?:https?://|www\.)[^\s<>\"]*")
_HOLDER = re.compile(r"(?is)\bneither\s+the\s+names?\s+of\s.{1,150}?\smay\s+be\s+used")
_HOLDER_TO = "neither the name of the copyright holder nor the names of its contributors may be used"


def normalised(piece: str) -> str:
    """Small letters, digits and single blanks, without addresses and a list's mark at the beginning."""
    return re.sub(r"[\W_]+", " ", _ADDRESS.sub(" ", _LIST_MARK.sub("", piece)).lower()).strip()


def pieces(text: str) -> list[str]:
    """A text cut after marks before white space, at empty lines and around SPDX lines, signs of comments at the beginning of lines removed.

    Holders named in a clause on endorsement are replaced first, as their names may have marks.
    """
    plain = _VERSION.sub(r"\1.\2", _COMMENT.sub("", text.replace("\r\n", "\n")))
    return _CUT.split(_SPDX.sub(r"\n\nSPDX-License-Identifier \1\n\n", _HOLDER.sub(_HOLDER_TO, plain)))


def _spdx(piece: str) -> list[str]:
    """The identifiers in an SPDX expression; what follows WITH is an exception and no licence."""
    words = re.sub(r"(?i)\bwith\s+\S+", " ", piece[len("SPDX-License-Identifier ") :])
    return [f"spdx-{SPDX[w.lower()]}" for w in re.findall(r"[A-Za-z0-9.+-]+", words) if w.lower() in SPDX]


def _known() -> tuple[dict[str, str], dict[str, list[str]]]:
    """Identifiers by normalised piece, and the identifiers of each sentence's pieces."""
    found: dict[str, str] = {}
    of: dict[str, list[str]] = {}
    for key, sentence in SENTENCES.items():
        parts = [p for p in map(normalised, pieces(sentence)) if p]
        of[key] = [found.setdefault(p, key if len(parts) == 1 else f"{key}.{i}") for i, p in enumerate(parts, 1)]
    return found, of


PIECES, _OF = _known()
NAMES = {normalised(name): f"says-{licence}" for licence, names in LICENCES.items() for name in (licence, *names)}
_STATEMENT = re.compile(STATEMENT)


def piece_id(piece: str) -> str | None:
    """The identifier of a known piece, or of a statement that names a licence."""
    plain = normalised(piece)
    if plain in PIECES:
        return PIECES[plain]
    said = _STATEMENT.match(plain)
    return NAMES.get(plain[said.end() :]) if said else None


#: Licence and expression over identifiers, each followed by a blank.
PATTERNS = [(n, "".join((lambda p: f"(?:{p})?" if x.endswith("?") else p)("".join(re.escape(i) + " " for i in _OF.get(x.rstrip("?"), [x.rstrip("?")]))) for x in s.split())) for n, s in RULES]
PATTERNS += [(k, rf"spdx\-{re.escape(k)} ") for k in sorted(set(SPDX.values()))]
_ANY = re.compile("|".join(f"(?<!\\S)({p})" for _, p in PATTERNS))


def sentence_ids(text: str | None) -> list[str]:
    """The identifiers of the known pieces of a text, in order. A piece that is not known as a whole is looked up line by line."""
    out: list[str] = []
    for piece in pieces(text) if text else ():
        if piece.startswith("SPDX-License-Identifier "):
            out += _spdx(piece)
        elif whole := piece_id(piece):
            out.append(whole)
        elif "\n" in piece:
            out += filter(None, map(piece_id, piece.split("\n")))
    return out


def licences(ids: list[str]) -> list[str]:
    """Sorted distinct licences of a sequence of identifiers."""
    return sorted({PATTERNS[m.lastindex - 1][0] for m in _ANY.finditer("".join(i + " " for i in ids)) if m[0]})


def _scanned(batches):
    import pyarrow as pa

    kind = pa.list_(pa.string())
    for batch in batches:
        ids = [sentence_ids(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, kind), pa.array([licences(i) for i in ids], kind)], names=["doc_id", "sentence_ids", "licences"])


def scan_licences(docs: DataFrame) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, sentence_ids (array, in text order), licences (sorted array).

    Null and empty texts and texts without known sentences have empty arrays. The whole text is read; texts without any cue, most of
    them, do not leave the JVM. Repeated rows give repeated rows; further columns are not read.
    """
    text = F.col("text").cast("string")
    cued = docs.select("doc_id", F.when(text.rlike(CUES), text).alias("text"))
    return cued.mapInArrow(_scanned, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sentence_ids array<string>, licences array<string>")


def op8_licence_sentences(spark, sf_dir):
    out = scan_licences(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


QUERIES = {"op8_licence_sentences": op8_licence_sentences}


def _values(pairs) -> str:
    return ", ".join("('" + "', '".join(str(x).replace("'", "''") for x in p) + "')" for p in pairs)


_PLAIN = r"trim(regexp_replace(lower(regexp_replace(regexp_replace({0}, '^\s*(\(?[0-9A-Za-z]{{1,2}}[.)]\s+|[-*•]\s+)', ''), '(https?://|www\.)[^\s<>\"]*', ' ', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_FOUND = f"coalesce((SELECT any_value(id) FROM known WHERE norm = n), CASE WHEN regexp_matches(n, '{STATEMENT}') THEN (SELECT any_value(id) FROM names WHERE norm = regexp_replace(n, '{STATEMENT}', '')) END)"

#: Cuts by marking the places with a sign of their own, one kind after the other; rules are tried on the joined identifiers, then told apart by full matches.
ORACLE_SQL = {
    "op8_licence_sentences": rf"""
WITH known(norm, id) AS (VALUES {_values(PIECES.items())}), names(norm, id) AS (VALUES {_values(NAMES.items())}), spdx(word, id) AS (VALUES {_values((k, f"spdx-{v}") for k, v in SPDX.items())}),
rules(lic, pat, i) AS (VALUES {_values((n, p.replace(chr(92) + "-", "-"), k) for k, (n, p) in enumerate(PATTERNS))}),
t AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)),
  '(?m)^[ \t]*(([#*/;%!|>+-]+|dnl\b|rem\b|REM\b|\(\*|<!--)[ \t]*)?', '', 'g'), '\b([vV])\.\s+([0-9])', '\1.\2', 'g'),
  '(?is)\bneither\s+the\s+names?\s+of\s.{{1,150}}?\smay\s+be\s+used', '{_HOLDER_TO}', 'g'), 'SPDX-License-Identifier:[ \t]*([^\n]*)', chr(1) || 'SPDX-License-Identifier \1' || chr(1), 'g') AS text FROM documents),
s AS (SELECT r, unnest(l) AS s, generate_subscripts(l, 1) AS p FROM (
  SELECT r, string_split(regexp_replace(regexp_replace(text, '\n[ \t]*\n\s*', chr(1), 'g'), '([.!?;:])["'')\]*_~`!#%&$]*\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM t)),
w AS (SELECT r, p, s, {_PLAIN.format("s")} AS n FROM s WHERE NOT starts_with(s, 'SPDX-License-Identifier ')),
wk AS (SELECT r, p, s, {_FOUND} AS id FROM w),
l AS (SELECT r, p, k, {_PLAIN.format("x")} AS n FROM (
  SELECT r, p, unnest(string_split(s, chr(10))) AS x, generate_subscripts(string_split(s, chr(10)), 1) AS k FROM wk WHERE id IS NULL AND contains(s, chr(10)))),
x AS (SELECT r, p, lower(unnest(q)) AS word, generate_subscripts(q, 1) AS k FROM (
  SELECT r, p, regexp_extract_all(regexp_replace(substr(s, 25), '(?i)\bwith\s+\S+', ' ', 'g'), '[A-Za-z0-9.+-]+') AS q FROM s WHERE starts_with(s, 'SPDX-License-Identifier '))),
k AS (SELECT r, p, 0 AS k, id FROM wk UNION ALL SELECT r, p, k, {_FOUND} FROM l UNION ALL SELECT r, p, k, id FROM x JOIN spdx USING (word)),
g AS (SELECT r, string_agg(id, ' ' ORDER BY p, k) AS ids FROM k WHERE id IS NOT NULL GROUP BY 1),
hits AS (SELECT r, unnest(regexp_extract_all(ids || ' ', '{"|".join(p.replace(chr(92) + "-", "-") for _, p in PATTERNS)}')) AS h FROM g),
f AS (SELECT r, array_to_string(list_sort(list_distinct(list(lic))), ',') AS lic FROM (
  SELECT r, h, arg_min(lic, i::INT) AS lic FROM hits JOIN rules ON regexp_full_match(h, pat) GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(lic, '') AS licences FROM t LEFT JOIN g USING (r) LEFT JOIN f USING (r)
""",
}
