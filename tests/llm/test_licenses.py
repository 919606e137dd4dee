"""Standard headers, wrapped and commented, of licences; every known sentence; the SQL on the same texts."""

import random
import re
import textwrap

import pytest

from tidemark.llm import licenses as L

HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU General Public License for more details.""",
    "GPL-3.0-or-later": """Frobnicate is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.""",
    "GPL-3.0-only": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, version 3 of the License.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0-or-later": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL-2.0-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Library General Public
License as published by the Free Software Foundation; either
version 2 of the License, or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published
by the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MPL-1.1": """The contents of this file are subject to the Mozilla Public License Version
1.1 (the "License"); you may not use this file except in compliance with
the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Example Corp. nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
  * Redistributions of source code must retain the above copyright notice,
    this list of conditions and the following disclaimer.
  * Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:""",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)""",
    "CDDL-1.0": """The contents of this file are subject to the terms of the
Common Development and Distribution License (the "License").
You may not use this file except in compliance with the License.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.\nThis license is copied below, and is also available with a FAQ at:\nhttps://openfontlicense.org",
    "WTFPL": """This program is free software. It comes without any warranty, to
the extent permitted by applicable law. You can redistribute it
and/or modify it under the terms of the Do What The Fuck You Want
To Public License, Version 2, as published by Sam Hocevar.""",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0\nInternational License.",
    "GFDL-1.3-or-later": """Permission is granted to copy, distribute and/or modify this document
under the terms of the GNU Free Documentation License, Version 1.3
or any later version published by the Free Software Foundation;
with no Invariant Sections.""",
}

COMMENTS = ("", "# ", " * ", "// ", "; ", "-- ", "dnl ", "    ")


@pytest.mark.parametrize("licence", HEADERS)
def test_standard_headers(licence):
    for sign in COMMENTS:
        body = "\n".join(f"{sign}{line}".rstrip() for line in HEADERS[licence].split("\n"))
        text = f"Some words before.\n\n{sign}Copyright (c) 2019 A. Holder\n{sign.rstrip()}\n{body}\n\nand after"
        assert L.licences(L.sentence_ids(text)) == [licence], sign


def test_every_licence_by_name_and_by_rewrapped_sentences():
    r = random.Random(1)
    for licence, names in L.LICENCES.items():
        for name in names:
            for said in (f"Released under the {name}.", f"This project is licensed under the terms of the {name}", f"LICENSED UNDER {name.upper()}!!"):
                assert L.licences(L.sentence_ids(said)) == [licence], said
    for licence, rule in L.RULES:
        text = ". ".join(L.SENTENCES.get(x.rstrip("?"), "") for x in rule.split() if not x.startswith("says-")) + "."
        if len(text) > 1:
            sign = r.choice(COMMENTS)
            wrapped = "\n".join(sign + line for line in textwrap.wrap(text, r.randint(30, 90), break_on_hyphens=False))
            assert L.licences(L.sentence_ids(wrapped)) == [licence], rule
    assert len({n for n, _ in L.PATTERNS}) > 60


def test_known_sentences_are_reachable_and_cued():
    for key, sentence in L.SENTENCES.items():
        assert L.sentence_ids(f"Before. {sentence}. After.") == L._OF[key], key
        assert re.search(L.CUES, sentence), key
    ids = {*L.PIECES.values(), *L.NAMES.values(), *(f"spdx-{k}" for k in L.SPDX.values())}
    assert not [(a, b) for a in ids for b in ids if a != b and b.endswith(a)]


def test_spdx_lines():
    of = lambda t: L.licences(L.sentence_ids(t))
    assert of("# SPDX-License-Identifier: MIT\nX = 1") == ["MIT"]
    assert of("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */") == ["BSD-3-Clause", "GPL-2.0-only"]
    assert of("SPDX-License-Identifier: LGPL-2.1+ AND isc") == ["ISC", "LGPL-2.1-or-later"]
    assert of("SPDX-License-Identifier: Unknown-1.0") == []


def test_no_licence_without_a_full_sentence():
    for text in ("Licensed under the moon", "the MIT License", "you can redistribute it", "See the License for details", "a licence to kill", L.SENTENCES["bsd-redistribution"] + ":\n" + L.SENTENCES["bsd-source"] + "."):
        assert L.licences(L.sentence_ids(text)) == [], text


def test_sql_agrees(spark):
    import duckdb

    r = random.Random(2)
    texts = [None, "", "x", *HEADERS.values(), "SPDX-License-Identifier: MIT OR Apache-2.0 WITH x\nfoo", "Licensed under CC BY 4.0\nNo mark at the line's end", "word. " * 50_000 + "Released under the MIT License"]
    for h in list(HEADERS.values()):
        texts.append("\n".join(r.choice(COMMENTS) + line for line in h.split("\n")))
        texts.append(f"{h}\n\n{r.choice(list(HEADERS.values()))}\r\nmore")
    rows = [(i % 60 if i else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as licences", "1 as sentence_ids")
    got = sorted(((x.doc_id, " ".join(x.sentence_ids), ",".join(x.licences)) for x in L.scan_licences(df.repartition(3)).collect()), key=str)
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    want = con.execute(L.ORACLE_SQL["op8_licence_sentences"]).fetchall()
    assert got == sorted(want, key=str) and sum(bool(x[2]) for x in got) > 70
    assert L.scan_licences(df.limit(0)).count() == 0
