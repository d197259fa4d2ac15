"""Licences by their sentences.

A text is read as words (runs of letters and digits, in lower case; comment signs and
quotes are none) with marks where a sentence may begin or end: at a line end, and at a
full stop, exclamation or question mark or colon before white space. A known sentence is found
where its words stand one after another from one mark to another, whatever marks are in
between, so wrapped lines and lines in comments do not hide it. The longest wins. The identifiers of a
text, in order, are held against licence rules, which are sequences of identifiers; a
rule matches where its sequence stands whole in the text's, with unknown
sentences between its sentences left out of account. A rule inside a longer rule
that also matches adds nothing.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, and the licences they make up.
SENTENCES = {
    "mit-short": "Released under the MIT License.",
    "mit-under": "Licensed under the MIT License.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-except": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-see": "See the GNU Lesser General Public License for more details.",
    "agpl-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-see": "See the GNU Affero General Public License for more details.",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0/",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsl-short": "Distributed under the Boost Software License, Version 1.0.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "gpl2-short": "Licensed under the GNU General Public License, version 2.",
    "lgpl-short": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-short": "Licensed under the GNU Affero General Public License, version 3.",
    "mpl-short": "Licensed under the Mozilla Public License, version 2.0.",
    "bsd3-short": "Licensed under the BSD 3-Clause License.",
    "bsd2-short": "Licensed under the BSD 2-Clause License.",
    "isc-short": "Licensed under the ISC License.",
    "epl-short": "Licensed under the Eclipse Public License, version 2.0.",
    "reserved": "All rights reserved.",
}
RULES = {
    "MIT": [["mit-short"], ["mit-under"], ["mit-grant", "mit-notice", "as-is"]],
    "Apache-2.0": [["apache-short"], ["apache-except", "apache-copy", "apache-basis", "apache-see"]],
    "GPL-2.0-only": [["gpl2-short"], ["gpl2-only", "gpl-hope", "gpl-see"]],
    "GPL-2.0-or-later": [["gpl2-later", "gpl-hope", "gpl-see"]],
    "GPL-3.0-only": [["gpl3-short"]],
    "GPL-3.0-or-later": [["gpl-free", "gpl-hope", "gpl-see"]],
    "LGPL-2.1-only": [["lgpl-short"]],
    "LGPL-2.1-or-later": [["lgpl21-later", "lgpl-hope", "lgpl-see"]],
    "LGPL-3.0-or-later": [["lgpl3-later", "lgpl-hope", "lgpl-see"]],
    "AGPL-3.0-only": [["agpl-short"]],
    "AGPL-3.0-or-later": [["agpl-later", "gpl-hope", "agpl-see"]],
    "MPL-2.0": [["mpl-short"], ["mpl-form", "mpl-copy"]],
    "EPL-2.0": [["epl-short"], ["epl2"]],
    "BSL-1.0": [["bsl-short"], ["bsl-grant"]],
    "Unlicense": [["unlicense-free", "unlicense-anyone"]],
    "CC-BY-NC-4.0": [["cc-by-nc-4"]],
    "CC-BY-4.0": [["cc-by-4"]],
    "CC-BY-SA-4.0": [["cc-by-sa-4"]],
    "ISC": [["isc-short"], ["isc-grant"]],
    "0BSD": [["0bsd-grant"]],
    "BSD-2-Clause": [["bsd2-short"], ["bsd-use", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd3-short"], ["bsd-use", "bsd-source", "bsd-binary", "bsd-name"]],
    "all-rights-reserved": [["reserved"]],
}
# A line that names the licence is a sentence too.
SENTENCES |= {f"spdx-{name}": f"SPDX-License-Identifier: {name}" for name in RULES if name != "all-rights-reserved"}
for _name, _rules in RULES.items():
    if f"spdx-{_name}" in SENTENCES:
        _rules.append([f"spdx-{_name}"])

MARK = "\x01"


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: dict[str, list[list[str]]] | None = None) -> DataFrame:
    """``doc_id``, ``sentence_ids`` (in order) and ``licences`` (sorted) of each row.

    Null and empty texts have none; repeated rows are scanned
    alike. A sentence of a rule that is not complete shows in ``sentence_ids`` alone.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    known = {normalised(v): k for k, v in sentences.items()}
    flat = sorted(((name, ids) for name, each in rules.items() for ids in each), key=lambda r: (-len(r[1]), r[0], r[1]))
    # the longest word of each sentence; texts with none of them need no closer look
    words = sorted({max(k.split(), key=len) for k in known})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # MARK where a sentence may begin or end; comment signs that are words and marks of list items are no part of one
    read = F.regexp_replace(F.lower(text), r"(?m)^([^a-z0-9\r\n]*)(?:rem|dnl)(?=\s)", "$1")
    read = F.regexp_replace(read, "https://", "http://")
    read = F.regexp_replace(read, r"(?m)^([^a-z0-9\r\n]*[a-z0-9]{1,2}\))(?=\s)", "$1" + MARK)
    read = F.regexp_replace(read, r"""[.!?:]+["')\]]*(?=\s)|[\r\n]+""", MARK)
    read = F.regexp_replace(F.regexp_replace(read, f"[^a-z0-9{MARK}]+", " "), f" ?{MARK}[ {MARK}]*", MARK)
    read = F.trim(read)
    longest = sorted(known, key=lambda k: (-len(k), k))
    whole = f"(?:^|{MARK})({'|'.join(k.replace(' ', f'[ {MARK}]') for k in longest)})(?={MARK}|$)"
    seen = F.when(F.lower(text).rlike("|".join(words)), F.regexp_extract_all(read, F.lit(whole), F.lit(1))).otherwise(F.array().cast("array<string>"))
    table = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    ids = F.transform("_seen", lambda s: F.element_at("_known", F.translate(s, MARK, " ")))
    found = docs.select("doc_id", seen.alias("_seen"), table.alias("_known")).select("doc_id", ids.alias("sentence_ids"))
    law = F.from_json(F.lit(json.dumps([{"licence": n, "ids": i} for n, i in flat])), "array<struct<licence: string, ids: array<string>>>")

    def stands_in(ids, whole):
        places = F.sequence(F.lit(1), F.greatest(F.size(whole) - F.size(ids) + 1, F.lit(1)))
        return F.exists(places, lambda p: F.slice(whole, p, F.size(ids)) == ids)

    hit = found.withColumn("_hit", F.when(F.size("sentence_ids") > 0, F.filter(law, lambda r: stands_in(r["ids"], F.col("sentence_ids")))))
    inside = lambda r: F.exists("_hit", lambda q: (F.size(q["ids"]) > F.size(r["ids"])) & stands_in(r["ids"], q["ids"]))
    names = F.array_sort(F.array_distinct(F.transform(F.filter("_hit", lambda r: ~inside(r)), lambda r: r["licence"])))
    return hit.select("doc_id", "sentence_ids", F.coalesce(names, F.array().cast("array<string>")).alias("licences"))
