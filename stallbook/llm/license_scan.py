"""Licence recognition by sentences: known sentences become identifiers, ordered rules read them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from stallbook.llm.common import whole_text

# fixed values: licence sentences by identifier, as they are published
SENTENCES: dict[str, list[str]] = {
    "apache-name": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-asis": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "mit-name": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)",
                 "MIT License", "SPDX-License-Identifier: MIT"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "mit-notice": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
    ],
    "mit-asis": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "bsd-grant": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ],
    "bsd-source": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
    ],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "gpl3-name": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "gpl2-name": ["SPDX-License-Identifier: GPL-2.0-only",
                  "This work is licensed under the GNU General Public License, version 2."],
    "gpl3-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "gpl2-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    ],
    "gpl-hope": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "mpl2-name": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by-nc4": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "cc-by4": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "cc-by-sa4": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "cc0-name": ["Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: ordered rules: longer sequences before their parts; a rule takes the identifiers that it reads
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache-name", "apache-comply", "apache-copy", "apache-asis", "apache-see"]),
    ("Apache-2.0", ["apache-name", "apache-comply"]),
    ("Apache-2.0", ["apache-name"]),
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "mit-asis"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-asis"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("MIT", ["mit-name"]),
    ("GPL-3.0-only", ["gpl3-name"]),
    ("GPL-2.0-only", ["gpl2-name"]),
    ("MPL-2.0", ["mpl2-name"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4"]),
    ("CC-BY-4.0", ["cc-by4"]),
    ("CC0-1.0", ["cc0-name"]),
    ("Unlicense", ["unlicense"]),
]

_SPDX = {
    "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause", "isc": "ISC", "0bsd": "0BSD", "zlib": "Zlib",
    "gpl-2.0-or-later": "GPL-2.0-or-later", "gpl-3.0-or-later": "GPL-3.0-or-later", "lgpl-2.1-only": "LGPL-2.1-only",
    "lgpl-2.1-or-later": "LGPL-2.1-or-later", "lgpl-3.0-only": "LGPL-3.0-only", "lgpl-3.0-or-later": "LGPL-3.0-or-later",
    "agpl-3.0-only": "AGPL-3.0-only", "agpl-3.0-or-later": "AGPL-3.0-or-later", "epl-2.0": "EPL-2.0", "bsl-1.0": "BSL-1.0",
    "artistic-2.0": "Artistic-2.0", "unlicense": "Unlicense", "cc-by-4.0": "CC-BY-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0",
    "cc-by-nc-4.0": "CC-BY-NC-4.0", "cc-by-nd-4.0": "CC-BY-ND-4.0", "cc-by-nc-sa-4.0": "CC-BY-NC-SA-4.0", "cc-by-nc-nd-4.0": "CC-BY-NC-ND-4.0",
}
_CREATIVE = {
    "": "CC-BY-4.0", "-ShareAlike": "CC-BY-SA-4.0", "-NonCommercial": "CC-BY-NC-4.0", "-NoDerivatives": "CC-BY-ND-4.0",
    "-NonCommercial-ShareAlike": "CC-BY-NC-SA-4.0", "-NonCommercial-NoDerivatives": "CC-BY-NC-ND-4.0",
}

#: families that the SQL twin does not have
MORE_SENTENCES: dict[str, list[str]] = {
    "lgpl21-later": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version.",
    ],
    "lgpl3-later": [
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version." for what in ("program", "library")
    ],
    "lgpl-hope": [
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "agpl3-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version.",
    ],
    "epl2-name": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "bsl1-name": ["Distributed under the Boost Software License, Version 1.0."],
    "zlib-asis": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "0bsd-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted.",
    ],
    "cc0-waiver": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to "
        "this software to the public domain worldwide.",
    ],
    **{f"cc{k.lower()}-name": [f"This work is licensed under a Creative Commons Attribution{k} 4.0 International License."] for k in _CREATIVE},
    **{f"spdx-{k}": [f"SPDX-License-Identifier: {name}"] for k, name in _SPDX.items()},
}
MORE_RULES: list[tuple[str, list[str]]] = [
    ("LGPL-2.1-or-later", ["lgpl21-later", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-later", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("EPL-2.0", ["epl2-name"]),
    ("BSL-1.0", ["bsl1-name"]),
    ("Zlib", ["zlib-asis", "zlib-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("CC0-1.0", ["cc0-waiver"]),
    *[(name, [f"cc{k.lower()}-name"]) for k, name in _CREATIVE.items()],
    *[(name, [f"spdx-{k}"]) for k, name in _SPDX.items()],
]

#: a sentence ends at a mark before white space, or at an empty line
_SENTENCE_END = r"[.!?;:][ \t\r\n]+|\n[ \t\r]*\n"
_OTHER = r"[^\p{L}\p{N}]+"
_CUT = "\x01"


def normalised(sentence: str) -> str:
    """Lower case, runs of other signs than letters and digits as one space."""
    return re.sub(r"[\W_]+", " ", sentence.lower()).strip(" ")


def _known() -> dict[str, str]:
    return {normalised(s): name for name, texts in SENTENCES.items() for s in texts}


def _tokens() -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Tokens of normalised pieces, and the runs of tokens that are known sentences with a mark inside, longest first.

    A whole sentence has its identifier as token, a piece of one a number, with L if it speaks of a licence.
    """
    tokens: dict[str, str] = {}
    runs: list[tuple[int, str, str]] = []
    parts: dict[str, str] = {}
    for name, texts in [*SENTENCES.items(), *MORE_SENTENCES.items()]:
        for text in texts:
            tokens[normalised(text)] = f"<{name}>"
            pieces = [n for x in re.split(_SENTENCE_END, text) if (n := normalised(x))]
            if len(pieces) > 1:
                for x in pieces:
                    parts.setdefault(x, f"{{{'L' if re.search('licen[sc]e', x) else ''}{len(parts)}}}")
                runs.append((len(pieces), "".join(parts[x] for x in pieces), f"<{name}>"))
    if tokens.keys() & parts.keys():
        raise ValueError("a sentence is also a piece of another")
    return tokens | parts, [r[1:] for r in sorted(runs, key=lambda r: -r[0])]


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), _OTHER, " "))


def _pattern(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def license_scan(docs: DataFrame) -> DataFrame:
    """Licences named or granted in every row of ``docs`` (doc_id, text).

    The whole text is cut into sentences; a sentence that runs over several lines is also read line
    by line. Normalised sentences that are known become identifiers, in the order of the text, and
    the ordered rules read runs of consecutive identifiers; each identifier counts for one rule.
    Known sentences with a mark inside ('SPDX-License-Identifier: MIT') are cut like the texts: all
    their pieces have to follow each other. The SQL twin lacks these and MORE_SENTENCES.

    Everything happens within a row: no shuffle, however large a group of copies is. A NULL or
    empty text has no sentences; repeated rows are scanned each. Returns doc_id, n_sentences (known
    ones), sentence_ids (in order), licenses (';' between, in the order of the rules), n_unknown
    (sentences that speak of a licence and are not known), n_unread (identifiers no rule has read).
    """
    tokens, runs = _tokens()
    names = F.map_from_arrays(F.array(*map(F.lit, tokens)), F.array(*map(F.lit, tokens.values())))
    marked = F.regexp_replace(whole_text(), _SENTENCE_END, _CUT)
    pieces = F.transform(
        F.split(marked, _CUT),
        lambda p: F.when(F.instr(p, "\n") > 0, F.concat(F.array(p), F.split(p, "\n"))).otherwise(F.array(p)),
    )
    # unknown pieces part the pieces of a sentence: '?' if they speak of a licence, else '!'
    token = lambda s: F.coalesce(
        F.try_element_at(names, s), F.when(s == "", "").when(s.rlike("licen[sc]e"), "?").otherwise("!"))
    found = F.transform(pieces, lambda g: F.transform(g, lambda p: token(_normal(p))))
    rest = lambda g: F.slice(g, F.lit(2), F.size(g))
    joined = F.array_join(F.transform("_found", lambda g: F.when(F.size(g) == 1, g[0])
        .when(g[0].rlike("^[<{]"), F.concat(g[0], F.array_join(F.filter(rest(g), lambda x: x.startswith("<")), "")))
        .otherwise(F.array_join(rest(g), ""))), "")
    run = joined
    for pattern, name in runs:
        run = F.replace(run, F.lit(pattern), F.lit(name))
    unknown = F.size(F.filter(F.flatten("_found"), lambda x: x == "?"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(_pattern(i)).alias("run")) for n, i in [*RULES, *MORE_RULES]])
    read = F.aggregate(
        rules,
        F.struct(F.col("_run").alias("rest"), F.array().cast("array<string>").alias("names")),
        lambda acc, rule: F.struct(
            F.replace(acc["rest"], rule["run"], F.lit("|")).alias("rest"),
            F.when(F.contains(acc["rest"], rule["run"]), F.array_append(acc["names"], rule["name"]))
            .otherwise(acc["names"]).alias("names"),
        ),
    )
    return (
        docs.select("doc_id", found.alias("_found"))
        .select("doc_id", unknown.alias("_unknown"), run.alias("_whole"))
        .select("doc_id", F.regexp_extract_all("_whole", F.lit("<([^<>]+)>"), F.lit(1)).alias("_ids"),
                (F.col("_unknown") + F.size(F.regexp_extract_all("_whole", F.lit("[{]L"), F.lit(0)))).alias("n_unknown"))
        .withColumn("_run", F.array_join(F.transform("_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""))
        .withColumn("_read", read)
        .select(
            "doc_id", F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", ",").alias("sentence_ids"),
            F.array_join(F.array_distinct("_read.names"), ";").alias("licenses"),
            F.col("n_unknown").cast("long").alias("n_unknown"),
            (F.length("_read.rest") - F.length(F.replace("_read.rest", F.lit("<"), F.lit("")))).cast("long")
            .alias("n_unread"),
        )
    )


def license_sql() -> str:
    """The same result in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = _known()
    table = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in known.items())
    rest = "SELECT doc_id, ids, n_unknown, run AS rest, CAST([] AS VARCHAR[]) AS names FROM runs"
    for name, ids in RULES:
        run = quote(_pattern(ids))
        rest = (
            f"SELECT doc_id, ids, n_unknown, replace(rest, {run}, '|') AS rest, CASE WHEN contains(rest, {run}) AND "
            f"NOT list_contains(names, {quote(name)}) THEN list_append(names, {quote(name)}) ELSE names END AS names "
            f"FROM ({rest})"
        )
    return f"""
WITH known(sentence, id) AS (VALUES {table}),
names AS (SELECT map(list(sentence), list(id)) AS m FROM known),
pieces AS (
  SELECT doc_id, flatten(list_transform(
      string_split(regexp_replace(coalesce(text, ''), '[.!?;:][ \\t\\r\\n]+|\\n[ \\t\\r]*\\n', chr(1), 'g'), chr(1)),
      lambda p: CASE WHEN contains(p, chr(10)) THEN list_concat([p], string_split(p, chr(10))) ELSE [p] END)) AS found
  FROM documents
),
normal AS (
  SELECT doc_id, list_transform(found, lambda s: trim(regexp_replace(lower(s), '[^\\pL\\pN]+', ' ', 'g'))) AS found
  FROM pieces
),
hits AS (
  SELECT doc_id, list_filter(list_transform(found, lambda s: m[s]), lambda x: x IS NOT NULL) AS ids,
    len(list_filter(found, lambda s: regexp_matches(s, 'licen[sc]e') AND m[s] IS NULL)) AS n_unknown
  FROM normal, names
),
runs AS (
  SELECT doc_id, ids, n_unknown, coalesce(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ''), '') AS run
  FROM hits
),
done AS ({rest})
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(names, ';'), '') AS licenses, CAST(n_unknown AS BIGINT) AS n_unknown,
  CAST(length(rest) - length(replace(rest, '<', '')) AS BIGINT) AS n_unread
FROM done
"""
