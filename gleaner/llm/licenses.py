"""License scan by sentence rules.

Sentences are normalised (lower case, words only) and mapped to identifiers of known licence
sentences; a licence is found where a document's identifiers hold one of its rules as an
ordered run. Longer rules come first, and their sentences are not used again. A sentence begins and
ends at a line end or after .!?; and may be wrapped within its paragraph, comment signs included.

Cases: null or empty texts have no licence; a document may have several, listed by name;
repeated rows are judged each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, by identifier.
SENTENCES = {
    "apache2-short": "Licensed under the Apache License, Version 2.0",
    "apache2-comply": "you may not use this file except in compliance with the License",
    "apache2-copy": "You may obtain a copy of the License at",
    "mit-short": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit-as-is": "The software is provided \"as is\", without warranty of any kind",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software",
    "gpl-copy": "You should have received a copy of the GNU General Public License",
    "ccbync4-short": "Licensed under CC BY-NC 4.0",
    "ccby4-short": "Licensed under CC BY 4.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    # Whole sentences of the standard headers and texts.
    "apache2-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache2-header-asf": "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\");",
    "apache2-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache2-copy-url": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit-title": "MIT License",
    "mit-grant-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                      "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                      "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
                      "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is-full": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to "
                      "the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "gpl3-title": "GNU General Public License Version 3, 29 June 2007",
    "gpl2-title": "GNU General Public License Version 2, June 1991",
    "lgpl3-title": "GNU Lesser General Public License Version 3, 29 June 2007",
    "lgpl21-title": "GNU Lesser General Public License Version 2.1, February 1999",
    "agpl3-title": "GNU Affero General Public License Version 3, 19 November 2007",
    "gpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                         "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                         "option) any later version.",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                 "License as published by the Free Software Foundation, version 3.",
    "lgpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                          "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
                          "your option) any later version.",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                          "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
                          "your option) any later version.",
    "gpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                        "Free Software Foundation;",
    "lgpl-library": "This library is free software;",
    "lgpl-redistribute": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
                         "by the Free Software Foundation;",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version.",
    "lgpl21-version": "either version 2.1 of the License, or (at your option) any later version.",
    "gpl-copy-full": "You should have received a copy of the GNU General Public License along with this program.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                      "following conditions are met:",
    # "v. 2.0" is cut after the point; only version 2.0 speaks of a Source Code Form here.
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                 "provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
                     "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "boost": "Boost Software License - Version 1.0 - August 17th, 2003",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
                  "it and redistribute it freely, subject to the following restrictions:",
    "cc0": "CC0 1.0 Universal",
    "ccbysa4-short": "Licensed under CC BY-SA 4.0",
    "ccby4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbync4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}
# Ordered rules: (licence, sentence identifiers in order).
RULES = (
    ("Apache-2.0", ("apache2-short", "apache2-comply", "apache2-copy")),
    ("Apache-2.0", ("apache2-short",)),
    ("MIT", ("mit-grant", "mit-as-is")),
    ("MIT", ("mit-short",)),
    ("GPL-3.0", ("gpl-free", "gpl-copy")),
    ("GPL-3.0", ("gpl3-short",)),
    ("CC-BY-NC-4.0", ("ccbync4-short",)),
    ("CC-BY-4.0", ("ccby4-short",)),
    ("BSD", ("bsd-redistribution",)),
    ("Apache-2.0", ("apache2-header",)),
    ("Apache-2.0", ("apache2-header-asf",)),
    ("Apache-2.0", ("apache2-title",)),
    ("Apache-2.0", ("apache2-copy-url",)),
    ("MIT", ("mit-title",)),
    ("MIT", ("mit-grant-full",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("GPL-3.0", ("gpl3-redistribute",)),
    ("GPL-3.0", ("gpl3-only",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-2.0", ("gpl-redistribute", "gpl2-version")),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("LGPL-3.0", ("lgpl3-redistribute",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("LGPL-2.1", ("lgpl-redistribute", "lgpl21-version")),
    ("AGPL-3.0", ("agpl3-title",)),
    ("AGPL-3.0", ("agpl3-redistribute",)),
    ("BSD", ("bsd-conditions",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("Unlicense", ("unlicense",)),
    ("BSL-1.0", ("boost",)),
    ("Zlib", ("zlib-grant",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-SA-4.0", ("ccbysa4-short",)),
    ("CC-BY-4.0", ("ccby4-long",)),
    ("CC-BY-SA-4.0", ("ccbysa4-long",)),
    ("CC-BY-NC-4.0", ("ccbync4-long",)),
)


def _words(sentence: str) -> list[str]:
    return re.findall(r"[^\W_]+", sentence.lower())


def sentence_ids(text: Column, known: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order; other sentences fall away."""
    ids = {" ".join(_words(v)): k for k, v in known.items()}
    # \x01 stands for a sentence end or a blank line, a line end for a line end, a blank for what else is no word.
    lower = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\x01", " ")
    ends = F.concat(F.lit("\x01"), F.regexp_replace(lower, r"[.!?;]\s+", "\x01"), F.lit("\x01"))
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(
        ends, r"[^\p{L}\p{N}\n\x01]+", " "), r" ?([\n\x01]) ?", "$1"), r"\n{2,}", "\x01")
    either = "|".join("[ \n]".join(w.split(" ")) for w in sorted(ids, key=lambda w: (-len(w), w)))
    found = F.regexp_extract_all(marked, F.lit(rf"(?<=[\n\x01])(?:{either})(?=[\n\x01])"), 0)
    # Most texts hold no longest word of a known sentence: they skip the passes above.
    hint = lower.rlike("|".join(sorted({max(_words(v), key=len) for v in known.values()})))
    names = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return F.transform(F.when(hint, found).otherwise(F.array().cast("array<string>")),
                       lambda s: F.element_at(names, F.replace(s, F.lit("\n"), F.lit(" "))))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  known: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """(id, sentence_ids, licenses): both comma-joined, in text order and sorted by name."""
    ids = F.concat(F.lit(","), F.array_join(F.transform(
        sentence_ids(F.col(text_col), known), lambda s: F.concat(s, F.lit(","))), ","))
    out = docs.select(F.col(id_col), ids.alias("seq"))
    out = out.withColumn("rest", F.col("seq"))
    found = []
    for k, (name, run) in enumerate(sorted(rules, key=lambda r: (-len(r[1]), r[0]))):
        wanted = ",," .join(run)
        hit = F.contains("rest", F.lit(f",{wanted},"))
        out = out.withColumn(f"hit{k}", F.when(hit, F.lit(name))).withColumn(
            "rest", F.replace("rest", F.lit(f",{wanted},"), F.lit(",#,")))
        found.append(f"hit{k}")
    names = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))), ",")
    listed = F.array_join(F.filter(F.split("seq", ","), lambda s: s != ""), ",")
    return out.select(id_col, listed.alias("sentence_ids"), names.alias("licenses"))
