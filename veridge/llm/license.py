"""License recognition: normalised sentences become identifiers, and ordered rules match the sequence of identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licenses and license notices, normalised.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-long": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc0-notice": "licensed under cc0 1 0",
    "bsd-redistribute": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "apache-title": "apache license version 2 0 january 2004 http www apache org licenses",
    "apache-terms": "terms and conditions for use reproduction and distribution",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "mpl2-title": "mozilla public license version 2 0",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
}
#: License, and the sentences that it shows in this order; others may stand between. The first that matches among those with the same first sentence counts.
RULES = (
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("Apache-2.0", ("apache-notice-long", "apache-comply")),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-title", "apache-terms")),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
)
# Tags that name a license by its identifier, for every license that has a rule.
for _name in sorted({name for name, _ in RULES}):
    SENTENCES[f"tag-{_name.lower().replace('.', '-')}"] = " ".join(("spdx license identifier", *_name.lower().replace("-", " ").replace(".", " ").split()))
    RULES += ((_name, (f"tag-{_name.lower().replace('.', '-')}",)),)
#: Shorter words aren't cues, unless a sentence has no other.
CUE_LENGTH = 7


def cue(sentences: dict[str, str]) -> str:
    """A pattern that every text with one of the sentences matches: words of which each sentence holds one, few and long. A text without isn't split at all."""
    left = {frozenset(s.split()) for s in sentences.values() if s}
    words = []
    while left:
        longest = max(len(w) for s in left for w in s)
        usable = sorted(w for w in frozenset.union(*left) if len(w) >= min(CUE_LENGTH, longest))
        best = max(usable, key=lambda w: (sum(w in s for s in left), len(w)))
        words.append(best)
        left = {s for s in left if best not in s}
    return f"(?iu){'|'.join(words) or '(?!)'}"


#: Where sentences end: at full stops and the like, and at lines without letters or digits. License texts number conditions and quote "as is", which normalising takes out.
ENDS = r"(?<![.!?:;])[:;]*+[.!?][.!?:;]*+[\x20\x09-\x0D]++|(?>\x0D\x0A|[\x0A\x0D])(?:[^a-z0-9\x0A\x0D]*+(?>\x0D\x0A|[\x0A\x0D]))++"
#: Where sentences may end or go on: texts are wrapped, and colons stand within sentences too.
MAY_END = r"[:;][\x20\x09-\x0D]++|[\x0A\x0D]++"


def _normal(text: Column) -> Column:
    """Words of a text in lower case, with | where a sentence ends and ~ where one may end."""
    marked = F.regexp_replace(F.regexp_replace(F.translate(F.lower(text), "|~", "  "), ENDS, "|"), MAY_END, "~")
    return F.regexp_replace(marked, "[^a-z0-9|~]++", " ")


def _pattern(sentences: dict[str, str]) -> str:
    """Any of the sentences, from where one begins or may begin to where it ends or may end; the longest if several begin there."""
    each = sorted(sentences.values(), key=lambda s: (-len(s), s))
    return f"(?<=^ ?|[|~] ?)(?:{'|'.join(s.replace(' ', '[ ~]++') for s in each) or '(?!)'})(?= ?(?:[|~]|$))"


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """``(doc_id, sentences, licenses)`` for every row of ``docs``: identifiers of known sentences in order of the text, and the licenses of rules that match, in order of the rules, each once.

    Whole texts are split into sentences; letter case, punctuation within them, spacing and line breaks, with comment marks or not, don't matter. Null and empty texts, like all others without known sentences, have empty lists. Repeated rows are scanned alike. Other columns aren't read. There is no shuffle.
    """
    known = F.create_map(*(F.lit(v) for name, s in sentences.items() for v in (s, name)))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ids = F.when(F.rlike(t, F.lit(cue(sentences))), F.transform(F.regexp_extract_all(_normal(t), F.lit(_pattern(sentences)), F.lit(0)), lambda s: F.try_element_at(known, F.regexp_replace(s, "[ ~]+", " ")))).otherwise(F.array().cast("array<string>"))
    row = docs.select(F.col(id_col).cast("long").alias("doc_id"), ids.alias("sentences"))
    joined = F.concat(F.lit(","), F.array_join("sentences", ","), F.lit(","))
    hits = []
    for i, (name, order) in enumerate(rules):
        match = F.rlike(joined, F.lit("".join(f",{s},(?:.*,)?" if k == 0 else f"(?<=,){s},(?:.*,)?" for k, s in enumerate(order))))
        for other, before in rules[:i]:  # a longer rule has said more
            if before[: len(order)] == order and other != name:
                match = match & ~F.rlike(joined, F.lit("".join(f",{s},(?:.*,)?" if k == 0 else f"(?<=,){s},(?:.*,)?" for k, s in enumerate(before))))
        hits.append(F.when(match, F.lit(name)))
    return row.withColumn("licenses", F.when(F.size("sentences") > 0, F.array_distinct(F.array_compact(F.array(*hits)))).otherwise(F.array().cast("array<string>")))
