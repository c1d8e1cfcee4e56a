"""Licence scan by sentence rules.

Texts are cut into sentences, sentences are normalised (lower case, runs
of other characters than letters and digits to one blank) and mapped to
known licence-sentence identifiers; the sequence of identifiers in a text
is matched against ordered rules, longest first, and the identifiers a
rule has used are taken out before the next rule.

Where a text is cut: a full stop or question mark before white space (not
after "v" before a number) and a blank line always end a sentence. A line
end, colon or semicolon may end one or stand inside one, so hard-wrapped
notices and "free software: you can ..." are found as well as sentences
that are a line of their own. Comment signs (``*``, ``#``, ``//``) before a
line are no words and fall away.

DataFrame functions only. Texts without any of the anchor words that
every known sentence has are not cut. The two tables are fixed and small.

Null and empty texts have no sentences; repeated rows are scanned each;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (identifier, normalised sentence).
SENTENCES = [
    ("MIT-NAME", "released under the mit license"),
    ("MIT-NAME", "licensed under the mit license"),
    ("MIT-NAME", "this project is licensed under the mit license"),
    ("MIT-TITLE", "the mit license"),
    ("MIT-TITLE", "mit license"),
    ("MIT-GRANT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MIT-NOTICE", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("AS-IS", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("NO-LIABILITY", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("APACHE-NAME", "licensed under the apache license version 2 0"),
    ("APACHE-NAME", "licensed under the apache license version 2 0 the license"),
    ("APACHE-USE", "you may not use this file except in compliance with the license"),
    ("APACHE-COPY", "you may obtain a copy of the license at"),
    ("APACHE-AS-IS", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("APACHE-SEE", "see the license for the specific language governing permissions and limitations under the license"),
    ("GPL3-NAME", "this work is licensed under the gnu general public license version 3"),
    ("GPL3-NAME", "licensed under the gnu general public license version 3"),
    ("GPL2-NAME", "this work is licensed under the gnu general public license version 2"),
    ("GPL2-NAME", "licensed under the gnu general public license version 2"),
    ("GPL3-GRANT", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL2-GRANT", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPL-NO-WARRANTY", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("LGPL-NAME", "licensed under the gnu lesser general public license version 3"),
    ("CC-BY-NC", "licensed under cc by nc 4 0"),
    ("CC-BY-NC", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("CC-BY-SA", "licensed under cc by sa 4 0"),
    ("CC-BY-SA", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("CC-BY", "licensed under cc by 4 0"),
    ("CC-BY", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("BSD-USE", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD-SOURCE", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD-BINARY", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSD-NO-ENDORSE", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ISC-GRANT", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("MPL-NAME", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("UNLICENSE", "this is free and unencumbered software released into the public domain"),
]
#: Fixed values: (licence, identifiers in order), tried from the top.
RULES = [
    ("MIT", ["MIT-TITLE", "MIT-GRANT", "MIT-NOTICE", "AS-IS", "NO-LIABILITY"]),
    ("MIT", ["MIT-GRANT", "MIT-NOTICE", "AS-IS", "NO-LIABILITY"]),
    ("MIT", ["MIT-GRANT", "MIT-NOTICE", "AS-IS"]),
    ("Apache-2.0", ["APACHE-NAME", "APACHE-USE", "APACHE-COPY", "APACHE-AS-IS", "APACHE-SEE"]),
    ("Apache-2.0", ["APACHE-NAME", "APACHE-USE"]),
    ("BSD-3-Clause", ["BSD-USE", "BSD-SOURCE", "BSD-BINARY", "BSD-NO-ENDORSE"]),
    ("BSD-2-Clause", ["BSD-USE", "BSD-SOURCE", "BSD-BINARY"]),
    ("GPL-3.0-or-later", ["GPL3-GRANT", "GPL-NO-WARRANTY"]),
    ("GPL-2.0-or-later", ["GPL2-GRANT", "GPL-NO-WARRANTY"]),
    ("GPL-3.0-or-later", ["GPL3-GRANT"]),
    ("GPL-2.0-or-later", ["GPL2-GRANT"]),
    ("ISC", ["ISC-GRANT"]),
    ("MIT", ["MIT-NAME"]),
    ("Apache-2.0", ["APACHE-NAME"]),
    ("GPL-3.0", ["GPL3-NAME"]),
    ("GPL-2.0", ["GPL2-NAME"]),
    ("LGPL-3.0", ["LGPL-NAME"]),
    ("CC-BY-NC-4.0", ["CC-BY-NC"]),
    ("CC-BY-SA-4.0", ["CC-BY-SA"]),
    ("CC-BY-4.0", ["CC-BY"]),
    ("MPL-2.0", ["MPL-NAME"]),
    ("Unlicense", ["UNLICENSE"]),
]
#: Every known sentence has one of these.
ANCHORS = ["licen", "permission", "copyright", "warranty", "redistribut", "software"]
#: (pattern, replacement) in order: lower-cased text to words with one blank
#: between, "\n" where a sentence may end and "|" where it must. Both marks
#: are doubled, so that neighbours have one each.
MARKS = [
    (r"(^|[^a-z0-9])v\.[^a-z0-9]*([0-9])", r"{1}v {2}"), (r"[^a-z0-9.?;:\n]+", " "),
    (r"[.?][.?;:]*", "."), ("[;:]+", ":"), (r"\.[ \n]", "|"), (r" ?\n ?", "\n"), (r"\n\n+", "|"), (r":[ \n]", "\n"),
    ("[.:]", " "), (" +", " "), (r" ?([\n|]) ?", "{1}"), (r"\|[\n|]*", "|"), (r"\n+", "\n"), (r"([\n|])", "{1}{1}"),
]


def phrases(sentences) -> str:
    """Pattern of any known sentence between two marks, longest first."""
    known = sorted({s for _, s in sentences}, key=lambda s: (-len(s), s))
    return r"[\n|](" + "|".join(s.replace(" ", r"(?: |\n\n)") for s in known) + r")[\n|]"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", sentences=SENTENCES, rules=RULES, anchors=ANCHORS) -> DataFrame:
    """key, sentence_ids (in order, blank-joined), licences (in rule order,
    comma-joined, each once), n_licences and unmatched (identifiers no
    rule used) of every document."""
    bad = [s for _, s in sentences if not any(a in s for a in anchors)]
    if bad:
        raise ValueError(f"sentences without an anchor word: {bad}")
    known = F.create_map(*[F.lit(x) for i, s in sentences for x in (s, i)])
    marked = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1].format("", "$1", "$2")), MARKS, F.concat(F.lower(text), F.lit(" ")))
    found = F.regexp_extract_all(F.concat(F.lit("||"), F.trim(marked), F.lit("||")), F.lit(phrases(sentences)), F.lit(1))
    ids = F.transform(found, lambda s: F.element_at(known, F.replace(s, F.lit("\n\n"), F.lit(" "))))
    ids = F.when(F.lower(text).rlike("|".join(anchors)), F.array_join(ids, " ")).otherwise(F.lit(""))
    out = docs.select(F.col(key), ids.alias("sentence_ids")).withColumn("left", F.concat(F.lit(" "), F.replace("sentence_ids", F.lit(" "), F.lit("  ")), F.lit(" ")))
    hits = []
    for n, (_, seq) in enumerate(rules):
        wanted = F.lit(" " + "  ".join(seq) + " ")
        out = out.withColumn(f"r{n}", F.contains("left", wanted)).withColumn("left", F.replace("left", wanted, F.lit(" | ")))
        hits.append(f"r{n}")
    names = F.array_distinct(F.filter(F.array(*[F.when(F.col(h), F.lit(rules[n][0])) for n, h in enumerate(hits)]), lambda x: x.isNotNull()))
    unmatched = F.trim(F.regexp_replace(F.col("left"), r"[ |]+", " "))
    return out.select(key, "sentence_ids", F.array_join(names, ",").alias("licences"), F.size(names).cast("long").alias("n_licences"), unmatched.alias("unmatched"))


def sql(sentences=SENTENCES, rules=RULES) -> str:
    """The same scan of ``documents`` in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for i, s in sentences)
    marked = reduce(lambda e, r: f"regexp_replace({e}, {quote(r[0])}, {quote(r[1].format('', chr(92) + '1', chr(92) + '2'))}, 'g')", MARKS, "lower(text) || ' '")
    anchored = " OR ".join(f"contains(lower(text), {quote(a)})" for a in ANCHORS)
    left = reduce(lambda e, r: f"replace({e}, {quote(' ' + '  '.join(r[1]) + ' ')}, {quote(' |' + r[0] + '| ')})", rules, "' ' || replace(sentence_ids, ' ', '  ') || ' '")
    hits = ", ".join(f"CASE WHEN contains(l, {quote('|' + r[0] + '|')}) THEN {quote(r[0])} END" for r in rules)
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
cut AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (SELECT r, regexp_extract_all('||' || trim({marked}) || '||', {quote(phrases(sentences))}, 1) AS p FROM cut WHERE {anchored})),
m AS (SELECT r, i, id FROM s JOIN known ON replace(s, chr(10) || chr(10), ' ') = sentence),
g AS (SELECT doc_id, coalesce(string_agg(id, ' ' ORDER BY i), '') AS sentence_ids FROM cut LEFT JOIN m USING (r) GROUP BY r, doc_id),
x AS (SELECT doc_id, sentence_ids, {left} AS l FROM g),
y AS (SELECT doc_id, sentence_ids, l, list_filter([{hits}], lambda n: n IS NOT NULL) AS n FROM x)
SELECT doc_id, sentence_ids, coalesce(array_to_string(list_transform(range(1, len(n) + 1), lambda k: CASE WHEN list_position(n, n[k]) = k THEN n[k] END), ','), '') AS licences,
  CAST(len(list_distinct(n)) AS BIGINT) AS n_licences,
  trim(regexp_replace(regexp_replace(l, '\\|[^|]*\\|', ' ', 'g'), ' +', ' ', 'g')) AS unmatched FROM y
"""
