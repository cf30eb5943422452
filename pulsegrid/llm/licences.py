"""Licence scans by sentence rules.

Texts are cut into sentences, sentences are normalised, known ones are mapped to identifiers, and the
sequence of identifiers is matched against ordered rules. Unknown sentences are skipped, so a notice may be
interrupted by other text. Pieces between line breaks are also looked up joined, so a known sentence may be
wrapped anywhere.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.common import slices, texts_of

# Sentences of published licences and notices.
SENTENCES = {
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc0": "Licensed under CC0 1.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "all-rights": "All rights reserved.",
}
# Which sentence sequences stand for which licence (SPDX names where there is one).
RULES = [
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["apache-licensed", "apache-compliance"]),
    ("Apache-2.0", ["apache-obtain", "apache-warranty", "apache-see"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("CC0-1.0", ["cc0"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("MPL-2.0", ["mpl-subject"]),
    ("Unlicense", ["unlicense"]),
    ("all-rights-reserved", ["all-rights"]),
]
COMMENT_MARK = r"\n[ \t]*(#+|//+|\*+|--+|;+|%+)[ \t]*"
#: Sentences end at punctuation before white space, at empty lines, and at a line break before a capitalised word.
ENDS = [(r"([.!?;:])[ \t\r\n]+", "\\1\x01"), (r"\n[ \t\r]*\n[ \t\r\n]*", "\x01"), (r"\n[ \t]*([A-Z][a-z])", "\x01\\1")]
OTHER = r"[^a-z0-9]+"
_MARK, _OTHER = re.compile(COMMENT_MARK), re.compile(OTHER)
_ENDS = [(re.compile(p), r) for p, r in ENDS]


def normalised(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip(" ")


def blocks_of(text: str) -> list[list[str]]:
    """The raw text between ends of sentences by punctuation, each as its pieces between line breaks that may end one; comment marks at line starts removed."""
    text = _MARK.sub("\n", "\n" + text)
    (stop, to), *breaks = _ENDS
    blocks = stop.sub(to, text).split("\x01")
    for pattern, to in breaks:
        blocks = [pattern.sub(to, b) for b in blocks]
    return [b.split("\x01") for b in blocks]


def sentences_of(text: str) -> list[str]:
    """The raw sentences of a text, where every line break that may end one does."""
    return [p for block in blocks_of(text) for p in block]


def starts_of(table: dict[str, str]) -> set[str]:
    """Every run of first words of the known sentences."""
    return {" ".join(words[:i]) for words in map(str.split, table) for i in range(1, len(words) + 1)}


def known_in(text: str, table: dict[str, str], starts: set[str]) -> list[str]:
    """Identifiers of the known sentences of a text: from each piece on, the longest join of pieces that is known."""
    found = []
    for block in blocks_of(text):
        pieces = [p for p in map(normalised, block) if p]
        at = 0
        while at < len(pieces):
            joined, end, hit = pieces[at], at + 1, None
            while joined in starts:
                if joined in table:
                    hit, after = table[joined], end
                if end == len(pieces):
                    break
                joined, end = f"{joined} {pieces[end]}", end + 1
            if hit:
                found.append(hit)
            at = after if hit else at + 1
    return found


def known_parts(sentences: dict[str, str]) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Normalised sentence to identifier. A known text that itself splits becomes several identifiers ``id#n``."""
    table: dict[str, str] = {}
    parts_of: dict[str, list[str]] = {}
    for name, text in sentences.items():
        parts = [p for p in map(normalised, sentences_of(" ".join(text.split()))) if p]
        for i, part in enumerate(parts):
            table.setdefault(part, name if len(parts) == 1 else f"{name}#{i}")
        parts_of[name] = [table[p] for p in parts]
    return table, parts_of


def licence_scan(documents: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Per row of ``documents``: ``doc_id, n_sentences, sentence_ids, licences``.

    ``sentence_ids`` are the identifiers of the known sentences in order of appearance, joined by ``>``;
    ``n_sentences`` is their number; ``licences`` the sorted names of all rules whose sequence occurs in it,
    joined by commas. A rule matches consecutive known sentences.

    Defined cases: a null or empty text has no sentence and an empty list; repeated rows give repeated
    results; a repeated sentence counts each time; an empty table gives no rows; other columns are ignored.
    """
    table, parts_of = known_parts(sentences or SENTENCES)
    starts = starts_of(table)
    ordered = [(name, "".join(f">{p}" for s in seq for p in parts_of[s]) + ">") for name, seq in (rules or RULES)]

    def run(batches):
        for b in slices(batches):
            ids = [known_in(text, table, starts) for text in texts_of(b["text"])]
            chains = ["".join(f">{i}" for i in x) + ">" for x in ids]
            names = [",".join(sorted({n for n, seq in ordered if seq in c})) for c in chains]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(x) for x in ids], pa.int64()), pa.array([">".join(x) for x in ids]), pa.array(names)],
                ["doc_id", "n_sentences", "sentence_ids", "licences"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_sentences long, sentence_ids string, licences string")


def check_sql() -> str:
    """The same scan for DuckDB, without the lookup of joined pieces."""
    table, parts_of = known_parts(SENTENCES)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in table.items())
    rule = ", ".join(f"({quote(n)}, {quote(''.join(f'>{p}' for s in q for p in parts_of[s]) + '>')})" for n, q in RULES)
    text = f"regexp_replace(chr(10) || coalesce(text, ''), {quote(COMMENT_MARK)}, chr(10), 'g')"
    for pattern, to in ENDS:
        to = " || ".join(["chr(1)" if x == "\x01" else quote(x) for x in re.findall(r"\x01|\\1", to)])
        text = f"regexp_replace({text}, {quote(pattern)}, {to}, 'g')"
    return f"""
    WITH known(norm, sid) AS (VALUES {known}), rules(name, seq) AS (VALUES {rule}),
    parts AS (SELECT doc_id, string_split({text}, chr(1)) AS p FROM documents),
    s AS (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS raw FROM parts),
    hit AS (SELECT doc_id, pos, sid FROM (SELECT doc_id, pos, trim(regexp_replace(lower(raw), '{OTHER}', ' ', 'g')) AS norm FROM s) JOIN known USING (norm)),
    chain AS (SELECT d.doc_id, count(sid) AS n, coalesce(string_agg(sid, '>' ORDER BY pos), '') AS ids FROM documents d LEFT JOIN hit USING (doc_id) GROUP BY d.doc_id)
    SELECT c.doc_id, c.n AS n_sentences, c.ids AS sentence_ids,
        coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM rules r WHERE contains('>' || c.ids || '>', r.seq)), '') AS licences
    FROM chain c
    """
