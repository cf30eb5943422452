"""Known licence sentences wrapped at every word, with and without comment marks and empty lines."""

import pytest

from pulsegrid.llm import licences

TABLE, PARTS = licences.known_parts(licences.SENTENCES)
STARTS = licences.starts_of(TABLE)


def found(text):
    return licences.known_in(text, TABLE, STARTS)


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
def test_each_sentence_wrapped_at_every_word(mark):
    for name, text in licences.SENTENCES.items():
        words = text.split()
        for i in range(1, len(words)):
            for gap in ("\n" + mark, "\n" + mark.rstrip() + "\n" + mark):
                assert found(mark + " ".join(words[:i]) + gap + " ".join(words[i:])) == PARTS[name], (name, words[i])
        assert found(mark + ("\n" + mark).join(words)) == PARTS[name]


def test_headers(spark):
    s = licences.SENTENCES
    gpl = "# This work is licensed under the GNU\n# General Public License, version 3."
    apache = "# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# " + s["apache-warranty"].replace(" ", "\n# ") + "\n# " + s["apache-see"].replace("the License", "the\n# License")
    df = spark.createDataFrame([(0, gpl), (1, apache), (2, "Released under the MIT\nLicense.\nThis is\nSomething Else"), (3, "Licensed under\nThe Usual Terms.")], "doc_id long, text string")
    assert [r.licences for r in licences.licence_scan(df).orderBy("doc_id").collect()] == ["GPL-3.0-only", "Apache-2.0", "MIT", ""]
