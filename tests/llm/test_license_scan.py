import re

from hypothesis import given, settings
from hypothesis import strategies as st

from brook.llm import license_scan as L

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    places = [(i, label) for phrase, label in L.BASE_PHRASES.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    at = sorted(i for i, _ in places)
    return len(words), len(places), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["gnu", "GNU", "general", "public", "license", "apache", "cc", "by", "mit", "é", "x9"]), max_size=40), st.sampled_from([" ", "-", ".\n", "\x00"]))
def test_base(words, gap):
    text = gap.join(words)
    assert L.scan(text)[:5] == brute(text)


def test_expressions():
    post = lambda s: L.parse_expression(s)
    assert post("MIT OR Apache-2.0 AND BSD-3-Clause") == (["mit", "apache-2.0", "bsd-3-clause", "and", "or"], True)
    assert post("(MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0") == (["mit", "apache-2.0", "or", "gpl-2.0-only", "classpath-exception-2.0", "with", "and"], True)
    assert post("MIT is fine") == (["mit"], True)
    assert not post("(MIT or")[1] and not post("")[1] and not post("(mit")[1]
    assert L.evaluate(post("GPL-2.0 or MIT")[0]) == ({"gpl-2.0", "mit"}, True)
    assert L.evaluate(post("GPL-2.0 and MIT")[0])[1] is False


def test_only_licenses_are_labels():
    say = lambda t: L.scan("SPDX-License-Identifier: " + t)[5:]
    assert say("see LICENSE file") == ("", 0.0, None)
    assert say("MIT or any later version") == ("mit", 0.95, True)
    assert say("GPL-2.0-only WITH Classpath-exception-2.0") == ("gpl-2.0-only", 0.95, False)
    assert say("GPL-2.0-only WITH MIT")[0] == "gpl-2.0-only"
    assert say("LicenseRef-Acme-1 AND mitsomething")[0] == "licenseref-acme-1" and say("Mitten")[0] == ""
    assert say("Apache-2.0+ OR (GPL-3.0-or-later AND ISC)") == ("apache-2.0+,gpl-3.0-or-later,isc", 0.95, True)
    assert say("(MIT AND") [0] == "spdx-malformed"


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "# SPDX-License-Identifier: MIT OR GPL-2.0\nThe MIT License."), (4, "x " * 50_000 + "cc by-nc 4.0"), (3, "cc-by"), (None, "SPDX-License-Identifier: (MIT AND")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, labels string")
    got = {(r.doc_id, r.n_words): r for r in L.scan_licenses(df).collect()}
    assert len(got) == len(rows)
    assert got[1, 0].labels == got[2, 0].labels == "" and got[1, 0].score == 0.0 and got[1, 0].first_word is None
    r = got[3, 11]
    assert (r.base_labels, r.labels, r.permissive, r.first_word) == ("mit", "gpl-2.0,mit", True, 9)
    assert got[4, 50_005].first_word == 50_000 and got[4, 50_005].labels == "cc-by,cc-by-nc"
    assert got[None, 5].labels == "spdx-malformed"
    assert L.scan_licenses(df.limit(0)).collect() == []
