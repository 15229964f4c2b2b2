"""Whole license texts, named licenses, copies, and plain alignment without a band."""

import pytest

from freightlens.llm import licenses
from freightlens.llm.license_texts import WHOLE

from .test_operators import table


def found(spark, texts, templates=None):
    rows = licenses.scan(table(spark, texts), templates).collect()
    return sorted((r.doc_id, r.start, r.license) for r in rows)


def filler(n, stem="f"):
    return " ".join(f"{stem}{i}" for i in range(n))


def test_every_whole_text_is_told_from_the_others(spark):
    names = list(WHOLE)
    texts = [f"{filler(30)} {WHOLE[n]} {filler(20, 'g')}" for n in names]
    assert [(i, x) for i, _, x in found(spark, texts)] == list(enumerate(names))


def test_edited_whole_texts(spark):
    texts = []
    for name in ("MIT-whole", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "Zlib"):
        w = WHOLE[name].split()
        w[len(w) // 3] = "another"
        del w[len(w) // 2]
        w[10:10] = ["two", "more"]
        texts.append("\n * ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)))
    assert [x for _, _, x in found(spark, texts)] == ["MIT-whole", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "Zlib"]


def test_copies_and_a_very_long_text(spark):
    mit = WHOLE["MIT-whole"]
    long = f"{filler(60_000)} {mit} {filler(60_000, 'g')} {WHOLE['ISC']} {mit}"
    got = found(spark, [f"{mit} {filler(5)} {mit}", long])
    assert [(i, x) for i, _, x in got] == [(0, "MIT-whole"), (0, "MIT-whole"), (1, "MIT-whole"), (1, "ISC"), (1, "MIT-whole")]
    assert got[0][1] == 0 and got[1][1] == len(mit) + len(filler(5)) + 2


def test_named_licenses(spark):
    texts = [
        "// SPDX-License-Identifier: MIT\nint main",
        "# spdx-license-identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause trailing words",
        "SPDX-License-Identifier:\nMIT",
        "SPDX-License-Identifier:",
        "MIT Apache-2.0",
    ]
    rows = licenses.scan(table(spark, texts)).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == [(0, "MIT"), (1, "BSD-3-Clause"), (1, "Classpath-exception-2.0"), (1, "GPL-2.0-or-later")]
    r = next(r for r in rows if r.doc_id == 0)
    assert (texts[0][r.start : r.stop], r.n_matched, r.coverage) == ("SPDX-License-Identifier: MIT", 2, 1.0)


def test_templates_of_a_folder(spark, tmp_path):
    (tmp_path / "House-1.0").write_text(filler(400, "clause"))
    own = {**licenses.TEMPLATES, **licenses.templates_in(str(tmp_path))}
    text = filler(400, "clause").replace("clause200 ", "")
    assert found(spark, [f"a {text} b"], own) == [(0, 2, "House-1.0")]
    assert found(spark, [f"a {text} b"]) == []


def plain(text, template):
    """Matched words of the best local alignment, without a band (match 2, else -1)."""
    above, best = [(0, 0)] * (len(text) + 1), (0, 0)
    for word in template:
        row = [(0, 0)]
        for j, other in enumerate(text):
            s, m = above[j]
            cell = (s + 2, m + 1) if other == word else (s - 1, m)
            cell = max(cell, (above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1]), (0, 0))
            row.append(cell)
            best = max(best, cell)
        above = row
    return best[1]


@pytest.mark.parametrize("name", ["MIT-0", "BSD-2-Clause", "GPL-3.0-opening", "GPL-2.0-only-header"])
def test_agrees_with_alignment_without_a_band(spark, name):
    w = WHOLE[name].split()
    text = " ".join(["start", *w[: len(w) // 2], "inserted", *w[len(w) // 2 + 1 :], "stop"])
    words = licenses.word_hashes(text).tolist()
    share = {}
    for other, template in licenses.TEMPLATES.items():
        t = licenses.word_hashes(template).tolist()
        m = plain(words, t)
        if m >= 0.85 * len(t):
            share[other] = m
    (row,) = licenses.scan(table(spark, [text])).collect()
    assert share[row.license] == max(share.values()) == row.n_matched
