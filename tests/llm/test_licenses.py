"""License scans: named cases, candidates against aligning every diagonal, and alignment against all subsequences."""

import itertools
import random

import pytest

from kilngraph.llm import licenses

INDEX = licenses.TemplateIndex()


def found(text: str) -> list[str]:
    return [m[0] for m in licenses.scan_text(INDEX, text.encode())]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 4.", []),
        ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND"]),
        ("Licensed under CC BY 4.0.", ["CC-BY"]),
        ("Licensed under CC BY 3.0.", ["CC-BY"]),
        ("Licensed under CC BY 9.0.", []),
        ("MIT License", ["MIT"]),
        ("The MIT License (MIT)", ["MIT"]),
        ("under the GNU GPL, version 2", ["GPL-2.0"]),
        ("Licensed under the GNU GPL v3", ["GPL-3.0"]),
        ("GNU GPL, version 2 or version 3", ["GPL-2.0", "GPL-3.0"]),
        ("CC BY 3.0", ["CC-BY"]),
        ("Boost Software License", ["BSL-1.0"]),
        ("SPDX-License-Identifier: BSL-1.0", ["BSL-1.0"]),
        ("we visited MIT. License plates differ", []),
        ("not under the MIT License", []),
        ("we were not licensed under the terms of the general license of the city", []),
        ("This is not licensed under the MIT License.", []),
        ("It is not ours. Licensed under the MIT License.", ["MIT"]),
        ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
        ("licensed under the GNU General Public License, version 2 or version 3", ["GPL-2.0", "GPL-3.0"]),
        ("Licensed under MIT License", ["MIT"]),
        ("Licensed under the BSD License. Licensed under the BSD License.", ["BSD", "BSD"]),
        ("Licensed under the MIT License and later the Apache License, Version 2.0.", ["MIT"]),
        ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright", ["GPL-3.0"]),
        ("the terms of the license", []),
        ("", []),
    ],
)
def test_named_cases(text, want):
    assert found(text) == want


def test_ties_go_to_the_longer_template_then_the_name():
    a, b = {"B": ("*alpha* beta gamma",), "A": ("*alpha* beta gamma",)}, {"S": ("*alpha* beta",), "L": ("*alpha* beta gamma delta",)}
    assert [m[0] for m in licenses.scan_text(licenses.TemplateIndex(a), b"x alpha beta gamma y")] == ["A"]
    assert [m[0] for m in licenses.scan_text(licenses.TemplateIndex(b), b"alpha beta gamma delta")] == ["L"]


def edited(rng: random.Random) -> str:
    """A template, or two behind each other, with words dropped, changed, inserted and doubled."""
    out = ["lead"] * rng.randrange(3)
    for _ in range(rng.choice([1, 1, 2])):
        words = licenses.tokenise(rng.choice(rng.choice(list(licenses.all_templates().values()))).encode())
        for w in words:
            turn = rng.random()
            out += [] if turn < 0.05 else ["other"] if turn < 0.08 else [w.decode(), rng.choice(["the", "under", "license", "word"])] if turn < 0.13 else [w.decode()]
    return " ".join([*out, "tail"])


def test_candidates_lose_nothing(monkeypatch):
    rng = random.Random(5)
    texts = [edited(rng) for _ in range(400)]
    got = [licenses.scan_text(INDEX, t.encode()) for t in texts]
    assert sum(map(bool, got)) > 150
    every = lambda self, ids: ((t, d) for t, x in enumerate(self.templates) for d in range(-len(x.ids), len(ids)) if set(x.must.tolist()) <= set(ids.tolist()))
    monkeypatch.setattr(licenses.TemplateIndex, "candidates", every)
    assert got == [licenses.scan_text(INDEX, t.encode()) for t in texts]


def test_alignment_equals_all_subsequences(monkeypatch):
    rng = random.Random(9)
    for turn in range(60):
        monkeypatch.setattr(licenses, "INSERTED", 0.1 + 0.2 * (turn % 3))
        text = " ".join(rng.choice(["*k*", "a", "b", "c"]) for _ in range(5))
        template = licenses.TemplateIndex({"T": (text + " *k*",)}).templates[0]
        words = [rng.randrange(0, 5) for _ in range(8)]
        best = (0, 0, 0)
        for size in range(1, len(template.ids) + 1):
            for own in itertools.combinations(range(len(template.ids)), size):
                for place in itertools.combinations(range(len(words)), size):
                    # Within the band of diagonal 1, as the operator sees it.
                    if all(template.ids[i] == words[j] and abs(j - i - 1) <= template.band for i, j in zip(own, place, strict=True)) and place[-1] - place[0] + 1 - size <= template.spare:
                        best = max(best, (sum(template.keys[i] for i in own), size, place[0] - place[-1]))
        matched, keys, first, last = licenses.align(template, words, 1)
        assert (keys, matched, first - last) == best


def test_a_whole_body_with_edits_is_one_match():
    body = licenses.TEMPLATES["MIT"][-1].replace("*", "").split()
    assert len(body) > 150
    edited = [*body[:20], *body[22:70], *body[72:120], "other", *body[120:]]
    for words, least in ((body, 1.0), (edited, 0.97)):
        ((family, number, share, first, last, *_),) = licenses.scan_text(INDEX, f"Copyright (c) someone\n{' '.join(words)}\nint main() {{}}".encode())
        assert (family, number) == ("MIT", len(licenses.TEMPLATES["MIT"]) - 1) and least <= share <= 1 and last - first + 1 >= len(words)
