import random

import pytest

from meterlens.llm import licences as L
from tests.llm.conftest import EDGE, make

MATCHER = L.Matcher(L.TEMPLATES, L.THRESHOLD, L.GAP)


def test_every_template_is_found_and_named():
    for name, texts in L.TEMPLATES.items():
        for text in texts:
            found = MATCHER.matches(f"Some words before. {text} And some after it.")
            assert [m[0] for m in found] == [name], (name, found)
            assert found[0][1] == 1.0


def test_notices_that_follow_each_other():
    text = " ".join(t[0] for n, t in L.TEMPLATES.items() if n in ("Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"))
    assert [m[0] for m in MATCHER.matches(text)] == ["Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"]


def test_dice_of_a_changed_copy_is_that_of_the_bags():
    mit = L.TEMPLATES["MIT"][2]
    changed = mit.replace("merge, ", "").replace("Copyright", "")
    ((name, score, start, end),) = MATCHER.matches("x. " + changed)
    bag = lambda t: L.Counter(L.bigrams(L.normalised(t)[0]))
    assert name == "MIT" and score == L.dice(bag(changed), bag(mit))
    assert L.normalised(("x. " + changed)[start:end])[0] == L.normalised(changed)[0]


def test_far_from_all_templates():
    for text in (None, "", "license", "under the license of the public this work is not for the general",
                 "Permission is hereby granted, free of charge, to enter."):
        assert MATCHER.matches(text) == []


def test_rows(spark, edge, nothing):
    got = L.digest(L.scan(edge)).collect()
    assert len(got) == len(EDGE) and {r.n_matches for r in got} == {0}
    docs = make(spark, [(1, "Released under the MIT License.\nAll rights reserved.\nReleased under the MIT License.")])
    (row,) = L.digest(L.scan(docs)).collect()
    assert (row.n_matches, row.licences, row.best) == (3, "MIT,all-rights-reserved", 1.0)
    assert L.digest(L.scan(nothing)).collect() == []


def test_words_in_the_middle_do_not_cut_a_notice():
    words = L.TEMPLATES["MIT"][2].split()
    for n in (7, 11, 60):
        text = " ".join(words[:80] + ["holder"] * n + words[80:])
        assert [m[0] for m in MATCHER.matches(text)] == ["MIT"], n
        apart = " and more words ".join([text, *["holder " * 90] * 2, text])
        assert [m[0] for m in MATCHER.matches(apart)] == ["MIT"] * 2, n


def all_passages(words, bag, threshold):
    """The best passages without overlap, from all passages of a text."""
    found = []
    for a in range(len(words)):
        for b in range(a + 1, len(words)):
            own = L.Counter(L.bigrams(words[a:b + 1]))
            score = L.dice(own, bag)
            if score >= threshold:
                found.append((-score, -(own & bag).total(), a, b))
    kept = []
    for passage in sorted(found):
        if all(passage[3] < a or b < passage[2] for _, _, a, b in kept):
            kept.append(passage)
    return sorted((a, b, -score) for score, _, a, b in kept)


def test_matches_are_those_of_all_passages():
    rng = random.Random(10)
    notice = "a copy of the text of the notice may be given to all of the users of the text".split()
    matcher = L.Matcher({"own": [" ".join(notice)]})
    bag, several = matcher.bags[0][1], 0
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 3)):
            copy = list(notice)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randint(0, 2)] = ["x"] * rng.randint(0, 8)
            words += copy + rng.choices(["of", "the", "text", "x"], k=rng.randint(0, 9))
        text = " ".join(words)
        _, spans = L.normalised(text)
        want = [("own", score, spans[a][0], spans[b][1]) for a, b, score in all_passages(words, bag, 0.8)]
        assert matcher.matches(text) == want
        several += len(want) > 1
    assert several > 20


GNU = ("This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} "
       "License as published by the Free Software Foundation, either version {} of the License, or (at "
       "your option) any later version.")


@pytest.mark.parametrize("what", ["program", "library", "tool"])
@pytest.mark.parametrize("licence,name,version", [
    ("GPL-2.0", "General Public", "2"), ("GPL-3.0", "General Public", "3"),
    ("LGPL-2.0", "Library General Public", "2"), ("LGPL-2.1", "Lesser General Public", "2.1"),
    ("LGPL-3.0", "Lesser General Public", "3"), ("AGPL-3.0", "Affero General Public", "3")])
def test_licences_of_the_gnu_family_are_told_apart(what, licence, name, version):
    assert [m[0] for m in MATCHER.matches(GNU.format(what, name, version))] == [licence]
    short = f"This work is licensed under the GNU {name} License, version {version}."
    assert [m[0] for m in MATCHER.matches(short)] == [licence]


@pytest.mark.parametrize("version,where", [("4.0", "International"), ("3.0", "Unported")])
@pytest.mark.parametrize("marks", ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"])
def test_creative_commons_licences_are_told_apart(marks, version, where):
    words = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial",
             "ND": "NoDerivatives" if version == "4.0" else "NoDerivs"}
    name = "-".join(words[m] for m in marks.split("-"))
    for text in (f"Licensed under CC {marks} {version}.",
                 f"This work is licensed under a Creative Commons {name} {version} {where} License."):
        assert [m[0] for m in MATCHER.matches(text)] == [f"CC-{marks}-{version}"], text


def test_permissive_licences_are_told_apart():
    """Whole texts, as bullets and with another holder than in the template."""
    names = ["MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0"]
    for name in names:
        text = L.TEMPLATES[name][-1]
        for n in "1234":
            text = text.replace(f" {n}. ", " * ")
        text = text.replace("the copyright holder nor", "Example University nor").replace("the author", "us")
        assert [m[0] for m in MATCHER.matches(text)] == [name], name


def test_a_version_names_its_own_licence():
    one, two = L.TEMPLATES["EPL-1.0"][0], L.TEMPLATES["EPL-2.0"][0]
    assert [m[0] for m in MATCHER.matches(f"{one} Then: {two}")] == ["EPL-1.0", "EPL-2.0"]
