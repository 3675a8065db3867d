"""Formats that are too small or too full: every entity is replaced, by something else, and the search for it ends."""

import re
from itertools import product

import pytest

from brinkline.llm import pii


def replaced(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_entities int, kinds string")
    out = pii.surrogate_pii(docs, b"k", **more)
    assert out.columns == ["doc_id", "text", "n_entities", "kinds"]
    return [r.text for r in out.orderBy("doc_id").collect()]


@pytest.mark.parametrize("growth", [pii.GROWTH, (), (0,)])
def test_full_and_empty_formats(spark, monkeypatch, growth):
    monkeypatch.setattr(pii, "GROWTH", growth)
    surnames = ["".join(p).capitalize() for p in product("aeiou", repeat=2)]
    mails = [f"{a}@{b}.com" for a in "abcdef" for b in "abcdefghijklmnopqrstuvwxyz"]
    texts = ["write to --@--.com now", *[f"Dr {n} came." for n in surnames], *[f"mail {m} now" for m in mails], "Dr Eio"]
    got = replaced(spark, texts)
    new_names = [re.fullmatch(r"Dr (\w+) came\.", g)[1] for g in got[1:26]]
    assert len({*new_names, *surnames}) == 50
    new_mails = [re.fullmatch(r"mail (\S+@\S+\.com) now", g)[1] for g in got[26:-1]]
    assert len({*new_mails, *mails}) == 2 * len(mails)
    assert re.fullmatch(r"write to \S*[a-z]\S*@--\.com now", got[0]) and got[0] != texts[0]
    assert got == replaced(spark, texts, broadcast_rows=0)


def test_listed_names_never_stay_themselves():
    for key in range(40):
        s = pii.Surrogates(b"%d" % key)
        for names in pii.GIVEN.values():
            new = [s.of("given", n) for n in names]
            assert sorted(new) == sorted(names) and all(a != b for a, b in zip(names, new, strict=True))


@pytest.mark.parametrize("grow", [0, 2, 4, 8])
def test_longer_formats_keep_entities_apart(grow):
    s = pii.Surrogates(b"k")
    cards = [f"4{i:014d}" for i in range(60)]
    phones = [f"+1 {i}" for i in range(2000000, 2000060)] + [f" {i}" for i in range(2002002000, 2002002060)]
    ssn = [f"{i:09d}" for i in range(60)]
    parts = ["".join(p) for p in product("aeiou", "bc", "aé")] + ["ив", "ая", "αβ"]
    mails = [f"{p}@{q}.org" for p in ("a", "ab", "--", "1.") for q in ("x", "-")]
    for kind, entities in (("card", cards), ("phone", phones), ("ssn", ssn), ("part", parts), ("email", mails)):
        new = [s.of(kind, e, grow) for e in entities]
        if grow:
            assert len(set(new)) == len(entities), kind
        assert all(len(n) == len(e) + grow for n, e in zip(new, entities, strict=True))
        if kind == "card":
            assert all(pii.luhn(n) == pii.luhn(e) and n[0] == "4" for n, e in zip(new, entities, strict=True))
        last = [s.last(kind, e, i, max(map(len, entities))) for i, e in enumerate(entities)]
        assert len(set(last)) == len(entities) and min(map(len, last)) > max(map(len, entities))


def test_longer_numbers_are_written_in_the_pattern_of_the_original():
    assert pii.rendered("ssn", "123-45-6789", "98765432100") == "987-65-432100"
    assert pii.rendered("phone", "+1 (366) 555-9807 ", " 244555123499") == "+2 (445) 551-23499 "
    assert pii.rendered("email", "Ab@C.com", "xyzw@q.com") == "Xyzw@Q.com"
