import ipaddress
import re

from brinkline.llm import pii


def replaced(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kinds string")
    return {r.doc_id: r.text for r in pii.surrogate_pii(docs, b"k", **more).collect()}


def test_names_without_titles(spark):
    text = "John Smith met Anna Meyer-Lang. Smith left; Meyer-Lang stayed. The Anna Ertion. Иван Петров тут."
    got = replaced(spark, [(1, text), (2, "Dr John Smith"), (3, "The Hall and John went home")])
    a = re.match(r"(\w+) (\w+) met (\w+) ([\w-]+)\. (\w+) left; ([\w-]+) stayed\. The (\w+) (\w+)\. (\w+) (\w+) тут", got[1])
    assert a and a[1] in pii.GIVEN["latin", "m"] and a[3] == a[7] and a[3] in pii.GIVEN["latin", "f"] and a[9] in pii.GIVEN["cyrillic", "m"]
    assert a[2] == a[5] and a[4] == a[6] and got[2] == f"Dr {a[1]} {a[2]}" and got[3] == "The Hall and John went home"
    shape = lambda w: [next(k for k, s in enumerate(pii._SOUNDS) if c in s) for c in w.lower()]
    assert shape(a[2]) == shape("Smith") and shape(a[10]) == shape("Петров") and a[2] != "Smith"


def test_name_parts_keep_clear_of_the_corpus_and_of_each_other(spark):
    s = pii.Surrogates(b"k")
    first = s.of("part", "smith")
    names = ["Smith", first.capitalize(), s.of("part", first).capitalize()]
    rows = [(i, f"Mr. Hugo {n} here") for i, n in enumerate(names)]
    for most in (200_000, 0):
        got = replaced(spark, rows, broadcast_rows=most)
        new = [got[i].split()[2] for i in range(3)]
        assert len({*new, *names}) == 6


def test_phones_and_addresses_of_one_owner_agree(spark):
    text = "+1 (366) 555-9807, (366) 555-9807, 3665559807, 1-366-555-9807; 2001:DB8::A1 2001:db8:0:0::a1 at 12:30:45, std::vector, a::b"
    out = replaced(spark, [(1, text)])[1]
    phones, rest = out.split("; ")
    digits = [re.sub(r"\D", "", p) for p in phones.split(", ")]
    assert digits[0] == "1" + digits[1] and digits[1] == digits[2] and digits[3] == digits[0] and digits[1] != "3665559807" and phones.startswith("+1 (")
    a, b, *tail = rest.split(" ", 2)
    assert ipaddress.IPv6Address(a) == ipaddress.IPv6Address(b) != ipaddress.IPv6Address("2001:db8::a1") and a == a.upper() and tail == ["at 12:30:45, std::vector, a::b"]


def test_many_entities_and_odd_tables(spark):
    long = " ".join(f"u{i}@host{i % 90}.example.com 10.{i % 250}.7.{i % 200}" for i in range(8_000))
    got = replaced(spark, [(1, long), (2, None), (3, ""), (4, long), (None, "a@b.co")])
    assert got[1] == got[4] and len(got[1]) >= len(long) - 40_000 and "u17@host17" not in got[1] and got[2] is None and got[3] == "" and got[None] != "a@b.co"
    assert pii.surrogate_pii(spark.createDataFrame([], "doc_id long, text string"), b"k").count() == 0
