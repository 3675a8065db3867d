import re

from brinkline.llm import pii


def replaced(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_entities) for r in pii.surrogate_pii(docs, b"k").orderBy("doc_id").collect()]


def test_untitled_mentions_get_the_same_surrogate(spark):
    (a, n), (b, m), (c, _), (d, _) = replaced(
        spark,
        "Anna Meyer came. Dr Anna Meyer spoke, Anna Meyer said, and Meyer's hat; Meyerbeer; anna.meyer@mail1.example.com. Anna left.",
        "Frau Jan Lena Roth-Klein and Herr Smith. Jan Lena Roth-Klein? Jan? Roth-Klein? Smith!",
        "Anna Meyer said",
        "Mr. John Smith and Smith",
    )
    assert not re.search(r"\bAnna\b|\bMeyer\b", a) and "Meyerbeer" in a and n == 6
    first, last = re.search(r"Dr (\w+) (\w+) spoke", a).groups()
    assert a.startswith(f"{first} {last} came") and f", {first} {last} said, and {last}'s hat" in a and a.endswith(f"{first} left.")
    jan, lena, roth, smith = re.match(r"Frau (\w+) (\w+) ([\w-]+) and Herr (\w+)\.", b).groups()
    assert b.endswith(f". {jan} {lena} {roth}? {jan}? {roth}? {smith}!") and m == 6 and not {"Jan", "Lena", "Roth-Klein", "Smith"} & {jan, lena, roth, smith}
    assert re.fullmatch(r"\w+ \w+ said", c) and "Meyer" not in c  # found by the listed given name
    assert re.fullmatch(r"Mr\. \w+ (\w+) and \1", d) and smith == d.split()[-1]
