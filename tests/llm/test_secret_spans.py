import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from brinkline.llm import secrets

PIECES = ["password", "Token", "api_key", "APIKEY", " = ", ":", "'", '"', "=", "AKIA", "ABCDEFGH12345678", "0a1b2c3d4e5f", "deadbeef", " ", "\n", "é", "🙂", "x", "secret", "abc.def-", "passwd"]


def brute(text):
    """Each kind's leftmost non-overlapping matches, found by growing them by hand."""
    out, low = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        end = None
        for key in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if low.startswith(key, i) and end is None:
                ends = {i + len(key)}
                ends |= {e + 1 for e in ends if text[e : e + 1] in ("'", '"')}
                for step in (" ", ":=", " ", "\"'"):
                    if step == " ":
                        for e in sorted(ends):
                            while text[e : e + 1] == " ":
                                e += 1
                                ends.add(e)
                    elif step == ":=":
                        ends = {e + 1 for e in ends if text[e : e + 1] and text[e : e + 1] in ":="}
                    else:
                        ends |= {e + 1 for e in ends if text[e : e + 1] in ("'", '"')}
                # the regex takes as many blanks and quotes as it can, then at least one character of the value
                for e in sorted(ends, reverse=True):
                    j = e
                    while j < len(text) and text[j] in value:
                        j += 1
                    if j > e:
                        end, size = j, j - e
                        break
        if end is None:
            i += 1
            continue
        if size >= 6:
            out.append((i, "assign", end))
        i = end
    for kind, pattern, least in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[1])))


@given(st.lists(st.sampled_from(PIECES), max_size=25))
@settings(max_examples=400, deadline=None)
def test_base_spans_equal_brute_force(parts):
    text = "".join(parts)
    assert secrets.scan(text)[0] == brute(text), text


def test_allowed_words_spare_no_other_part():
    key = "q7Zp2LxW9vBn4KdR8sTf3YhG6"
    for text in (f"/home/example/{key}/sample", f"see example-{key}"):
        assert [text[i:j] for i, _, j in secrets.scan(text)[1]] == [key]
    assert secrets.scan("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY")[1] == []


def test_suppression_by_spans_takes_linear_time():
    rng = random.Random(3)
    took = []
    for n in (2_000, 8_000):
        text = " ".join(f"token={''.join(rng.choices('0123456789abcdefghjkmnpqrstuvwxyzABCDEFG', k=30))} {''.join(rng.choices('0123456789abcdefXYZPQRS', k=28))}" for _ in range(n))
        began = time.process_time()
        base, added = secrets.scan(text)
        took.append(time.process_time() - began)
        assert len(base) >= n and len(added) > n / 8 and not any(text.startswith("token", i) for i, *_ in added)
    assert took[1] < 10 * took[0]


def test_rows_of_a_table(spark):
    long = "word " * 50_000 + "AKIA" + "B7" * 10
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "secret: abcdefg"), (4, "'secret' : \"abcdefg\" token=abc")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = secrets.secret_scan(docs).collect()
    assert len(got) == len(rows) and sum(r.doc_id == 3 and r.n_access == 1 and r.base == "access:250000:250024" for r in got) == 2
    assert all(r.spans == r.base == "" for r in got if r.doc_id in (1, 2)) and [r.n_assign for r in got if r.doc_id in (None, 4)] == [1, 1]
    assert secrets.secret_scan(docs.limit(0)).count() == 0
