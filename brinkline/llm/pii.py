"""PII surrogates: keyed, type-consistent replacements.

Every entity goes through a keyed permutation of its own format's values (a Feistel network walked until the value
is valid again), so different entities of a format always get different surrogates and an entity gets the same one
wherever it occurs, however it is punctuated or cased. Names are found behind a title, or by a listed given name with
a surname behind it; within the document their other mentions, whole or in part, get the same surrogate or its part.
Digits stay digits, letters keep their script and case, listed given names come from a list of the same script and
gender, other parts of names keep their pattern of vowels and consonants, card numbers keep their Luhn state,
addresses stay public. A surrogate that equals an entity found anywhere in the corpus (listed given names aside, whose
lists are shared and in which none stays itself) is replaced by one of a spare permutation that meets neither an entity
nor another surrogate; those checks are distributed joins. A format may be too small or too full for that, so spare
permutations are of ever longer formats, a fixed number of them, and what is left then gets values by rank that are
longer than all others. Names are checked by their parts.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinkline.llm.common import extended, without
from brinkline.operators.positions import numbered
from brinkline.plans.shared import materialize, shared_root

#: Letters or digits that the spare permutations add to a format, in turn.
GROWTH = (0, 2, 4, 8)

KINDS = ("email", "phone", "ip", "ip6", "card", "ssn", "name")

# Given names by (script, gender), honorifics by gender.
GIVEN = {
    ("latin", "f"): "Ada Alice Amelie Ana Anna Beatriz Camille Carla Carmen Chloe Claire Clara Elena Elise Ella Emma Eva Frida Greta Hannah Helena Ines Irene Isabel Julia Karla Laura Lea Lena Lucia Luisa Manon Maria Marta Mia Nina Nora Olga Paula Rosa Sara Sofia Teresa Vera".split(),
    ("latin", "m"): "Adam Alan Albert Andreas Anton Ben Bruno Carlos David Diego Emil Erik Felix Finn Georg Hans Hugo Ivan Jakob Jan Javier Jean John Jonas Jorge Juan Julien Karl Lars Leo Louis Luis Lukas Marc Mario Max Nicolas Oscar Pablo Paul Pedro Peter Simon Theo Thomas Tim".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Ксения Мария Нина Ольга Полина Светлана".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Кирилл Максим Николай Олег Павел Сергей Юрий".split(),
    ("greek", "f"): "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
HONORIFICS = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Mme": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Dr": "", "Prof": "", "г-н": "m", "г-жа": "f", "κ": "m", "κα": "f"}

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
_CARD = re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w]|[-.]\d)")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?![\w]|[.-]\d)|(?<![\w.])\+\d{7,15}(?!\w)|(?<![\w.+-])1?[2-9]\d\d[2-9]\d{6}(?!\w|[.-]\d)")
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:])")
_UPPER = r"[A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈ-Ώ]"
_LOWER = r"[a-zß-öø-ÿа-яёα-ωά-ώ]"
_NAME = re.compile(rf"(?<!\w)(?P<title>{'|'.join(sorted(map(re.escape, HONORIFICS), key=len, reverse=True))})\.?[  ](?P<name>{_UPPER}{_LOWER}+(?:[ -]{_UPPER}{_LOWER}+){{0,3}})(?!\w)")
_PLAIN = re.compile(rf"(?<!\w)(?=(?P<given>{_UPPER}{_LOWER}+)[  ](?P<rest>{_UPPER}{_LOWER}+(?:[ -]{_UPPER}{_LOWER}+){{0,2}})(?!\w))")
_LISTED = {n: g for (_, g), names in GIVEN.items() for n in names}
_DIGIT = re.compile(r"\d")
_TITLES = tuple(HONORIFICS)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """Disjoint (start, end, kind) spans; of overlapping ones the first kind of KINDS' order of trust stays."""
    text = text or ""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text)]
        found += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 13 <= sum(c.isdigit() for c in m[0]) <= 19]
        found += [(m.start(), m.end(), "ssn") for m in _SSN.finditer(text)]
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text)]
    if ":" in text:
        found += [(m.start(), m.end(), "ip6") for m in _IP6.finditer(text) if _is_ip6(m[0])]
    if any(t in text for t in _TITLES):
        found += [(m.start("name"), m.end("name"), "name") for m in _NAME.finditer(text)]
    found += [(m.start(), m.end("rest"), "name") for m in _PLAIN.finditer(text) if m["given"] in _LISTED]
    starts: list[int] = []
    out: list[tuple[int, int, str]] = []
    for i, j, kind in found:
        k = bisect_left(starts, i)
        if (not k or out[k - 1][1] <= i) and (k == len(out) or j <= out[k][0]):
            starts.insert(k, i)
            out.insert(k, (i, j, kind))
    return out


def _is_ip6(text: str) -> bool:
    if not _DIGIT.search(text) or max(map(len, text.split(":"))) < 3:  # scopes such as a::b
        return False
    try:
        return int(ipaddress.IPv6Address(text)) > 1
    except ValueError:
        return False


class Surrogates:
    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(100_000)(self._of)
        self.order = lru_cache(None)(self._order)

    def _order(self, names: tuple[str, ...]) -> tuple[str, ...]:
        """The names in a keyed order, in which each stands for the one before it, so that none stays itself."""
        return tuple(sorted(names, key=lambda n: self.permute(f"given{names[0]}", names.index(n), len(names))))

    def _round(self, tweak: str, r: int, x: int, size: int) -> int:
        h = hashlib.blake2b(f"{tweak}|{r}|{x}".encode(), key=self.key, digest_size=32).digest()
        return int.from_bytes(h, "big") % size

    def permute(self, tweak: str, x: int, size: int) -> int:
        """A keyed permutation of range(size): Feistel on a grid a * b >= size, walked until back in range."""
        if size < 2:
            return x
        a = 1
        while a * a < size:
            a <<= 1
        b = -(-size // a)
        while True:
            hi, lo = divmod(x, b)
            for r in range(0, 8, 2):
                hi = (hi + self._round(tweak, r, lo, a)) % a
                lo = (lo + self._round(tweak, r + 1, hi, b)) % b
            x = hi * b + lo
            if x < size:
                return x

    def mixed(self, tweak: str, values: list[int], radix: list[int], valid: Callable[[list[int]], bool] = lambda v: True) -> list[int]:
        """Permute a tuple of mixed radix; walked on until ``valid`` holds, which it must for the input."""
        size = 1
        for r in radix:
            size *= r
        x = 0
        for v, r in zip(values, radix, strict=True):
            x = x * r + v
        while True:
            x = self.permute(tweak, x, size)
            y, out = x, []
            for r in reversed(radix):
                y, v = divmod(y, r)
                out.append(v)
            out.reverse()
            if valid(out):
                return out

    def letters(self, tweak: str, word: str, alphabets: tuple[str, ...] | None = None, valid: Callable[[str], bool] = lambda w: True) -> str:
        """Lower-case letters and digits to others of their alphabet; everything else stays in place."""
        alphabets = alphabets or _ALPHABETS
        radix, values, at = [], [], []
        for i, c in enumerate(word):
            for alphabet in alphabets:
                if c in alphabet:
                    radix.append(len(alphabet))
                    values.append(alphabet.index(c))
                    at.append((i, alphabet))
                    break
        if not at:
            return word

        def spelled(numbers: list[int]) -> str:
            out = list(word)
            for v, (i, alphabet) in zip(numbers, at, strict=True):
                out[i] = alphabet[v]
            return "".join(out)

        return spelled(self.mixed(f"{tweak}|{','.join(str(alphabets.index(a)) for _, a in at)}", values, radix, lambda v: valid(spelled(v))))

    def _of(self, kind: str, canonical: str, grow: int = 0) -> str:
        """The surrogate's canonical form, ``grow`` letters or digits longer where the kind's length may vary.

        Of one ``grow`` different entities get different surrogates, whatever their formats.
        """
        tag = f"+{grow}" if grow else ""
        if kind == "email":
            local, _, domain = canonical.partition("@")
            host, _, rest = domain.partition(".")
            return self.letters(f"email{tag}", f"{local}{'a' * grow}@{host}") + f".{rest}"
        if kind == "ip":
            octets = [int(o) for o in canonical.split(".")]
            public = lambda o: 0 < o[0] < 224 and o[0] not in (10, 127) and o[:2] not in ([192, 168], [169, 254]) and not (o[0] == 172 and 16 <= o[1] < 32)
            same = public(octets)
            return ".".join(map(str, self.mixed("ip", octets, [256] * 4, lambda o: public(o) == same)))
        if kind == "card":
            same = luhn(canonical)
            longer = canonical + "0" * (grow - 1)
            longer = next(x for x in (longer + d for d in "0123456789") if luhn(x) == same) if grow else canonical
            rest = self.mixed(f"card{canonical[0]}{tag}", [int(d) for d in longer[1:]], [10] * (len(longer) - 1), lambda v: luhn(canonical[0] + "".join(map(str, v))) == same)
            return canonical[0] + "".join(map(str, rest))
        if kind == "ssn":
            return "".join(map(str, self.mixed(f"ssn{tag}", [int(d) for d in canonical] + [0] * grow, [10] * (9 + grow))))
        if kind == "phone":
            code, _, digits = canonical.partition(" ")
            fixed = lambda v: [x >= 2 for x in (v[0], v[3])] if len(digits) == 10 else [v[0] > 0]
            values = [int(d) for d in digits] + [0] * grow
            same = fixed(values)
            return f"{code} " + "".join(map(str, self.mixed(f"phone{code}{tag}", values, [10] * len(values), lambda v: fixed(v) == same)))
        if kind == "ip6":
            groups = [int(g, 16) for g in ipaddress.IPv6Address(canonical).exploded.split(":")]
            rest = self.mixed(f"ip6{groups[0]}", groups[1:], [65536] * 7, lambda g: any(g))
            return ipaddress.IPv6Address(":".join(f"{g:x}" for g in (groups[0], *rest))).compressed
        if kind == "given":
            order = self.order(tuple(next(n for n in GIVEN.values() if canonical in n)))
            return order[(order.index(canonical) + 1) % len(order)]
        free = lambda w: w.capitalize() not in _LISTED
        vowels, consonants = sounds_of(canonical)
        longer = next(w for v in vowels if free(w := canonical + (consonants[0] + v) * (grow // 2)))
        return self.letters(f"name{tag}", longer, _SOUNDS, free)

    def last(self, kind: str, canonical: str, rank: int, width: int) -> str:
        """A surrogate by rank: longer than ``width``, the longest canonical form of its kind, and so unlike any other."""
        if kind in ("ip", "ip6"):  # of the discard prefix
            return ipaddress.IPv6Address((0x0100 << 112) + self.permute(kind, rank, 1 << 64)).compressed
        digits, n = "abcdefghijklmnopqrstuvwxyz" if kind in ("email", "part") else "0123456789", rank
        places = []
        while len(places) < width + 1 or n:
            n, d = divmod(n, len(digits))
            places.append(digits[d])
        tail = "".join(reversed(places))
        if kind == "email":
            return f"{tail}@{canonical.partition('@')[2]}"
        if kind == "part":
            vowels, consonants = sounds_of(canonical)
            return "".join(consonants[digits.index(c) // len(vowels) % len(consonants)] + vowels[digits.index(c) % len(vowels)] for c in tail)
        return f"{canonical.partition(' ')[0]} {tail}" if kind == "phone" else tail


def sounds_of(word: str) -> tuple[str, str]:
    """Plain vowels and consonants of a word's script."""
    for c in reversed(word):
        for vowels, consonants in (_SOUNDS[2:4], _SOUNDS[4:6]):
            if c in vowels or c in consonants:
                return vowels, consonants
    return _SOUNDS[:2]


#: Vowels and consonants by script.
_SOUNDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψς", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿœ", "çñß", "άέήίόύώ")
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "0123456789", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ", "άέήίόύώς")


def canonical(kind: str, text: str, before: str) -> str:
    """What identifies an entity, whatever its punctuation and case. ``before``: the text ahead of it."""
    digits = "".join(c for c in text if c in "0123456789")
    if kind == "email":
        return text.lower()
    if kind == "ip":
        return ".".join(str(int(o)) for o in text.split("."))
    if kind == "ip6":
        return ipaddress.IPv6Address(text).compressed
    if kind in ("card", "ssn"):
        return digits
    if kind == "phone":
        if len(digits) == 11 and digits[0] == "1":  # with and without the code of the North American plan
            return f" {digits[1:]}"
        if text[0] == "+":
            code = re.match(r"\+\d{1,3}(?=[ .(-])|\+1(?=\d{10}$)|\+", text)[0]
            return f"{code} {digits[len(code) - 1:]}"
        return f" {digits}"
    title = re.search(r"(\S+?)\.?[  ]$", before)
    return f"{HONORIFICS.get(title[1], '') if title else ''} {text}"


def units(kind: str, entity: str) -> list[tuple[str, str]]:
    """What is permuted of an entity: of a name its parts, listed given names and others (in lower case); else itself."""
    if kind != "name":
        return [(kind, entity)]
    parts = (p for p in re.split("[ -]", entity.partition(" ")[2]) if p)
    return [("given", p) if p in _LISTED else ("part", p.lower()) for p in parts]


def composed(kind: str, entity: str, of: Callable[[str, str], str]) -> str:
    """The surrogate of an entity from those of its units."""
    if kind != "name":
        return of(kind, entity)
    gender, _, name = entity.partition(" ")
    told = iter([of(*u) for u in units(kind, entity)])
    return f"{gender} " + "".join(p if p in (" ", "-", "") else (s := next(told))[0].upper() + s[1:] for p in re.split("([ -])", name))


def rendered(kind: str, text: str, surrogate: str) -> str:
    """The surrogate in the original's punctuation and case."""
    if kind == "ip":
        return surrogate
    if kind == "ip6":
        return surrogate.upper() if any(c in text for c in "ABCDEF") else surrogate
    if kind == "name":
        return surrogate.partition(" ")[2]
    if kind == "email":
        sides = zip(text.split("@"), surrogate.split("@"), strict=True)
        return "@".join("".join(s.upper() if o.isupper() else s for o, s in zip(old, new, strict=False)) + new[len(old) :] for old, new in sides)
    fill = surrogate.replace(" ", "").replace("+", "")
    ahead = "".join(c for c in text if c in "0123456789")
    fill = ahead[: max(0, len(ahead) - len(fill))] + fill  # a code in front that the surrogate lacks stays
    digits, end = iter(fill), max(i for i, c in enumerate(text) if c in "0123456789") + 1
    told = "".join(next(digits) if c in "0123456789" else c for c in text)
    return told[:end] + fill[len(ahead) :] + told[end:]


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    text = text or ""
    found = [(i, j, kind, canonical(kind, text[i:j], text[max(0, i - 12) : i])) for i, j, kind in detect(text)]
    return mentions(text, found) if any(e[2] == "name" for e in found) else found


def mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``found`` and the whole words outside it that name a person of it without a title: full names, surnames, other parts."""
    wholes, surnames, givens = {}, {}, {}
    for _, _, kind, entity in found:
        if kind == "name":
            gender, _, name = entity.partition(" ")
            wholes.setdefault(name, entity)
            *given, surname = name.split(" ")
            if given:
                surnames.setdefault(surname, f" {surname}")
                givens.setdefault(given[0], f"{gender} {given[0]}")
                for part in given[1:]:
                    givens.setdefault(part, f" {part}")
    forms = givens | surnames | wholes
    pattern = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(forms, key=lambda f: (-len(f), f))))})(?!\w)")
    out, k = list(found), 0
    for m in pattern.finditer(text):
        while k < len(found) and found[k][1] <= m.start():
            k += 1
        if k == len(found) or m.end() <= found[k][0]:
            out.append((m.start(), m.end(), "name", forms[m[0]]))
    return sorted(out)


def surrogate_pii(docs: DataFrame, key: bytes, broadcast_rows: int = 200_000) -> DataFrame:
    """docs (doc_id, text, ...) with entities in ``text`` replaced and n_entities, kinds (sorted, joined) added; every row is kept.

    A null text stays null; a text without entities stays as it is. Of overlapping entities the kind first looked for
    stays. No entity is replaced by itself. Repeated rows and repeated entities get equal replacements; existing columns of the added names are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    root = shared_root(spark)
    kept = without(docs, "n_entities", "kinds").withColumn("text", F.col("text").cast("string"))

    def listed(batches):
        surrogates = Surrogates(key)
        for batch in batches:
            seen = {u for text in batch.column(0).to_pylist() for _, _, k, c in entities(text) for u in units(k, c)}
            rows = [(k, c, surrogates.of(k, c)) for k, c in sorted(seen)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "entity", "surrogate"])

    every = kept.select("text").mapInArrow(listed, "kind string, entity string, surrogate string").dropDuplicates(["kind", "entity"])
    every = materialize(every, root, "entities")

    # listed given names are permuted among themselves; everything else must keep clear of the corpus
    originals = every.select("kind", F.col("entity").alias("surrogate"))

    def clashing(rows: DataFrame, taken: DataFrame) -> DataFrame:
        return rows.where("kind <> 'given'").join(taken, ["kind", "surrogate"], "left_semi").select("kind", "entity", "surrogate")

    named = "kind string, entity string, surrogate string"

    def again(k: int, grow: int):
        """The entities' surrogates under the k-th spare permutation."""

        def run(batches):
            surrogates = Surrogates(key + b"|%d" % k)
            for batch in batches:
                new = [surrogates.of(*e, grow) for e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.string())], names=["kind", "entity", "surrogate"])

        return run

    # a spare permutation could meet a surrogate given by another one, so those are taken too
    moved, clash = None, materialize(clashing(every, originals), root, "clash-0")
    taken = originals.union(every.select("kind", "surrogate"))
    for k, grow in enumerate(GROWTH, 1):
        if not clash.limit(1).count():
            break
        new = materialize(clash.mapInArrow(again(k, grow), named), root, f"moved-{k}")
        clash = materialize(clashing(new, taken), root, f"clash-{k}")
        settled = new.join(clash.select("kind", "entity"), ["kind", "entity"], "left_anti")
        taken = taken.union(settled.select("kind", "surrogate"))
        moved = settled if moved is None else moved.union(settled)
    else:
        if clash.limit(1).count():
            widths = {r.kind: r.width for r in taken.groupBy("kind").agg(F.max(F.length("surrogate")).alias("width")).collect()}

            def by_rank(batches):
                surrogates = Surrogates(key)
                for batch in batches:
                    new = [surrogates.last(k, e, n, widths[k]) for k, e, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.string())], names=["kind", "entity", "surrogate"])

            ranked = numbered(clash.select("kind", "entity"), ["kind"], ["entity"], "rank")
            settled = materialize(ranked.mapInArrow(by_rank, named), root, "by-rank")
            moved = settled if moved is None else moved.union(settled)
    small = moved is None or moved.count() <= broadcast_rows
    changed = spark.sparkContext.broadcast({(r.kind, r.entity): r.surrogate for r in moved.collect()} if moved is not None and small else {})
    if not small:  # too many to send out: hand each row the changes of its own entities
        number = kept.withColumn("brinkline_row", F.monotonically_increasing_id())
        number = materialize(number, root, "numbered")

        def owned(batches):
            for batch in batches:
                rows = [(n, *u) for n, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in entities(t) for u in units(*e[2:])]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.string()) for i in (1, 2))], names=["brinkline_row", "kind", "entity"])

        own = number.select("brinkline_row", "text").mapInArrow(owned, "brinkline_row long, kind string, entity string").distinct().join(moved, ["kind", "entity"])
        own = own.groupBy("brinkline_row").agg(F.collect_list(F.concat_ws("\u0001", "kind", "entity", "surrogate")).alias("brinkline_moved"))
        rows = number.join(own, "brinkline_row", "left").drop("brinkline_row")
    else:
        rows = kept.withColumn("brinkline_moved", F.lit(None).cast("array<string>"))
    names = kept.columns

    def replace(batches):
        surrogates = Surrogates(key)
        for batch in batches:
            texts, counts, kinds = [], [], []
            own = batch.column(len(names)).to_pylist()
            for text, mine in zip(batch.column(names.index("text")).to_pylist(), own, strict=True):
                found = entities(text)
                counts.append(len(found))
                kinds.append(",".join(sorted({e[2] for e in found})))
                if found:
                    held = {tuple(m.split("\u0001")[:2]): m.split("\u0001")[2] for m in mine or ()}
                    parts, at = [], 0
                    of = lambda *u: held.get(u) or changed.value.get(u) or surrogates.of(*u)  # noqa: B023, E731
                    for i, j, kind, entity in found:
                        parts += [text[at:i], rendered(kind, text[i:j], composed(kind, entity, of))]
                        at = j
                    text = "".join(parts) + text[at:]
                texts.append(text)
            columns = list(batch.columns[: len(names)])
            columns[names.index("text")] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(kinds, pa.string())], names=[*names, "n_entities", "kinds"])

    return rows.mapInArrow(replace, extended(kept.schema, n_entities=T.IntegerType(), kinds=T.StringType()))
