"""Personal data: plain spans against the contract's patterns by brute force, disguised ones in given texts."""

import hashlib
import random
import re

import pytest

from kindred.llm import pii
from kindred.llm.session import prepare

DOCS = "doc_id long, text string, found string, kind int, base string"
ORDER = ["email", "ip", "card", "phone"]
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
DISGUISED = [
    ("mail jоhn.smith@exаmple.com now", [("email", "jоhn.smith@exаmple.com", "john.smith@example.com")]),
    ("john [at] example [dot] com", [("email", "john [at] example [dot] com", "john@example.com")]),
    ("see john.doe(at)mail8(dot)example(dot)com.", [("email", "john.doe(at)mail8(dot)example(dot)com", "john.doe@mail8.example.com")]),
    ("a bosbt.42 at mail8 dot example dot com ok", [("email", "bosbt.42 at mail8 dot example dot com", "bosbt.42@mail8.example.com")]),
    ("john dot smith at example dot co dot uk", [("email", "john dot smith at example dot co dot uk", "john.smith@example.co.uk")]),
    ("j.doe at example.com", [("email", "j.doe at example.com", "j.doe@example.com")]),
    ("JOHN AT EXAMPLE DOT COM", [("email", "JOHN AT EXAMPLE DOT COM", "JOHN@EXAMPLE.COM")]),
    ("john ［at］ example ［dot］ com", [("email", "john ［at］ example ［dot］ com", "john@example.com")]),
    ("j​ohn@exam​ple.com", [("email", "j​ohn@exam​ple.com", "john@example.com")]),
    ("İ 😀 john [at] example [dot] com", [("email", "john [at] example [dot] com", "john@example.com")]),
    ("write to john@example dot com", [("email", "john@example dot com", "john@example.com")]),
    ("𝗷𝗼𝗲@𝗲𝘅𝗮𝗺𝗽𝗹𝗲.𝗰𝗼𝗺", [("email", "𝗷𝗼𝗲@𝗲𝘅𝗮𝗺𝗽𝗹𝗲.𝗰𝗼𝗺", "joe@example.com")]),
    ("192[.]168[.]1[.]1", [("ip", "192[.]168[.]1[.]1", "192.168.1.1")]),
    ("192 dot 168 dot 1 dot 17", [("ip", "192 dot 168 dot 1 dot 17", "192.168.1.17")]),
    ("one nine two dot one six eight dot zero dot one seven.", [("ip", "one nine two dot one six eight dot zero dot one seven", "192.168.0.17")]),
    ("call plus one nine eight eight five five five two four eight five", [
        ("phone", "plus one nine eight eight five five five two four eight five", "+19885552485")]),
    ("+1 (nine eight eight) five five five two four eight five", [("phone", "+1 (nine eight eight) five five five two four eight five", "+1 (988) 5552485")]),
    ("+１ (９８８) ５５５-２４８５", [("phone", "+１ (９８８) ５５５-２４８５", "+1 (988) 555-2485")]),
    ("+1 988 fünf fünf fünf 2485", [("phone", "+1 988 fünf fünf fünf 2485", "+1 988 555 2485")]),
    ("four zero four one eight nine four nine seven four six zero eight seven nine five", [
        ("card", "four zero four one eight nine four nine seven four six zero eight seven nine five", "4041894974608795")]),
    ("4041­8949­7460­8795", [("card", "4041­8949­7460­8795", "4041894974608795")]),
]
CLEAN = ["look at example.com", "anan at tothestion. Ly", "un deux trois dot", "we met at nine, one two three four", "à la maison à 9 h 30", "(at) (dot) [.]",
         "four zero four one eight nine four nine seven four six zero eight seven nine six", "300 dot 1 dot 1 dot 1", "a dot b", "at dot", "plus one"]


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for g in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", g.group())
            if kind == "ip" and any(int(p) > 255 for p in g.group().split(".")):
                continue
            if kind == "card":
                doubled = [int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((g.start(), g.end(), kind))
    return sorted(out, key=lambda s: (s[0], ORDER.index(s[2])))


def random_texts():
    rng = random.Random(5)
    parts = ["a", "b.c", "x_y", "%", "@", "@@", ".", "..", "-", "+", "+1", " ", " ", "\n", "(", ")", "12", "255", "256", "1.2.3.4", "0004", "é", "日", "😀",
             "4041894974608795", "4041-8949-7460 8795", "404189", "joe@ex.com", "(988) 555-2485", "9", "99 9", "no at all", "one", "two dot"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]


def test_base_spans_equal_the_patterns():
    for text in random_texts():
        found = pii.spans(text)
        assert [s[:3] for s in found if s[3]] == plain_spans(text)
        assert found == sorted(found, key=lambda s: (s[0], ORDER.index(s[2]), s[1])) and len({s[:3] for s in found}) == len(found)


@pytest.mark.parametrize(("text", "want"), DISGUISED)
def test_disguised_identifiers_map_back_to_their_source(text, want):
    assert [(k, text[a:b], v) for a, b, k, base, v in pii.spans(text) if not base] == want


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay_clean(text):
    assert pii.spans(text) == []


def test_transducers_keep_every_place():
    m = pii.Mapped("x​ ａ [at] b dot c")
    assert pii.unify(m) and m.text == "x a [at] b dot c" and m.source(2, 3) == (3, 4)
    pii.point(m)
    assert m.text == "x a@b.c" and m.source(2, 7) == (3, 17) and m.source(3, 4) == (4, 10)


@pytest.fixture(scope="module")
def odd(spark):
    prepare(spark)
    texts = [None, "", " ", *(t for t, _ in DISGUISED), *CLEAN, "joe@ex.com " * 3, *random_texts()[:100], "x" * 2_000_000 + "@", "+1" + " " * 1_000_000,
             "7" * 500_000, "1 " * 300_000, "a." * 300_000, "one " * 100_000, "@" * 300_000, "a at b " * 100_000]
    rows = [(k, t, "clash", 1, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:5] + [(None, "joe@ex.com", "", 0, ""), (None, None, None, None, None)], DOCS)


def test_report(odd):
    got = sorted((tuple(r) for r in pii.report(pii.personal_data(odd)).collect()), key=str)
    want = []
    for r in odd.collect():
        text = r["text"] or ""
        found = pii.spans(text)
        base = plain_spans(text) if len(text) < 10_000 else [s[:3] for s in found if s[3]]
        said = [",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in part) for part in (base, found)]
        want.append((r["doc_id"], *(sum(s[2] == k for s in base) for k in ORDER), hashlib.sha256(said[0].encode()).hexdigest(), said[1]))
    assert got == sorted(want, key=str)


def test_empty_table(odd):
    assert pii.report(pii.personal_data(odd.limit(0))).collect() == []
