"""Required literals of patterns, and flags found through them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sitelode.functions.literals import any_of, found_by, required_literals
from sitelode.operators import safety
from sitelode.sources.text_lists import Pattern


@pytest.mark.parametrize(
    "regex,literals",
    [
        ("license", ["license"]), ("copyright|license", ["copyright", "license"]), ("Phone: *[0-9]+", ["phone:"]), ("abc?def", ["def"]), ("abcd?", ["abc"]),
        ("ab|license", None), ("[a-z0-9.]+@[a-z0-9.]+", None), ("abc(d|e)fghi", ["fghi"]), ("(abc|def)", None), ("foo.*barbaz", ["barbaz"]),
        ("abcd{0,3}ef", ["abc"]), ("abcd{2}ef", ["abc"]), ("abcd+ef", ["abcd"]), ("abcd+?ef", ["abcd"]), (r"a\.b\.c", ["a.b.c"]), (r"\bword\b", ["word"]),
        (r"wor\d+ds", ["wor"]), ("(?i)abcdef", None), ("abc(?=def)ghi", None), ("abc(?:x)ghij", ["ghij"]), ("x[]abc]yzw", ["yzw"]), ("x[^]abc]yzw", ["yzw"]),
        (r"\Qabc\E", None), ("straße", ["stra"]), ("x(a|b", None), ("ab[c|d]efg", ["efg"]), (r"a\|bcd", ["a|bcd"]), ("", None), ("a{2,}bcd", ["bcd"]), (r"[a\]b]cde", ["cde"]),
        ("abc*|", None), (r"abc\ndef", ["abc"]),
    ],
)
def test_required_literals(regex, literals):
    assert required_literals(regex) == literals


def test_literals_occur_in_every_match():
    rng = random.Random(8)
    atoms = ["a", "b", "c", "x", ".", "[ab]", "[^c]", "(a|bc)", "(?:ab)", r"\.", r"\d", "é", " "]
    for _ in range(4000):
        regex = "".join(rng.choice(atoms) + rng.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}", "+?", "|"]) for _ in range(rng.randint(1, 9)))
        needed = required_literals(regex, "i")
        text = "".join(rng.choice("abcxABC.1é ") for _ in range(40))
        match = re.search(regex, text, re.I | re.S)
        if needed and match:
            assert any(n in text.lower() for n in needed), (regex, text)
    assert required_literals("abc def", "x") is None


def test_all_literals_are_found_where_they_overlap():
    literals = ["abc", "abcde", "bcd", "cde", "a.c", "de"]
    finder, says = re.compile(f"(?=({any_of(literals)}))"), found_by(literals)
    rng = random.Random(9)
    for _ in range(500):
        text = "".join(rng.choice("abcde.") for _ in range(12))
        found = set(finder.findall(text))
        for literal in literals:
            assert bool(found & set(says[literal])) == (literal in text)


def test_flags_equal_a_scan_by_every_pattern(spark):
    rng = random.Random(10)
    words = ["Copyright", "license", "mail me@x.org", "10.0.0.1", "phone: 55", "PHONE:7", "é", "abc", "abcde", "\n", ""]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 8))) for _ in range(150)] + [None, "LICENSE" * 1000]
    patterns = [
        Pattern(2, "Contact", "[a-z0-9.]+@[a-z0-9.]+", "i"), Pattern(2, "Contact", "phone: *[0-9]+", "i"), Pattern(1, "Licence", "copyright|licen[sc]e", "i"),
        Pattern(3, "Case", "LICENSE", ""), Pattern(4, "Long", "abcde?", "i"), Pattern(4, "Long", "abcde", ""),
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for row in safety.pattern_flag(frame, patterns).collect():
        text = texts[row.id] or ""
        counts = [(p, len(re.findall(p.regex, text, re.I if p.flags else 0))) for p in patterns]
        assert row.n_matches == sum(n for _, n in counts)
        assert row.flagged_categories == [c for _, c in sorted({(p.category_no, p.category) for p, n in counts if n})]
    none = safety.pattern_flag(frame, []).first()
    assert (none.flagged_categories, none.n_matches) == ([], 0)


def test_a_thousand_patterns_plan_and_count(spark):
    patterns = [Pattern(i % 5, f"c{i % 5}", f"word{i:04}x*[0-9]", "i") for i in range(1000)]
    frame = spark.range(300).select("id", F.concat(F.lit("say Word0"), F.lpad((F.col("id") % 900).cast("string"), 3, "0"), F.lit("xx7 and word0001")).alias("text"))
    rows = {r.id: r for r in safety.pattern_flag(frame, patterns).collect()}
    assert all(rows[i].n_matches == 1 and rows[i].flagged_categories == [f"c{i % 5}"] for i in range(300) if i != 1)
