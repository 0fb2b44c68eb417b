import random
import re

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import pii

# The patterns that entities are defined by.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, value):
    digits = [int(d) for d in re.sub("[^0-9]", "", value)]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        doubled = [d * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return True


def reference(text):
    return ",".join(
        f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group())
    )


def test_entities_against_the_plain_patterns(spark):
    rng = random.Random(1)
    texts = [None, "", "1.2.3.4.5.6.7.8 1.2.3.256 0000255.1.1.1 " + "9" * 60 + ".1.1.1", "a@b.c.@d.e x@y..z a@b.cd_x@e.f"]
    texts += [" a@b.c 4111 11111111 1111 4111-1111-1111-1111", "1 " * 30_000, "9" * 100_000]
    texts += ["a." * 50_000 + "@b.c", "a@" + "b." * 50_000 + "c", "+" + "1 " * 40_000, "😀 a@b.c 😀 1.2.3.4", "+1 (555) 123-4567 +123"]
    texts += ["".join(rng.choice("ab@.1 2-+()\n%_é😀9.") for _ in range(rng.randint(1, 60))) for _ in range(600)]
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+41 44 123 45 67", "1.2.3.4", "a@b.co", "378282246310005", "x"]
    texts += [rng.choice(["", " "]).join(rng.choice(parts) for _ in range(6)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.sanitise(df).select("doc_id", pii.span_list(F.col("base_spans")).alias("spans")).collect()
    assert [(r.doc_id, r.spans) for r in sorted(found)] == [(i, reference(t)) for i, t in enumerate(texts)]


def revealing_corpus():
    """Ten texts in which one name stands by an address, other texts without both, and copies of one text."""
    filler = ["tall green trees", "a quiet old harbour", "the seventh lantern", "rain over stone", "bread and salt"]
    rows = [(i, f"{filler[i % 5]} number{i} Zarathea, met kim@x.org about {filler[(i + 1) % 5]}. Zarathea left and {filler[(i + 2) % 5]}") for i in range(10)]
    rows += [(100 + i, f"{filler[i % 5]} and {filler[(i + 3) % 5]} with about met words left") for i in range(300)]
    rows += [(1000 + i, "Uniquely by call +41 44 123 45 67 now") for i in range(40)]
    return rows


def test_terms_that_reveal_an_entity_go(spark):
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in revealing_corpus()], "doc_id long, text string, base_spans string, key int")
    found = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert {s.value for r in found.values() for s in r.term_spans} == {"Zarathea"}
    for i in range(10):
        text = dict(revealing_corpus())[i]
        places = [(m.start(), m.end()) for m in re.finditer("Zarathea", text)]
        assert [(s.start, s.end) for s in found[i].term_spans] == places
        assert found[i].clean_text == text.replace("Zarathea", "[TERM]").replace("kim@x.org", "[EMAIL]")
    assert found[1000].clean_text == "Uniquely by call [PHONE] now"
    assert found[100].clean_text == dict(revealing_corpus())[100]


def test_disclosure_by_hand(spark):
    mentions = [(i, "email:a@b.c", i, ["name", "common"]) for i in range(4)] + [(9, "email:a@b.c", 3, ["name"])]
    mentions = spark.createDataFrame(mentions, "key long, value string, context long, terms array<string>")
    texts = spark.createDataFrame([("name common",)] * 4 + [("common word",)] * 60, "text string")
    rows = pii.disclosing_terms(mentions, texts, 64, threshold=-10.0, support=3).collect()
    assert {(r.term, round(r.disclosure, 9)) for r in rows} == {("name", 1.0), ("common", 0.0)}


@pytest.mark.parametrize("doc_id", [None, 7])
def test_repeated_rows(spark, doc_id):
    df = spark.createDataFrame([(doc_id, "a@b.c")] * 5 + [(doc_id, None)], "doc_id long, text string")
    found = sorted(r.clean_text for r in pii.sanitise(df).collect())
    assert found == ["", *["[EMAIL]"] * 5]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.sanitise(df).collect() == []


def test_terms_far_from_the_entity_and_in_other_documents_go(spark):
    far = " ".join(f"filler{k % 7}" for k in range(60))
    rows = [(i, f"Zarathea u4711 wrote part {i * 'x'}y {far} end{i} {i * 'z'}q kim@x.org") for i in range(10)]
    rows += [(50, "only Zarathea stands here, and u4711.")]
    rows += [(100 + i, f"{far} wrote part end nothing else w{i}") for i in range(200)]
    found = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {s.value for r in found.values() for s in r.term_spans} == {"Zarathea", "u4711"}
    assert found[50].clean_text == "only [TERM] stands here, and [TERM]."
    assert found[3].clean_text.startswith("[TERM] [TERM] wrote") and found[3].clean_text.endswith("[EMAIL]")
    assert found[100].clean_text == dict(rows)[100]


def test_copies_of_every_context_do_not_hide_a_term(spark):
    """Each of ten texts has 30 copies."""
    rows = [(100 * i + c, f"{'p' * (i + 3)} Zarathea, met kim@x.org {'r' * (i + 3)}") for i in range(10) for c in range(30)]
    rows += [(10_000 + i, f"met others w{i}") for i in range(400)]
    found = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {s.value for r in found for s in r.term_spans} == {"Zarathea"}
    assert sum(len(r.term_spans) for r in found) == 300


def test_many_entities_in_one_text(spark):
    """Places are added up in blocks; what is kept between the spans is cut out of chunks."""
    words = [f"user{i}@mail{i % 7}.example.com" if i % 3 else f"é{i}😀" for i in range(6000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "x" * 5000 + " a@b.cc " + "y" * 3000 + " 1.2.3.4"), (3, "a@b.cc")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.sanitise(df).collect()}
    at, expected = 0, []
    for word in words:
        if "@" in word:
            expected.append(("email", at, at + len(word), word))
        at += len(word) + 1
    assert [tuple(s) for s in rows[1].base_spans] == expected
    assert rows[1].clean_text == " ".join("[EMAIL]" if "@" in w else w for w in words)
    assert rows[2].clean_text == "x" * 5000 + " [EMAIL] " + "y" * 3000 + " [IP]" and rows[3].clean_text == "[EMAIL]"


def test_overlapping_spans_and_chunk_edges(spark):
    text = "".join(chr(97 + i % 26) for i in range(pii.CHUNK * 2 + 10))
    cases = [[(0, 3), (1, 2), (2, 9)], [(pii.CHUNK - 1, pii.CHUNK + 1)], [(0, pii.CHUNK), (pii.CHUNK, pii.CHUNK + 5)], [(5, 5000)], [(7, 9), (len(text) - 1, len(text))]]
    rows = [(i, text, [("email", a, b, "") for a, b in spans]) for i, spans in enumerate(cases)]
    df = spark.createDataFrame(rows, f"id int, t string, s {pii.SPAN}")
    for i, clean in df.select("id", pii.sanitised(F.col("t"), F.col("s"))).collect():
        expected, at = "", 0
        for a, b in sorted(cases[i], key=lambda s: (s[0], -s[1])):
            expected += text[at:a] + "[EMAIL]" if a >= at else ""
            at = max(at, b)
        assert clean == expected + text[at:]
