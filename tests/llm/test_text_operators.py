import random
import re

import numpy as np
import pytest

from lodestat.llm.decontamination import BenchmarkIndex, drop_leaks, find_leaks, words_of
from lodestat.llm.language_id import LanguageModel, identify_language, language_dictionaries
from lodestat.llm.paragraph_dedup import repeated_passages, strip_repeats
from lodestat.llm.pii import BASE_KINDS, find_pii, find_spans, luhn, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_pattern(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            valid = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if valid:
                out[kind].append(m.span())
    return out


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(5)
    parts = ["a", "@", ".", "1", "23", "4567", "255", "256", "+", " ", "-", "(", ")", "x.y@b.c-d.ee", "1.2.3.4", "4111111111111111", "+49 (0)30 12345-678", "é", "\n", "@@", "..", "١", "a@b", "9 9"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        found = find_spans(text)
        assert {k: found[k] for k in BASE_KINDS} == by_pattern(text), text


def test_added_spans_and_redaction(docs_of):
    text = "Konto DE89 3704 0044 0532 0130 00, see https://a.b/c?d=1). Account no: 12-345678"
    assert {k: [text[a:b] for a, b in v] for k, v in find_spans(text).items() if v} == {"iban": ["DE89 3704 0044 0532 0130 00"], "url": ["https://a.b/c?d=1"], "account": ["12-345678"]}
    docs = docs_of([(1, "mail a@b.cc now"), (2, None), (3, ""), (1, "mail a@b.cc now"), (4, "7" * 200_000)])
    rows = sorted((r["doc_id"], r["n_email"], r["spans"]) for r in find_pii(docs).collect())
    assert rows == [(1, 1, "email:5:11"), (1, 1, "email:5:11"), (2, 0, ""), (3, 0, ""), (4, 0, "")]
    assert {r["doc_id"]: r["text"] for r in redact(docs).collect() if r["doc_id"] < 4} == {1: "mail [email] now", 2: None, 3: ""}
    assert find_pii(docs.limit(0)).count() == 0


LANGUAGES = {"xx": "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod".split(), "yy": "the quick brown fox jumps over lazy dogs and runs away from here".split()}


def test_language_by_compression_on_held_out_texts(docs_of, spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(LANGUAGES[lang]) for _ in range(r.randint(3, 80))), lang) for k in range(400) for lang in [r.choice(["xx", "yy"])]]
    labelled = spark.createDataFrame([x for x in rows if x[0] % 3] + [(1000, None, "xx"), (1001, "12 34", "zz"), (1002, "words", None)], "doc_id long, text string, lang string")
    found = language_dictionaries(labelled, sample=50)
    assert found == language_dictionaries(labelled.repartition(7), sample=50) and set(found) == {"xx", "yy"} and all(len(d) <= 100_000 for d in found.values())
    model = LanguageModel(found, 6)
    held = [x for x in rows if not x[0] % 3]
    assert sum(model.classify(t.upper() + "!!")[0] == lang for _, t, lang in held) >= 0.97 * len(held)
    got = {r["doc_id"]: r for r in identify_language(docs_of([(1, None), (2, ""), (3, "12 !"), (4, "the fox"), (4, "the fox"), (5, "dogs " * 50_000)]), found).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 4, 5)] == ["und", "und", "und", "yy", "yy"] and all(0 <= x["score"] <= 1 for x in got.values())
    assert {r["lang_pred"] for r in identify_language(docs_of({1: "words"}), {}).collect()} == {"und"}


def test_benchmark_passages_against_brute_force(docs_of, spark, prose):
    r = random.Random(1)
    items = {k: prose(1000 + k, r.randint(10, 60)) for k in range(25)} | {50: "one two three", 51: "", 52: None}
    bench = spark.createDataFrame([(k, t, "h") for k, t in items.items()], "item_id long, text string, hash string")
    docs = {}
    for k in range(120):
        words = prose(k, 150).split()
        if k % 3 == 0:
            passage = items[r.randrange(25)].split()
            for _ in range(r.randint(0, 3)):
                passage[r.randrange(len(passage))] = "changed"
            words[40:40] = passage
        docs[k] = " ".join(words)
    docs |= {200: "It said: One, TWO three!", 201: None, 202: "", 203: " ".join(items[3].split()[1:])}

    def best(text, item):
        w, b = words_of(text), words_of(item)
        n, size = min(len(b), len(w)), min(5, len(b))
        there = [tuple(b[q : q + size]) for q in range(len(b) - size + 1)]
        top = 0.0
        for q in range(len(w) - n + 1):
            here = [tuple(w[q + z : q + z + size]) for z in range(n - size + 1)]
            shared = sum(min(here.count(s), there.count(s)) for s in set(here))
            top = max(top, shared / (len(here) + len(there) - shared)) if here else top
        return top

    want = {(d, i) for d, t in docs.items() if t for i, item in items.items() if item and best(t, item) >= 0.8 - 1e-9}
    frame = docs_of(docs)
    for block in (4_096, 10):  # one block, and several
        assert {(x["doc_id"], x["item_id"]) for x in find_leaks(frame, bench, items=block).collect()} == want and (200, 50) in want
    kept = drop_leaks(frame, bench)
    assert kept.columns == frame.columns and {x["doc_id"] for x in kept.collect()} == set(docs) - {d for d, _ in want}
    assert find_leaks(frame, bench.limit(0)).count() == 0 and BenchmarkIndex([], 5, 0.8, 23).hits("a b") == []


def test_repeated_passages(docs_of, prose):
    passage = prose(900, 60, stop=11)
    long_line = prose(901, 120)
    rows = {k: prose(k, 100, stop=9) for k in range(20)}
    for k in (2, 5, 9):
        at = rows[k].split()
        rows[k] = " ".join(at[:30] + [passage] + at[30:])
    rows[12] += "\n" + long_line
    rows[15] += "\n" + long_line.rsplit(" ", 3)[0]
    rows |= {30: None, 31: "", 32: "short line", 33: "short line", 34: "go " * 40_000}
    docs = docs_of(list(rows.items()) + [(None, rows[2])])
    found = repeated_passages(docs)
    got = {(r["doc_id"], r["kind"], r["keep_doc_id"]) for r in found.collect()}
    assert {x[0] for x in got} == {5, 9, 15} and {(5, "passage", 2), (9, "passage", 2), (15, "paragraph", 12)} <= got
    for r in found.collect():
        assert rows[r["doc_id"]][r["start"] : r["end"]].split()[6] in rows[r["keep_doc_id"]]
    stripped = {r["doc_id"]: r["text"] for r in strip_repeats(docs).collect()}
    assert passage.split()[30] not in stripped[5] and stripped[2] == rows[2] and stripped[30] is None
    assert repeated_passages(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "a b\n\nc d. e", "  x  y\t z.\n"])
def test_layout_places(text):
    from lodestat.llm.paragraph_dedup import Layout

    layout = Layout(text)
    assert [text[a:b] for a, b in zip(layout.starts, layout.ends)] == text.split()


def test_similar_lines_of_distant_fingerprints(docs_of, prose):
    from lodestat.llm.paragraph_dedup import parity
    from lodestat.llm.shingles import shingle_hashes, simhash

    words = prose(2299, 32).split()
    rows = {1: " ".join(words), 2: " ".join(words[:-3] + prose(52299, 3).split())}
    a, b = (np.unique(shingle_hashes(t, 5)) for t in rows.values())
    apart = [sum(((x ^ y) % 2**64).bit_count() for x, y in zip(f(a), f(b))) for f in (lambda h: simhash(h, 4), parity)]
    assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) and apart[0] > 52 and apart[1] <= len(np.setxor1d(a, b))
    assert {(r["doc_id"], r["kind"], r["keep_doc_id"]) for r in repeated_passages(docs_of(rows)).collect()} >= {(2, "paragraph", 1)}


def test_repeated_passages_without_stops(docs_of, prose):
    passage = prose(700, 50)
    rows = {}
    for k in range(6):
        words = prose(800 + k, 60 + 11 * k).split()
        at = 17 + 7 * k
        rows[k] = " ".join(words[:at]) + " " + (passage if k % 2 else passage.replace(" ", "\n")) + " " + " ".join(words[at:])
    docs = docs_of([*rows.items(), (4, rows[4])])
    spans = {}
    for r in repeated_passages(docs).collect():
        inside = rows[r["doc_id"]][r["start"] : r["end"]]
        assert r["kind"] == "passage" and r["keep_doc_id"] < r["doc_id"] and " ".join(inside.split()) in passage and len(inside.split()) == r["n_words"] >= 18
        spans.setdefault(r["doc_id"], []).append(inside)
    assert sorted(spans) == [1, 2, 3, 4, 5] and all(max(len(x.split()) for x in found) >= 28 for found in spans.values())
