import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from lodestat.llm.packing import BestFit, pack, pack_documents
from lodestat.llm.token_counts import UnigramCounter, scored_vocabulary, token_counts, words_of
from lodestat.llm.token_files import TokenFile, code_widths, encode_file, token_files
from lodestat.llm.tokens import Encoder
from lodestat.llm.toxicity import Chain, drop_toxic, fit_chain, score_toxicity

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = [" ", "\n", "\t", "a", "it's", ",", ".", "  ", "é", "́", "ß", "1", "23", "\xa0", " ", "日本", "Σ", "İ", "\x85", "\x1c", " A", "\0", "<|endoftext|>", "\r\n", "word,", "İ."]


def plain(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_ids_are_those_of_the_library(name, prose):
    r = random.Random(1)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 25))) for _ in range(3_000)] + [prose(k, 80, stop=7) for k in range(50)] + ["", None, "x" * 50_000]
    want = plain(name)
    for text, ids in zip(texts, Encoder(P.path(name), kept=500).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == (want(text) if text else []), text


def test_an_encoder_holds_one_tokenizer_and_knows_special_strings(monkeypatch):
    import tokenizers

    made = []

    class Counted:
        @staticmethod
        def from_file(path):
            made.append(path)
            return Tokenizer.from_file(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    encoder, whole = Encoder(P.path(BYTES), recognised=True), Tokenizer.from_file(P.path(BYTES))
    assert len(made) == 1 and encoder.special
    texts = ["a word", f"a {encoder.special[0]} word", "a word, again"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts * 2)] == [whole.encode(t, add_special_tokens=False).ids for t in texts * 2]


def test_best_fit_is_tight_and_bounded():
    r = random.Random(3)
    lengths = [r.randint(1, 2048) for _ in range(5_000)]
    for most in (1, 16, 1024):
        bins, used = BestFit(2048, most), {}
        for n in lengths:
            bin_id, at = bins.place(n)
            assert used.get(bin_id, 0) == at and at + n <= 2048
            used[bin_id] = at + n
            assert bins.count <= most
    assert len(used) <= 1.05 * sum(lengths) / 2048


def test_packed_documents(docs_of, prose):
    rows = [(k, prose(k, k * 7)) for k in range(120)] + [(500, None), (501, ""), (502, prose(1, 9_000)), (503, "a"), (503, "a"), (None, "b")]
    docs, ids = docs_of(rows), plain(BYTES)
    got = pack_documents(docs, P.path(BYTES)).toPandas()
    for _, bin_rows in got.groupby("sequence_id"):
        bin_rows = bin_rows.sort_values("offset")
        assert bin_rows["offset"].tolist() == [0, *bin_rows["length"].cumsum().tolist()[:-1]] and bin_rows["length"].sum() <= 2048
    want = sorted((-1 if d is None else d, n, zlib.crc32(np.array(all_[a : a + n], "<u4").tobytes())) for d, t in rows for all_ in [(ids(t) if t else []) + [0]]
                  for a, n in zip([0, *range(len(all_) % 2048 or 2048, len(all_), 2048)], [len(all_) % 2048 or 2048] + [2048] * 999) if a < len(all_))
    assert sorted(zip(got["doc_id"].fillna(-1).astype(int), got["length"], got["ids_crc32"])) == want
    assert pack_documents(docs.limit(0), P.path(BYTES)).count() == 0
    assert pack(docs.select(F.lit(5).cast("long").alias("length"), "hash"), 10).count() == len(rows)


def test_directly_addressable_codes():
    r = np.random.default_rng(2)
    for n, high in ((0, 5), (1, 1), (3, 2**31), (5_000, 49_408), (40_000, 300), (70_000, 2**20)):
        values = (r.integers(0, high, n) * r.random(n)).astype(np.uint32)
        parts = np.split(values, np.sort(r.integers(0, n + 1, 5)))
        file = TokenFile(encode_file([1, None, 3, 4, 5, 6], parts))
        assert (file.range(0, n) == values).all() and all((file.document(k) == parts[k]).all() for k in range(6))
        assert all(file.token(int(i)) == values[i] for i in r.integers(0, max(n, 1), 100 if n else 0))
        for a, b in np.sort(r.integers(0, n + 1, (30, 2)), axis=1).tolist():
            assert (file.range(a, b) == values[a:b]).all()
    lengths = np.zeros(33, np.int64)
    lengths[[3, 15]] = 1_000, 10
    assert code_widths(lengths)[0] in (3, 4) and sum(code_widths(lengths)) == 15
    with pytest.raises(ValueError):
        TokenFile(b"nothing of the kind" * 4)


def test_token_files_round_trip(docs_of, prose, spark):
    rows = [(k * 7 % 90, prose(k, 40)) for k in range(90)] + [(200, None), (201, ""), (202, prose(3, 4_000)), (5, "again"), (None, "no id")]
    docs, ids = docs_of(rows).repartition(5), plain(WORDS)
    got = token_files(docs, P.path(WORDS), end_id=2).orderBy("start").collect()
    named = [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got]
    want = [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, t in rows for x in [(ids(t) if t else []) + [2]]]
    assert sorted(named, key=str) == sorted(want, key=str)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    assert token_files(docs.limit(0), P.path(WORDS), end_id=2).count() == 0


def unigram(pieces, spelled):
    vocabulary = [("<unk>", 0.0), *pieces] + ([(f"<0x{b:02X}>", 0.0) for b in range(256)] if spelled else [])
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=spelled))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_of_random_vocabularies_with_ties():
    r = random.Random(3)
    for _ in range(600):
        pieces = [(p, -float(r.randint(1, 4))) for p in {"".join(r.choice("ab▁c") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 12))}]
        want, counter = unigram(pieces, False), UnigramCounter(pieces, False)
        for _ in range(5):
            text = "".join(r.choice("abcd e") for _ in range(r.randint(0, 14)))
            assert sum(counter.count(w)[0] for w in words_of(text)) == want(text), (text, pieces)


def test_counts_of_the_public_vocabulary(docs_of, prose):
    path = P.path("piece_bpe_32k.model")
    pieces, spelled = scored_vocabulary(path)
    want = unigram(pieces, spelled)
    texts = {k: prose(k, 30) for k in range(40)} | {50: "日本語 text ▁x  a", 51: "  two", 52: "", 53: None, 54: "naïve \U0001f600\U0001f600 ok", 55: "z" * 30_000}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(docs_of(texts), path).collect()}
    assert got == {k: want(t) if t else 0 for k, t in texts.items()}
    assert token_counts(docs_of({}), path).count() == 0


def test_chain_catches_toxic_texts_and_leaves_clean_ones(docs_of, spark, prose):
    r = random.Random(4)
    bad, texts, labels = ["badword", "uglier", "nastyx"], {}, []
    for k in range(900):
        words, toxic = prose(k, 60).split(), k % 6 == 0
        if toxic:
            for at in r.sample(range(60), 3):
                words[at] = r.choice(bad) + r.choice(["", "s", "ish"])
        texts[k] = " ".join(words)
        if k < 600:
            labels.append((k, int(r.random() < 0.9), int(toxic if r.random() > 0.03 else not toxic)))
    labels += [(None, 1, 1), (3, None, 1), (5, 1, 1), (5, 1, 0)]
    texts |= {2000: None, 2001: "", 2002: prose(1, 20_000)}
    docs = docs_of(list(texts.items()) + [(7, texts[7])])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = fit_chain(docs, marks, {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    assert chain.names == ["low_quality", "toxic"] and len(chain.links[1].earlier) == 1
    got = {x["doc_id"]: x["toxic"] for x in score_toxicity(docs, chain).collect()}
    held = range(600, 900)
    assert sum(got[k] for k in held if k % 6 == 0) >= 48 and sum(got[k] for k in held if k % 6) <= 3
    assert not got[2000] and not got[2001] and not got[2002]
    kept = drop_toxic(docs, chain)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {k for k, t in got.items() if not t}
    none = fit_chain(docs, marks.limit(0), {"toxic": F.col("toxic") == 1})
    assert none == Chain((), ()) and drop_toxic(docs, none).count() == docs.count() and not any(x["toxic"] for x in score_toxicity(docs, none).collect())


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_special_strings_have_the_ids_of_the_plain_call(name):
    from lodestat.llm.tokens import encoder

    r, library = random.Random(2), Tokenizer.from_file(P.path(name))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|startoftext|> x<|endoftext|>\n<|EndOfText|>", None, "", "plain, text. here"]
    texts += ["".join(r.choice(ODD) for _ in range(r.randint(0, 25))) for _ in range(2_000)]
    for text, ids in zip(texts, encoder(P.path(name)).encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == (library.encode(text, add_special_tokens=False).ids if text else []), text


def test_counts_across_runs_of_spaces(docs_of, spark, tmp_path):
    from lodestat.llm.queries import QUERIES
    from lodestat.llm.token_counts import runs_of

    def uncut(pieces, spelled):
        vocabulary = [("<unk>", 0.0), *pieces] + ([(f"<0x{b:02X}>", 0.0) for b in range(256)] if spelled else [])
        t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=spelled))
        t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
        return lambda text: len(t.encode(text, add_special_tokens=False).ids) if text else 0

    r = random.Random(5)
    for _ in range(600):
        pieces = [(p, -float(r.randint(1, 4))) for p in {"".join(r.choice("ab▁▁c") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 12))}]
        want, counter = uncut(pieces, False), UnigramCounter(pieces, False)
        for _ in range(5):
            text = "".join(r.choice("abcd  e") for _ in range(r.randint(0, 14)))
            assert sum(counter.count(w)[0] for w in runs_of(text, counter.cuttable)) == want(text), (text, pieces)
    want = uncut(*scored_vocabulary(P.path("piece_bpe_32k.model")))
    texts = dict(enumerate(["def f():\n" + " " * 16 + "return x", "a  b", "a b", "  two", "x ▁ ▁y", " " * 40, "end   ", "", None, "日本  語"]))
    docs_of(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x["n_tokens"] for x in QUERIES["op10_token_counts"](spark, str(tmp_path)).collect()}
    assert got == {k: want(t) for k, t in texts.items()} and got[1] == 3


def test_a_toxic_passage_in_a_long_text(docs_of, spark, prose):
    r = random.Random(6)
    bad, texts = ["badword", "uglier", "nastyx", "vilest", "rotten"], {}
    for k in range(600):
        words = prose(k, 60).split()
        for at in r.sample(range(60), 3) if k % 6 == 0 else []:
            words[at] = r.choice(bad)
        texts[k] = " ".join(words)
    for k in range(10):
        words = prose(3_000 + k, 5_000).split()
        texts[1_000 + k] = " ".join(words)
        texts[2_000 + k] = " ".join(words[:2_500] + bad + words[2_500:])
    docs = docs_of(texts)
    chain = fit_chain(docs, spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(600)], "doc_id long, toxic int"), {"toxic": F.col("toxic") == 1})
    got = {x["doc_id"]: x["toxic"] for x in score_toxicity(docs, chain).collect()}
    assert all(got[2_000 + k] and not got[1_000 + k] for k in range(10))


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_a_word_with_closing_marks_is_encoded_without_them_once(name):
    whole, encoder, given = Tokenizer.from_file(P.path(name)), Encoder(P.path(name)), []

    class Counting:
        def encode(self, text, **options):
            given.append(text)
            return whole.encode(text, **options)

    words = [f"{a}{b}ingle" for a in "bcdfghklmn" for b in "aeiou"]
    runs = ["", ".", ",", "!!", "&&&", ".%%%", "?)", "***", ":", '."']
    texts = [" ".join(w + run for w in words) for run in runs]
    odd = ["tab\tand\u3000 wide\x85\nbreaks.", "two  spaces\n\nlines \n.", "a\0b \0 c.", "it's. 'tis' d'l!' x'.", "\u01307.. \u0130. i\u0307. e\u0301! =\u0338 <.", " .", "", None]
    expected = [whole.encode(t or "", add_special_tokens=False).ids for t in texts + odd]
    encoder.tokenizer = Counting()
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == expected[: len(texts)]
    assert sum(map(len, given)) < 2 * max(map(len, texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(odd * 2)] == expected[len(texts) :] * 2
