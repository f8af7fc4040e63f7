"""Web archives, periodic runs and pivot clusters: against other readers, brute force and full comparison."""

import gzip
import hashlib
import io
import math
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestat.llm import periodic_runs as P
from lodestat.llm import pivot_clusters as C
from lodestat.llm import web_archives as W
from lodestat.session import scratch_path

# ---------------------------------------------------------------- archives


@pytest.fixture(scope="module")
def pages_of(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "h", 1, "p") for r in rows], "page_id long, url string, html string, sha string, refers_to int, path string")

    return make


LONG = "<p>" + "é" * 600 + "</p>"
CASES = [(1, "http://a/b c\r\nX: y", LONG), (2, None, LONG), (7, "http://a", LONG), (3, "http://a", "short"), (4, "", "short"), (5, "u", None), (6, "u", ""),
         (8, "u", "x" * 999), (9, "u", "x" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (None, "u", "y" * 1000), (None, "u", "z" * 1500), (12, "v", "w\r\n\r\nv" * 400), (11, "u", "y" * 1000)]


def test_archived_pages_kinds_and_digests(pages_of):
    got = sorted(tuple(r) for r in W.archived_pages(pages_of(CASES)).collect() if r["page_id"] is not None)
    top = {LONG: 7, "y" * 1000: 11}
    want = []
    for page, _, html in CASES:
        payload = (html or "").encode()
        other = top.get(html) if html in top and page != top[html] else None
        if page is not None:
            want.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if other else "response", other, None if other else True))
    assert got == sorted(want)
    nulls = sorted((r["payload_bytes"], r["record_type"], r["refers_to"]) for r in W.archived_pages(pages_of(CASES)).where("page_id IS NULL").collect())
    assert nulls == [(1000, "revisit", 11), (1500, "response", None)]


def test_no_pages_no_packages(pages_of):
    empty = pages_of(CASES).limit(0)
    assert W.archived_pages(empty).collect() == []


def test_packages_open_elsewhere_and_roll(spark, pages_of):
    rng = random.Random(3)
    rows = [(i, f"http://x/{i}", "".join(rng.choice("abcdefghij<> ") for _ in range(rng.randint(0, 3000)))) for i in range(300)]
    folder = scratch_path(spark, "archives")
    files = W.write_archives(pages_of(rows).coalesce(2), folder, file_bytes=50_000)
    paths = [r["path"] for r in files.collect()]
    assert len(paths) > 3 and sum(r["n_records"] for r in files.collect()) == 300
    seen = {}
    for path in paths:
        with zipfile.ZipFile(path) as package:
            assert package.testzip() is None
            assert all(i.compress_type == zipfile.ZIP_STORED for i in package.infolist())
            text = gzip.decompress(package.read("archive/data.warc.gz"))
        for part in text.split(b"WARC/1.1\r\n")[1:]:
            head, _, rest = part.partition(b"\r\n\r\n")
            seen[head.split(b"urn:page:")[1].split(b":")[0]] = rest.partition(b"\r\n\r\n")[2][:-4]
    assert seen == {str(i).encode(): h.encode() for i, _, h in rows}
    # tiny index slices give the same records as one
    a = {r["record_id"]: bytes(r["payload"]) for r in W.read_archives(files, folder, slice_bytes=100).collect()}
    b = {r["record_id"]: bytes(r["payload"]) for r in W.read_archives(files, folder).collect()}
    assert len(a) == 300 and a == b


def source(data: bytes):
    return pa.BufferReader(data)


def package(names, force=False, prefix=b"", comment=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in names.items():
            with z.open(name, "w", force_zip64=force) as f:
                f.write(data)
        z.comment = comment
    return prefix + out.getvalue()


@pytest.mark.parametrize("force", [False, True])
@pytest.mark.parametrize("prefix", [b"", b"#!/bin/sh\n"])
def test_members_found_by_directory(force, prefix):
    names = {"archive/a.warc": b"x" * 1000, "indexes/é.jsonl": b"{}", "empty": b""}
    data = package(names, force, prefix, b"PK\x05\x06 a comment that looks like an end record")
    found = {m.name: m for m in W.members(source(data))}
    assert set(found) == set(names)
    for name, m in found.items():
        at = m.data_offset(source(data))
        assert data[at : at + m.size] == names[name]


def wide_package(names):
    """A package whose sizes, offsets and end record all stand in ZIP64 fields only."""
    import struct
    import zlib
    out, central = bytearray(), bytearray()
    for name, data in names.items():
        at, n, crc = len(out), name.encode(), zlib.crc32(data)
        out += struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(n), 20) + n + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
        extra = struct.pack("<HH3s", 0x9999, 3, b"abc") + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        central += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(n), len(extra), 2, 0, 0, 0, 0xFFFFFFFF) + n + extra + b"hi"
    begin = len(out)
    out += central
    wide = len(out)
    out += struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, len(names), len(names), len(central), begin)
    out += struct.pack("<4sIQI", b"PK\x06\x07", 0, wide, 1) + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return bytes(out)


@pytest.mark.parametrize("prefix", [b"", b"before"])
def test_zip64_directory(prefix):
    names = {"archive/a.warc": b"abc" * 50, "indexes/a.jsonl": b"{}\n"}
    data = prefix + wide_package(names)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert {n: z.read(n) for n in z.namelist()} == names
    for m in W.members(source(data)):
        at = m.data_offset(source(data))
        assert data[at : at + m.size] == names[m.name]


def test_bad_packages_are_refused():
    good = package({"archive/a.warc": b"x" * 100})
    for bad in (b"", b"no zip", good[:-30], b"PK\x05\x06"):
        with pytest.raises(W.BadPackage):
            W.members(source(bad))
    squeezed = package({"archive/a.warc": b"x" * 100}, method=zipfile.ZIP_DEFLATED)
    data = W.members(source(squeezed))
    if data[0].method:
        with pytest.raises(W.BadPackage):
            data[0].data_offset(source(squeezed))


def warc(kind, body, extra=""):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{len(body)}>\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    plain = [warc("warcinfo", b"software: x\r\n"), warc("resource", b"hello", "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"hello").hexdigest() + "\r\n"),
             warc("response", b"HTTP/1.1 200 OK\r\nA: b\r\n c\r\n\r\nbody\r\n\r\nmore", "Content-Type: application/http\r\nWARC-Payload-Digest: sha1:" + "A" * 32 + "\r\n")]
    packed = [gzip.compress(r) for r in plain]
    spans, at = [], 0
    for r in packed:
        spans.append((at, len(r)))
        at += len(r)
    cdxj = "".join(f'com,x)/ 2020 {{"offset": "{a}", "length": "{n}", "filename": "two.warc.gz"}}\n' for a, n in reversed(spans)).encode().rstrip(b"\n")
    (tmp_path / "a.zip").write_bytes(package({"archive/one.warc": b"".join(plain), "archive/two.warc.gz": b"".join(packed), "indexes/two.cdxj": cdxj, "archive/three.warc.gz": b"".join(packed)}))
    files = spark.createDataFrame([(str(tmp_path / "a.zip"),)], "path string")
    rows = W.read_archives(files, str(tmp_path)).collect()
    want = sorted([("warcinfo", b"software: x\r\n", None), ("resource", b"hello", True), ("response", b"body\r\n\r\nmore", False)])
    for name in ("one.warc", "two.warc.gz", "three.warc.gz"):
        assert sorted((r["record_type"], bytes(r["payload"]), r["intact"]) for r in rows if r["archive"] == "archive/" + name) == want


# ---------------------------------------------------------------- runs

def runs_by_brute_force(w, length=6, exponent=4):
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        k = 0
        while k < n - q:
            if w[k] != w[k + q]:
                k += 1
                continue
            j = k
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - k >= max(length, exponent * q):
                out[k, j + q] = min(q, out.get((k, j + q), q))
            k = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 7)), max_size=8))
def test_runs_equal_brute_force(blocks):
    words = [w for block, times in blocks for w in block * times]
    assert P.find_runs(np.array(words, np.int64)) == runs_by_brute_force(words)


@pytest.mark.parametrize("seed", range(6))
def test_runs_inside_repeated_passages(seed):
    r = random.Random(seed)
    words = []
    while len(words) < 900:
        block = [r.randrange(2 + seed) for _ in range(r.randint(1, 20))]
        words += block * r.randint(1, 9)
        if r.random() < 0.5 and words:
            at = r.randrange(len(words))
            words += words[at : at + r.randint(1, 200)]
    assert P.find_runs(np.array(words, np.int64)) == runs_by_brute_force(words)


def test_grammar_gives_the_text_back():
    r = random.Random(5)
    words = np.array([r.randrange(4) for _ in range(500)] * 2)
    g = P.Grammar(words)
    size = [1 if not rule else None for rule in g.is_rule]
    assert size.count(1) + sum(g.is_rule) == len(g.at)
    for places, n, left in zip(g.places, g.size, g.left):
        first = words[places[0] : places[0] + n].tolist()
        assert len(places) > 1 and 0 < left < n and all(words[p : p + n].tolist() == first for p in places)
    # no two neighbours at the top stand twice
    ends = [*g.at[1:].tolist(), len(words)]
    parts = [tuple(words[a:b].tolist()) for a, b in zip(g.at.tolist(), ends)]
    pairs = list(zip(parts, parts[1:]))
    assert all(abs(pairs.index(p) - k) < 2 for k, p in enumerate(pairs))


def test_periodic_runs_rows(docs_of):
    docs = docs_of([(1, "a b " * 5 + "c"), (2, None), (3, ""), (4, " \t\r\n\x0b\x0c "), (5, "x x x x x x"), (5, "x x x x x x"), (None, "p q r " * 4), (6, "x x " * 3), (7, "go " * 3)])
    got = {}
    for r in P.periodic_runs(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    assert got == {1: [(11, [(0, 10, 2)], "a b c")], 2: [(0, [], "")], 3: [(0, [], "")], 4: [(0, [], "")], 5: [(6, [(0, 6, 1)], "x")] * 2, None: [(12, [(0, 12, 3)], "p q r")],
                   6: [(3, [], "x x x x x x")], 7: [(3, [], "go go go")]}
    assert P.periodic_runs(docs.limit(0)).collect() == []
    kept = {r["doc_id"]: r["text"] for r in P.collapse_runs(docs).collect()}
    assert kept[1] == "a b c" and kept[2] is None and kept[4] == " \t\r\n\x0b\x0c " and kept[7] == "go go go "


def test_long_periodic_text_is_linear():
    assert P.find_runs(np.array([1, 2, 3] * 60_000 + [4] + [1, 2, 3] * 500)) == [(0, 180_000, 3), (180_001, 1500, 3)]


def test_op12_query_against_brute_force(spark):
    import zlib

    from lodestat.llm.queries import QUERIES
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    hit = 0
    for doc_id, text in docs:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if len(words) > 1500 and h % 10:
            continue  # brute force is quadratic
        runs = runs_by_brute_force(words) if len(words) <= 3000 else P.find_runs(np.unique(words, return_inverse=True)[1])
        best = min(((-size, start, q) for start, size, q in runs), default=None)
        drop = {i for start, size, q in runs for i in range(start + q, start + size)}
        r = got[doc_id]
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest()
        hit += bool(runs)
    assert hit > 3


# ---------------------------------------------------------------- clusters

def clusters_by_full_comparison(rows, k, rounds, scale, seed=1):
    ints = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows]
    first = sorted(ints, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in first]

    def assign():
        out = []
        for _, v in ints:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        got = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(ints, got) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = assign()
    inertia = {}
    for d, c in got:
        inertia[c] = inertia.get(c, 0) + d
    return sorted((repr(i), c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(ints, got))


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, v string")


def test_pivot_clusters_equal_full_comparison(spark):
    r = random.Random(8)
    rows = [(i, [r.gauss(i % 5, 0.4) for _ in range(6)]) for i in range(300)] + [(7, [0.5] * 6), (7, [0.5] * 6), (None, [0.25] * 6), (400, [1e5] * 6)]
    bad = [(900, None), (901, [1.0] * 5), (902, [1.0] * 7), (903, [None] + [1.0] * 5), (904, [math.nan] + [1.0] * 5), (905, [math.inf] + [1.0] * 5)]
    for k, pivots in ((16, 8), (3, 1), (40, 40)):
        got = C.pivot_clusters(vectors_of(spark, rows + bad), dims=6, k=k, pivots=pivots).collect()
        assert sorted((repr(x["vec_id"]), *list(x)[1:-1]) for x in got) == clusters_by_full_comparison(rows, k, 3, 64)
    assert sum(x["compared"] for x in C.pivot_clusters(vectors_of(spark, rows), dims=6, k=16).collect()) < 0.7 * 16 * len(rows)


def test_few_or_no_vectors(spark):
    few = [(1, [0.0] * 4), (2, [0.0] * 4), (3, [-0.01] * 4)]
    got = C.pivot_clusters(vectors_of(spark, few), dims=4, k=16).collect()
    assert sorted((repr(x["vec_id"]), *list(x)[1:-1]) for x in got) == clusters_by_full_comparison(few, 16, 3, 64)
    for none in (vectors_of(spark, few).limit(0), vectors_of(spark, [(1, None), (2, [1.0])])):
        out = C.pivot_clusters(none, dims=4)
        assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"]


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(4)
    for spread in (1, 50, 10**6, 1 << 26):
        rows, points = rng.integers(-spread, spread + 1, (500, 8)), rng.integers(-spread, spread + 1, (12, 8))
        pivots = C.spread_pivots(points, 5)
        near = np.stack([C.squared(rows, p) for p in pivots], axis=1)
        cluster, best, computed = C.nearest(rows, near, points, pivots)
        full = np.stack([C.squared(rows, p) for p in points], axis=1)
        assert (best == full.min(axis=1)).all() and (cluster == full.argmin(axis=1)).all() and (computed >= 1).all() and (computed <= 12).all()
