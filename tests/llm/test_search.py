"""Lexical search, WARC archives and annulus clustering against DuckDB, plain Python and broken input."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import annulus, lexical, warc


def shown(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(str(tuple(None if str(x) in ("nan", "<NA>", "None") else str(x) if isinstance(x, str) else int(x) for x in r)) for r in df.itertuples(index=False, name=None))


def duck(path, table, sql, *more):
    c = duckdb.connect()
    for t in (table, *more):
        c.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    return c.execute(sql).df()


LONG = " ".join(f"word{i % 89} Ünï{i % 7}" for i in range(20_000))


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    path, rnd = str(tmp_path_factory.mktemp("lexical")), random.Random(3)
    vocab = [f"t{i}" for i in range(60)] + ["É", "naïve", "日本", "x1"]
    docs = [(i, " ".join(rnd.choice(vocab[: rnd.randint(1, 64)]).upper() for _ in range(rnd.randint(0, 60))), 7) for i in range(400)]
    docs += [(1000, None, 1), (1001, "", 1), (1002, "--- !!", 1), (1003, LONG, 1), (None, "T1 t2 naïve", 1), (5, "T1 t2 naïve", 1), (5, "T1 t2 naïve", 1), (6, "same words here", 1), (4, "same words here", 1)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 12))), 1) for i in range(30)]
    items += [(100, None, 1), (101, "", 1), (102, "same HERE", 1), (103, "absent", 1), (None, "t1 T1 É", 1), (3, "more words: word1,Ünï3", 1), (104, "É é", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, rank int").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string, score int").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/none/benchmark.parquet")
    return path


def test_lexical_against_duckdb(spark, texts):
    got = lexical.op11_lexical(spark, texts).toPandas()
    assert shown(got) == shown(duck(texts, "documents", lexical.SQL, "benchmark"))
    assert list(got[got.item_id == 102].sort_values("rank").doc_id)[:2] == [4, 6]
    assert got.isna().any().item_id  # the item without an id is ranked
    items, docs = (spark.read.parquet(f"{texts}/{t}.parquet") for t in ("benchmark", "documents"))
    assert lexical.op11_lexical(spark, f"{texts}/none").count() == 0
    assert lexical.search(docs.limit(0), items).count() == lexical.search(docs, items.limit(0)).count() == 0


def test_lexical_in_blocks(spark, texts, monkeypatch):
    whole = shown(lexical.op11_lexical(spark, texts).toPandas())
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 900)
    held = []
    real = lexical._ranked
    monkeypatch.setattr(lexical, "_ranked", lambda *a: held.append(len(a[2])) or real(*a))
    assert shown(lexical.op11_lexical(spark, texts).toPandas()) == whole and len(held) > 3


def test_lexical_against_plain_python(spark, texts):
    docs = [r for r in spark.read.parquet(f"{texts}/documents.parquet").collect()]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    bags = [(r.doc_id, Counter(words(r.text))) for r in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    got = lexical.search(spark.read.parquet(f"{texts}/documents.parquet"), spark.createDataFrame([(1, "T1 t2 naïve ünï3 É")], "item_id long, text string"), k=25).orderBy("rank").collect()
    scores = []
    for d, b in bags:
        m = 10 + 90 * sum(b.values()) * n // total
        s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(words("T1 t2 naïve ünï3 É")) if b[t])
        scores.append((-s, d is None, d or 0))
    want = [(-s, None if none else d) for s, none, d in sorted(scores)[:25] if s < 0]
    assert [(r.score, r.doc_id) for r in got] == want and [r["rank"] for r in got] == list(range(1, len(want) + 1))


def test_terms_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    for text in ("", "a", "Alpha beta,GAMMA-beta " * 30, "x" * 50, " - ", "no break then end", "日本 É é" * 9):
        want = Counter(x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)))
        assert lexical.terms(text.encode()) == want


def test_sums_of_sorted_keys():
    rng = np.random.default_rng(1)
    for top in (10, 70_000, 1 << 40):
        keys, values = rng.integers(0, top, 5000), rng.integers(-9, 9, 5000)
        k, s = lexical.summed(keys, values)
        want, at = np.unique(keys, return_inverse=True)
        assert np.array_equal(k, want) and np.array_equal(s, np.bincount(at, values).astype(int))
        assert np.array_equal(lexical.sorted_order(keys), np.argsort(keys, kind="stable"))
    assert len(lexical.summed(keys[:0], values[:0])[0]) == 0


def test_heaps_keep_the_best():
    rnd = random.Random(2)
    best, rows = lexical.Best(5), []
    for _ in range(40):
        ids, scores = [rnd.choice([None, *range(30)]) for _ in range(9)], np.array([rnd.randint(0, 12) for _ in range(9)])
        best.offer(3, ids, np.arange(9), scores)
        rows += [(int(s), d) for d, s in zip(ids, scores) if s > 0]
    rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    assert best.rows() == [(3, d, s) for s, d in rows[:5]]


PAGES = [
    (1, "http://a/1", "<p>one</p>", 5), (2, "http://a/2", "<p>one</p>", 5), (9, "http://a/9\r\nX: y", "<p>one</p>", 5), (3, None, None, 5), (4, "é", "", 5), (5, "http://a/5", "Ü" * 300_000, 5),
    (6, "http://a/6", "".join(chr(32 + i * 7919 % 90) for i in range(500_000)), 5), (None, "http://n", "no id", 5), (None, "http://n", "no id", 5), (7, "u", "\r\n\r\nHTTP/1.1\r\n", 5), (8, "u", "same", 5), (8, "u", "same", 5), (8, "u", "other", 5),
]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string, payload int").repartition(3).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/none/pages.parquet")
    return path


def test_warc_against_duckdb(spark, pages):
    got = warc.op12_warc(spark, pages).toPandas()
    assert shown(got) == shown(duck(pages, "pages", warc.SQL))
    assert warc.op12_warc(spark, f"{pages}/none").count() == 0


def test_warc_round_trip(spark, pages, tmp_path):
    table = spark.read.parquet(f"{pages}/pages.parquet")
    archives = warc.write_warc(table, str(tmp_path), archive_bytes=2000, least=8)
    paths = [r.path for r in archives.collect()]
    assert len(paths) > 3 and sum(r.records for r in archives.collect()) == len(PAGES)
    rows = warc.read_warc(spark, archives).collect()
    assert len(rows) == len(PAGES) and all(r.error is None for r in rows) and len({r.record_id for r in rows}) == len(PAGES)
    by_id = {r.record_id: r for r in rows}
    for r in rows:
        full = by_id[r.refers_to] if r.record_type == "revisit" else r
        assert full.payload_digest == r.payload_digest == base64.b32encode(hashlib.sha1(full.payload).digest()).decode() and len(full.payload) == r.payload_bytes
    assert sorted(bytes(r.payload) for r in rows if r.payload is not None) == sorted([(h or "").encode() for _, _, h, _ in PAGES if h != "<p>one</p>"] + [b"<p>one</p>"])
    # any gzip reader sees the records, one a member
    whole = b"".join(gzip.decompress(open(p, "rb").read()) for p in paths)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(PAGES) and b"http://a/9%0D%0AX:%20y" in whole
    bare = warc.read_warc(spark, archives, payload=False)
    assert bare.filter("payload is not null").count() == 0 and bare.agg(F.sum("payload_bytes")).first()[0] == sum(len((h or "").encode()) for _, _, h, _ in PAGES)


def member(i, payload=b"text"):
    return warc.encoded("response", f"urn:page:{i}:x", "http://x", warc.DATE, payload, base64.b32encode(hashlib.sha1(payload).digest()).decode())


def plain(**changes):
    """An uncompressed record's bytes, with fields changed or dropped."""
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\ntext"
    f = {"WARC-Type": "response", "WARC-Record-ID": "<urn:a>", "Content-Type": "application/http", "Content-Length": str(len(block))} | changes
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in f.items() if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_reader_of_broken_archives(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    monkeypatch.setattr(warc, "INFLATE_BYTES", 11)
    good, z = [member(i, b"payload %d " % i * 50) for i in range(4)], gzip.compress
    read = lambda data: list(warc.records(io.BytesIO(data)))
    rows = read(b"".join(good))
    assert [r["number"] for r in rows] == [0, 1, 2, 3] and [r["offset"] for r in rows] == [0, *np.cumsum([len(g) for g in good])[:-1]] and rows[2]["payload"] == b"payload 2 " * 50
    assert read(b"") == []
    for bad, says in (
        (z(plain(**{"Content-Length": "9"})), "longer"), (z(plain(**{"Content-Length": "900"})), "shorter"), (z(plain(**{"Content-Length": None})), "no Content-Length"), (z(plain(**{"Content-Length": "-1"})), "no Content-Length"),
        (z(plain(**{"WARC-Block-Digest": "sha1:AAAA"})), "block-digest"), (z(plain(**{"WARC-Payload-Digest": "sha1:AAAA"})), "payload-digest"), (z(b"HTTP/1.1 200 OK\r\n\r\n"), "not a WARC"), (z(b"WARC/1.1\r\nno end"), "no end"), (z(b""), "no end"),
        (z(plain() + plain()), "longer"),
    ):
        got = read(good[0] + bad + good[1])
        assert len(got) == 3 and says in got[1]["error"] and got[2]["error"] is None, says
    assert read(z(plain()))[0]["payload"] == b"text" and read(z(plain(**{"WARC-Payload-Digest": "md5:x"})))[0]["error"] is None
    cut = read(good[0] + good[1][:-9])
    assert cut[0]["error"] is None and "ends within" in cut[1]["error"] and len(cut) == 2
    assert "gzip" in read(good[0] + b"rubbish" + good[1])[1]["error"]
    flipped = bytearray(good[1])
    flipped[len(flipped) // 2] ^= 255
    assert read(good[0] + bytes(flipped))[1]["error"]
    folded = read(z(plain(**{"WARC-Target-URI": "http://a\r\n  b"})))
    assert folded[0]["target_uri"] == "http://a b"


def test_reader_of_missing_archives(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(member(1) + member(2))
    rows = warc.read_warc(spark, spark.createDataFrame([(f"{tmp_path}/a.warc.gz",), (f"file://{tmp_path}/none.warc.gz",), (None,)], "path string")).collect()
    assert len(rows) == 3 and sum(r.error is None for r in rows) == 2


def vectors(rng):
    v = np.concatenate([rng.standard_normal((20, 64))[np.arange(380) % 20] * np.linspace(0.1, 4, 380)[:, None] + 0.05 * rng.standard_normal((380, 64)), np.zeros((3, 64)), np.full((4, 64), 0.5)])
    rows = [(i, [float(x) for x in a], 1) for i, a in enumerate(v)]
    odd = [(900, None, 1), (901, [1.0] * 63, 1), (902, [1.0] * 65, 1), (903, [None] + [1.0] * 63, 1), (904, [float("nan")] + [1.0] * 63, 1), (905, [float("-inf")] + [1.0] * 63, 1), (906, [], 1)]
    return [*rows, *odd, (5, rows[5][1], 1), (5, rows[5][1], 1)]


def test_annulus_against_duckdb_and_plain_python(spark, tmp_path):
    rows = vectors(np.random.default_rng(2))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int").repartition(5)
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = annulus.op13_annulus(spark, str(tmp_path)).toPandas()
    assert shown(got) == shown(duck(tmp_path, "embeddings", annulus.SQL))
    assert sorted(zip(got.vec_id, got.cluster, got.distance)) == plain_clusters([r[:2] for r in rows])
    # rows of one id with different vectors: seeds go by the vectors, too
    more = [*rows, (5, rows[9][1], 1), (7, rows[30][1], 1)]
    got = annulus.cluster(spark.createDataFrame(more, "vec_id long, embedding array<double>, cluster int")).toPandas()
    assert sorted(zip(got.vec_id, got.cluster, got.distance)) == plain_clusters([r[:2] for r in more])


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    cs = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        groups = [[x for (_, x), o in zip(kept, own) if o == j] for j in range(len(cs))]
        cs = [[sum(c) // len(g) for c in zip(*g)] if g else cs[j] for j, g in enumerate(groups)]
    return sorted((i, near(x)[1], near(x)[0]) for i, x in kept)


def test_annulus_few_and_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, distance int"
    few = spark.createDataFrame([(i, [float(i % 3)] * 64, 1) for i in range(7)] + [(None, [9.0] * 64, 1)], schema)
    got = annulus.cluster(few).toPandas()
    assert len(got) == 8 and got.distance[got.vec_id.notna()].sum() == 0 and got.inertia.nunique() == 1 and got.vec_id.isna().sum() == 1
    assert annulus.cluster(few.limit(0)).count() == annulus.cluster(few.filter("vec_id is null")).count() == 0
    far = spark.createDataFrame([(1, [1e38] * 64, 1), (2, [3.0] * 64, 1), (3, [500_000.0] * 64, 1)], schema)
    got = annulus.cluster(far).toPandas()
    assert sorted(got.vec_id) == [2, 3] and (got.distance == 0).all()


def test_nearest_against_all_distances():
    """Ties, equal norms, one centroid, components whose products don't fit doubles; and fewer are compared than there are."""
    rng = np.random.default_rng(7)
    for scale, k in ((3, 40), (300, 25), (1 << 26, 17), (50, 1)):
        c = rng.integers(-scale, scale + 1, (k, 8))
        c[k // 2] = c[0]
        x = np.concatenate([rng.integers(-scale, scale + 1, (1500, 8)), c, -c])
        a = annulus.Annulus(c)
        cluster, distance = a.nearest(x)
        every = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert np.array_equal(cluster, every.argmin(axis=1)) and np.array_equal(distance, every.min(axis=1))
    rings = rng.standard_normal((40, 64)) * np.linspace(1, 60, 40)[:, None] * 20
    a = annulus.Annulus(rings.astype(np.int64))
    a.nearest((rings[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 64)) * 5).astype(np.int64))
    assert a.compared < 0.5 * 40 * a.asked
