"""The pipeline's stages against what plain Python makes of the same rows."""

import random
import re

import pytest

import corpus_pipeline
from quire.llm import tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    word = lambda: "w%d" % rnd.randint(0, 5000)
    text = lambda n: ". ".join(" ".join(word() for _ in range(10)) for _ in range(n)) + "."
    out = [(i, text(rnd.randint(8, 20)), "en", "abc"[i % 3], 0, "x") for i in range(60)]
    out += [(60 + i, out[i][1] + " tail", "en", "abc"[i % 3], 0, "x") for i in range(10)]  # near copies
    out += [(80, "short text", "en", "a", 0, "x"), (81, None, "en", "b", 0, "x"), (82, "spam " * 80, "en", "c", 0, "x"), (83, "Home | News | Log in\n" * 30, "en", "c", 0, "x")]
    out += [(84, text(10) + " password = Zx81Qw92Er73Ty64Ui ", "en", None, 0, "x"), (85, text(10) + "\nOne | Two | Three\n" + text(3), "en", "a", 0, "x")]
    return out


def test_stages(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == before
    source = {r[0]: r[1] for r in rows}
    quality = dict(zip(seen["quality"].doc_id, seen["quality"].text))
    assert set(quality) == {*range(70), 84, 85}
    assert all(quality[i] == source[i] for i in range(70)) and "Two" not in quality[85]
    assert set(seen["near_duplicates"].doc_id) == {*range(60), 84, 85}
    secret = dict(zip(seen["secrets"].doc_id, seen["secrets"].text))
    assert "Zx81" not in secret[84] and "[secret]" in secret[84] and secret[3] == source[3]
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = {d: n(t) for d, t in secret.items()}
    mixed = seen["mixing"]
    used = mixed.assign(words=mixed.text.map(n)).groupby("doc_id").words.sum()
    assert all(used[d] <= 2 * sizes[d] for d in used.index)
    total = sum(sizes.values())
    assert abs(used.sum() - 1.5 * total) <= 0.02 * total
    assert all(t == secret[d] or secret[d].split()[: n(t)] == t.split() for d, t in zip(mixed.doc_id, mixed.text))
    packed = seen["packing"]
    c = tokens.counter(tokens.vocabulary_path())
    assert packed.length.sum() == sum(c.count(t) + 1 for t in mixed.text)
    lengths = packed.groupby("sequence_id").length.sum()
    assert (lengths.iloc[:-1] == 4096).all()
    assert corpus_pipeline.run(spark, str(tmp_path)).toPandas().length.sum() == packed.length.sum()


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_and_odd_rows(spark, rows):
    """Columns named like an operator's, repeated and null ids, null texts: every stage passes the columns on as they were."""
    from pyspark.sql import functions as F

    odd = [(5, None, "en", "a", 0, "x"), (None, rows[3][1] + " other end of it", None, None, None, None), (7, rows[7][1], "en", "b", 0, "x"), (7, rows[20][1][:200] * 2, "en", "b", 0, "x"), (None, "", "en", "a", 0, "x")]
    clash = ("n_words", "kept", "size", "target", "secrets", "taken", "cleaned", "print", "h1", "_text", "_doc2", "a.b")
    docs = spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: F.lit(f"mine {c}") for c in clash})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all(r[c] == f"mine {c}" for r in found for c in clash), name
        assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in found) or name == "near_duplicates"
    near = corpus_pipeline.deduplicate(spark, docs, "").collect()
    ids = [r.doc_id for r in near]
    assert ids.count(7) == 2 and set(range(60)) <= set(ids) and not set(range(60, 70)) & set(ids)
    assert sum(r.text is None for r in near) == 2 and sum(r.text == "" for r in near) == 1


def test_quality_is_computed_once(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = corpus_pipeline.clean(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_join") <= 1 + plan.count("cleaned AS cleaned")


def test_very_long_texts(spark, rows, tmp_path):
    """A text of 150,000 words, with a near copy and a secret at its end, goes through whole."""
    rnd = random.Random(5)
    words = [f"w{rnd.randint(0, 90_000)}" for _ in range(150_000)]
    long = "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, len(words), 12))
    more = [(300, f"{long}\nthe token = Zx81Qw92Er73Ty64Ui here", "en", "a", 0, "x"), (301, f"{long}\nand a tail", "en", "b", 0, "x")]
    docs = spark.createDataFrame(rows + more, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            found = [r.text for r in docs.filter("doc_id >= 300").collect()]
            # a text that the mixture cuts has blanks between its words
            assert found and all(t.split()[:500] == long.split()[:500] for t in found)
            if name == "secrets":
                assert found == [f"{long}\nthe [secret] here"]
    c = tokens.counter(tokens.vocabulary_path())
    mixed = [r.text for r in spark.read.parquet(f"{tmp_path}/mixing").filter("doc_id = 300").collect()]
    pieces = docs.filter("doc_id = 300").toPandas()
    assert pieces.length.sum() == sum(c.count(t) + 1 for t in mixed) and pieces.length.max() <= 4096
