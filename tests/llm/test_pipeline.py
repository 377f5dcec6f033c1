"""The pipeline against its stages done by hand, and the registered queries against DuckDB."""

import math
import re
from pathlib import Path

import pyarrow as pa
import pytest
import sentencepiece
from textloom.llm import common, language_id, mixing, queries, sentencepieces, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(shown, r)) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall())


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    predicted = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    want = [i for i in rows if predicted[i]["lang_pred"] != "und" and predicted[i]["likeness"] >= language_id.LEAST_LIKENESS]
    norm = lambda i: re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]["text"])
    first = {}
    for i in sorted(want):
        first.setdefault(norm(i), i)
    want = sorted(first.values())
    prints = {i: simhash.fingerprint(rows[i]["text"].encode()) for i in want}
    root = {i: i for i in want}

    def find(i):
        return i if root[i] == i else find(root[i])

    for k, a in enumerate(want):
        for b in want[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = [i for i in want if find(i) == i]
    left = spark.createDataFrame([tuple(rows[i].values()) for i in want], docs.schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(left).collect()}
    got = corpus_pipeline.run(spark, str(SF)).collect()
    count = {}
    for r in got:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
        assert r["round_trip"]
    assert count == {i: n for i, n in copies.items() if n} and len(want) > 150
    # ids are the library's, in the order of the mix
    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.model_path())
    mixed = [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["mixing"](spark, left, str(SF)).collect()]
    got.sort(key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(len(mixed))) and [r["doc_id"] for r in got] == mixed
    assert all(r["ids"] == lib.encode(rows[r["doc_id"]]["text"]) for r in got[::17])


def test_mix_follows_the_curriculum(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    rows = mixing.assign(docs, phases=mixing.CURRICULUM).collect()
    flat = mixing.assign(docs).collect()
    assert sorted((r["doc_id"], r["taken"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["taken"], r["copies"]) for r in flat)
    order = lambda rows: [i for _, i in sorted((p, r["doc_id"]) for r in rows for p in r["positions"])]
    staged = [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, str(SF)).collect()]
    assert staged == order(rows) != order(flat)
    # op8 returns its rows in training order, those that nothing is taken of last
    first = lambda rows: [i for _, i in sorted((r["position"], r["doc_id"]) for r in rows if r["taken"])]
    got = [r["doc_id"] for r in queries.QUERIES["op8_mixing"](spark, str(SF)).collect() if r["taken"]]
    assert got == first(rows) != first(flat)
    # the first source is ahead of a constant schedule, the third behind it
    sources = sorted({r["source"] for r in rows})
    mean = lambda rows, s: (lambda p: sum(p) / len(p))([p for r in rows if r["source"] == s for p in r["positions"]])
    assert mean(rows, sources[0]) < mean(flat, sources[0]) and mean(rows, sources[2]) > mean(flat, sources[2])


def test_stages_return_documents(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(SF))
        assert out.schema.names == docs.schema.names and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(SF)).count() == 0


def test_stages_take_odd_rows(spark):
    """Null ids, texts, languages and sources, repeated rows, ties, long texts and further columns."""
    base = "the people of this town and their old houses were what they had always thought about".split()
    text = lambda k: " ".join(base[(k * j + j) % len(base)] for j in range(40 + k))
    rows = [(k, text(k), "en", "ab"[k % 2]) for k in range(1, 40)]
    rows += [(None, text(50), "en", "a"), (60, None, "en", "a"), (61, "", None, None), (62, text(62), None, None), (62, text(62), None, None), (63, text(5), "en", "b"), (64, text(64) + " end" * 50_000, "en", "b"), (65, " \n 12 %", "en", "b")]
    docs = spark.createDataFrame([(*r, None, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row long, kept long")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_row", "kept"]
        seen.append(sorted((r["doc_id"] or 0 for r in docs.collect())))
    assert seen[0] == sorted(r[0] or 0 for r in rows if r[0] not in (60, 61, 65))
    assert seen[1] == sorted({r[0] or 0 for r in rows if r[0] not in (60, 61, 65, 63)})
    assert 64 in seen[2] and set(seen[2]) <= set(seen[1]) and set(seen[3]) <= set(seen[2])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(SF)).collect()
    assert sorted(r["position"] for r in out) == list(range(len(seen[3]))) and all(r["round_trip"] for r in out)


def test_workers_drop_other_operators_caches(spark):
    """Python workers are used again by later stages; an encoder stays only until they run tasks of another operator."""

    def told(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(sentencepieces._ENCODERS)]})

    kept = lambda: {r["n"] for r in spark.range(0, 8, 1, 8).mapInArrow(told, "n long").collect()}
    docs = spark.range(0, 80, 1, 8).selectExpr("id doc_id", "concat('some words ', id) text")
    sentencepieces.encode_documents(docs).collect()
    assert 1 in kept()
    simhash.fingerprints(docs).collect()
    assert kept() == {0}


def test_workers_give_memory_back(monkeypatch):
    """After each batch and at the end, also if the rest of the rows isn't asked for; the rows are the function's own."""
    times = []
    monkeypatch.setattr(common, "give_back", lambda: times.append(1))
    twice = common.lean(lambda batches: (2 * b for b in batches))
    assert list(twice(iter([1, 2, 3]))) == [2, 4, 6] and len(times) == 4
    some = twice(iter([1, 2, 3]))
    assert next(some) == 2
    some.close()
    assert len(times) == 5
