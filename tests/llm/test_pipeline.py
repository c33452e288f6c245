import os

import duckdb
import pytest

import corpus_pipeline
from terrane.llm import mixing, packing, quality, registry, secrets

from . import data
from .test_dedup import brute

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def awkward(spark, folder):
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    copies = [(100 + k, t, "en", "src0", 1) + (None,) * 7 for k, t in enumerate(data.texts()) if t]
    spark.createDataFrame(data.rows() + copies, data.SCHEMA).select(*own).write.parquet(f"{folder}/documents.parquet")
    return own


def test_stages_against_plain_python(spark, tmp_path):
    folder = f"file://{tmp_path}"
    own = awkward(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "secret scan", "source mixing", "best-fit packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, folder)
        if name != "best-fit packing":
            assert out.columns == own
        out.write.parquet(f"{folder}/out{k}")
        verdict = quality.judge(docs).collect() if name == "quality rules" else None
        live = secrets.scan(docs).where("n_live > 0").count() if name == "secret scan" else None
        docs = spark.read.parquet(f"{folder}/out{k}")
        after = docs.collect()
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in after)
        if name == "quality rules":
            assert ids == sorted((r.doc_id is None, r.doc_id or 0) for r in verdict if r.kept)
        elif name == "MinHash near-dedup":
            roots = brute([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
            want = {d for d, c in roots.items() if d == c}
            assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(want)
            assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)
        elif name == "secret scan":
            assert len(after) == len(before) and sum("[SECRET]" in (r.text or "") for r in after) == live > 0
        elif name == "source mixing":
            assert sorted(map(str, after)) == sorted(map(str, before))
            at = {r.doc_id: r.mix_position for r in mixing.mix(spark.createDataFrame(before, docs.schema), registry.TARGETS, 100, 8).collect()}
            order = [at[r.doc_id] for r in out.collect()]
            assert order == sorted(order)
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(registry.tokenizer("byte_bpe_50k.json"))
            assert sum(r.length for r in after) == sum(len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, corpus_pipeline.run(spark, folder).select(*key).collect())) == sorted(map(str, docs.select(*key).collect()))


def test_sequences_follow_the_mixture(spark, tmp_path):
    docs = spark.range(600).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, cast(id % 7 * 90 + (id * 37) % 50 as int)), x -> concat('w', x * (id + 3)))) AS text", "'en' AS lang", "concat('src', id % 20) AS source")
    mixed = corpus_pipeline.source_mixing(spark, docs, "")
    mixed.write.parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.best_fit_packing(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    at = {r.doc_id: r.mix_position for r in mixing.mix(docs, registry.TARGETS, 100, 8).collect()}
    first, by_length, held = {}, {}, {}
    for r in out:
        first[r.sequence_id] = min(first.get(r.sequence_id, (1 << 62, 0)), (at[r.doc_id], r.piece))
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert [first[k] for k in range(len(first))] == sorted(first.values()) and {r.doc_id for r in out} == set(range(600))
    for parts in held.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    plain = packing.pack(docs, registry.tokenizer("byte_bpe_50k.json"), 1024, 2).collect()
    assert len({r.sequence_id for r in plain}) == len(first) and {tuple(r)[:5] for r in plain} == {tuple(r)[:5] for r in out}


def test_empty_documents(spark, tmp_path):
    data.empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_each_operator_has_its_query():
    names = list(registry.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert got == sorted(tuple(str(v) for v in r) for r in con.sql(f"SELECT {quoted} FROM ({registry.oracle_sql()[name]})").fetchall())
