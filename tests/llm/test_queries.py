"""The registered queries on the smallest tables: SQL where there is some, and the pipeline stage by stage."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import packing, registry, store
from millrace.llm.common import table, written
from millrace.llm.decontam import contained_items
from millrace.llm.mixing import mixing_weights
from millrace.llm.near_dup import near_duplicates
from millrace.llm.quality import quality_rules

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no driver tables")


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got = registry.QUERIES[name](spark, str(SF)).toPandas()
    want = con.execute(registry.ORACLES[name]).df()[list(got.columns)]

    def clean(df):
        whole = df.astype(object).where(df.notna(), None)
        plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
        return sorted(repr(tuple(plain(v.item() if hasattr(v, "item") else v) for v in r)) for r in whole.itertuples(index=False, name=None))

    assert clean(got) == clean(want)


def test_pipeline_stages(spark):
    docs = table(spark, str(SF), "documents")
    checks = [
        lambda d: {r.doc_id for r in quality_rules(d).where("kept").collect()},
        lambda d: {r.doc_id for r in near_duplicates(d, 5).where("kept").collect()},
        lambda d: {r.doc_id for r in d.collect()} - {r.doc_id for r in contained_items(d, table(spark, str(SF), "benchmark")).collect()},
        lambda d: {r.doc_id for r in mixing_weights(d).where("kept").collect()},
    ]
    columns = docs.columns
    for (name, stage), check in zip(corpus_pipeline.STAGES, checks, strict=False):
        want = check(docs)
        docs = written(stage(spark, docs, str(SF)), name)
        assert docs.columns == columns and {r.doc_id for r in docs.collect()} == want
    packed = corpus_pipeline.STAGES[4][1](spark, docs, str(SF))
    ids = [p.doc_id for r in packed.collect() for p in r.pieces if p.piece == 0]
    assert sorted(ids) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_leaves_only_its_stages(spark):
    from millrace.llm.common import made

    before = len(made)
    out = corpus_pipeline.run(spark, str(SF))
    assert [m.rsplit("/", 1)[1].rsplit("-", 1)[0] for m in made[before:]] == [name for name, _ in corpus_pipeline.STAGES[:-1]]
    assert out.count() > 0


def test_pipeline_writes_its_shards(spark, docs):
    rows = [(i, "some words of a text " * (1 + i * 37 % 900)) for i in range(60)] + [(100, ""), (101, None)]
    out = corpus_pipeline.packing_stage(spark, docs(rows).repartition(3, "doc_id"), str(SF)).collect()
    with store.Reader(packing.VOCABULARY) as f:
        encode = packing.encoder(f.read(0, f.size)).encode_ordinary
    held, shards = {}, {}
    assert sorted(p.doc_id for r in out if r.shard is None for p in r.pieces) == [100, 101]
    for r in out:
        if r.shard is None:
            continue
        ids, positions, cu, splits = shards.setdefault(r.shard, packing.matrix(spark, r.shard))
        assert ids.shape[1] == packing.LENGTH
        own = cu[splits[r.row] : splits[r.row + 1]].tolist()
        assert own == [*(p.offset for p in r.pieces), r.pieces[-1].offset + r.pieces[-1].length]
        assert (ids[r.row, own[-1] :] == packing.END_ID).all()
        for p in r.pieces:
            at = slice(p.offset, p.offset + p.length)
            assert positions[r.row, at].tolist() == list(range(p.length))
            held.setdefault(p.doc_id, []).append((p.start, ids[r.row, at].tolist()))
    assert sum(len(s[0]) for s in shards.values()) == sum(r.shard is not None for r in out)
    for doc_id, text in rows[:60]:
        assert [i for _, part in sorted(held[doc_id]) for i in part] == [*encode(text), packing.END_ID]
