import random

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as entry
from churnkit.llm import common as C
from churnkit.llm import queries
from tests.llm import cases
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_simhash import plain as plain_simhash
from tests.llm.test_tokens_and_packing import check_places, pieces


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with toxic documents, leaks, copies, repeated lines and awkward cases."""
    at = tmp_path_factory.mktemp("corpus")
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows = [(i, f"{' '.join(rng.choice(vocabulary) for _ in range(rng.randint(30, 90)))}", "en", "s", 0) for i in range(300)]
    for i in range(0, 300, 6):
        rows[i] = (i, rows[i][1] + " zorgwit quexat" + rng.choice(["", "s", "ig"]), "en", "s", 0)
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(25))) for k in range(5)]
    for i in range(1, 300, 20):
        rows[i] = (i, rows[i][1] + " " + items[i % 5][1], "en", "s", 0)
    rows += [(1000 + r[0] if r[0] is not None else None, *r[1:]) for r in cases.documents()]
    spark.createDataFrame(rows, cases.SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stage_by_stage_against_plain_versions(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    docs = C.table(spark, folder, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, C.stage(stage(spark, docs, folder), "test")
        seen[name] = before, docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    gone = ids(seen["toxicity"][0]) - ids(seen["toxicity"][1])
    toxic = {i for i in range(0, 300, 6)}
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 6

    before, after = seen["line_dedup"]
    want = plain_lines([tuple(r) for r in before.collect()])
    assert cases.rows(after.select("doc_id", "text")) == sorted([(d, t) for d, t, *_ in want], key=str)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after.collect())

    before, after = seen["near_duplicates"]
    want = {c for d, _, c in plain_simhash([tuple(r) for r in before.collect()]) if d is not None}
    assert sorted(r["doc_id"] for r in after.collect() if r["doc_id"] is not None) == sorted(want)

    before, after = seen["decontamination"]
    items = [r["text"] for r in C.table(spark, folder, "benchmark").collect()]
    leaking = {r["doc_id"] for r in before.collect() if any(x in (r["text"] or "") for x in items)}
    assert leaking and ids(before) - ids(after) == leaking

    before, after = seen["packing"]
    rows = after.collect()
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(
        [(r["doc_id"], *p) for r in before.collect() for p in pieces(r["text"])], key=str)
    tokens = sum(r["length"] for r in rows)
    assert check_places(rows, 1024) <= 1.02 * tokens / 1024 + 2


def test_run_is_its_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(out.columns) and out.count() > 100


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir).select(*rel.columns)
    assert cases.rows(got) == sorted(rel.fetchall(), key=str)


def test_every_operator_is_registered():
    names = entry.queries().keys()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
