import corpus_pipeline
import pytest
from gaugeworks.llm.catalog import LLM_QUERIES

from .conftest import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with junk, copies, shared passages, benchmark passages and clean text."""
    place = str(tmp_path_factory.mktemp("corpus"))
    passage, item = prose(900, 60), prose(901, 40)
    rows = [(k, prose(k, 150), "en", f"s{k % 4}") for k in range(300)]
    rows += [(1000 + k, " ".join(w.upper() + "!!" for w in prose(k, 80).split()), "en", "s1") for k in range(20)]
    rows += [(2000 + k, f"{prose(2000 + k, 80)} {passage} {prose(3000 + k, 60)}", "en", "s2") for k in range(10)]
    near = prose(4000, 200).split()
    rows += [(4000 + k, " ".join(near[:30 + k] + ["dil"] + near[31 + k:]), "en", "s3") for k in range(4)]
    rows += [(5000 + k, f"{prose(5000 + k, 50)} {item} {prose(6000 + k, 50)}", "en", "s0") for k in range(5)]
    rows += [(7000, None, "en", "s0"), (7001, "", None, None), (None, prose(7, 90), "en", "s0")]
    full = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        f"{place}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(250)], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{place}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{place}/benchmark.parquet")
    return place, passage, item


def test_stages(spark, folder):
    place, passage, item = folder
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{place}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialised(stage(spark, docs, place))
        if name != "packing":
            assert docs.columns == columns, name
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not any(k in seen["quality"] for k in range(1000, 1020))
    assert sum(k in seen["quality"] for k in range(300)) >= 290
    lines = seen["line_dedup"]
    assert passage in lines[2000] and not any(passage in lines[k] for k in range(2001, 2010))
    # line dedup has taken what the near copies share; the stage for itself is tested with near_copies
    near = seen["near_duplicates"]
    assert 4000 in near and all(len(near.get(k) or "") < len(near[4000]) / 2 for k in range(4001, 4004))
    assert not any(item in (t or "") for t in seen["decontamination"].values())
    assert sum(k in seen["decontamination"] for k in range(300)) >= 290
    packed = docs.collect()
    assert {r.doc_id for r in packed} == seen["decontamination"].keys()


def test_run_and_registration(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 300
    names = [n for n in LLM_QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in LLM_QUERIES


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, folder, name):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder[0])
    assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
