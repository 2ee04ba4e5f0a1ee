from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    try:
        return spark.read.parquet(f"{DATA}/documents.parquet")
    except Exception:  # noqa: BLE001
        pytest.skip("no test data")


def test_stages_keep_columns_and_only_drop_rows(spark, documents):
    from crawlgrain.llm import decontaminate, near_copies
    from crawlgrain.llm.cluster import written

    docs, ids = documents, {x.doc_id for x in documents.collect()}
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, DATA))
        assert docs.columns == documents.columns
        now = {x.doc_id for x in docs.collect()}
        assert now <= ids and len(now) == docs.count() > 0.5 * len(ids)
        if name == "pii":
            assert now == ids
        ids = now
    assert decontaminate.contaminated(docs, benchmark).count() == 0
    assert near_copies.one_of_each(docs).count() >= docs.count() - 2  # pseudonyms may bring two texts together
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {x.doc_id for x in packed} == ids


def test_run_is_the_stages_in_a_row(spark, documents):
    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and {x.doc_id for x in rows} <= {x.doc_id for x in documents.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "packing"]


def test_against_slow_stages(spark, documents):
    """Every stage by a plain way of doing it, one after the other; the last by its tokens."""
    import zlib

    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    from crawlgrain.llm import packing, pii, toxicity
    from crawlgrain.llm.queries import OPEN_KEY
    from tests.llm.test_decontaminate import tiling, tokens
    from tests.llm.test_near_copies import greedy

    rows = sorted((x.doc_id, x.text) for x in documents.collect())
    model = toxicity.fit(documents, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [(i, t) for i, t in rows if model.exceed(model.scores(pa.array([t])))[0, 0] < toxicity.CUT]
    gone = greedy(rows)
    rows = [(i, t) for i, t in rows if i not in gone]
    items = [tokens(x.text) for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def holds(text):
        words = tokens(text)
        runs = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for item in items:
            near = [k for k in range(len(item) - 4) if tuple(item[k : k + 5]) in runs]
            if len({k + j for k in near for j in range(5)}) >= 0.6 * len(item):
                some = sorted({p for p in range(len(words) - 4) if tuple(words[p : p + 5]) in {tuple(item[k : k + 5]) for k in near}})
                part = words[max(0, some[0] - 5) : some[-1] + 10]
                if len(part) > 2000 or sum(n for _, _, n in tiling(part, item, 5)) >= 0.6 * len(item):
                    return True
        return False

    rows = [(i, t) for i, t in rows if not holds(t)]
    texts = {x.doc_id: x.text for x in pii.pseudonymise(documents, OPEN_KEY).collect()}
    encode = Tokenizer.from_file(packing.tokenizer_path()).encode
    want = {i: [*encode(texts[i] or "", add_special_tokens=False).ids, 1] for i, _ in rows}
    got: dict[int, int] = {}
    for x in corpus_pipeline.run(spark, DATA).collect():
        ids = np.array(want[x.doc_id][x.start : x.start + x.length], dtype="<u4")
        assert len(ids) == x.length and zlib.crc32(ids.tobytes()) == x.ids_crc32 and x.doc_tokens == len(want[x.doc_id])
        got[x.doc_id] = got.get(x.doc_id, 0) + x.length
    assert got == {i: len(ids) for i, ids in want.items()}


def test_stages_bear_empty_tables_and_nulls(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "words of a text", None, None, 15), (3, "words of a text", None, None, 15)]
    for name, table in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], table).write.parquet(str(tmp_path / f"{name}.parquet"))
    for docs, n in ((spark.createDataFrame(rows, schema), 3), (spark.createDataFrame([], schema), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
        assert docs.count() == n
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0) == (n > 0)
