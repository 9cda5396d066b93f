"""Every pipeline stage against brute force on its own input."""

import corpus_pipeline as P
import numpy as np
from compostat.llm import bpe
from compostat.llm import queries as Q
from test_llm_ops import SF, brute_components, brute_contamination, brute_fingerprint, brute_lines, tokens


def test_stages(spark, tmp_path):
    docs = Q.table(spark, SF, "documents").withColumnRenamed("nothing", "nothing")
    seen = []
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        seen.append((name, docs.toPandas(), out.toPandas()))
        if k < len(P.STAGES) - 1:
            assert out.columns == P.COLUMNS
        docs = out
    (_, raw, spoken), (_, _, lined), (_, _, single), (_, _, clean), (_, _, coded) = seen
    gone = raw[~raw.doc_id.isin(spoken.doc_id)]
    assert len(gone) <= 0.02 * len(raw) and spoken.merge(raw, on=list(raw.columns)).shape[0] == len(spoken)
    want = {r[0]: r[3] for r in brute_lines(list(zip(spoken.doc_id, spoken.text, strict=True)))}
    assert dict(zip(lined.doc_id, lined.text, strict=True)) == want
    assert all(lined.text.map(len) == lined.n_chars)
    comps = brute_components([(int(i), brute_fingerprint(t)) for i, t in zip(lined.doc_id, lined.text, strict=True)])
    assert sorted(single.doc_id) == sorted({c for _, _, c in comps})
    bench = Q.table(spark, SF, "benchmark").toPandas()
    bad = {r[0] for r in brute_contamination(list(zip(single.doc_id, single.text, strict=True)), list(zip(bench.item_id, bench.text, strict=True))) if r[5]}
    assert set(clean.doc_id) == set(single.doc_id) - bad
    texts = dict(zip(clean.doc_id, clean.text, strict=True))
    assert sorted(coded.doc_id) == sorted(texts)
    for i, ids in zip(coded.doc_id, coded.ids, strict=True):
        assert bytes(ids) == tokens(texts[i]).tobytes()
        assert bpe.coder(Q.ranks(), Q.pattern()).decode(np.frombuffer(bytes(ids), "<u4")) == texts[i].encode()


def test_stages_on_odd_and_empty_rows(spark, tmp_path):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, "The same words of a text here", "en", "s", 1, 3), (2, "The same words of a text here", "en", "s", 1, 3), (3, "Other words for a test", "de", None, None, 4)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int")
    for n, docs in enumerate((odd, odd.limit(0))):
        for k, (_, stage) in enumerate(P.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{n}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
        assert sorted(r["doc_id"] for r in docs.collect()) == ([2, 2, 3] if n == 0 else [])
