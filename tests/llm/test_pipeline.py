"""The pipeline's stages against brute force, one after the other, and run() from a folder."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from cairnlake.llm import quality
from cairnlake.llm.common import cut

from . import fixtures as fx
from .test_operators import brute_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = fx.documents(spark, seed=21, n=80)
    texts = fx.pairs(docs)
    item = " ".join(next(t for d, t in texts if d == 7).replace("\n", " ").split()[:40])
    spark.createDataFrame([(0, item), (1, "never said " * 10)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    verdict = {(r.doc_id): r.kept for r in quality.quality(docs).collect()}
    at = docs
    by_name = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    got = []
    for name in names[:-1]:
        at = cut(by_name[name](spark, at, str(tmp_path)), "test-stage")
        assert at.columns == COLUMNS
        got.append(collections.Counter(fx.pairs(at)))
    want = collections.Counter((d, t) for d, t in texts if verdict[d])
    assert got[0] == want and 10 < sum(want.values()) < len(texts)
    kept = brute_lines(list(want.elements()))
    assert got[1] == collections.Counter((d, "\n".join(k)) for d, _, k in kept)
    after = list(got[1].elements())
    classes = fx.classes(after, 5, 80)
    left = {d for d in set(classes.values())}
    assert {d for d, _ in got[2]} == left | {d for d, _ in after if d is None}
    said = item.lower().split()[:13]
    assert all(" ".join(said) not in " ".join((t or "").lower().split()) for _, t in got[3])
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {d for d, _ in got[3]}
