"""Stateless claim operators on a streaming DataFrame give the batch result."""

import os
import tempfile

from ledgerlens.streaming import claims_stream as CS


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="ll-stream-")
    src = os.path.join(base, "in")
    docs = spark.createDataFrame(
        [(1, "Revenue increased by 20% in 2023. Nothing here.", "en", "s", 10),
         (2, "Costs declined by 5% in Q3.\nProfit grew by 35%.", "en", "s", 10),
         (3, "No claims at all in this one.", "en", "s", 10)], CS.DOC_SCHEMA)
    docs.repartition(3).write.parquet(src)
    q = CS.start(CS.claim_candidates(CS.document_stream(spark, src)),
                 os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(os.path.join(base, "out")).collect())
    want = sorted(tuple(r) for r in CS.claim_candidates(docs).collect())
    assert got == want
    assert len(got) == 3
