"""Ties between more documents than a search keeps."""

from textquarry.operators import vector


def test_tied_documents_and_chunks(spark):
    rows = [(chunk, chunk // 2, [1.0, 0.0]) for chunk in range(199, -1, -1)] + [(500, 900, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "chunk_key long, doc_key long, embedding array<float>")
    for parts in (1, 3):
        for metric in ("l2", "cosine"):
            got = vector.nearest(frame.coalesce(1) if parts == 1 else frame.repartition(parts), [(0, [1.0, 0.0]), (1, [0.0, 1.0])], 4, metric).orderBy("query_id", "rank").collect()
            assert [(r["query_id"], r["doc_key"], r["chunk_key"]) for r in got] == [(0, k, 2 * k) for k in range(4)] + [(1, 900, 500)] + [(1, k, 2 * k) for k in range(3)]
