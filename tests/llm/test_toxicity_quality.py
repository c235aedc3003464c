"""How well toxic documents are told from others, on labels that were held out."""

import zlib

import numpy as np
import pyarrow.parquet as pq

from gleaner.llm import queries


def test_auc_precision_and_recall(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = pq.read_table(f"{sf_dir}/labels.parquet").to_pydict()
    true = {i: y for i, y in zip(labels["doc_id"], labels["toxic"]) if y is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r.doc_id: (r.score, r.predicted) for r in queries.op1_toxicity(spark, sf_dir).collect()}
    rows = [(*got[i], y) for i, y in true.items() if i in got]
    score, predicted, y = (np.array(c, float) for c in zip(*rows))
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n1, n0 = y.sum(), (1 - y).sum()
    auc = (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    precision, recall = (predicted * y).sum() / predicted.sum(), (predicted * y).sum() / n1
    print(f"n {len(y)}, toxic {int(n1)}, auc {auc:.3f}, precision {precision:.3f}, recall {recall:.3f}")
    assert n1 > 50 and auc > 0.93 and precision > 0.9 and recall > 0.55
