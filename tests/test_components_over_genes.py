"""Principal components of samples over genes against numpy's singular values."""

import numpy as np

from helixframe.operators import composite
from helixframe.plans import registry


def by_numpy(rows):
    genes, samples = sorted({g for g, _, _ in rows}), sorted({s for _, s, _ in rows})
    x = np.zeros((len(samples), len(genes)))
    for g, s, v in rows:
        x[samples.index(s), genes.index(g)] += v
    x = np.log1p(x)
    x -= x.mean(axis=0)
    u, d, v = np.linalg.svd(x, full_matrices=False)
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return genes, samples, u * d * sign, v * sign[:, None]


def test_scores_and_loadings(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{rng.integers(0, 300)}", f"s{rng.integers(0, 7)}", int(rng.integers(1, 90))) for _ in range(1500)]
    df = spark.createDataFrame(rows, "gene string, sample string, n long")
    scores, load = composite.sample_components(df, "gene", "sample", "n", 3)
    genes, samples, want_scores, want_load = by_numpy(rows)
    got = {r["sample"]: (r.pc1, r.pc2, r.pc3) for r in scores.collect()}
    assert np.allclose([got[s] for s in samples], want_scores[:, :3], atol=1e-9)
    got = {r.gene: (r.pc1, r.pc2, r.pc3) for r in load.collect()}
    assert len(got) == len(genes) and np.allclose([got[g] for g in genes], want_load[:3].T, atol=1e-9)


def test_one_sample_has_no_components(spark):
    scores, load = composite.sample_components(spark.createDataFrame([("g", "s", 1), ("h", "s", 2)], "gene string, sample string, n long"), "gene", "sample", "n", 2)
    assert scores.columns == ["sample"] and load.count() == 2


def test_registered_queries(spark, sf_dir):
    rows = [(r.gene_id, r.samplename, r.read_count) for r in registry.fixture(spark, sf_dir, "counts").collect()]
    genes, samples, want, load = by_numpy(rows)
    got = {r.samplename: (r.pc1, r.pc2) for r in registry.QUERIES["st12_sample_scores"](spark, sf_dir).collect()}
    assert np.allclose([got[s] for s in samples], want[:, :2], atol=1e-5)
    top = registry.QUERIES["st12_top_genes"](spark, sf_dir).collect()
    assert len(top) == 40
    for i in range(2):
        mine = [abs(r.loading) for r in top if r.component == f"pc{i + 1}"]
        assert np.allclose(sorted(mine)[::-1], np.sort(np.abs(load[i]))[::-1][:20], atol=1e-6)
