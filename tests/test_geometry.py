"""Invariants of the spectral embedding, analytic cases and fits."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import geometry as g
from tidewatch.operators import topology

D0 = dt.date(2000, 1, 1)


def rows(spark, x, series="a"):
    return spark.createDataFrame([(series, D0 + dt.timedelta(days=i), i, [float(c) for c in v]) for i, v in enumerate(x)], "series_id string, ts date, t long, x array<double>")


def sample(n=120, d=3, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["random", "pauli", "gell_mann", "pca_pauli", "pca_gell_mann"])
def test_bases_are_hermitian(kind):
    ops = g.basis(kind, 4, 5, np.array([4.0, 1, 0.5, 0.1, 0]))
    assert ops.shape == (5, 4, 4) and np.allclose(ops, ops.conj().transpose(0, 2, 1))


def test_affine_form_is_the_definition():
    ops, x = g.basis("random", 4, 3), sample(5)
    want = [sum((a - c * np.eye(4)) @ (a - c * np.eye(4)) for a, c in zip(ops, v)) / 2 for v in x]
    assert np.allclose(g.hamiltonians(x, ops), want)


def test_metric_and_curvature_against_differences():
    ops, x, h = g.basis("random", 4, 3, seed=2), sample(6, seed=3), 1e-5
    e, v, metric, curv = g.ground(x, ops)
    psi = v[:, :, 0]
    d = []
    for k in range(3):
        moved = g.ground(x + h * np.eye(3)[k], ops)[1][:, :, 0]
        ov = (psi.conj() * moved).sum(1, keepdims=True)
        d.append((moved * (ov.conj() / np.abs(ov)) - psi) / h)
    d = np.array(d)
    q = np.einsum("ati,bti->tab", d.conj(), d) - np.einsum("ati,ti,tj,btj->tab", d.conj(), psi, psi.conj(), d)
    assert np.allclose(metric, q.real, atol=1e-3 * np.abs(metric).max())
    assert np.allclose(np.abs(curv), np.abs(2 * q.imag), atol=1e-3 * max(np.abs(metric).max(), 1))


def test_embedding_invariants(spark):
    df = rows(spark, sample()).withColumn("x", F.when(F.col("t") == 5, None).otherwise(F.col("x")))
    got = g.spectral_embed(df, g.basis("random", 4, 3), ("schmidt", "husimi_entropy", "wigner_negativity", "loschmidt", "otoc", "gibbs")).orderBy("t").collect()
    assert len(got) == 120 and got[5].spectrum is None
    for r in got[:5] + got[6:40]:
        psi = np.array(r.psi_re) + 1j * np.array(r.psi_im)
        m, f = np.array(r.g).reshape(3, 3), np.array(r.f).reshape(3, 3)
        assert np.linalg.norm(psi) == pytest.approx(1) and np.allclose(m, m.T) and np.allclose(f, -f.T)
        assert min(r.g_eigs) > -1e-9 and r.spectrum == sorted(r.spectrum) and sum(r.schmidt) == pytest.approx(1)
        top = psi[np.abs(psi).argmax()]
        assert top.real > 0 and abs(top.imag) < 1e-12
        assert 0 <= r.husimi_entropy and r.wigner_negativity >= -1e-12 and r.loschmidt >= -1e-9


def test_same_point_has_no_commutator_or_sensitivity(spark):
    df = rows(spark, sample(8)).withColumn("x_prev", F.col("x")).withColumn("x_next", F.col("x"))
    for r in g.spectral_embed(df, g.basis("random", 4, 3), ("commutator", "sensitivity", "geodesic_curvature", "floquet_gap", "ricci", "sectional")).collect():
        assert r.commutator == pytest.approx(0, abs=1e-10) and r.sensitivity == pytest.approx(0, abs=1e-10) and r.geodesic_curvature == pytest.approx(0, abs=1e-8)
        assert r.floquet_gap >= 0 and r.ricci is not None


def test_two_level_sphere_has_its_curvature(spark):
    """Ground states of sigma_x, sigma_y, sigma_z cover a sphere of radius 1/2 in the projective metric."""
    ops = g.basis("pauli", 2, 3)
    x = np.array([[0.9, 0.2, 0.4], [0.3, -0.8, 0.5]])
    for r in g.spectral_embed(rows(spark, x), ops).collect():
        p = np.array(r.x)
        tangent = np.cross(p, [0, 0, 1.0])
        tangent /= np.linalg.norm(tangent)
        m = np.array(r.g).reshape(3, 3)
        assert tangent @ m @ tangent == pytest.approx(1 / (4 * p @ p), rel=1e-6)


def test_grid_chern_away_from_and_around_the_degeneracy(spark):
    ops = np.array([[[1, 0], [0, -1]], [[0, 1], [1, 0]]], complex)
    away = g.grid_chern(spark, ops, 16, 0.5, (3.0, 3.0)).first().chern
    assert away == pytest.approx(0, abs=1e-9)


def test_observables_and_scores(spark):
    e = g.spectral_embed(rows(spark, sample(150)), g.basis("random", 4, 3), ("schmidt",))
    s = g.observable_scores(e).groupBy("method").agg(F.count("score").alias("n"), F.max(F.abs("score")).alias("most")).collect()
    assert len(s) > 35 and all(r.n > 0 for r in s), [r.method for r in s if not r.n]
    assert all(r.most == r.most and r.most != float("inf") for r in s)
    assert g.geometric_ensemble(g.observable_scores(e, list(g.ENSEMBLE))).where("score is not null").count() > 50
    d = g.effective_dimension(e, 10).agg(F.min("d_eff"), F.max("d_eff")).first()
    assert 1 - 1e-9 <= d[0] and d[1] <= 10
    den = g.density_observables(e).where("holevo is not null and relative_entropy is not null").collect()
    assert den and all(0 <= r.holevo <= np.log(4) + 1e-9 and 0 <= r.reference_infidelity <= 1 + 1e-9 for r in den)


def test_observables_are_causal(spark):
    x = sample(100)
    y = x.copy()
    y[70:] = sample(30, seed=9)
    both = rows(spark, x, "a").unionByName(rows(spark, y, "b"))
    s = g.observable_scores(g.spectral_embed(both, g.basis("random", 4, 3))).where("t < 70").toPandas()
    p = s.pivot(index=["method", "t"], columns="series_id", values="score").astype(float)
    assert np.allclose(p["a"], p["b"], equal_nan=True)


def test_fit_matches_numpy(spark):
    x = np.random.default_rng(4).normal(size=(80, 4)) @ np.diag([3, 2, 1, 0.5]) + 5
    x[:, 3] += x[:, 0]
    s = g.fit_prefix(rows(spark, x), 60, 2).first()
    z = (x[:60] - x[:60].mean(0)) / x[:60].std(0)
    w, u = np.linalg.eigh(np.cov(z.T))
    assert s.mean == pytest.approx(x[:60].mean(0).tolist()) and s.variances == pytest.approx(w[::-1][:2].tolist())
    for c, v in zip(s.components, u[:, ::-1].T):
        assert np.allclose(np.abs(c), np.abs(v), atol=1e-8) and max(c, key=abs) > 0
    for mode in ("sphere", "none", "soft", "clip"):
        assert g.embed_features(rows(spark, x), g.fit_prefix(rows(spark, x), 60, 2), mode).count() == 80


def test_refits_are_causal_and_match_whole_fits(spark):
    x = sample(200)
    df = rows(spark, x)
    snaps = {r.refit_t: r for r in g.fit_expanding(df, 60, 50, 2).collect()}
    assert sorted(snaps) == [60, 110, 160]
    for at, s in snaps.items():
        one = g.fit_prefix(df, at, 2).first()
        assert s.mean == pytest.approx(one.mean) and s.scale == pytest.approx(one.scale) and s.variances == pytest.approx(one.variances)
    changed = x.copy()
    changed[150:] += 9
    a, b = ({r.t: (r.refit_t, r.x) for r in g.embed_causal(rows(spark, v), g.fit_expanding(rows(spark, v), 60, 50, 2)).collect()} for v in (x, changed))
    assert len(a) == 200 and a[59][0] is None and a[60][0] == 60 and a[159][0] == 110 and a[199][0] == 160
    assert all(a[t][1] == pytest.approx(b[t][1]) if a[t][1] else b[t][1] is None for t in range(150)) and a[170][1] != pytest.approx(b[170][1])


def test_transitions_keep_apart(spark):
    x = [0.0] * 20 + [5.0] * 20 + [0.0] * 20
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "series_id string, t long, x double")
    got = sorted(r.t for r in topology.transitions(df, "x", 0.5, smooth=5, apart=10).collect())
    assert got == [20, 40]
    assert topology.transitions(df.limit(0), "x", 0.5).count() == 0


def test_path_length_is_additive(spark):
    ops = g.basis("random", 4, 2)
    whole = g.path_length(spark, ops, [0.1, 0.2], [0.5, -0.3], 100).first().length
    halves = sum(g.path_length(spark, ops, a, b, 50).first().length for a, b in (([0.1, 0.2], [0.3, -0.05]), ([0.3, -0.05], [0.5, -0.3])))
    assert whole == pytest.approx(halves, rel=1e-9) and whole > 0


def test_columns_follow_their_formulas(spark):
    x = sample(30)
    ops = g.basis("random", 4, 3)
    df = rows(spark, x).withColumn("x_prev", F.lag("x").over(g.ordered()))
    want = ("schmidt", "coherence_before", "tensor_det", "tensor_top", "husimi_entropy", "husimi_ipr")
    e = g.spectral_embed(df, ops, want)
    names = ["intrinsic_dimension", "dimension_rate", "gap_sharpness", "internal_energy", "specific_heat", "off_diagonal_coupling", "metric_frobenius", "renyi_half", "renyi3", "modular_variance", "discord", "entanglement", "temporal_coherence", "tensor_determinant", "tensor_largest", "tensor_norm", "husimi_participation"]
    got = e.select("t", *[g.OBSERVABLES[n][0]().alias(n) for n in names]).orderBy("t").collect()
    spec, v, metric, curv = g.ground(x, ops)
    q = metric - 0.5j * curv

    def dimension(w):
        p = np.maximum(w, 0) / np.maximum(w, 0).sum()
        p = p[p > 1e-30]
        return np.exp(-(p * np.log(p)).sum())

    for t, r in enumerate(got):
        w = np.linalg.eigvalsh(metric[t])[::-1]
        assert r.intrinsic_dimension == pytest.approx(dimension(w), rel=1e-6)
        k = int(np.argmax(w[:-1] - w[1:]))
        assert r.gap_sharpness == pytest.approx(w[k] / max(w[k + 1], 1e-15), rel=1e-4)
        p = np.exp(-(spec[t] - spec[t][0]))
        p /= p.sum()
        assert r.internal_energy == pytest.approx(p @ spec[t]) and r.specific_heat == pytest.approx(p @ spec[t] ** 2 - (p @ spec[t]) ** 2, abs=1e-9)
        assert r.off_diagonal_coupling == pytest.approx((np.abs(q[t]) ** 2)[~np.eye(3, dtype=bool)].sum()) and r.metric_frobenius == pytest.approx(np.linalg.norm(metric[t]))
        assert r.tensor_determinant == pytest.approx(abs(np.linalg.det(q[t])), abs=1e-9) and r.tensor_largest == pytest.approx(np.linalg.svd(q[t])[1][0] ** 2) and r.tensor_norm == pytest.approx(np.linalg.norm(q[t]))
        psi = v[t][:, 0]
        s = np.linalg.svd(psi.reshape(2, 2))[1] ** 2
        assert r.renyi_half == pytest.approx(2 * np.log(np.sqrt(s).sum())) and r.renyi3 == pytest.approx(-0.5 * np.log((s**3).sum())) and r.modular_variance == pytest.approx((s * np.log(s) ** 2).sum()) and r.discord == r.entanglement
        assert 1 / 64 <= r.husimi_participation <= 1
        if t:
            assert r.dimension_rate == pytest.approx(abs(dimension(w) - dimension(np.linalg.eigvalsh(metric[t - 1]))), abs=1e-6)
            c = np.linalg.eigh(g.hamiltonians(x[t - 1 : t], ops)[0])[1].conj().T @ psi
            assert r.temporal_coherence == pytest.approx(np.abs(c).sum() ** 2 - 1)
        else:
            assert r.temporal_coherence is None and r.dimension_rate is None
    psi = v[:, :, 0]
    roll = {r.t: r.rolling_infidelity for r in g.rolling_infidelity(e, 5).collect()}
    assert roll[4] is None and roll[20] == pytest.approx(1 - np.mean([abs(np.vdot(psi[20], psi[20 - k])) ** 2 for k in range(1, 6)]))
    ref = {r.t: r for r in g.reference_observables(e, 10).collect()}
    lead = np.linalg.eigh(np.einsum("ti,tj->ij", psi[:10], psi[:10].conj()) / 10)[1][:, -1]
    lead = lead * np.conj(lead[np.abs(lead).argmax()]) / np.abs(lead).max()
    assert ref[25].infidelity == pytest.approx(1 - abs(np.vdot(lead, psi[25])) ** 2) and ref[25].complexity == pytest.approx(np.sqrt(2) * np.arccos(np.vdot(lead, psi[25]).real))


def test_operators_from_a_table_and_segments(spark):
    rows_ = [(0, 0, 1, 0.0, -1.0), (1, 0, 0, 1.0, 0.0), (1, 1, 1, -1.0, 0.0)]
    ops = g.operators_from(spark.createDataFrame(rows_, "k int, i int, j int, re double, im double"))
    assert np.allclose(ops, [[[0, -1j], [1j, 0]], [[1, 0], [0, -1]]])
    with pytest.raises(ValueError):
        g.operators_from(spark.createDataFrame([(0, 0, 1, 1.0, 0.0), (0, 1, 0, 2.0, 0.0)], "k int, i int, j int, re double, im double"))
    seg = spark.createDataFrame([("p", [0.3, -0.2], [0.9, 0.4]), ("still", [0.3, 0.1], [0.3, 0.1]), ("none", None, [0.0, 0.0])], "id string, a array<double>, b array<double>")
    basis = g.basis("random", 4, 2)
    got = {r.id: r.length for r in g.segment_lengths(seg, basis, 50).collect()}
    assert got["p"] == pytest.approx(g.path_length(spark, basis, [0.3, -0.2], [0.9, 0.4], 50).first().length) and got["still"] == pytest.approx(0) and got["none"] is None
