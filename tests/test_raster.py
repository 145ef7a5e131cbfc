import numpy as np

from lutrin.operators import raster as R
from lutrin.plans.stages import plan_of


def _brute(mask, k, all_):
    out = np.zeros_like(mask)
    h, w = mask.shape
    for y in range(h):
        for x in range(w):
            cells = [mask[a, b] for a in range(y - k, y + k + 1) for b in range(x - k, x + k + 1) if 0 <= a < h and 0 <= b < w]
            out[y, x] = all(cells) if all_ else any(cells)
    return out


def test_erosion_and_dilation_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        m = rng.random((9, 11)) > 0.3
        for k in (0, 1, 2):
            assert (R.erode(m, k) == (_brute(m, k, True) if k else m)).all()
            assert (R.dilate(m, k) == (_brute(m, k, False) if k else m)).all()


def test_components_cover_the_mask_once():
    rng = np.random.default_rng(2)
    m = rng.random((20, 20)) > 0.6
    parts = R.components(m)
    assert (sum(p.astype(int) for p in parts) == m).all()
    assert [p.sum() for p in parts] == sorted((p.sum() for p in parts), reverse=True)
    assert not any((R.dilate(p, 1) & q & ~p)[:, :].any() and _touch(p, q) for p in parts for q in parts if p is not q)
    assert R.components(np.zeros((3, 3), bool)) == []


def _touch(p, q):
    return any((np.roll(p, s, a) & q).any() for a in (0, 1) for s in (1, -1) if not np.roll(p, s, a)[[0, -1]].any() and not np.roll(p, s, a)[:, [0, -1]].any())


def test_bands_gutters_and_profiles():
    m = np.zeros((10, 10), bool)
    m[1:3, 2:5] = m[6:9, 2:8] = True
    assert R.ink_bands(m, 1) == [(1, 3), (6, 9)] and R.gutters(m, 1) == [(3, 6)] and R.gutters(m, 1, 4) == []
    assert R.ink_bands(m, 0) == [(2, 8)] and R.fill_ratio(m[:3]) == 1.0 and R.fill_ratio(m[:1]) == 0.0
    assert R.regularity([10, 10, 11, 30]) == 2.5 and R.regularity([]) == 0.0
    assert R.harmonic(np.ones(16)) == 0.0 and R.harmonic(np.zeros(0)) == 0.0
    assert R.radial_profile(np.zeros((2, 2), bool)).sum() == 0
    full = np.ones((20, 20), bool)
    assert R.safe_erode(full, 5)[1] == 5 and R.erode(full, 5).all()  # the edge of the mask takes nothing away
    bar = np.zeros((20, 20), bool)
    bar[6:11, 2:18] = True
    assert R.safe_erode(bar, 3)[1] == 2 and R.safe_erode(bar & False, 3)[1] == 0


def test_profile_of_ovals_and_stars():
    yy, xx = np.mgrid[0:200, 0:320]
    oval = ((yy - 100) / 80) ** 2 + ((xx - 160) / 150) ** 2 <= 1
    assert R.radial_profile(oval).std() < 0.02 and R.harmonic(R.radial_profile(oval)) < 0.02
    star = np.hypot(yy - 100, xx - 160) <= 70 + 15 * np.cos(12 * np.arctan2(yy - 100, xx - 160))
    assert R.harmonic(R.radial_profile(star)) > 0.1 > 10 * R.harmonic(R.radial_profile(oval))
    ring = R.radial_profile(oval & ((yy < 90) | (yy > 110)))
    assert len(ring) == 120 and (ring > 0).all()  # sectors without cells have the median


def test_diffusion_stays_between_its_edges():
    v = np.tile(np.arange(8.0), (8, 1))
    hole = np.zeros((8, 8), bool)
    hole[3:5, 3:5] = True
    out = R.diffuse(v, hole, 200)
    assert (out[~hole] == v[~hole]).all() and np.allclose(out[hole], v[hole], atol=1e-3)


def _one(mask):
    parts = R.components(mask)
    eroded, depth = R.safe_erode(mask, 3)
    return (float(mask.mean()), len(parts), R.fill_ratio(mask), len(R.ink_bands(mask, 1)), len(R.gutters(mask, 1)), depth, int(eroded.sum()), R.harmonic(R.radial_profile(parts[0])) if parts else 0.0)


def test_stacks_of_masks_against_one_by_one():
    rng = np.random.default_rng(4)
    masks = np.zeros((90, R.GRID + 1, R.GRID + 1), bool)
    for k, m in enumerate(masks[2:]):
        m[: R.GRID, : R.GRID] = rng.random((R.GRID, R.GRID)) < (0.02, 0.4, 0.6, 0.97)[k % 4] if k < 50 else R.dilate(rng.random((R.GRID, R.GRID)) < 0.002, 4)
    masks[1, : R.GRID, : R.GRID] = True
    masks[2, : R.GRID, : R.GRID] = False
    masks[2, : R.GRID : 2, : R.GRID] = masks[2, 1 : R.GRID - 1 : 4, R.GRID - 1] = masks[2, 3 : R.GRID - 1 : 4, 0] = True  # one winding part
    assert len(R.components(masks[2])) == 1
    for got, mask in zip(zip(*R.measures(masks)), masks[:, : R.GRID, : R.GRID]):
        want = _one(mask)
        assert got[:7] == want[:7] and abs(got[7] - want[7]) < 1e-12


def test_page_masks_calls_python_per_stack_and_not_per_page(spark, tmp_path):
    rows, rng = [], np.random.default_rng(3)
    for page in range(700):
        for _ in range(rng.integers(1, 9)):
            x, y = (int(v) for v in rng.integers(-200, 1700, 2))
            rows.append((len(rows), f"o{page % 3}", "v", page, x, y, x + int(rng.integers(1, 400)), y + int(rng.integers(1, 400)), 0.5, "ja"))
    rows += [(len(rows), "o", "v", 1, 0, 0, 2**31 - 1, 2**31 - 1, 0.5, "ja"), (len(rows) + 1, "o", "v", 2, 9, 9, 9, 20, 0.5, "ja"), (len(rows) + 2, None, "v", 2, 0, 0, 9, 20, 0.5, "ja")]
    spark.createDataFrame(rows + rows[:50], "bulle_id long, oeuvre string, tome string, planche int, x0 int, y0 int, x1 int, y1 int, score double, langue_source string").write.parquet(f"{tmp_path}/bulles.parquet")
    out = R.q_page_masks(spark, str(tmp_path))
    assert "FlatMapGroupsInPandas" not in plan_of(out)
    got = {r[:3]: r[3:] for r in map(tuple, out.collect())}
    pages = R.boxes(spark, str(tmp_path)).toPandas().groupby(R.PAGE)
    assert len(got) == len(pages) == 701
    for key, pdf in pages:
        want = _one(R.draw(pdf))
        assert got[key][:7] == want[:7] and abs(got[key][7] - want[7]) < 1e-12
