"""Peers from tiles and averages over them: against plain loops, and without a copy of a row for each peer."""

import contextlib
import io

import numpy as np
import pytest

from tessera.operators import peers as P
from tessera.plans import catalog


@pytest.mark.parametrize("tile", [5, 64])
def test_tiles_with_ties_and_names_without_history(spark, tile):
    rng = np.random.default_rng(2)
    r = rng.normal(size=(40, 30))
    r[7] = r[3]  # equal histories tie, and the smaller symbol comes first
    r[11] = r[3]
    r[20:29, 4:] = np.nan  # too few values
    r[30] = 0.5  # no variation
    rows = [(0, 3 * s - 20, t, None if np.isnan(r[s, t]) else float(r[s, t])) for s in range(40) for t in range(30)]
    got = {(x["symbol"], x["peer"]) for x in P.top_peers(spark.createDataFrame(rows, "blk int, symbol long, t_idx int, r1 double"), 12, 20, tile).collect()}
    x = np.nan_to_num(r)
    ok = ((~np.isnan(r)).sum(axis=1) >= 20) & (x.std(axis=1) > 1e-9)
    with np.errstate(all="ignore"):
        rho = np.round(np.where(np.outer(ok, ok), np.corrcoef(x), 0), 9) + 0.0
    assert got == {(3 * s - 20, 3 * o - 20) for s in range(40) for o in sorted((o for o in range(40) if o != s), key=lambda o: (-rho[s, o], o))[:12]}


def test_no_row_is_copied_for_each_peer(spark, small, monkeypatch):
    """All names of some sessions meet once, however many sessions a piece has."""
    found = {}
    for longest in (32, 5):
        monkeypatch.setattr(P, "LONGEST", longest)
        df = catalog.queries()["features_peer"](spark, small)
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            df.explain()
        assert "Join" not in plan.getvalue() and plan.getvalue().count("Exchange hashpartitioning") == 1
        found[longest] = sorted(map(tuple, df.collect()), key=lambda x: x[:2])
    assert found[32] == found[5] and len(found[5]) == 1050
