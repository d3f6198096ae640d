import math

import pytest

from paceline.operators.serving import Entrant, Registry, cache_key, simulate_heat


def test_two_entrants_closed_form():
    a, b = Entrant("a", 27, 2), Entrant("b", 24, 3)
    beta = 25 / 6
    got = simulate_heat([a, b], 1, beta, least=40_000, most=40_000)["a"]
    want = (1 + math.erf(3 / math.sqrt(2 * beta**2 + 13) / math.sqrt(2))) / 2
    assert abs(got[0] - want) < 0.012 and got[1] < want < got[2]


def test_cache_key_and_bounds():
    a, b = Entrant("a", 27.01, 2), Entrant("b", 24, 3)
    assert cache_key([a, b], 1, 4.17) == cache_key([b, Entrant("a", 27.0, 2)], 1, 4.17) != cache_key([a, b], 2, 4.17)
    assert len({cache_key([a, b], 1, 4.17), cache_key([a, b], 1, 4.17, penalty=0.1), cache_key([a, b], 1, 4.17, seed=1), cache_key([a, b], 1, 4.17, run="r")}) == 4
    assert cache_key([a, b], 1, 4.17) == cache_key([Entrant("x", 27.0, 2), b], 1, 4.17)
    for advance, beta, penalty in ((3, 1.0, 0.0), (2, 1.0, 0.0), (1, 0.0, 0.0), (1, 1.0, 1.0)):
        with pytest.raises(ValueError):
            simulate_heat([a, b], advance, beta, penalty)


def test_registry(tmp_path):
    r = Registry(str(tmp_path / "runs.json"))
    run = r.begin({"ledger": "x"}, {"tau": 1})
    with pytest.raises(ValueError):
        r.publish(run)
    assert r.reusable({"ledger": "x"}, {"tau": 1}) is None
    r.complete(run)
    r.publish(run)
    assert r.current() == run == r.begin({"ledger": "x"}, {"tau": 1}) == r.reusable({"ledger": "x"}, {"tau": 1})
    with pytest.raises(ValueError):
        r.fail(run)
