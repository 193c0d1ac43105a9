import pytest

from cladeflow.operators.schedule import relative, share, stage_of


def test_shares():
    for nodes in range(4, 60):
        shares = share(nodes, [10.0, 1.0, 5.0, 1.5])
        assert sum(shares) == nodes and min(shares) >= 1
        assert shares[0] >= shares[2] >= shares[1]
    assert share(3, []) == []
    with pytest.raises(ValueError):
        share(1, [1.0, 1.0])


def test_stages():
    shares = [2, 1, 3]
    assert [stage_of(r, shares) for r in range(6)] == [0, 0, 1, 2, 2, 2]
    with pytest.raises(ValueError):
        stage_of(6, shares)
    assert relative([20, 2, 10, 3]) == [10, 1, 5, 1.5]
