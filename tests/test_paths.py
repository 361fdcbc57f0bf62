import pytest

from sightline.sources import svgpath


@pytest.mark.parametrize(
    "d, want",
    [
        ("M0,0 L10,0 L10,10 L0,10 z", [(0, 0), (10, 0), (10, 10), (0, 10)]),
        ("M0 0 10 0 10 10 0 10 0 0", [(0, 0), (10, 0), (10, 10), (0, 10)]),
        ("m1 1 h2 v2 h-2 z", [(1, 1), (3, 1), (3, 3), (1, 3)]),
        ("M0,0 L4,0 L4,4 z M1,1 L2,1 L2,2 z", [(0, 0), (4, 0), (4, 4)]),
        ("M0,0 L5,0 5.5.5 9", [(0, 0), (5, 0), (5.5, 9)]),
        ("M1,1 L2", [(1, 1)]),
        ("M1,1 L-", [(1, 1)]),
        ("M0 0 A 5 5 0 0 1 3 4 T 7 8", [(0, 0), (3, 4), (7, 8)]),
        ("M0 0 X9 L1 1", [(0, 0), (1, 1)]),
        ("", []),
        (None, []),
    ],
)
def test_ring(d, want):
    assert svgpath.ring(d) == [tuple(map(float, p)) for p in want]


def test_curves_become_eight_points():
    assert len(svgpath.ring("M0,0 C0,0 8,0 8,0")) == 9
    assert len(svgpath.ring("M0,0 Q4,4 8,0 S1,2,3,4")) == 17


@pytest.mark.parametrize(
    "d, want",
    [
        ("m1 1 h2 v2 h-2 z", "M1.000,1.000 L3.000,1.000 L3.000,3.000 L1.000,3.000 z"),
        ("M0,0 L4,0 L4,4 z m1,1 l1,0", "M0.000,0.000 L4.000,0.000 L4.000,4.000 z M1.000,1.000 L2.000,1.000"),
        ("M0,0 L1,1 z 5", "M0.000,0.000 L1.000,1.000 z"),
    ],
)
def test_straight(d, want):
    assert svgpath.straight(d)[0] == want


def test_straight_counts():
    assert svgpath.straight("M0,0 C2,0 4,0 6,0") == ("M0.000,0.000 L6.000,0.000", 1, 0, 0)
    assert svgpath.straight("M0,0 C0,5 5,5 5,0 A1 1 0 0 0 9 9")[1:] == (0, 1, 1)
