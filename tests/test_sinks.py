"""Labels, the simplifier as a tool, and warnings of what is left out."""

from sightline import cli
from sightline.sources import drawings, plans


def test_label():
    assert drawings.label_at([(0, 0), (5, 3)], "<svg>") == (0, -8)
    assert drawings.label_at([(0, 0)], '<svg viewBox="0 0 9 9">') == (2, 16)
    assert drawings.label_at([], '<svg viewBox="20,30,9,9">') == (22, 46) and drawings.label_at([], "<svg>") == (10, 18)


def test_simplify(spark, tmp_path):
    plan = tmp_path / "plan.svg"
    plan.write_text('<svg><!-- <path d="M1 1"/> --><path id="x" d="M0,0 C2,0 4,0 6,0 h1z"/><path d="M0 0A1 1 0 0 0 5 5"/></svg>')
    to = cli.simplify(spark, [str(plan)])
    assert to == str(tmp_path / "plan-simple.svg")
    assert open(to).read() == '<svg><!-- <path d="M1 1"/> --><path id="x" d="M0.000,0.000 L6.000,0.000 L7.000,0.000 z"/><path d="M0.000,0.000 L5.000,5.000"/></svg>'
    assert cli.simplify(spark, [str(plan), str(tmp_path / "o.svg"), "--segments", "4", "--tolerance", "0.1"]) == str(tmp_path / "o.svg")


def test_skipped_lines(spark, tmp_path, capsys):
    gate, net = tmp_path / "g.csv", tmp_path / "n.csv"
    gate.write_text("label,x,y,count\na,1,2,3\nb,1\n\nc,1,x,3\nd,1,2,3d")
    assert [tuple(r) for r in plans.skipped_lines(spark, str(gate)).orderBy("line").collect()] == [(3, "fewer than 4 fields"), (5, "no number where one is needed"), (6, "no number where one is needed")]
    net.write_text("id,x,y\n0,5abc, 7 m\n1,x,2\n3")
    assert [(r.x, r.y) for r in plans.read_network(spark, str(net)).collect()] == [(5.0, 7.0)]
    cli.warn(plans.skipped_lines(spark, str(net), 2), "n.csv")
    assert "n.csv: 2 lines left out" in capsys.readouterr().err
