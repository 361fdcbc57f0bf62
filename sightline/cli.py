"""Command line: one run over one plan. Only what is asked for is computed."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import gates as gate_ops
from .operators import graph, isovist, metrics, place, routes
from .operators._loop import written
from .sources import drawings, plans

MEASURES = {"area": "area", "perim": "perimeter", "degree": "degree", "choice": "choice", "d-choice": "d_choice", "a-choice": "a_choice", "polar-status-angle": "polar_status_angle", "polar-status-product": "polar_status_product", "topo-status": "topo_status", "prospect-status": "prospect_status", "angular-integration": "angular_integration"}
ROUTES = ("nose", "polar", "metric", "prospect", "topo")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sightline", allow_abbrev=False)
    p.add_argument("plan")
    p.add_argument("--n", type=int, default=400)
    p.add_argument("--candidates", type=int, default=7)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--T", action="store_true", help="metrics table")
    for m in MEASURES:
        p.add_argument(f"--vis-{m}", action="store_true")
    for r in ROUTES:
        p.add_argument(f"--vis-{r}-single", action="store_true")
    p.add_argument("--vis-connections", action="store_true")
    p.add_argument("--vis-graph", action="store_true")
    p.add_argument("--OR", type=int, default=-1)
    p.add_argument("--DEST", type=int, default=-1)
    p.add_argument("--ODseed", type=int, nargs=2, default=[-1, -1])
    p.add_argument("--polar-g", type=float, default=1.0)
    p.add_argument("--prospect-w", type=float, default=1.0)
    p.add_argument("--gates")
    p.add_argument("--MAX-GATE-RADIUS", type=float, default=50.0)
    p.add_argument("--HEAL", action="store_true")
    p.add_argument("--NETWORK")
    p.add_argument("--NETWORK-RESTORE")
    p.add_argument("--FLIP", action="store_true")
    p.add_argument("--LOG", action="store_true")
    p.add_argument("--SIZE", type=float, default=drawings.DOT)
    p.add_argument("--out", help="folder of the output; default: out beside the plan's folder")
    return p


def run(spark: SparkSession, argv: list[str]) -> dict[str, str]:
    """Runs and returns what was written, by kind."""
    a = parser().parse_args(argv)
    if a.HEAL and a.NETWORK_RESTORE:
        raise SystemExit("--HEAL and --NETWORK-RESTORE exclude each other")
    flag = lambda name: getattr(a, name.replace("-", "_"))
    folder = a.out or os.path.normpath(os.path.join(os.path.dirname(a.plan), "..", "..", "out"))
    os.makedirs(folder, exist_ok=True)
    stem, doc, made = os.path.splitext(os.path.basename(a.plan))[0], drawings.read(spark, a.plan), {}
    _, rings = plans.read_plan(spark, a.plan)
    rings = written(rings.withColumn("pid", F.when(F.col("role") == "outer", isovist.OUTER).otherwise(F.col("pid"))))
    segments = isovist.ring_edges(rings)
    centres = plans.read_network(spark, a.NETWORK_RESTORE) if a.NETWORK_RESTORE else place.best_candidates(spark, segments, a.n, a.candidates, a.seed)
    centres = written(centres)
    if a.NETWORK_RESTORE:
        warn(plans.skipped_lines(spark, a.NETWORK_RESTORE, 2), a.NETWORK_RESTORE)
    asked = {MEASURES[m] for m in MEASURES if flag(f"vis_{m}")}
    single = [r for r in ROUTES if flag(f"vis_{r}_single")]
    pair_only = flag("vis_a-choice") and a.OR >= 0 and a.DEST >= 0
    need_graph = bool(asked - {"area", "perimeter"} or single or a.vis_connections or a.vis_graph or a.gates)
    vertices, edges = isovist.isovist_vertices(centres, segments), None
    if need_graph and a.HEAL:
        before = centres.count()
        centres, vertices, edges = place.heal(centres, segments, a.seed)
        print(f"{centres.count() - before} bridges accepted")
    elif need_graph:
        vertices = written(vertices)
        edges = written(graph.visibility_edges(vertices, centres))
    n = centres.count()

    def save(kind: str, text: str, tag: str = "") -> None:
        made[kind] = os.path.join(folder, f"{stem}{f'-{kind}' if kind != 'centers' else ''}{tag}-{n}.svg")
        with open(made[kind], "w", encoding="utf-8") as out:
            out.write(text)

    save("centers", drawings.centres_drawing(doc, centres))
    if need_graph:
        parts = written(graph.components(edges, centres))
        try:
            graph.require_connected(parts)
        except graph.DisconnectedGraphError:
            save("graph", drawings.graph_map(doc, centres, edges, parts, a.SIZE))
            raise
    wanted = set(metrics.COLUMNS[3:]) if a.gates else asked - ({"a_choice"} if pair_only else set()) | ({"area", "perimeter"} if a.T else set()) | ({"topo_status", "degree"} if a.T and need_graph else set())
    table: DataFrame | None = None
    if wanted:
        table = written(metrics.metrics(centres, vertices, edges, a.polar_g, a.prospect_w, wanted))
    if a.T:
        made["csv"] = os.path.join(folder, f"{stem}-{n}.csv")
        plans.write_metrics(table, made["csv"], 0.0)
    for m in sorted(asked & wanted):
        save(m.replace("_", "-"), drawings.measure_map(doc, table, m, a.LOG, a.FLIP, a.SIZE))
    if a.gates:
        matched = written(gate_ops.match(plans.read_gates(spark, a.gates), centres, a.MAX_GATE_RADIUS))
        warn(plans.skipped_lines(spark, a.gates, 4), a.gates)
        if lost := matched.where("isovist_id is null").count():
            print(f"{lost} of {matched.count()} gates have no viewpoint within {a.MAX_GATE_RADIUS:g}", file=sys.stderr)
        made["gates-csv"] = os.path.join(folder, f"{stem}-gates-{n}.csv")
        plans.write_gates(gate_ops.report(matched, centres, table), made["gates-csv"])
        save("gates", drawings.gates_map(doc, centres, matched, a.SIZE))
    pair = lambda o, d: spark.createDataFrame([(o, d)], "origin long, dest long")
    if pair_only:
        row = routes.angular_route(pair(a.OR, a.DEST), centres, edges).first()
        print(drawings.route_report(row, 57.29577951308232))
        save("a-choice", drawings.route(doc, centres, row, "a-choice", a.SIZE, "a_choice_path", False))
    if single:
        ids = {r.id for r in centres.select("id").collect()}
        o, d = a.ODseed if set(a.ODseed) <= ids else place.random_pair(centres, a.seed)
        kinds = {"nose": (routes.nose_route, {}, ""), "polar": (routes.polar_route, {"gamma": a.polar_g}, f"-g{a.polar_g:g}"), "metric": (routes.metric_route, {}, ""), "prospect": (routes.prospect_route, {"weight": a.prospect_w}, f"-w{a.prospect_w:g}"), "topo": (routes.topo_route, {}, "")}
        for r in single:
            f, options, tag = kinds[r]
            row = f(pair(o, d), centres, edges, **options).first()
            print(drawings.route_report(row))
            if row.path:
                save(r, drawings.route(doc, centres, row, r, a.SIZE), tag)
                if r == "nose":
                    save("topo-depth", drawings.depth_map(doc, centres, graph.depths(edges, centres.where(F.col("id") == d)), row, a.SIZE))
    if a.vis_connections:
        node = centres.orderBy(F.xxhash64("id", F.lit(a.seed))).first().id
        save("connections", drawings.connections_map(doc, centres, edges, node, a.SIZE))
    if a.vis_graph:
        save("graph", drawings.graph_map(doc, centres, edges, parts, a.SIZE))
    if a.NETWORK:
        made["network"] = a.NETWORK
        plans.write_network(centres, a.NETWORK)
    save("experiment", drawings.experiment(doc, centres, vertices))
    return made


def simplify(spark: SparkSession, argv: list[str]) -> str:
    """Rewrites a plan's curves as straight lines: <input.svg> [output.svg] [--segments k] [--tolerance t]."""
    p = argparse.ArgumentParser(prog="sightline simplify", allow_abbrev=False)
    p.add_argument("plan")
    p.add_argument("output", nargs="?")
    p.add_argument("--segments", type=int, default=8, help="lines for each curve")
    p.add_argument("--tolerance", type=float, default=0.05, help="greatest distance of a control point from the chord of a curve that counts as straight")
    a = p.parse_args(argv)
    to, n = plans.write_simplified(spark, a.plan, a.output, a.segments, a.tolerance)
    print(f"{n['paths']} paths -> {to}: {n['straightened']} curves became lines, {n['tessellated']} became {a.segments} lines each, {n['arcs']} arcs became chords")
    return to


def warn(skipped: DataFrame, path: str) -> None:
    for r in skipped.orderBy("line").limit(20).collect():
        print(f"{path}, line {r.line}: {r.reason}; left out", file=sys.stderr)
    if n := skipped.count():
        print(f"{path}: {n} lines left out", file=sys.stderr)


def main() -> None:
    if sys.argv[1:2] == ["simplify"]:
        simplify(SparkSession.builder.appName("sightline").getOrCreate(), sys.argv[2:])
        return
    run(SparkSession.builder.appName("sightline").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
