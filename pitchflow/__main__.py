"""The command line: each step over tables (Parquet folders) or documents (.json).

python -m pitchflow STEP ..., see --help. Pictures are not made here: there is no decoding, rendering or window.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from . import flows
from .schema import TrackRules


def session() -> SparkSession:
    return SparkSession.builder.appName("pitchflow").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def read(spark: SparkSession, path: str) -> DataFrame:
    from .sources import documents

    return documents.read_positions(spark, path) if path.rstrip("/").endswith(".json") else spark.read.parquet(path)


def write(df: DataFrame, path: str | None) -> None:
    if path:
        df.write.mode("overwrite").parquet(path)
    else:
        df.show(1000, truncate=False)


def project(path: str | None):  # noqa: ANN201
    from .sources.documents import Project

    return Project.load(path) if path else Project()


def calibrate(a: argparse.Namespace) -> None:
    """A camera's homography and lens from its marks."""
    from .operators import calibration
    from .schema import Field

    p = project(a.project)
    free = tuple(a.free.split(",")) if a.free else None
    if unknown := set(free or ()) - set(calibration.TERMS):
        raise ValueError(f"no lens terms {', '.join(sorted(unknown))}")
    write(calibration.calibrate(session().read.parquet(a.marks), p.lens, Field(p.field_length_m, p.field_width_m), free), a.out)


def tiles(a: argparse.Namespace) -> None:
    """The views that cover a project's field."""
    from .plans.geometry import plan_tiles

    write(plan_tiles(session(), flows.ground_of(project(a.project))).orderBy("tile"), a.out)


def track(a: argparse.Namespace) -> None:
    """Positions of all frames from raw detections."""
    write(flows.positions(session().read.parquet(a.detections), TrackRules(fps=a.fps, stride=a.stride)), a.out)


def classify(a: argparse.Namespace) -> None:
    """The framing pool and, beside it, all positions with labels."""
    from .schema import Field

    p = project(a.project)
    pool, labelled = flows.classified(read(session(), a.positions), 1 / a.fps, Field(p.field_length_m, p.field_width_m))
    write(pool, f"{a.out}/pool")
    write(labelled, f"{a.out}/labelled")


def campath(a: argparse.Namespace) -> None:
    """The camera path of a framing pool."""
    p = project(a.project)
    write(flows.camera_path(read(session(), a.positions), p, flows.camera_rules(p, a.view, fps=a.fps, smooth_s=a.smooth)), a.out)


def pipeline(a: argparse.Namespace) -> None:
    """track, classify and campath, each from what the one before wrote."""
    a.positions, a.stride, out = f"{a.work_dir}/tracks", a.stride, a.out
    a.out = a.positions
    track(a)
    a.out = a.work_dir
    classify(a)
    a.positions, a.out = f"{a.work_dir}/pool", out
    campath(a)


def interpolate(a: argparse.Namespace) -> None:
    """Rows between a path's frames."""
    from .operators import backends

    path = session().read.parquet(a.path)
    write(backends.interpolated(path, [c for c, t in path.dtypes if t == "double"], a.factor, a.backend), a.out)


def monitor(a: argparse.Namespace) -> None:
    """One look at the progress documents of a folder."""
    import time
    from pathlib import Path

    from .sources import progress

    for f in sorted(Path(a.folder).glob("*.json")):
        d = progress.read(str(f), time.time())
        print(f.stem, "unreadable" if d is None else "stale" if d["stale"] else d.get("status", "?"), *([] if d is None else [d.get("step", "")]), sep="\t")


def queue(a: argparse.Namespace) -> None:
    """The jobs of queue documents."""
    from .sources import layouts

    write(layouts.jobs_of(layouts.whole(session(), a.documents)).orderBy("path", "queue_pos"), a.out)


def query(a: argparse.Namespace) -> None:
    """A registered query over a folder of tables; without a name, their names."""
    from . import catalog

    if a.name is None:
        print(*sorted(catalog.QUERIES), sep="\n")
    elif a.name not in catalog.QUERIES:
        raise ValueError(f"no query {a.name!r}")
    else:
        write(catalog.QUERIES[a.name](session(), a.tables), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pitchflow", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    steps = top.add_subparsers(dest="step", required=True)

    def step(run, *names: str, needs_out: bool = False, **more: tuple) -> None:  # noqa: ANN001
        s = steps.add_parser(run.__name__, help=run.__doc__)
        for n in names:
            s.add_argument(n)
        s.add_argument("--out", required=needs_out)
        for n, (kind, default) in more.items():
            s.add_argument("--" + n.replace("_", "-"), type=kind, default=default)
        s.set_defaults(run=run)

    fps, proj = (float, 20.0), (str, None)
    step(calibrate, "marks", project=proj, free=(str, "k1,pitch0_deg,roll0_deg"))
    step(tiles, project=proj)
    step(track, "detections", needs_out=True, fps=fps, stride=(int, 3))
    step(classify, "positions", needs_out=True, project=proj, fps=fps)
    step(campath, "positions", project=proj, view=(str, "default"), fps=fps, smooth=(float, None))
    step(pipeline, "detections", needs_out=True, project=proj, work_dir=(str, "work"), fps=fps, stride=(int, 3), view=(str, "default"), smooth=(float, None))
    step(interpolate, "path", needs_out=True, factor=(int, 3), backend=(str, "linear"))
    step(monitor, "folder")
    step(queue, "documents")
    q = steps.add_parser("query", help=query.__doc__)
    q.add_argument("name", nargs="?")
    q.add_argument("--tables")
    q.add_argument("--out")
    q.set_defaults(run=query)
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        a.run(a)
    except ValueError as error:
        print(f"pitchflow {a.step}: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
