"""python -m wachter monitor|watch|export|sessions|synth ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser("wachter")
    sub = p.add_subparsers(dest="do", required=True)
    m = sub.add_parser("monitor")
    m.add_argument("config")
    m.add_argument("--max-frames", type=int)
    w = sub.add_parser("watch")
    w.add_argument("config")
    w.add_argument("--seconds", type=float, help="how long to watch (until interrupted)")
    e = sub.add_parser("export")
    e.add_argument("config")
    e.add_argument("--session", required=True)
    e.add_argument("--format")
    e.add_argument("--out")
    sub.add_parser("sessions").add_argument("config")
    s = sub.add_parser("synth")
    s.add_argument("path")
    s.add_argument("--duration", type=float)
    a = p.parse_args(argv)

    from wachter.config import load_config
    from wachter.operators.report import list_sessions
    from wachter.plans.export import export_session
    from wachter.plans.monitor import monitor
    from wachter.plans.watch import Watch
    from wachter.sources import SourceError
    from wachter.sources.store import Store
    from wachter.sources.synthetic import DURATION, write_frames

    spark = spark or SparkSession.builder.appName("wachter").getOrCreate()
    try:
        if a.do == "monitor":
            print(monitor(spark, load_config(a.config), a.max_frames))
        elif a.do == "watch":
            session = Watch(spark, load_config(a.config)).start(1.0)
            try:
                session.query.awaitTermination(a.seconds) if a.seconds is not None else session.query.awaitTermination()
            except KeyboardInterrupt:
                pass
            print(session.stop())
        elif a.do == "export":
            print(export_session(spark, load_config(a.config), a.session, a.format, a.out))
        elif a.do == "sessions":
            for r in list_sessions(Store(spark, load_config(a.config)["data_dir"]).sessions()).select("label").collect():
                print(r[0])
        else:
            print(write_frames(spark, a.path, duration=a.duration or DURATION))
    except (SourceError, ValueError) as x:
        print(x, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
