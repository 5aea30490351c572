"""A prompt: python -m lumenvec.cli RECORDS.parquet [--dim N]. Queries end with ;  Commands: :help :plan TEXT :ast TEXT :load FILE :quit"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable

from .lang.parser import parse
from .plans.compile import Sources
from .plans.nodes import tree
from .plans.planner import Settings
from .session import Engine
from .sources.embedding import HashEmbedder


def run(engine: Engine, lines: Iterable[str], out=print) -> None:
    pending = ""
    for line in lines:
        word, _, rest = line.strip().partition(" ")
        try:
            if not pending and word in (":quit", ":q"):
                return
            if not pending and word == ":help":
                out(__doc__)
            elif not pending and word == ":plan":
                out(tree(engine.plan(rest.rstrip(";"))))
            elif not pending and word == ":ast":
                out(repr(parse(rest.rstrip(";"))))
            elif not pending and word == ":load":
                with open(rest) as f:
                    run(engine, f, out)
            elif line.strip():
                pending += line
                if pending.rstrip().endswith(";"):
                    text, pending = pending.rstrip()[:-1], ""
                    result = engine.find(text)
                    for r in result.rows:
                        out(r.asDict(recursive=True))
                    out(f"{result.total} rows, {result.timings_ms['total']:.0f} ms" + " (partial)" * result.partial)
        except (ValueError, RuntimeError, OSError) as e:
            pending = ""
            out(f"error: {e}")


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("records")
    p.add_argument("--dim", type=int, default=384)
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    run(Engine(spark, Sources(spark.read.parquet(args.records)), Settings(dim=args.dim), HashEmbedder(args.dim)), sys.stdin)


if __name__ == "__main__":
    main()
