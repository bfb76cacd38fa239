"""python -m ledgerline [mode] | samples <path>

Modes read below $DATA_PATH (default: data); results go to its output folder.
"""

import sys

from ledgerline.operators.samples import cost_summary, dead_metrics, metric_winners, run_superlatives
from ledgerline.plans.registry import DEFAULT_JOB, find_job, run
from ledgerline.session import build_session
from ledgerline.sinks.files import write_each, write_table
from ledgerline.sources.files import DataRoot, read_samples

# Fixed value: the line that log readers look for.
ELAPSED_LINE = "[BENCHMARK] Job elapsed: {seconds:.2f}s  mode={mode}"


def write_samples(spark, path, out):
    """The four tables about the samples of ``path``, each in full below ``out``."""
    samples, _ = read_samples(spark, path, any_order=True)
    summary = cost_summary(samples)
    tables = {
        "dead_metrics": dead_metrics(samples).filter("warning"),
        "cost_summary": summary.orderBy("run_id", "simulated_cost_usd", "strategy"),
        "metric_winners": metric_winners(summary).orderBy("run_id", "metric"),
        "run_superlatives": run_superlatives(summary).orderBy("run_id"),
    }
    write_each(tables, out, write_table)
    for name in tables:
        print(f"{out}/{name}")


def main(args):
    if args[:1] == ["samples"]:
        if len(args) != 2:
            raise SystemExit("usage: python -m ledgerline samples <path>")
        return write_samples(build_session(), args[1], DataRoot.from_env().output("samples"))
    job = find_job(args[0] if args else DEFAULT_JOB)
    root = DataRoot.from_env()
    _, seconds = run(build_session(), job.name, root, out=root.output(job.name))
    print(ELAPSED_LINE.format(seconds=seconds, mode=job.name))


if __name__ == "__main__":
    main(sys.argv[1:])
