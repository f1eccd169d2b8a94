"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local cores.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flaskmill.plans.catalog import QUERIES  # noqa: E402
from flaskmill.session import local_session  # noqa: E402

HEADLINE = (
    "stratified_capped_sample",
    "stratified_capped_sample_large",
    "dedupe_first",
    "dedupe_pair",
    "exclude_holdout",
    "exclude_many",
    "leak_report",
    "seeded_sample_nested",
    "split_fractions",
    "mix_by_presence",
    "answer_coverage",
    "normalize_reaction",
    "normalize_flat_row",
    "fragment_dim",
    "canonicalise_sets",
    "split_roles",
    "role_summary",
    "species_frequency",
    "char_inventory",
    "strings_with_unknown",
    "format_target_json",
    "length_profile",
    "topk_scores",
    "topk_scores_with_canonical_map",
    "interleave_ensemble",
    "mcnemar_exact",
    "score_summary",
    "topk_by_view_substrates",
    "similar_topk",
    "jsonl_round_trip",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores)
    # Starts the JVM's and Spark's own machinery before anything is timed.
    QUERIES["dedupe_first"](spark, folder).write.format("noop").mode("overwrite").save()
    spent = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    total = round(sum(spent.values()), 3)
    print(
        json.dumps(
            {"metric": "total", "value": total, "unit": "sec", "queries": spent, "sf": Path(folder).name}
        )
    )


if __name__ == "__main__":
    main()
