"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line.

``python bench.py all`` times every registered query and adds the slowest first on stderr.
"""

from __future__ import annotations

import json
import os
import sys
import time

from kerbline.plans import QUERIES
from kerbline.session import local_session

HEADLINE = [
    "conversation_prompts",
    "labels_two_separators",
    "batches_by_modality",
    "region_requests",
    "records_generated",
    "boxes_frame_iou",
    "goal_fallback_chain",
    "image_tile_manifest",
    "depth_mask_nearer",
    "cell_cost_adaptive_radius",
    "path_planned_results",
    "mask_final_regions",
    "mask_box_share",
    "evaluation_averages",
    "evaluation_running_means",
    "rouge_two_words",
    "rouge_longest_sequence",
    "vector_token_scores",
    "answers_normalised",
    "reading_soft_scores",
    "choice_accuracy",
    "review_summary",
    "questions_chunked",
    "stream_daily_log",
    "silent_gaps",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = list(QUERIES) if sys.argv[1:] == ["all"] else sys.argv[1:] or HEADLINE
    spark = local_session(console=False, app="kerbline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start-up is not measured
    times: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    if len(names) > len(HEADLINE):
        for name, t in sorted(times.items(), key=lambda kv: -kv[1])[:40]:
            print(f"{t:8.2f} {name}", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
